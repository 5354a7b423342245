"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds to them.

Tokens are runs of letters, digits and ``+/_-.``. Each gets features of its own shape and first letters, of the neighbouring words (hashed)
and what stands between them, of its line and of the whole file; the field gives every token one of the labels begin, inside, outside.
Training is by numpy: stochastic gradient steps on the exact log likelihood (forward-backward over windows of ``WINDOW`` tokens).

Decoding is exact Viterbi over whole texts without walking them: where a token's outside score leads by more than any two transitions
can make up for, every best path is outside there, so only the short stretches between such tokens are decoded.

The field is fitted on a bounded sample: at most ``SAMPLE`` texts of at most ``LONGEST`` bytes, in order of a hash of the id, with secrets in
the formats of ``FORMATS``, most of which no pattern has, and look-alikes (``INNOCENT``) set into them at random (seeded), and the patterns' own
matches as further examples. All else runs over all rows and whole texts. Spans of the field that overlap a pattern's span, or have
fewer than ``LEAST_CHARS`` characters (as many as the patterns ask for), are left out; pattern spans always stay.

Defined cases: null and empty texts have no span; repeated rows give the same spans; an empty table gives no row (and a
field that was fitted on nothing finds nothing); ids are only carried along; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formgrain.llm.common import LOWER, blocks, prefix_hash, prepare, range_hash, spaced, table, utf8

SAMPLE = 400
LONGEST = 16_000
WINDOW = 24
EPOCHS = 6
LEAST_CHARS = 8  # a span of the field has at least so many characters
BUCKETS = 512  # of a neighbouring word

#: Fixed patterns and the least length that a match needs.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = "password", "passwd", "secret", "token", "apikey", "api_key"
KINDS = "assign", "access", "hex", "crf"

#: Words that tend to stand before a secret.
TRIGGERS = "password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "auth", "bearer", "credential", "credentials", "access", "private"


def pattern_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping within a kind."""
    out = []
    low = text.lower()
    if any(x in low for x in KEYWORDS):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1])))


# ------------------------------------------------------------------------------------------- features

_LOWER, _UPPER, _DIGIT, _SYMBOL, _OTHER = 1, 2, 4, 8, 16
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = _LOWER, _UPPER, _DIGIT, _OTHER
_CLASS[[ord(x) for x in "+/_-."]] = _SYMBOL
_HEX = np.zeros(256, bool)
_HEX[[ord(x) for x in "0123456789abcdef"]] = True
_STEPS = np.array([1, 2, 3, 5, 9, 16, 20, 24, 32, 40, 64])
_SHARES = np.array([0.001, 0.1, 0.25, 0.5, 0.75, 0.999])
#: Features of one token: name and number of values.
FIELDS = {
    "length": 12, "classes": 32, "changes": 7, "digits": 7, "hex": 2, "own": 2, "before": 4, "gap": 8, "after": 3, "left": 12, "right": 12, "file": 8, "long_changes": 49,
    "word_before": BUCKETS, "word_two_before": BUCKETS, "word_after": BUCKETS, "letters": BUCKETS, "line": 32,
}
_AT = np.cumsum([0, *FIELDS.values()])
N_FEATURES = int(_AT[-1])
B, I, O = 0, 1, 2


class Tokens:
    """Tokens of a block: byte range, text, and one feature of each field."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, a: int, b: int):
        self.bytes, self.starts, self.ends = spaced(raw, offsets, a, b)
        kinds = _CLASS[self.bytes]
        inside = kinds > 0
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        at, to = edge[0::2], edge[1::2]
        self.at, self.to = at, to
        self.first, self.last = np.searchsorted(at, self.starts), np.searchsorted(at, self.ends)
        n = len(at)
        self.doc = np.repeat(np.arange(len(self.starts)), self.last - self.first)
        if not n:
            self.features = np.empty((0, len(FIELDS)), np.int32)
            return
        size = to - at
        total = lambda x: (lambda c: c[to] - c[at])(np.concatenate([[0], np.cumsum(x, dtype=np.int32)]))
        has = np.zeros(n, np.int32)
        for bit in (_LOWER, _UPPER, _DIGIT, _SYMBOL, _OTHER):
            has += bit * (total(kinds == bit) > 0)
        turn = np.zeros(len(kinds), bool)
        turn[1:] = (kinds[1:] != kinds[:-1]) & inside[1:] & inside[:-1]
        changes = total(turn)
        digits = total(kinds == _DIGIT)
        length = np.searchsorted(_STEPS, size, "right")
        change = np.searchsorted([1, 2, 3, 5, 8, 13], changes, "right")
        marks = range_hash(prefix_hash(LOWER[self.bytes]), at, to)
        own = np.isin(marks, _trigger_hashes())
        start, end = np.zeros(n, bool), np.zeros(n, bool)
        start[self.first[self.first < self.last]] = True
        end[self.last[self.first < self.last] - 1] = True
        shift = lambda x, k, none: np.concatenate([np.full(min(k, n), none, x.dtype), x[: n - k]]) if k > 0 else np.concatenate([x[-k:], np.full(min(-k, n), none, x.dtype)])
        one = np.where(start, False, shift(own, 1, False))
        two = np.where(start | shift(start, 1, True), False, shift(own, 2, False))
        sign = np.concatenate([[0], np.cumsum((self.bytes == 58) | (self.bytes == 61), dtype=np.int32)])
        quote = np.concatenate([[0], np.cumsum((self.bytes == 34) | (self.bytes == 39), dtype=np.int32)])
        gone = np.where(start, at, shift(to, 1, 0))
        gap = 4 * start + 2 * (sign[at] > sign[gone]) + (quote[at] > quote[gone])
        nxt = self.bytes[np.minimum(to, len(self.bytes) - 1)]
        after = np.where((nxt == 34) | (nxt == 39), 1, np.where((nxt == 58) | (nxt == 61), 2, 0))
        per = np.zeros((3, len(self.starts)))
        np.add.at(per[0], self.doc, own)
        np.add.at(per[1], self.doc, digits)
        np.add.at(per[2], self.doc, size)
        file = 4 * (per[0] > 0) + np.searchsorted([0.01, 0.05, 0.2], per[1] / np.maximum(per[2], 1), "right")
        # Neighbouring words by hash, 0 where there is none; the first four letters of a long token with more than letters in it.
        bucket = 1 + (marks % np.uint64(BUCKETS - 1)).astype(np.int64)
        before = np.where(start, 0, shift(bucket, 1, 0))
        two_before = np.where(start | shift(start, 1, True), 0, shift(bucket, 2, 0))
        behind = np.where(end, 0, shift(bucket, -1, 0))
        four = np.zeros(n, np.int64)
        for i in range(4):
            four = four * 257 + self.bytes[np.minimum(at + i, len(self.bytes) - 1)]
        letters = np.where((size >= 16) & (has & (_DIGIT | _SYMBOL) > 0), 1 + four % (BUCKETS - 1), 0)
        # The line: its length, whether it has a sign, how many tokens stand on it, whether this is the first.
        breaks = np.flatnonzero(self.bytes == 10)
        line = np.searchsorted(breaks, at)
        line_end = np.append(breaks, len(self.bytes))[line]
        line_start = np.append(-1, breaks)[line] + 1
        leads = np.append(True, line[1:] != line[:-1])
        alone = np.bincount(line)[line] <= 3
        of_line = 8 * np.searchsorted([40, 100, 400], line_end - line_start, "right") + 4 * (sign[line_end] > sign[line_start]) + 2 * leads + alone
        fields = [
            length, has, change, np.searchsorted(_SHARES, digits / size, "right"), (total(_HEX[self.bytes]) == size).astype(int), own.astype(int), one + 2 * two, gap, after,
            np.where(start, 0, shift(length, 1, 0)), np.where(end, 0, shift(length, -1, 0)), file[self.doc], np.minimum(length // 2, 6) * 7 + change,
            before, two_before, behind, letters, of_line,
        ]
        self.features = np.stack([f + base for f, base in zip(fields, _AT)], axis=1).astype(np.int32)


def _trigger_hashes() -> np.ndarray:
    data = " ".join(TRIGGERS).encode()
    low = np.frombuffer(data + b" ", np.uint8)
    gaps = np.flatnonzero(low == 32)
    return range_hash(prefix_hash(low), np.concatenate([[0], gaps[:-1] + 1]), gaps)


# ------------------------------------------------------------------------------------------- the field


def train_windows(features: np.ndarray, labels: np.ndarray, mask: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Weights (feature, label) and transitions from windows: features (n, WINDOW, fields), labels and mask (n, WINDOW)."""
    rng = np.random.default_rng(seed)
    weights, turns = np.zeros((N_FEATURES + 1, 3)), np.zeros((3, 3))
    sums_w, sums_t = np.full(weights.shape, 1e-2), np.full(turns.shape, 1e-2)
    eye = np.eye(3)
    for _ in range(epochs):
        order = rng.permutation(len(features))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            f, y, m = features[pick], labels[pick], mask[pick]
            emit = weights[f].sum(axis=2)
            n, length = y.shape
            alpha, beta = np.zeros((length, n, 3)), np.zeros((length, n, 3))
            alpha[0] = emit[:, 0]
            for t in range(1, length):
                step = np.logaddexp.reduce(alpha[t - 1][:, :, None] + turns[None], axis=1) + emit[:, t]
                alpha[t] = np.where(m[:, t, None], step, alpha[t - 1])
            for t in range(length - 2, -1, -1):
                step = np.logaddexp.reduce(turns[None] + (emit[:, t + 1] + beta[t + 1])[:, None, :], axis=2)
                beta[t] = np.where(m[:, t + 1, None], step, beta[t + 1])
            z = np.logaddexp.reduce(alpha[-1], axis=1)
            node = np.exp(alpha + beta - z[None, :, None]).transpose(1, 0, 2) * m[:, :, None]
            grad = (node - eye[y] * m[:, :, None]) / n
            g_w = np.zeros_like(weights)
            np.add.at(g_w, f.reshape(-1, f.shape[2]), np.repeat(grad.reshape(-1, 1, 3), f.shape[2], axis=1))
            g_t = np.zeros((3, 3))
            for t in range(1, length):
                pair = np.exp(alpha[t - 1][:, :, None] + turns[None] + (emit[:, t] + beta[t])[:, None, :] - z[:, None, None]) * m[:, t, None, None]
                g_t += (pair.sum(axis=0) - np.einsum("na,nb->ab", eye[y[:, t - 1]] * m[:, t, None], eye[y[:, t]])) / n
            g_w += 1e-5 * weights
            g_t += 1e-3 * turns
            sums_w += g_w**2
            sums_t += g_t**2
            weights -= 0.3 * g_w / np.sqrt(sums_w)
            turns -= 0.1 * g_t / np.sqrt(sums_t)
    weights[N_FEATURES] = 0
    return weights, turns


def viterbi(emit: np.ndarray, turns: np.ndarray) -> list[int]:
    """Best labels of a stretch that stands between outside tokens."""
    score = emit[0] + turns[O]
    back = []
    for row in emit[1:]:
        step = score[:, None] + turns
        back.append(step.argmax(axis=0))
        score = step.max(axis=0) + row
    path = [int((score + turns[:, O]).argmax())]
    for row in reversed(back):
        path.append(int(row[path[-1]]))
    return path[::-1]


def decode(tokens: Tokens, weights: np.ndarray, turns: np.ndarray) -> np.ndarray:
    """The best label of every token (a text stands between outside tokens)."""
    labels = np.full(len(tokens.at), O)
    if not len(labels):
        return labels
    emit = weights[tokens.features[:, 0]].copy()
    for j in range(1, tokens.features.shape[1]):
        emit += weights[tokens.features[:, j]]
    open_ = emit[:, O] - emit[:, :2].max(axis=1) <= 2 * (turns.max() - turns.min())
    at = np.flatnonzero(open_)
    if not len(at):
        return labels
    cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(tokens.doc[at]) > 0)) + 1
    for part in np.split(at, cut):
        labels[part] = viterbi(emit[part], turns)
    return labels


def field_spans(tokens: Tokens, labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, first byte, last byte + 1) of each run begin, inside, inside, ..."""
    out: list[list[int]] = []
    for i in np.flatnonzero(labels != O).tolist():
        doc = int(tokens.doc[i])
        if labels[i] == I and out and out[-1][3] == i - 1 and out[-1][0] == doc:
            out[-1][2:] = [int(tokens.to[i]), i]
        else:
            out.append([doc, int(tokens.at[i]), int(tokens.to[i]), i])
    return [(d, a - int(tokens.starts[d]), b - int(tokens.starts[d])) for d, a, b, _ in out]


# ------------------------------------------------------------------------------------------- training set


_LETTERS, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_MIXED = _LETTERS + _LETTERS.upper() + _DIGITS


def _pick(rng: np.random.Generator, letters: str, low: int, high: int = 0) -> str:
    n = int(rng.integers(low, high)) if high else low
    return "".join(letters[i] for i in rng.integers(0, len(letters), n))


#: Formats of secrets that are set into training texts; ``word`` and ``pair`` only after a word that announces them.
FORMATS = {
    "hex": lambda r: _pick(r, _DIGITS + "abcdef", int(r.choice([24, 32, 40, 64]))),
    "base64": lambda r: _pick(r, _MIXED + "+/", 20, 64),
    "prefixed": lambda r: f"{_pick(r, _LETTERS, 2, 5)}_{_pick(r, _MIXED, 20, 40)}",
    "live": lambda r: f"{_pick(r, _LETTERS, 2)}_{_pick(r, _LETTERS, 4)}_{_pick(r, _MIXED, 16, 32)}",
    "upper": lambda r: _pick(r, _LETTERS.upper() + _DIGITS, 16, 24),
    "uuid": lambda r: "-".join(_pick(r, _DIGITS + "abcdef", n) for n in (8, 4, 4, 4, 12)),
    "signed": lambda r: ".".join(["eyJ" + _pick(r, _MIXED + "_-", 16, 40), _pick(r, _MIXED + "_-", 20, 80), _pick(r, _MIXED + "_-", 20, 44)]),
    "dashed": lambda r: "-".join([_pick(r, _LETTERS, 4), _pick(r, _DIGITS, 10, 13), _pick(r, _MIXED, 20, 28)]),
    "mixed": lambda r: _pick(r, _MIXED, 24, 48),
    "block": lambda r: "\n".join(_pick(r, _MIXED + "+/", 64) for _ in range(int(r.integers(2, 6)))),
    "word": lambda r: _pick(r, _LETTERS, 3, 6) + _pick(r, _DIGITS, 2, 4) + _pick(r, _LETTERS.upper() + _DIGITS, 4, 8),
    "pair": lambda r: _pick(r, _LETTERS.upper(), 1) + _pick(r, _LETTERS, 3, 6) + "_" + _pick(r, _MIXED, 6, 10),
}
#: Ordinary things that look a little like secrets.
INNOCENT = [
    lambda r: f"{r.integers(1990, 2030)}-{r.integers(10, 13)}-{r.integers(10, 29)}", lambda r: ".".join(str(x) for x in r.integers(1, 255, 4)), lambda r: _pick(r, _DIGITS, 8, 20),
    lambda r: f"v{r.integers(0, 9)}.{r.integers(0, 40)}.{r.integers(0, 9)}-rc{r.integers(1, 9)}", lambda r: f"{_pick(r, _LETTERS, 4, 9)}_{_pick(r, _LETTERS, 4, 9)}", lambda r: _pick(r, _LETTERS, 4, 8).title() + _pick(r, _LETTERS, 4, 8).title(),
    lambda r: "/".join(_pick(r, _LETTERS, 3, 9) for _ in range(int(r.integers(2, 5)))) + ".txt", lambda r: f"https://{_pick(r, _LETTERS, 5, 9)}.com/{_pick(r, _LETTERS, 3, 9)}/{r.integers(1, 9999)}", lambda r: f"{_pick(r, _LETTERS, 4, 9)}.{r.integers(1, 99)}@mail{r.integers(1, 9)}.example.com",
    lambda r: f"+{r.integers(1, 99)} ({_pick(r, _DIGITS, 3)}) {_pick(r, _DIGITS, 3)}-{_pick(r, _DIGITS, 4)}", lambda r: _pick(r, _LETTERS, 16, 40), lambda r: f"{_pick(r, _LETTERS.upper(), 3, 5)}-{r.integers(1, 99999)}", lambda r: "-" * int(r.integers(8, 40)), lambda r: "-".join(_pick(r, _LETTERS, 3, 8) for _ in range(int(r.integers(3, 6)))),
]
_SHORT = "word", "pair"
_FORMS = '{name} = "{secret}"', "{name}: {secret}", "{name}={secret}", "{name} {secret}", "<{name}>{secret}</{name}>", "Authorization: Bearer {secret}", "https://user:{secret}@example.com/", "{secret}", "\n{secret}\n"


def training_windows(texts: list[str], seed: int = 5, formats: dict = FORMATS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows around secrets, set in or found by the patterns, around look-alikes, and some without either."""
    rng = np.random.default_rng(seed)
    rows, names = [], list(formats)
    for text in texts:
        words = text.split(" ")
        for _ in range(int(rng.integers(0, 4))):
            kind = names[int(rng.integers(0, len(names)))]
            secret, name = formats[kind](rng), str(rng.choice(TRIGGERS))
            form = _FORMS[int(rng.integers(0, len(_FORMS) - 2 * (kind in _SHORT)))]
            if rng.random() < 0.3:
                name = name.upper() if rng.random() < 0.5 else f"{_pick(rng, _LETTERS, 2, 6)}_{name}"
            rows.append((words, form.format(name=name, secret=secret), secret))
        rows.append((words, INNOCENT[int(rng.integers(0, len(INNOCENT)))](rng), None))
    found = []
    for words, put, secret in rows:
        at = int(rng.integers(0, len(words) + 1))
        near = int(rng.integers(0, len(words) + 1))
        other = INNOCENT[int(rng.integers(0, len(INNOCENT)))](rng)
        some = [*words[:at], put, *words[at:]]
        text = " ".join([*some[:near], other, *some[near:]])
        found += _windows(text, secret, [other] if secret else [other, put], rng)
    if not found:
        return np.empty((0, WINDOW, len(FIELDS)), np.int32), np.empty((0, WINDOW), np.int64), np.empty((0, WINDOW), bool)
    return tuple(np.stack(x) for x in zip(*found))


def _windows(text: str, secret: str | None, innocent: list[str], rng: np.random.Generator) -> list[tuple]:
    data = text.encode()
    tokens = Tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]), 0, 1)
    n = len(tokens.at)
    labels, known = np.full(n, O), np.zeros(n, bool)

    def inside(s: int, e: int) -> tuple[int, int]:
        return int(np.searchsorted(tokens.to, s, "right")), int(np.searchsorted(tokens.at, e))

    spans = [(len(text[:s].encode()), len(text[:e].encode())) for s, k, e in pattern_spans(text) if k != "assign"]
    spans += [(m.start(2), m.end(2)) for m in re.finditer(ASSIGN.pattern.encode(), data, re.I) if len(m[2]) >= 8]
    if secret and (at := data.find(secret.encode())) >= 0:
        spans.append((at, at + len(secret)))
    for s, e in sorted(set(spans)):
        i, j = inside(s, e)
        if j > i and e - s >= LEAST_CHARS:
            labels[i], labels[i + 1 : j] = B, I
    marked = [np.flatnonzero(labels == B)[:6]]
    for x in innocent:
        i, j = inside(at := max(0, data.find(x.encode())), at + len(x.encode()))
        known[i:j] = True
        marked.append(np.arange(i, min(j, i + 1)))
    # What looks like a secret but isn't known to be one teaches nothing: windows with it are left out.
    code = tokens.features[:, 1] - _AT[1] if n else np.empty(0, int)
    doubtful = np.flatnonzero((labels == O) & ~known & (tokens.to - tokens.at >= 20) & (code & _DIGIT > 0) & (code & (_LOWER | _UPPER) > 0))
    starts = [max(0, int(i) - int(rng.integers(2, WINDOW - 6))) for i in np.concatenate(marked)]
    starts += [int(x) for x in rng.integers(0, max(1, n - WINDOW), 2)]
    found = []
    for at in starts:
        f, y = tokens.features[at : at + WINDOW], labels[at : at + WINDOW]
        if len(f) and not ((doubtful >= at) & (doubtful < at + WINDOW)).any():
            pad = WINDOW - len(f)
            found.append((np.pad(f, ((0, pad), (0, 0)), constant_values=N_FEATURES), np.pad(y, (0, pad), constant_values=O), np.arange(WINDOW) < len(f)))
    return found


def fit(texts: list[str], formats: dict = FORMATS) -> tuple[np.ndarray, np.ndarray]:
    features, labels, mask = training_windows(texts, formats=formats)
    if not len(features):
        none = np.zeros((N_FEATURES + 1, 3))
        none[:, O] = 1.0
        return none, np.zeros((3, 3))
    return train_windows(features, labels, mask)


# ------------------------------------------------------------------------------------------- the operator


def scan_texts(column: pa.Array, model: tuple[np.ndarray, np.ndarray]) -> list[list[tuple[int, str, int]]]:
    """All spans of each text, in code points, by start and kind."""
    raw, offsets = utf8(column)
    out: list[list[tuple[int, str, int]]] = []
    for a, b in blocks(offsets):
        tokens = Tokens(raw, offsets, a, b)
        extra: dict[int, list[tuple[int, int]]] = {}
        for doc, s, e in field_spans(tokens, decode(tokens, *model)):
            extra.setdefault(doc, []).append((s, e))
        hexes = np.zeros(len(tokens.bytes) + 1, np.int8)
        hexes[1:] = _HEX[tokens.bytes]
        edge = np.flatnonzero(np.diff(hexes, append=0))
        long_ = edge[0::2][edge[1::2] - edge[0::2] >= 32] if len(edge) else edge
        hot = set(np.searchsorted(tokens.starts, long_, "right") - 1)
        for i in range(b - a):
            data = raw[offsets[a + i] : offsets[a + i + 1]].tobytes()
            low = data.lower()
            if i not in hot and i not in extra and b"AKIA" not in data and not any(x.encode() in low for x in KEYWORDS):
                out.append([])
                continue
            text = data.decode()
            spans = pattern_spans(text)
            for s, e in extra.get(i, ()):
                if not text.isascii():
                    s, e = len(data[:s].decode()), len(data[:e].decode())
                if e - s >= LEAST_CHARS and all(e <= x or s >= y for x, _, y in spans):
                    spans.append((s, "crf", e))
            out.append(sorted(spans, key=lambda x: (x[0], KINDS.index(x[1]))))
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and its spans as array<struct<kind, start, end>>."""
    spark = docs.sparkSession
    prepare(spark)
    some = docs.where(F.octet_length(text_col) <= LONGEST).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    picks = F.broadcast(some.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(SAMPLE))  # SAMPLE rows
    texts = some.join(picks, "id").orderBy(F.xxhash64("id"), "id", "text").limit(2 * SAMPLE).toPandas()["text"]
    model = spark.sparkContext.broadcast(fit(list(texts)))
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for batch in batches:
            rows = [[{"kind": k, "start": s, "end": e} for s, k, e in spans] for spans in scan_texts(batch.column(1), model.value)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(span))], ["doc_id", "spans"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, spans array<struct<kind string, start long, end long>>")


def op5_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = text(F.filter("spans", lambda x: x["kind"] != "crf"))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), count("crf").alias("n_crf"))


def secret_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op5_secret_crf`` that SQL can express."""
    return op5_secret_crf(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


MORE = {"secret_patterns": secret_patterns}

_ANY_CASE = "|".join("".join(f"[{x}{x.upper()}]" if x.isalpha() else x for x in word) for word in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
_PATTERNS = {"assign": (rf"""({_ANY_CASE})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8), "access": ("(AKIA[A-Z0-9]+)", 1, 16), "hex": ("([0-9a-f]+)", 1, 32)}

ORACLE = {
    "secret_patterns": "WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),\nm AS ("
    + "\nUNION ALL ".join(
        f"SELECT doc_id, {i} AS rank, '{kind}' AS kind, {least} AS least, regexp_split_to_array(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}', 0) AS found, regexp_extract_all(text, '{pattern}', {group}) AS own FROM t"
        for i, (kind, (pattern, group, least)) in enumerate(_PATTERNS.items())
    )
    + """),
s AS (SELECT doc_id, rank, kind, least, own[i] AS own, length(found[i]) AS size, list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM m)),
k AS (SELECT * FROM s WHERE length(own) >= least)
SELECT t.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, rank), '')) AS base_sha256
FROM t LEFT JOIN k ON t.doc_id = k.doc_id GROUP BY t.doc_id""",
}
