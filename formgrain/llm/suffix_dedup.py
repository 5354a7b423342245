"""Suffix-array dedup: every byte covered by a string of ``WIDTH`` bytes that also starts elsewhere goes.

Where equal strings can be, without moving the corpus: each window of ``WIDTH`` bytes is known by the smallest hash of its
``GRAM``-byte pieces, so equal windows carry equal keys. A run of windows with one key is a fragment, one row of a few numbers.
Only keys that occur again (or repeat within their fragment) matter further. Equal fragments are collapsed into classes
first, so a passage in any number of documents is one class with a count; bytes are fetched for one member of each class, and only
where a key has several classes or repeats inside one. A class of several members needs no sort to know that all its windows recur.

The classes of a key are then sorted in one task by two-stage suffix sorting: suffixes smaller than their successor are sorted
directly, all others are induced from them by one scan over the buckets of first bytes. The common prefixes of neighbours in the
suffix array are counted in their bytes, and those of ``WIDTH`` bytes mark duplicates. Windows have the key of their content, so equal
windows always meet. One array holds at most ``KEY_BYTES`` of a key: the classes of a key with more are cut by a further key of the same
kind (another hash of the pieces), collapsed and sorted in the same way, and again until all fit; after ``LEVELS`` cuts the key is the
window itself, which leaves nothing to sort.

Defined cases: null texts are empty; texts shorter than ``WIDTH`` bytes keep everything; very long texts are read in overlapping
parts; overlapping repeats count, as in a long run of one word; rows that repeat a document are duplicates of each other and each come
out; null ids are carried along; an empty table gives no row; other columns are not read. Rows are told apart by 128 bits of id and text,
fragments by their length and two 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formgrain.llm.common import blocks, give_back, materialise, mix, prefix_hash, prepare, range_hash, signed, spaced, table, utf8

WIDTH = 200
GRAM = 32
#: Bytes of one suffix array, and of one key in it: about 140 bytes of arrays go with each.
ARRAY_BYTES = KEY_BYTES = 3 << 19
#: Cuts by pieces that a key's classes may go through.
LEVELS = 12
#: Text bytes in which fragments are found at once: about a hundred bytes of arrays go with each.
FIND_BYTES = 1 << 19
_PLACE = 28  # bits of a position in a block


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of each window, from running minima of blocks of the window's width."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def find_fragments(text: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int = WIDTH, gram: int = GRAM, level: int = 0):
    """Runs of windows with one key: (document, first byte, windows, key, hash of all its bytes, whether the key repeats in it).

    Each ``level`` has another hash of the pieces; with pieces as long as a window the key is that of the whole window.
    """
    none = np.empty(0, np.int64)
    if len(text) < width + 1:
        return none, none, none, none, none, none.astype(bool)
    sums = prefix_hash(text)
    at = np.arange(len(text) - gram + 1)
    h = range_hash(sums, at, at + gram)
    if level:
        h = mix(h ^ np.uint64(level * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    high = h >> np.uint64(_PLACE) << np.uint64(_PLACE)
    mask = np.uint64((1 << _PLACE) - 1)
    span = width - gram + 1
    left = (sliding_min(high | at.astype(np.uint64), span) & mask).astype(np.int64)
    right = ((sliding_min(high | (mask - at.astype(np.uint64)), span) & mask) ^ mask).astype(np.int64)
    key = h[left]
    n = len(left)  # windows of the block; those that cross texts are left out
    doc = np.searchsorted(starts, np.arange(n), "right") - 1 if len(starts) > 1 else np.zeros(n, np.int64)
    valid = np.arange(n) + width <= ends[doc]
    cut = np.ones(n, bool)
    cut[1:] = (key[1:] != key[:-1]) | ~valid[:-1]
    first = np.flatnonzero(cut & valid)
    if not len(first):
        return none, none, none, none, none, none.astype(bool)
    edge = np.flatnonzero(cut | ~valid)
    after = np.searchsorted(edge, first, "right")
    stop = np.where(after < len(edge), edge[np.minimum(after, len(edge) - 1)], n)
    repeats = np.concatenate([[0], np.cumsum(left != right)])
    moved = np.concatenate([[0], np.cumsum(np.concatenate([[False], left[1:] != left[:-1]]))])
    twice = (repeats[stop] > repeats[first]) | (moved[stop] > moved[np.minimum(first + 1, n)])
    return doc[first], first - starts[doc[first]], stop - first, signed(key[first]), signed(range_hash(sums, first, stop + width - 1)), twice


def suffix_array(text: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Two-stage sort of the suffixes of ``text`` (symbols, 0 between fragments).

    ``same``: a hash of what is compared of each suffix; suffixes with equal ones may stand in any order.
    """
    n = len(text)
    place = np.where(np.append(text[:-1] != text[1:], True), np.arange(n), n - 1)
    differs = np.minimum.accumulate(place[::-1])[::-1]
    small = np.append(text, 0)[differs + 1] > text[differs]  # smaller than its successor
    small[differs == n - 1] = True

    # First stage: direct sort of these, one of each class, seven symbols at a time.
    wide = np.append(text, np.zeros(512, text.dtype)).astype(np.uint64)
    words = np.zeros(n + 256, np.uint64)
    for j in range(7):
        words |= wide[j : n + 256 + j] << np.uint64(9 * (6 - j))
    own = np.flatnonzero(small)
    _, pick, inverse = np.unique(same[own], return_index=True, return_inverse=True)
    rep = own[pick]
    order = np.argsort(words[rep], kind="stable")
    new = np.append(True, words[rep[order]][1:] != words[rep[order]][:-1])
    depth = 7
    while depth < WIDTH + 7:
        tied = np.flatnonzero(~new | ~np.append(new[1:], True))
        if not len(tied):
            break
        group = np.cumsum(new)[tied]
        word = words[np.minimum(rep[order[tied]] + depth, n + 255)]
        inner = np.lexsort((word, group))
        order[tied] = order[tied][inner]
        group, word = group[inner], word[inner]
        new[tied] = np.append(True, (group[1:] != group[:-1]) | (word[1:] != word[:-1]))
        depth += 7
    rank = np.empty(len(rep), np.int64)
    rank[order] = np.arange(len(rep))
    sorted_small = own[np.argsort(rank[inverse.ravel()], kind="stable")]

    # Second stage: a scan over the buckets puts each other suffix behind those already in its bucket.
    symbols = text[sorted_small]
    present = np.unique(text)
    first, last = np.searchsorted(symbols, present), np.searchsorted(symbols, present, "right")
    waiting: dict[int, list[np.ndarray]] = {int(c): [] for c in present}
    out = []

    def scan(chunk: np.ndarray) -> None:
        out.append(chunk)
        before = chunk[chunk > 0] - 1
        before = before[~small[before]]
        if len(before):
            symbol = text[before]
            by = np.argsort(symbol, kind="stable")
            before, symbol = before[by], symbol[by]
            for part in np.split(before, np.flatnonzero(symbol[1:] != symbol[:-1]) + 1):
                waiting[int(text[part[0]])].append(part)

    for c, a, b in zip(present.tolist(), first, last):
        while waiting[c]:
            chunk = np.concatenate(waiting[c])
            waiting[c] = []
            scan(chunk)
        if b > a:
            scan(sorted_small[a:b])
    return np.concatenate(out)


def common_prefix(raw: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Bytes that agree from places ``a`` and ``b`` on, up to ``most``; eight at a time, and only for pairs that agree so far."""
    wide = np.lib.stride_tricks.as_strided(np.append(raw, np.zeros(most + 8, np.uint8)), (len(raw) + most, 8), (1, 1)).view("<u8")[:, 0]
    out, todo = np.zeros(len(a), np.int64), np.arange(len(a))
    for at in range(0, most, 8):
        apart = wide[a[todo] + at] ^ wide[b[todo] + at]
        end = np.flatnonzero(apart)
        low = apart[end] & (~apart[end] + np.uint64(1))  # the lowest bit that differs tells the first byte that does
        out[todo[end]] = at + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        todo = todo[apart == 0]
    out[todo] = most
    return np.minimum(out, most)


def repeated_windows(fragments: list[bytes], runs: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """For each fragment, which of its windows also start elsewhere among the fragments."""
    sizes = np.array([len(x) for x in fragments])
    at = np.cumsum(sizes + 1) - sizes - 1
    raw = np.frombuffer(b"\0".join(fragments) + b"\0", np.uint8)
    text = raw.astype(np.uint16) + np.uint16(1)
    text[at + sizes] = 0
    ends = np.repeat(at + sizes, sizes + 1)
    here = np.arange(len(raw))
    stop = np.minimum(here + width, ends)
    same = range_hash(prefix_hash(raw), here, stop)
    short = stop - here < width
    same[short] = mix(same[short] + (stop - here)[short].astype(np.uint64))
    valid = here - np.repeat(at, sizes + 1) < np.repeat(runs, sizes + 1)
    array = suffix_array(text, same)
    a, b = array[:-1], array[1:]
    both = np.flatnonzero(valid[a] & valid[b])
    long_ = both[common_prefix(raw, a[both], b[both], width) >= width]
    marked = np.zeros(len(raw), bool)
    marked[a[long_]] = True
    marked[b[long_]] = True
    return [marked[s : s + r] for s, r in zip(at, runs)]


def spans_of(marked: np.ndarray) -> tuple[list[int], list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    return edge[0::2].tolist(), edge[1::2].tolist()


_MARKS = "key long, print long, run int, starts array<int>, ends array<int>"


def _marks_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in _MARKS.split(", ")])


def _sorted_marks(batches):
    """Rows (key, print, run, copies, bytes) with the classes of a key together -> the recurring windows of each class."""
    held: list[tuple] = []  # whole keys
    own: list[tuple] = []  # the key that is being read

    def size(rows: list[tuple]) -> int:
        return sum(len(x[4]) for x in rows)

    def done(rows: list[tuple]):
        marks = repeated_windows([x[4] for x in rows], np.array([x[2] for x in rows]))
        return _marks_batch([(k, p, r, *(([0], [r]) if copies > 1 else spans_of(m))) for (k, p, r, copies, _), m in zip(rows, marks)])

    total = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if own and row[0] != own[0][0]:
                if held and total + size(own) > ARRAY_BYTES:
                    yield done(held)
                    held, total = [], 0
                held += own
                total += size(own)
                own = []
            own.append(row)
    if held and total + size(own) > ARRAY_BYTES:
        yield done(held)
        held = []
    if held or own:
        yield done(held + own)
    give_back()


def solve(data: DataFrame, level: int = 1, most: int = KEY_BYTES, levels: int = LEVELS) -> DataFrame:
    """Classes (key, print, run, copies, bytes) -> the recurring windows of each that has some, whatever the bytes of a key."""
    sizes = data.groupBy("key").agg(F.sum(F.octet_length("bytes")).alias("size")).where(F.col("size") > most).select("key")
    large = materialise(sizes, "large")
    if level > levels + 1 or large.isEmpty():
        return data.repartition("key").sortWithinPartitions("key", "print", "run").mapInArrow(_sorted_marks, _MARKS)
    fits = data.join(large, "key", "left_anti")
    marks = fits.repartition("key").sortWithinPartitions("key", "print", "run").mapInArrow(_sorted_marks, _MARKS)

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                key, mark, run, copies, data = (batch.column(j)[i].as_py() for j in range(5))
                for a in range(0, run, FIND_BYTES):
                    raw = np.frombuffer(data, np.uint8)[a : a + FIND_BYTES + WIDTH - 1]
                    text = np.append(raw, np.uint8(10))
                    _, at, runs, keys, prints, _ = find_fragments(text, np.array([0]), np.array([len(raw)]), gram=GRAM if level <= levels else WIDTH, level=level)
                    keys = signed(mix(keys.view(np.uint64) + np.uint64(key & (1 << 64) - 1)))
                    full = lambda x, t, n=len(at): pa.array(np.full(n, x), t)
                    pieces = [raw[x : x + r + WIDTH - 1].tobytes() for x, r in zip(at.tolist(), runs.tolist())]
                    yield pa.RecordBatch.from_arrays([full(key, pa.int64()), full(mark, pa.int64()), full(run, pa.int32()), full(copies, pa.int64()), pa.array(a + at, pa.int32()), pa.array(keys), pa.array(prints), pa.array(runs, pa.int32()), pa.array(pieces, pa.binary())], ["key", "print", "run", "copies", "at", "key2", "print2", "run2", "bytes"])

    parts = materialise(data.join(large, "key", "left_semi").select("key", "print", "run", "copies", "bytes").mapInArrow(cut, "key long, print long, run int, copies long, at int, key2 long, print2 long, run2 int, bytes binary"), "cut")
    classes = parts.groupBy(F.col("key2").alias("key"), F.col("print2").alias("print"), F.col("run2").alias("run")).agg(F.sum("copies").alias("copies"), F.first("bytes").alias("bytes"))
    inner = solve(materialise(classes, "classes"), level + 1, most, levels).where(F.size("starts") > 0).select(F.col("key").alias("key2"), F.col("print").alias("print2"), F.col("run").alias("run2"), "starts", "ends")
    moved = parts.drop("bytes").join(inner, ["key2", "print2", "run2"]).select("key", "print", "run", *[F.transform(c, lambda x: x + F.col("at")).alias(c) for c in ("starts", "ends")])
    joined = moved.groupBy("key", "print", "run").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends")])  # at most a window's place each
    return marks.unionByName(joined)


_UID = "uid struct<a: long, b: long>"


def recurring(docs: DataFrame) -> DataFrame:
    """(uid, text) -> (uid, spans): for each text the ranges of window starts that recur, as array<struct<at, starts, ends>>."""

    def fragments(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for a, b in blocks(offsets, FIND_BYTES):
                text, starts, ends = spaced(raw, offsets, a, b)
                step = len(text) if b > a + 1 else FIND_BYTES  # a long text in parts, which overlap by all but one byte of a window
                for s in range(0, max(1, len(text) - WIDTH), step):
                    part = text[s : s + step + WIDTH - 1]
                    doc, at, run, key, mark, twice = find_fragments(part, starts, ends) if step == len(text) else find_fragments(np.append(part, np.uint8(10)), np.array([0]), np.array([min(len(part), int(ends[0]) - s)]))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + a)), pa.array(at + s, pa.int32()), pa.array(run, pa.int32()), pa.array(key), pa.array(mark), pa.array(twice)], ["uid", "at", "run", "key", "print", "twice"])
        give_back()

    spots = materialise(docs.mapInArrow(fragments, f"{_UID}, at int, run int, key long, print long, twice boolean"), "fragments")
    # Written, so that the joins with them can be split where a key is hot.
    keys = materialise(spots.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("t")).where("n > 1 or t").select("key"), "keys")
    spots = materialise(spots.join(keys, "key"), "candidates")
    classes = materialise(spots.groupBy("key", "print", "run").agg(F.count(F.lit(1)).alias("copies"), F.max("twice").alias("twice"), F.min(F.struct("uid", "at")).alias("member")), "classes")
    groups = materialise(classes.groupBy("key").agg(F.count(F.lit(1)).alias("classes"), F.max("twice").alias("t")).where("classes > 1 or t").select("key"), "groups")
    sole = classes.join(groups, "key", "left_anti").where("copies > 1").select("key", "print", "run", F.array(F.lit(0)).alias("starts"), F.array("run").alias("ends"))

    def fetch(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            rows = []
            for i, wanted in enumerate(batch.column(1).to_pylist()):
                for x in wanted:
                    at = offsets[i] + x["at"]
                    rows.append((x["key"], x["print"], x["run"], x["copies"], raw[at : at + x["run"] + WIDTH - 1].tobytes()))
            for k in range(0, len(rows), 4000):
                types = pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 4000]), types)], ["key", "print", "run", "copies", "bytes"])

    wanted = classes.join(groups, "key").select(F.col("member.uid").alias("uid"), F.struct(F.col("member.at").alias("at"), "key", "print", "run", "copies").alias("x")).groupBy("uid").agg(F.collect_list("x").alias("wanted"))
    data = materialise(docs.join(wanted, "uid").select("text", "wanted").mapInArrow(fetch, "key long, print long, run int, copies long, bytes binary"), "bytes")
    marks = materialise(solve(data).where(F.size("starts") > 0).unionByName(sole).dropDuplicates(["key", "print", "run"]), "marks")
    found = spots.join(marks, ["key", "print", "run"])
    return found.groupBy("uid").agg(F.collect_list(F.struct("at", "starts", "ends")).alias("spans"))


def removed_ranges(spans: list[dict] | None, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte ranges that the recurring windows of a text cover."""
    if not spans:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a = np.concatenate([x["at"] + np.array(x["starts"], np.int64) for x in spans])
    b = np.concatenate([x["at"] + np.array(x["ends"], np.int64) for x in spans]) + width - 1
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.append(True, a[1:] > b[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)
    return a[new], b[last]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (ranges), kept (the remaining bytes)."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("uid", F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64("text", "doc_id", F.lit(1)).alias("b")))
    spans = recurring(rows.select("uid", "text"))
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def cut(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            out = []
            for i, found in enumerate(batch.column(2).to_pylist()):
                data = raw[offsets[i] : offsets[i + 1]]
                a, b = removed_ranges(found)
                keep = np.ones(len(data) + 1, bool)
                for s, e in zip(a.tolist(), b.tolist()):
                    keep[s:e] = False
                kept = data[keep[:-1]].tobytes()
                out.append((len(data), int((b - a).sum()), len(a), hashlib.sha256(kept).hexdigest(), [{"start": s, "end": e} for s, e in zip(a.tolist(), b.tolist())], kept))
            types = pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(span), pa.binary()
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), types))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed", "kept"])

    joined = rows.join(spans, "uid", "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start long, end long>>, kept binary")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


ORACLE = {
    "op7_suffix_dedup": f"""
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h, encode(coalesce(text, '')) AS raw, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents),
w AS (SELECT doc_id, p, hash(array_slice(raw, p + 1, p + {WIDTH})) AS k FROM (SELECT doc_id, raw, unnest(range(0, n_bytes - {WIDTH} + 1)) AS p FROM d)),
m AS (SELECT doc_id, p FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
s AS (SELECT *, CASE WHEN p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {WIDTH} THEN 1 ELSE 0 END AS fresh FROM m),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS island FROM s),
r AS (SELECT doc_id, island, min(p) AS a, max(p) + {WIDTH} AS b FROM i GROUP BY ALL),
g AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
k AS (SELECT doc_id, string_agg(substr(h, 1 + 2 * before, 2 * (a - before)), '' ORDER BY a) || substr(max(h), 1 + 2 * max(b)) AS kept, sum(b - a) AS removed, count(*) AS spans FROM g JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)""",
}
