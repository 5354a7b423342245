"""Language-model scoring by prediction by partial matching.

Texts are scored in the normal form that the base score uses too: ASCII lower case, words joined by one space, one end
symbol, so that both are probabilities of the same event. The byte-context trie holds, for every context of up to ``ORDER``
bytes, how often each byte followed it in the training rows. A byte that was seen c times in the longest context gets
(c - e) / n, with n times that the context was seen and e = ``ESCAPE``; the d different bytes leave d * e / n, the estimate of an escape
(e = 1/2 is method D; 0.3 did best on rows held out at sf0.01). Otherwise that mass goes to the next shorter
context, where the bytes that the longer one has already offered are excluded and the rest is scaled up to one. Below order 0 all
bytes are alike.

Every task counts its (ORDER + 1)-grams with one sort, and one shuffle adds them up; lower orders are sums over the last bytes. All
nodes of the trie take part, however rare, so the model grows with the corpus; it lives in tables, one for each order. Only the most
frequent nodes of the highest order, at most ``NODES`` (a hash table of 32 MB), are broadcast. They settle most bytes in the pass over the
texts. All others are rows (text, gram, times), which are joined with the table of the highest order and, as far as they aren't
in it, with those of the contexts and of the next lower order, and so on: what was never seen, a small part of held-out texts.

Base score: word counts come from the same shuffle; the most frequent words, at most ``NODES``, are broadcast, the occurrences of all others
are joined with their counts, by a 64-bit hash of the word.

Defined cases: null, empty and blank texts are one end; without training rows N and V are 0 and each base term is
log10(0.1 / 0.1) = 0 while bytes are alike; repeated rows are scored and learned from as often as they occur; rows that share an id
each come out once; rows without an id are not held out; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formgrain.llm.common import BLOCK, Words, blocks, crc_mod, give_back, materialise, mix, prepare, signed, table, utf8

ORDER = 5
ESCAPE = 0.3
NODES = 1 << 20
PIECE = BLOCK // 4  # bytes of text worked on at once: each takes several numbers of 8 bytes
HELD, ROWS = 1 << 20, 1 << 17  # distinct keys that a task keeps, rows that it sends at once
END = 10
_GRAM, _WORD, _DOCS = 0, 1, 2
_TEXT = 3


def normal_form(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts in normal form, each after ``ORDER`` end symbols, and each text's range (its end included)."""
    low = words.low.copy()
    counts = words.last - words.first
    size = np.concatenate([[0], np.cumsum(words.to - words.at + 1)])
    keep_from = np.zeros(len(low) + 1, np.int8)
    keep_from[words.at] += 1
    keep_from[words.to + 1] -= 1  # a word and the white byte after it
    keep = np.cumsum(keep_from[:-1], dtype=np.int8) > 0
    low[words.to] = 32
    some = counts > 0
    low[words.to[words.last[some] - 1]] = END
    keep[words.ends[~some]] = True
    lengths = np.where(some, size[words.last] - size[words.first], 1)
    ends = np.cumsum(lengths + ORDER)
    starts = ends - lengths
    out = np.full(int(ends[-1]) if len(ends) else 0, END, np.uint8)
    at = np.ones(len(out), bool)
    at[(starts[:, None] - 1 - np.arange(ORDER)).ravel()] = False
    out[at] = low[keep]
    return out, starts, ends


def grams_of(text: np.ndarray) -> np.ndarray:
    """At each place from ORDER on, its byte (lowest) and the ORDER bytes before it."""
    wide = text.astype(np.int64)
    key = wide[ORDER:].copy()
    for j in range(1, ORDER + 1):
        key |= wide[ORDER - j : len(wide) - j] << (8 * j)
    return key


def places(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which grams belong to a text (the others stand in the end symbols before it)."""
    edge = np.zeros(n + 1, np.int8)
    edge[starts - ORDER] += 1
    np.subtract.at(edge, ends - ORDER, 1)
    return np.cumsum(edge[:-1], dtype=np.int8) > 0


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    n = np.diff(np.append(first, len(keys))) if counts is None else np.add.reduceat(counts, first)
    return keys[first], n.astype(np.int64)


def count_corpus(texts: DataFrame) -> DataFrame:
    """kind, key, n: grams, words and the number of texts; each task sends what it has added up."""

    def run(batches):
        held: dict[int, list] = {_GRAM: [], _WORD: []}
        docs = 0

        def rows(kind, most):
            """What has been added up of a kind, if it is more than ``most`` keys; else it is kept."""
            if not held[kind]:
                return
            keys, n = (np.concatenate(x) for x in zip(*held[kind]))
            held[kind] = []
            keys, n = tally(keys, n)
            if len(keys) <= most:
                held[kind] = [(keys, n)]
                return
            for k in range(0, len(keys), ROWS):
                some = keys[k : k + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind, np.int32)), pa.array(some), pa.array(n[k : k + ROWS])], ["kind", "key", "n"])

        for batch in batches:
            raw, offsets = utf8(batch.column(0))
            docs += len(offsets) - 1
            for a, b in blocks(offsets, PIECE):
                words = Words(raw, offsets, a, b)
                text, starts, ends = normal_form(words)
                keys = grams_of(text)
                held[_GRAM].append(tally(keys[places(starts, ends, len(keys))]))
                held[_WORD].append(tally(signed(words.hash)))
                for kind in held:
                    if sum(len(x[0]) for x in held[kind]) > 3 * HELD // 2:
                        yield from rows(kind, HELD)
        yield from rows(_GRAM, 0)
        yield from rows(_WORD, 0)
        yield pa.RecordBatch.from_arrays([pa.array([_DOCS], pa.int32()), pa.array([0], pa.int64()), pa.array([docs], pa.int64())], ["kind", "key", "n"])
        give_back()

    return texts.mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Lookup:
    """Numbers by 64-bit key: open addressing in arrays with three places for two keys at least. The key -1 is none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (3 * len(keys) // 2).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
        todo, at = np.arange(len(keys)), self._start(keys)
        while len(todo):
            free = np.flatnonzero(self.slots[at] == -1)
            place, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.slots[place], self.values[place] = keys[todo[put]], values[todo[put]]
            rest = np.ones(len(todo), bool)
            rest[put] = False
            todo, at = todo[rest], self._next(at[rest])

    def _start(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.int64).view(np.uint64)) >> self.shift).astype(np.int64)

    def _next(self, at: np.ndarray) -> np.ndarray:
        return (at + 1) & (len(self.slots) - 1)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and their numbers (0 for the others)."""
        at, todo = self._start(keys), np.arange(len(keys))
        hit, out = np.zeros(len(keys), bool), np.zeros(len(keys))
        while len(todo):
            there = self.slots[at]
            same = there == keys[todo]
            hit[todo[same]] = True
            out[todo[same]] = self.values[at[same]]
            on = ~same & (there != -1)
            todo, at = todo[on], self._next(at[on])
        return hit, out


def most_frequent(rows: DataFrame, value, most: int = NODES) -> tuple[Lookup, Column]:
    """Of (key, n), ``value`` of the most frequent keys, at most ``most``, and which rows are left."""
    size = F.floor(8 * F.log2("n"))
    sizes = rows.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("keys")).orderBy(F.desc("size")).collect()  # at most 8 * 64 rows
    held, least = 0, 8 * 64
    for x in sizes:
        if held + x["keys"] > most:
            break
        held, least = held + x["keys"], x["size"]
    top = rows.where(size >= least).select("key", value.alias("x")).toArrow()  # <= most rows
    return Lookup(top.column(0).to_numpy(), top.column(1).to_numpy()), size < least


def _bytes(k: int) -> int:
    return (1 << (8 * (k + 1))) - 1


def build_trie(counts: DataFrame) -> list[DataFrame]:
    """For each order k its nodes: key (the byte and the k before it), n (times seen), p, and escape (what its context leaves)."""
    grams, out = counts.where(F.col("kind") == _GRAM).select("key", "n"), []
    context = Window.partitionBy(F.shiftright("key", 8))
    for k in range(ORDER, -1, -1):
        if k < ORDER:
            grams = out[-1].groupBy(F.col("key").bitwiseAND(F.lit(_bytes(k))).alias("key")).agg(F.sum("n").alias("n"))
        seen = grams.withColumns({"total": F.sum("n").over(context), "different": F.count(F.lit(1)).over(context)})
        out.append(materialise(seen.select("key", "n", ((F.col("n") - ESCAPE) / F.col("total")).alias("p"), (ESCAPE * F.col("different") / F.col("total")).alias("escape")), f"order{k}"))
    return out[::-1]


def settle(rows: DataFrame, trie: list[DataFrame]) -> DataFrame:
    """(row, key, times) of grams of the highest order -> (row, gain): the sum of their bytes' log10 probabilities.

    ``add`` is what the contexts that didn't have a byte have added for it so far. The rows that go on from order to order are few: a
    byte of a training text is always found in the highest.
    """
    gains = []
    rows = rows.withColumn("add", F.lit(0.0))
    for k in range(len(trie) - 1, -1, -1):
        tried = materialise(rows.join(trie[k].select("key", "p"), "key", "left"), "tried")
        gains.append(tried.where("p is not null").groupBy("row").agg(F.sum(F.col("times") * F.log10("p") + F.col("add")).alias("gain")))
        missed = tried.where("p is null")
        if missed.isEmpty():
            break
        missed = missed.withColumn("context", F.shiftright("key", 8))
        asked = missed.select("context").distinct()
        nodes = trie[k].withColumn("context", F.shiftright("key", 8)).join(asked, "context", "left_semi")
        if k:
            lower = trie[k - 1].select(F.col("key").alias("low"), F.col("p").alias("lower"))
            nodes = nodes.withColumn("low", F.col("key").bitwiseAND(F.lit(_bytes(k - 1)))).join(lower, "low")
        else:
            nodes = nodes.withColumn("lower", F.lit(1 / 256))
        left = F.greatest(F.lit(1.0) - F.sum("lower"), F.lit(1e-12))
        factor = nodes.groupBy("context").agg((F.log10(F.max("escape")) - F.log10(left)).alias("factor"))
        passed = missed.join(factor, "context", "left").withColumn("add", F.col("add") + F.col("times") * F.coalesce("factor", F.lit(0.0)))
        if k:
            rows = passed.groupBy("row", F.col("key").bitwiseAND(F.lit(_bytes(k - 1))).alias("key")).agg(F.sum("times").alias("times"), F.sum("add").alias("add"))
        else:
            gains.append(passed.groupBy("row").agg(F.sum(F.col("add") - F.col("times") * float(np.log10(256))).alias("gain")))
    return _union(gains)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _distinct(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of each document, and how often each occurs."""
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]))) if len(key) else np.empty(0, np.int64)
    return key[first], doc[first], np.diff(np.append(first, len(key)))


def score_texts(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", nodes: int = NODES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    prepare(spark)
    counts = materialise(count_corpus(training.select(F.col(text_col).alias("text"))), "counts")
    trie = build_trie(counts)
    grams = spark.sparkContext.broadcast(most_frequent(trie[ORDER], F.log10("p"), nodes)[0])
    words = counts.where(F.col("kind") == _WORD).select("key", "n")
    facts = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = counts.where(F.col("kind") == _DOCS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total, distinct = facts[0] + ends, facts[1] + (ends > 0)
    level = float(np.log10(total + 0.1 * (distinct + 1)))
    common, rest = most_frequent(words, F.col("n").cast("double"), nodes)
    frequent = spark.sparkContext.broadcast(common)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for a, b in blocks(offsets, PIECE):
                words = Words(raw, offsets, a, b)
                own = signed(words.hash)
                hit, n = frequent.value.find(own)
                sums = np.concatenate([[0.0], np.cumsum(np.where(hit, np.log10(n + 0.1), -1.0))])  # as if rare words were unknown
                known = np.concatenate([[0], np.cumsum(hit)])
                text, starts, ends_ = normal_form(words)
                keys = grams_of(text)
                sure, logs = grams.value.find(keys)
                total_logs = np.concatenate([[0.0], np.cumsum(logs)])
                tokens = words.last - words.first + 1
                cols = tokens, known[words.last] - known[words.first] + (ends > 0), sums[words.last] - sums[words.first] + np.log10(ends + 0.1) - tokens * level, total_logs[ends_ - ORDER] - total_logs[starts - ORDER]
                m = b - a
                none = lambda k, t: pa.nulls(k, t)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, _TEXT, np.int32)), pa.array(row + np.arange(m)), none(m, pa.int64()), none(m, pa.int32()), batch.column(0).slice(a, m), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64())], names)
                rare_words = _distinct(own[~hit], np.repeat(np.arange(m), words.last - words.first)[~hit])
                open_ = np.flatnonzero(places(starts, ends_, len(keys)) & ~sure)
                rare_grams = _distinct(keys[open_], np.searchsorted(starts - ORDER, open_, "right") - 1)
                for what, (key, doc, times) in ((_WORD, rare_words), (_GRAM, rare_grams)):
                    if k := len(key):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(k, what, np.int32)), pa.array(row + doc), pa.array(key), pa.array(times.astype(np.int32)), none(k, batch.schema.field(0).type), none(k, pa.int64()), none(k, pa.int64()), none(k, pa.float64()), none(k, pa.float64())], names)
                row += m
        give_back()

    names = ["kind", "row", "key", "times", "doc_id", "n_tokens", "known", "base", "sure"]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = materialise(texts.mapInArrow(run, f"kind int, row long, key long, times int, doc_id {kind}, n_tokens long, known long, base double, sure double"), "scored")
    grams.destroy()  # what is read from here on is written
    frequent.destroy()
    of = lambda what: found.where(F.col("kind") == what)
    rare = of(_WORD).select("row", "key", "times").join(words.where(rest), "key")
    more = rare.groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * (F.log10(F.col("n") + 0.1) + 1)).alias("better"))
    gain = settle(of(_GRAM).select("row", "key", "times"), trie).groupBy("row").agg(F.sum("gain").alias("gain"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = of(_TEXT).select("row", "doc_id", "n_tokens", "known", "base", "sure").join(more, "row", "left").join(gain, "row", "left")
    return out.select(
        "doc_id",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("better")).alias("base_score"),
        (F.col("sure") + zero("gain")).alias("score"),
    )


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = f"coalesce({crc_mod('doc_id', 10)} = 0, false)"
    scored = score_texts(docs, docs.where(f"not {held_out}"))
    return scored.select("doc_id", F.expr(held_out).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def ppm_base_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op4_ppm`` that SQL can express, the base score to three places."""
    return op4_ppm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 3).alias("base_score"))


MORE = {"ppm_base_score": ppm_base_score}

ORACLE = {
    "ppm_base_score": r"""
WITH t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') || [chr(10)] AS words,
    xor(4294967295, list_reduce(CAST([4294967295] AS BIGINT[]) || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda crc, c: list_reduce(CAST([xor(crc, c), 0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) % 10 = 0 AS held_out
  FROM documents),
w AS (SELECT doc_id, held_out, unnest(words) AS word FROM t),
k AS (SELECT word, count(*) AS c FROM w WHERE NOT held_out GROUP BY 1),
f AS (SELECT sum(c) AS n, count(*) AS v FROM k)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens,
  round(sum(log10((coalesce(c, 0) + 0.1) / (n + 0.1 * (v + 1)))), 3) AS base_score
FROM w LEFT JOIN k USING (word) CROSS JOIN f GROUP BY doc_id""",
}
