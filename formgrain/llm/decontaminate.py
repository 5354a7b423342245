"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Every ``N``-word sequence of an item is a seed, so each one that an edited copy has left leads to it, whatever became of its
neighbours. One pass finds the seeds in each document. An item of which less than the least score's share of words occurs in the document,
or in the stretch, can't reach that score and is left out before it is aligned; where seeds of one item fall near one diagonal, the
item's words are aligned with that stretch of the document by Smith-Waterman (match 2, mismatch -1, gap -1), and the best score over
twice the item's length says how much of it is there, paraphrased or edited.

The benchmark is the query set and goes to the executors in blocks of at most ``BLOCK_BYTES`` of text: a larger one takes
more passes, never a larger broadcast. Documents are not shuffled, so a passage that is copied into any number of them
is no hot key; only matched pairs leave a task.

Defined cases: null and blank texts match nothing, on both sides; an item with fewer than ``N`` words is a seed as a whole and has to
occur as it is; a longer one than ``N + 1`` words has to score more than a lone seed does (this matters for items of 5 and 6
words); of several stretches that hold an item the best is given, and the score is the share of the whole item, so that less than
``LEAST_SCORE`` of a long item is no match; equal items and items that repeat each give their own pairs; rows that repeat a document each give theirs;
empty tables give no row; ids are carried along, other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formgrain.llm.common import Words, blocks, filter_rows, materialise, prepare, shingle_hashes, table, utf8

N = 3
BLOCK_BYTES = 8 << 20
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of the greatest possible score from which a pair counts.
LEAST_SCORE = 0.5
_BITS = 20


class Grams:
    """A sorted set of n-gram hashes with a bit table in front of it."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``hashes`` that are in the set, and where in it they are."""
        at = np.flatnonzero(self.bits[(hashes >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        i = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        hit = self.keys[i] == hashes[at]
        return at[hit], i[hit]


class Items:
    """Words and n-grams of a block of benchmark items."""

    def __init__(self, texts: pa.Array):
        raw, offsets = utf8(texts)
        self.words = []
        for a, b in blocks(offsets):
            w = Words(raw, offsets, a, b)
            self.words += [w.hash[w.first[i] : w.last[i]].copy() for i in range(b - a)]
        self.hashes = [shingle_hashes(w, min(N, max(1, len(w)))) for w in self.words]
        self.widths = sorted({min(N, len(w)) for w in self.words if len(w)})
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.flat = np.concatenate(self.words) if self.words else np.empty(0, np.uint64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def seeds(self) -> dict[int, tuple]:
        """Per width: set of seeds, and for each seed the items that it stands for."""
        out = {}
        for n in self.widths:
            some = [i for i, w in enumerate(self.words) if len(w) and min(N, len(w)) == n]
            item, hashes = np.repeat(some, [len(self.hashes[i]) for i in some]), np.concatenate([self.hashes[i] for i in some])
            order = np.lexsort((item, hashes))
            item, hashes = item[order], hashes[order]
            once = np.append(True, (hashes[1:] != hashes[:-1]) | (item[1:] != item[:-1]))
            distinct, first = np.unique(hashes[once], return_index=True)
            out[n] = Grams(distinct), np.append(first, int(once.sum())), item[once]
        return out

    def reachable(self, some: np.ndarray, words: np.ndarray, least: float) -> np.ndarray:
        """Which of these items have enough words in a text for the least score."""
        size = self.lengths[some]
        first = np.cumsum(size) - size
        own = self.flat[np.repeat(self.starts[some] - first, size) + np.arange(int(size.sum()))]
        known = np.unique(words)
        hit = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own
        return np.add.reduceat(hit.astype(np.int64), first) >= least * size


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local score of two word sequences, and where it ends in each (exclusive)."""
    down = -GAP * np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, np.int64)
    best = (0, 0, 0)
    for i, word in enumerate(a):
        step = np.zeros_like(row)
        step[1:] = np.maximum(row[:-1] + np.where(b == word, MATCH, MISMATCH), row[1:] + GAP)
        np.maximum(step, 0, out=step)
        row = np.maximum.accumulate(step + down) - down  # gaps in the row
        j = int(row.argmax())
        if row[j] > best[0]:
            best = int(row[j]), i + 1, j
    return best


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """Share of the greatest possible score, and the range of ``text`` that it takes."""
    score, i, j = smith_waterman(item, text)
    if not score:
        return 0.0, 0, 0
    _, _, back = smith_waterman(item[:i][::-1], text[:j][::-1])
    return score / (MATCH * len(item)), j - back, j


def stretches(diagonals: np.ndarray, length: int) -> list[np.ndarray]:
    """Groups of hits whose diagonals lie within an item's length of each other."""
    order = np.argsort(diagonals, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(diagonals[order]) > max(4, length // 2)) + 1)


def candidates(words: np.ndarray, items: Items, seeds: dict[int, tuple], least: float) -> np.ndarray:
    """Items that have a seed in a text, and enough words in it."""
    found = []
    for n, (grams, first, item) in seeds.items():
        _, i = grams.find(np.unique(shingle_hashes(words, n)))
        found += [item[first[k] : first[k + 1]] for k in i.tolist()]
    some = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    return some[items.reachable(some, words, least)] if len(some) else some


def matches(words: np.ndarray, items: Items, seeds: dict[int, tuple], least: float):
    """Of one text, for each item in it the best stretch: (item, score, first word, last word + 1, seeds). One item's hits are held at a time."""
    some = candidates(words, items, seeds, least)
    if not len(some):
        return
    sorted_grams = {}
    for n in {min(N, len(items.words[x])) for x in some.tolist()}:
        hashes = shingle_hashes(words, n)
        order = np.argsort(hashes, kind="stable")
        sorted_grams[n] = hashes[order], order
    for x in some.tolist():
        own = items.words[x]
        hashes, order = sorted_grams[min(N, len(own))]
        low, high = np.searchsorted(hashes, items.hashes[x]), np.searchsorted(hashes, items.hashes[x], "right")
        times = high - low
        at = order[np.repeat(low - np.cumsum(times) + times, times) + np.arange(int(times.sum()))]
        diagonal = at - np.repeat(np.arange(len(times)), times)
        found = []
        for group in stretches(diagonal, len(own)):
            pad = max(4, len(own) // 4)
            a, b = max(0, int(diagonal[group].min()) - pad), min(len(words), int(diagonal[group].max()) + len(own) + pad)
            if not items.reachable(np.array([x]), words[a:b], least)[0]:
                continue
            score, s, e = align(own, words[a:b])
            if score >= least and (len(own) <= N + 1 or score * len(own) > N):
                found.append((x, score, a + s, a + e, len(group)))
        if found:
            yield max(found, key=lambda y: (y[1], -y[2]))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, score, first_word, last_word (exclusive), n_seeds."""
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where(F.length("text") > 0)
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    found = None
    for texts, ids in _queries(items):
        one = _pass(_texts(docs, id_col, text_col), texts, ids, kind, item_kind, least)
        found = one if found is None else found.unionByName(one)
    return spark.createDataFrame([], _schema(kind, item_kind)) if found is None else found


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no item; each goes by its own text."""
    prepare(docs.sparkSession)
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where(F.length("text") > 0)
    for texts, _ in _queries(items):
        model = _model(docs.sparkSession, texts)

        def free(column, model=model):
            out = np.ones(len(column), bool)
            out[[i for i, _ in _hits(column, *model.value, least, first=True)]] = False
            return out

        docs = filter_rows(docs, text_col, free)
    return docs


def _schema(kind: str, item_kind: str) -> str:
    return f"doc_id {kind}, item_id {item_kind}, score double, first_word long, last_word long, n_seeds long"


def _queries(items: DataFrame):
    """Texts and ids of the items, a block of at most about ``BLOCK_BYTES`` at a time."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // BLOCK_BYTES)
    for part in range(parts):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").toArrow()
        if some.num_rows:
            yield some.column("text"), some.column("item_id").combine_chunks()


def _model(spark: SparkSession, texts):
    items = Items(texts)
    return spark.sparkContext.broadcast((items, items.seeds()))


def _hits(column, items: Items, seeds: dict[int, tuple], least: float, first: bool = False):
    """(row, match) of a column of texts; of each row the ``first`` one only."""
    raw, offsets = utf8(column)
    for a, b in blocks(offsets):
        words = Words(raw, offsets, a, b)
        hot = np.zeros(b - a, bool)
        for n, (grams, *_) in seeds.items():
            at, _ = grams.find(shingle_hashes(words.hash, n))
            hot[np.searchsorted(words.first, at, "right") - 1] = True
        for i in np.flatnonzero(hot).tolist():
            for row in matches(words.hash[words.first[i] : words.last[i]], items, seeds, least):
                yield a + i, row
                if first:
                    break


def _pass(texts: DataFrame, queries, ids: pa.Array, kind: str, item_kind: str, least: float) -> DataFrame:
    model, names = _model(texts.sparkSession, queries), texts.sparkSession.sparkContext.broadcast(ids)

    def search(batches):
        for batch in batches:
            found = list(_hits(batch.column(1), *model.value, least))
            if found:
                keys, rows = zip(*found)
                item, *cols = zip(*rows)
                types = pa.float64(), pa.int64(), pa.int64(), pa.int64()
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys)), names.value.take(pa.array(item)), *(pa.array(c, t) for c, t in zip(cols, types))], ["doc_id", "item_id", "score", "first_word", "last_word", "n_seeds"])

    return texts.mapInArrow(search, _schema(kind, item_kind))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")), "leaks")


ORACLE: dict[str, str] = {}
