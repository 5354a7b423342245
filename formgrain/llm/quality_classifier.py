"""Quality classifier: supervised subword embeddings.

A text is the mean of learned vectors of its hashed words, word pairs and character n-grams; a softmax layer turns the mean
into class probabilities. Vectors and layer are trained by stochastic gradient descent in numpy. For scoring, the
layer is folded into the vectors: each hash bucket keeps one number, its share of the log odds, so the broadcast model is
``2**BITS`` floats whatever the corpus, and a whole text costs one pass over its bytes.

The model is fitted on a bounded sample: at most ``SAMPLE`` labelled texts of each class, none over ``LONGEST`` bytes, taken in
order of a hash of the id. Everything else runs over all rows and whole texts.

Defined cases: null and empty texts get the score of the bias; labels that are null or of another value are not learned
from, nor are ids with contradicting labels in doubt: each row counts; without a label of both classes the score is 0.5
throughout; repeated rows are scored alike; rows without an id are not held out; an empty table gives no row; labels, lang, source and id never enter a score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formgrain.llm.common import Words, blocks, crc_mod, filter_rows, mix, prepare, table, utf8

BITS = 18
DIM = 8
SAMPLE = 1500
LONGEST = 16_000
EPOCHS = 4
RATE = 300.0
THRESHOLD = 0.7
NGRAMS = 3, 4, 5

_C = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def _hashed(words: Words) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Bucket arrays, each with the range that each text has in it: words, pairs of words, character n-grams."""
    top = np.uint64(64 - BITS)
    h = words.hash
    out = [((h >> top).astype(np.int32), words.first, words.last)]
    if len(h) > 1:
        pair = mix(h[:-1] * np.uint64(3) + h[1:])
        pair[h[:-1] == h[1:]] = np.uint64(0x5DEECE66D1CE4E5B)  # a word twice in a row is one feature, whatever the word
        out.append(((pair >> top).astype(np.int32), words.first, np.maximum(words.last - 1, words.first)))
    v = words.bytes.astype(np.uint32)
    for n in NGRAMS:
        m = len(v) - n + 1
        if m <= 0:
            continue
        x = v[:m] * _C[0] + np.uint32(n * 0x01000193)
        for i in range(1, n):
            x += v[i : m + i] * _C[i]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        out.append(((x >> np.uint32(32 - BITS)).astype(np.int32), words.starts, np.maximum(words.ends - n + 1, words.starts)))
    return out


def bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text: distinct buckets and their shares."""
    raw, offsets = utf8(texts)
    out = []
    for a, b in blocks(offsets):
        parts = _hashed(Words(raw, offsets, a, b))
        for i in range(b - a):
            ids, counts = np.unique(np.concatenate([x[s[i] : e[i]] for x, s, e in parts]), return_counts=True)
            out.append((ids, (counts / max(1, counts.sum())).astype(np.float32)))
    return out


def train(texts: pa.Array, labels: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """Each bucket's share of the log odds of label 1, and the bias."""
    if len(set(labels.tolist())) < 2:
        return np.zeros(1 << BITS, np.float32), 0.0
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-0.1, 0.1, (1 << BITS, DIM)).astype(np.float32)
    layer = rng.uniform(-0.1, 0.1, (2, DIM)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    rows = bags(texts)
    total = EPOCHS * len(rows)
    for step, i in enumerate(np.concatenate([rng.permutation(len(rows)) for _ in range(EPOCHS)])):
        ids, share = rows[i]
        rate = RATE * (1 - step / total)
        mean = share @ vectors[ids]
        odds = layer @ mean + bias
        p = np.exp(odds - odds.max())
        p /= p.sum()
        p[labels[i]] -= 1
        down = layer.T @ p
        layer -= 0.02 * rate / RATE * np.outer(p, mean)
        bias -= 0.002 * rate / RATE * p
        vectors[ids] -= rate * share[:, None] * down
    return vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0])


def score_block(words: Words, weights: np.ndarray, bias: float) -> np.ndarray:
    total, n = np.zeros(len(words.starts)), np.zeros(len(words.starts))
    for ids, s, e in _hashed(words):
        sums = np.concatenate([[0.0], np.cumsum(weights[ids], dtype=np.float64)])
        s, e = np.minimum(s, len(ids)), np.minimum(e, len(ids))  # short texts at the end of a block
        total += sums[e] - sums[s]
        n += e - s
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(n, 1) + bias, -700, 700)))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, least: int = SAMPLE) -> pd.DataFrame:
    """At most ``least`` texts of each class, in order of a hash of the id."""
    picks = [labels.where(F.col(label_col) == c).select(F.col(id_col).alias("id"), F.lit(c).alias("label")).orderBy(F.xxhash64("id"), "id").limit(least) for c in (0, 1)]
    some = F.broadcast(picks[0].unionByName(picks[1]))  # 2 * least rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.octet_length("text") <= LONGEST).join(some, "id")
    return rows.orderBy(F.xxhash64("id"), "id", "label", "text").limit(3 * least).toPandas()


def fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str):
    """A broadcast model and the function that scores a column of texts with it."""
    spark = docs.sparkSession
    prepare(spark)
    known = sample(docs, labels, id_col, text_col, label_col)
    model = spark.sparkContext.broadcast(train(pa.array(known["text"], pa.string()), known["label"].to_numpy(np.int64)))

    def scores(texts: pa.Array) -> np.ndarray:
        raw, offsets = utf8(texts)
        return np.concatenate([np.empty(0), *(score_block(Words(raw, offsets, a, b), *model.value) for a, b in blocks(offsets))])

    return scores


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, score, predicted. ``labels`` holds the rows that may be learned from."""
    scores = fitted(docs, labels, id_col, text_col, label_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            score = scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not rejected; each goes by its own text."""
    scores = fitted(docs, labels, id_col, text_col, label_col)
    return filter_rows(docs, text_col, lambda texts: scores(texts) >= threshold)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(f"{crc_mod('doc_id', 4)} <> 2")
    found = classify(table(spark, sf_dir, "documents"), labels)
    return found.select("doc_id", F.expr(f"coalesce({crc_mod('doc_id', 4)} = 2, false)").alias("held_out"), "score", "predicted")


ORACLE: dict[str, str] = {}
