"""A training corpus from ``documents``: quality, exact copies, near copies, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of ``documents``; the last returns
the packed pieces. Between stages the documents are written as Parquet and read back, so a lost executor costs a task and not
the run, and what a stage has written beside its result is deleted.

Defined cases, for all stages: a row's fate depends on its own text, whatever its id, null ids and ids that repeat included; null texts
count as empty; other columns, whatever their names, come out as they went in; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formgrain.llm.best_fit_packing import pack
from formgrain.llm.common import materialise, release, row_key, table, written
from formgrain.llm.decontaminate import clean
from formgrain.llm.exact_dedup import exact_dedup
from formgrain.llm.minhash_dedup import near_dedup
from formgrain.llm.quality_classifier import accepted


def _keep(rows: DataFrame, key: str, winners: DataFrame) -> DataFrame:
    """The rows whose key is in the one column of ``winners``, without the key."""
    return rows.join(winners.toDF(key), key, "left_semi").drop(key)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on all labels, does not reject. Equal texts share a decision; empty ones get the score of the bias."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text (white space aside): the longest as it stands, then the smallest id, nulls last, then the first row."""
    rows, key = row_key(docs, "rows")
    found = exact_dedup(rows, id_col=key, order_col="doc_id")
    return _keep(rows, key, found.where("kept").select("doc_id"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more): the smallest id, nulls last, then the
    first row. Texts without words are near copies of nothing, and all stay."""
    rows, key = row_key(docs, "rows")
    groups = near_dedup(rows, id_col=key, k=5, per_cent=80).select(F.col("doc_id").alias("at"), F.col("component_id").alias("group"))
    ids = rows.select(F.col(key).alias("at"), F.col("doc_id").alias("id"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at"))
    winners = groups.join(ids, "at").groupBy("group").agg(first.alias("first")).select("first.at")
    return _keep(rows, key, winners)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, and the sequence and offset of each. Every row is packed, repeated ones as often as they occur."""
    return pack(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("leaks", leaks), ("packing", packing)]

#: SQL can express neither the trained classifier nor the tokenizer; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, first = table(spark, sf_dir, "documents"), len(written(spark))
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        release(spark, first, -1)  # all but the stage's result
    return STAGES[-1][1](spark, docs, sf_dir)
