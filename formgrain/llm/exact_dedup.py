"""Exact dedup by a heavy-hitter split.

Texts are equal when they agree after all white space is deleted. One pass over the texts yields a small table of
digests. A Misra-Gries summary of each partition, summed over all, names at most ``counters`` digests that may be
frequent. Their winners are verified by an exact aggregate, and at most ``counters`` of them are broadcast, so that no row of
a frequent digest is shuffled. All other digests go through an ordinary shuffle.

Defined cases: a null text counts as empty and equals every blank text; a null id loses ties and is its own keeper only
if its text is the longest; rows that repeat an id share its fate; an empty table gives an empty result; other columns
of the input are not read.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formgrain.llm.common import WHITE, materialise, prepare, table

COUNTERS = 1024


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order_col: str | None = None) -> DataFrame:
    """id, what orders ties, sha256 of the text without white space, code points of the text as it is."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(order_col or id_col).alias("tie"),
        F.unhex(F.sha2(F.translate(text, WHITE, ""), 256)).alias("digest"),
        F.length(text).cast("long").alias("n_points"),
    )


def misra_gries(counts: Counter, more: Counter, k: int) -> Counter:
    """Merge two summaries of ``k`` counters: what the (k+1)-th largest has is taken from all."""
    counts.update(more)
    if len(counts) > k:
        cut = sorted(counts.values(), reverse=True)[k]
        counts = Counter({x: n - cut for x, n in counts.items() if n > cut})
    return counts


def frequent(rows: DataFrame, k: int) -> DataFrame:
    """At most ``k`` digests that are likely frequent: the largest sums of the summaries of all tasks.

    What is named here decides how a digest's rows travel, never the result: counts and winners are exact either way.
    """

    def summary(batches):
        counts: Counter = Counter()
        for batch in batches:
            counts = misra_gries(counts, Counter(batch.column(0).to_pylist()), k)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["digest", "low"])

    parts = rows.select("digest").mapInArrow(summary, "digest binary, low long")
    return parts.groupBy("digest").agg(F.sum("low").alias("low")).orderBy(F.desc("low"), "digest").limit(k)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS, order_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256. Ties go to the smallest ``order_col``, then to the smallest id."""
    spark = docs.sparkSession
    prepare(spark)
    rows = materialise(digests(docs, id_col, text_col, order_col), "digests")
    best = F.min(F.struct((-F.col("n_points")).alias("n"), F.col("tie").isNull().alias("none"), "tie", F.col("doc_id").isNull().alias("blank"), F.col("doc_id").alias("id")))
    winners = lambda some: some.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
    heavy = F.broadcast(materialise(frequent(rows, counters).select("digest"), "frequent"))  # <= counters rows
    top = F.broadcast(materialise(winners(rows.join(heavy, "digest", "left_semi")), "winners"))  # <= counters rows
    rest = rows.join(heavy, "digest", "left_anti")
    found = rows.join(top, "digest").unionByName(rest.join(winners(rest), "digest"))
    return found.select(
        "doc_id",
        F.col("best.id").alias("keep_id"),
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("best.id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = {
    "op6_exact_dedup": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY h ORDER BY length(text) DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY h ORDER BY length(text) DESC, doc_id) AS kept,
       h AS text_sha256
FROM t""",
}
