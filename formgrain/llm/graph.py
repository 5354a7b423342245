"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formgrain.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (id, root): the smallest id that each linked id reaches. Ids without links are left out.

    Each step is an aggregate (with map-side partial minima, so a hub costs no more than any other) and a join on the hub
    that Spark may split where it is skewed, as the minima are written first. Nothing is gathered in one task or on the driver; the number of steps is about
    the logarithm of the longest path. It ends when the links are stars: no id has two roots, no root has one of its own.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m"))
    while True:
        both = now.unionByName(now.select(F.col("m").alias("v"), F.col("v").alias("m")))
        low = materialise(both.groupBy("v").agg(F.least(F.min("m"), F.col("v")).alias("low")), "low")
        # Large star: larger neighbours to the smallest one. Every v here is larger than its m.
        large = both.join(low, "v").where("m > v").select(F.col("m").alias("v"), F.col("low").alias("m"))
        large = materialise(large.distinct(), "large")
        # Small star: the smaller neighbours, and the id itself, to the smallest one.
        least = materialise(large.groupBy("v").agg(F.min("m").alias("low"), F.max("m").alias("high")), "least")
        more = large.join(least.where("low <> high"), "v").where("m <> low").select(F.col("m").alias("v"), F.col("low").alias("m"))
        now = materialise(least.select("v", F.col("low").alias("m")).unionByName(more), "small")
        again = now.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        roots = now.select(F.col("m").alias("v")).distinct()
        if again.join(roots, "v", "left_semi").isEmpty() and again.where("n > 1").isEmpty():
            return now.select(F.col("v").alias("id"), F.col("m").alias("root"))
