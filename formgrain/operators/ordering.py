"""Ordered operators: numbering, first rows of a group, islands, reading order, arg-max, modes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formgrain.sources.scratch import written


def numbered(rows: DataFrame, order: Sequence[Column], name: str = "position", parts: int = 0) -> DataFrame:
    """1, 2, ... over all rows in an order, without one task that sees them all.

    Rows are range-partitioned, sorted and written once, so that counts and numbers are of the same partitions even if a task runs again; a
    row's number is its place in its partition plus the sizes of the partitions before. Only those sizes (one row each) are broadcast.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low = (1 << 33) - 1  # the part of the generated id that counts within a partition
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = ranged.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(low)})
    placed = written(placed, "numbered")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).drop("_n")
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.coalesce("_before", F.lit(0)) + F.col("_place") + 1).drop("_part", "_place", "_before")


def first_of_each(rows: DataFrame, group: str, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark limits each group before the shuffle."""
    return rows.withColumn("_at", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_at") <= n).drop("_at")


def islands(rows: DataFrame, group: Sequence[str], at: Column, gap: Column | float) -> DataFrame:
    """Numbers the runs of each group that no gap of more than ``gap`` interrupts (column ``island``, from 0)."""
    w = Window.partitionBy(*group).orderBy(at)
    marked = rows.withColumn("_new", F.coalesce(((at - F.lag(at).over(w)) > gap).cast("int"), F.lit(0)))
    return marked.withColumn("island", F.sum("_new").over(w).cast("long")).drop("_new")


def best_of_each(rows: DataFrame, group: Sequence[str], score: Column, tie: Sequence[Column]) -> DataFrame:
    """The row with the greatest score of each group; of equals the first by ``tie``."""
    others = [c for c in rows.columns if c not in group]
    key = F.struct((-score).alias("_s"), *[t.alias(f"_t{i}") for i, t in enumerate(tie)], *others)
    return rows.groupBy(*group).agg(F.min(key).alias("_b")).select(*group, *[F.col(f"_b.{c}").alias(c) for c in others])


def corners(points: Column) -> Column:
    """Four (x, y) corners as top left, top right, bottom right, bottom left, by sum and difference."""
    pick = lambda score: F.array_min(F.transform(points, lambda p: F.struct(score(p).alias("s"), p["x"].alias("x"), p["y"].alias("y"))))
    point = lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"))
    return F.array(point(pick(lambda p: p["x"] + p["y"])), point(pick(lambda p: p["y"] - p["x"])), point(pick(lambda p: -p["x"] - p["y"])), point(pick(lambda p: p["x"] - p["y"])))
