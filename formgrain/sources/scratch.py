"""Intermediate tables that several actions read: written once to a folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from formgrain.errors import ConfigurationError


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only on a single machine one of our own, where that is unset."""
    home = spark.conf.get("spark.checkpoint.dir", None)
    if not home:
        if not spark.sparkContext.master.startswith("local"):
            raise ConfigurationError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        home = "file://" + tempfile.mkdtemp(prefix="formgrain-")
        spark.conf.set("spark.checkpoint.dir", home)
    return home.rstrip("/")


def path(spark: SparkSession, tag: str) -> str:
    return f"{folder(spark)}/{tag}-{uuid.uuid4().hex}"


def written(rows: DataFrame, tag: str) -> DataFrame:
    """The rows, written and read back: their order in a partition, and what the plan below says, no longer depend on a task that runs again."""
    at = path(rows.sparkSession, tag)
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)
