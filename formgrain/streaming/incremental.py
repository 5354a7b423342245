"""Runs over forms that keep arriving: the scoring plan as a stream. The checkpoint plays the part of the reuse gate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from formgrain import schema as S
from formgrain.operators.scoring import from_evaluations


def stream_evaluations(spark: SparkSession, folder: str) -> DataFrame:
    """Cells of evaluation documents (one JSON object a line) as they arrive in a folder."""
    return from_evaluations(spark.readStream.schema(S.EVALUATION_SCHEMA).json(folder))


def append_new(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each batch of new rows to ``write`` once and ends when nothing is left; the next call goes on from there."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
