"""Artifacts of runs: one Parquet table partitioned by run and step; the last write of a form wins."""

from __future__ import annotations

import json
import platform
from collections.abc import Sequence
from datetime import date
from importlib import metadata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formgrain.sources import scratch

SCHEMA = "form_id string, text string, json string, run_id string, step string"


class ArtifactStore:
    """Text and JSON artifacts by (run, step, form)."""

    def __init__(self, spark: SparkSession, root: str, run_id: str):
        self.spark, self.root, self.run_id = spark, root.rstrip("/"), run_id

    def path(self, step: str, form_id: str, suffix: str) -> str:
        """Where an artifact that is a file of its own (an image) goes."""
        return f"{self.root}/files/{self.run_id}/{step}/{form_id}{suffix}"

    def _write(self, rows: DataFrame, step: str) -> None:
        """A step's artifacts replace those of the same step; other steps and runs stay."""
        out = rows.withColumns({"run_id": F.lit(self.run_id), "step": F.lit(step)})
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "step").parquet(f"{self.root}/artifacts")

    def write_text(self, rows: DataFrame, step: str, text: str = "text") -> None:
        self._write(rows.select("form_id", F.col(text).alias("text"), F.lit(None).cast("string").alias("json")), step)

    def write_json(self, rows: DataFrame, step: str, columns: Sequence[str]) -> None:
        self._write(rows.select("form_id", F.lit(None).cast("string").alias("text"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json")), step)

    def read(self, step: str) -> DataFrame:
        """form_id, text, json; the partition filter keeps other steps and runs unread."""
        rows = self.spark.read.schema(SCHEMA).parquet(f"{self.root}/artifacts")
        return rows.where((F.col("run_id") == self.run_id) & (F.col("step") == step)).select("form_id", "text", "json")

    def has(self, step: str) -> bool:
        """Whether the run has any artifact of a step."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/artifacts/run_id={self.run_id}/step={step}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def exists(self, forms: DataFrame, *steps: str) -> DataFrame:
        """Those forms that have an artifact of every step."""
        for step in steps:
            forms = forms.join(self.read(step).select("form_id"), "form_id", "left_semi")
        return forms

    def write_errors(self, rows: DataFrame) -> None:
        """(form_id, error, type) of forms that failed."""
        self.write_json(rows, "errors", ["error", "type"])


def scratch_store(spark: SparkSession) -> ArtifactStore:
    """A store of its own for a run that keeps nothing, in the shared folder."""
    return ArtifactStore(spark, scratch.path(spark, "run"), "run")


def describe_run(run_id: str, settings: dict, forms: list[tuple[str, str]], command: str, fingerprint: str | None = None, day: date | None = None) -> dict:
    """What a run was: settings without secrets, forms, versions, fingerprint of the data, command."""
    return {
        "run_id": run_id,
        "date": (day or date.today()).isoformat(),
        "command": command,
        "python": platform.python_version(),
        "versions": versions(),
        "dataset_fingerprint": fingerprint,
        "settings": settings,
        "forms": [{"id": i, "split": s} for i, s in forms],
    }


def versions() -> dict[str, str]:
    """Versions of the libraries that a run may use, as far as they are installed."""
    out = {}
    for name in ("pyspark", "pyarrow", "pandas", "numpy"):
        try:
            out[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            continue
    return out


def write_run_files(spark: SparkSession, folder: str, description: dict, summary: dict) -> None:
    """``run.json`` and ``summary.json`` beside a run's artifacts, on any file system that Spark reaches."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    for name, content in (("run.json", description), ("summary.json", summary)):
        at = fs_path(f"{folder}/{name}")
        out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
        try:
            out.write(bytearray(json.dumps(content, indent=2, ensure_ascii=False).encode()))
        finally:
            out.close()


def write_report(rows: DataFrame, path: str) -> None:
    """A report such as the attribution table, as JSON lines."""
    rows.write.mode("overwrite").json(path)
