"""Datasets of forms: manifest, answer keys, images, saved evaluations, and the settings that name them."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formgrain import schema as S
from formgrain.errors import ConfigurationError
from formgrain.operators.ordering import first_of_each


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """One row per form, from ``manifest.jsonl``; a missing file is a configuration error."""
    path = f"{root}/manifest.jsonl"
    if not _exists(spark, path):
        raise ConfigurationError(f"no manifest at {path}")
    return spark.read.schema(S.MANIFEST_SCHEMA).json(path)


def first(forms: DataFrame, count: int, split: str | None = None) -> DataFrame:
    """The first forms, by id, of one split or of each."""
    if split is not None:
        return forms.where(F.col("split") == split).orderBy("id").limit(count)
    return first_of_each(forms, "split", ["id"], count)


def chosen(forms: DataFrame, dev: int, test: int) -> DataFrame:
    """A run's forms: dev forms before test forms (column ``split_rank``)."""
    part = lambda s, n, i: first(forms, n, s).withColumn("split_rank", F.lit(i))
    return part("dev", dev, 0).unionByName(part("test", test, 1))


def records(spark: SparkSession, path: str) -> DataFrame:
    """Answer keys, one JSON document per file; fields that the record doesn't have are not read. A malformed file fails."""
    rows = spark.read.schema(S.RECORD_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1)
    return rows.select(name.alias("id"), F.struct(*S.RECORD_SCHEMA.names).alias("record"))


def evaluations(spark: SparkSession, path: str) -> DataFrame:
    """Saved evaluations, one JSON document per form."""
    return spark.read.schema(S.EVALUATION_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)


def dataset_summary(spark: SparkSession, root: str) -> DataFrame:
    """The one row of ``dataset.json``, with the fingerprint."""
    return spark.read.schema("count long, dev long, test long, base_seed long, level string, fingerprint string").option("multiLine", True).json(f"{root}/dataset.json")


def images(spark: SparkSession, path: str) -> DataFrame:
    """Decoded images (blue, green, red); a file that can't be decoded is an error row, not a lost one."""
    rows = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*")
    return rows.withColumn("error", F.when(F.col("height") < 0, F.concat(F.lit("cannot read image "), F.col("origin"))))


def image_bytes(spark: SparkSession, path: str, pattern: str = "*.{jpg,jpeg,png}") -> DataFrame:
    """Raw bytes of image files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def names_in(listed: str) -> tuple[str, ...]:
    """Names of a comma-separated setting; blanks are dropped."""
    return tuple(x.strip() for x in listed.split(",") if x.strip())


def known_forms(ids: DataFrame, forms: DataFrame) -> DataFrame:
    """The manifest's rows of a run's forms (column ``id``); an id that the manifest lacks fails while it runs."""
    marked = ids.select("id").join(forms.withColumn("_there", F.lit(True)), "id", "left")
    lacking = F.raise_error(F.concat(F.lit("ConfigurationError: the dataset has no form "), F.col("id"))).cast("boolean")
    return marked.where(F.coalesce("_there", lacking)).drop("_there")


def decoded_photos(spark: SparkSession, root: str, forms: DataFrame) -> DataFrame:
    """Of manifest rows: form_id and the columns of the image source."""
    rows = images(spark, f"{root}/images")
    name = lambda c: F.substring_index(F.regexp_replace(c, r"\.[^./]+$", ""), "/", -1)
    wanted = forms.select(F.col("id").alias("form_id"), name(F.col("image")).alias("file"))
    return rows.withColumn("file", name(F.col("origin"))).join(wanted, "file").drop("file")


def form_files(spark: SparkSession, root: str, forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of manifest rows: images (form_id, split, content, suffix) and answer keys (form_id, split, truth)."""
    name = lambda c: F.substring_index(F.regexp_replace(c, r"\.[^./]+$", ""), "/", -1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jpg,jpeg,png}").load(root)
    files = files.select(name(F.col("path")).alias("file"), F.lower(F.substring_index("path", ".", -1)).alias("suffix"), "content")
    images = forms.select(F.col("id").alias("form_id"), "split", name(F.col("image")).alias("file")).join(files, "file").drop("file")
    keys = records(spark, f"{root}/truth").select(F.col("id").alias("form_id"), F.col("record").alias("truth"))
    return images, forms.select(F.col("id").alias("form_id"), "split").join(keys, "form_id")


@dataclass(frozen=True)
class Settings:
    """Settings from the environment (upper-case names) and an optional ``.env`` file; secrets never show in a run's description.

    ``workers`` is the number of partitions in which forms go through the models; ``trace`` names Spark's jobs after the run's steps.
    """

    dataset_dir: str = "data/synthetic"
    runs_dir: str = "runs"
    dev_count: int = 5
    test_count: int = 20
    workers: int = 4
    straightener: str = ""
    ocr_engine: str = "none"
    ocr_languages: tuple[str, ...] = ("fra",)
    structurer: str = "vision"
    structuring_prompt: str = ""
    repair_rules: str = ""
    refine_fields: str = ""
    refine_scale: int = 3
    read_marks: bool = False
    ocr_url: str = ""
    structure_url: str = ""
    model: str = ""
    temperature: float = 0.0
    reasoning_effort: str = ""
    retries: int = 2
    input_price: float = 0.0
    output_price: float = 0.0
    timeout: float = 1800.0
    trace: bool = False
    api_key: str = field(default="", repr=False)
    server_token: str = field(default="", repr=False)

    SECRET = ("api_key", "server_token")

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None, dotenv: str | None = None) -> Settings:
        found: dict[str, str] = {}
        if dotenv and os.path.exists(dotenv):
            for line in open(dotenv, encoding="utf-8"):
                name, eq, value = line.strip().partition("=")
                if eq and not name.startswith("#"):
                    found[name.strip().lower()] = value.strip().strip("\"'")
        found |= {k.lower(): v for k, v in (os.environ if env is None else env).items()}
        out = {}
        for f in fields(cls):
            if f.name in found:
                kind = type(f.default)
                try:
                    value = found[f.name]
                    out[f.name] = value.lower() in ("1", "true", "yes", "on") if kind is bool else names_in(value) if kind is tuple else kind(value)
                except ValueError as e:
                    raise ConfigurationError(f"{f.name} must be {kind.__name__}: {found[f.name]!r}") from e
        return cls(**out)

    def public(self) -> dict:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name not in self.SECRET}
