"""A run: forms through the configured steps, then scores and the summary. Steps that aren't configured aren't in the plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formgrain import schema as S
from formgrain.operators import metrics, overlay, scoring
from formgrain.operators import repair as R
from formgrain.sources.store import ArtifactStore, scratch_store

Step = Callable[[DataFrame], DataFrame]


@dataclass
class Flow:
    """The steps of a run, in their fixed order. Each takes and returns one row per form.

    ``straighten`` and ``ocr`` work on images and are optional, as are ``refine`` (answers by path), ``marks`` and ``rules``. Each step with a
    model behind it is written before anything reads it, so no form is asked for twice; without a store that is one of the run's own.
    """

    structure: Step
    straighten: Step | None = None
    ocr: Step | None = None
    refine: Step | None = None
    refine_paths: tuple[str, ...] = ()
    marks: Step | None = None
    rules: tuple[str, ...] = ()
    store: ArtifactStore | None = None
    reuse: bool = False
    prices: tuple[float, float] = (0.0, 0.0)
    written: list[str] = field(default_factory=list)

    def _kept(self, forms: DataFrame, name: str, step: Step, columns: list[str], failed: Column | None = None) -> DataFrame:
        """A step's result, written before anything reads it; what an earlier run left is read, and only the other forms are done."""
        if self.reuse and self.store.has(name):
            done = self.store.exists(forms.select("form_id"), name)
            todo, _ = overlay.reuse(forms, done)
            old = self.store.read(name).join(done, "form_id", "left_semi")
        else:
            todo, old = forms, None
        new = step(todo)
        if old is not None:
            had = old.select("form_id", F.from_json("json", new.select(*columns).schema).alias("r")).select("form_id", "r.*")
            new = had.unionByName(new.select("form_id", *columns))
        self.store.write_json(new, f"{name}.new", columns)  # beside the old, which is still being read
        rows = self.store.read(f"{name}.new").select("form_id", F.from_json("json", new.select(*columns).schema).alias("r")).select("form_id", "r.*")
        self.store.write_json(rows if failed is None else rows.where(~failed), name, columns)  # a failed step isn't kept
        self.written.append(name)
        return rows

    def predict(self, forms: DataFrame) -> DataFrame:
        """(form_id, content, suffix) -> form_id, record, produced_output, changes, usage and errors."""
        self.store = self.store or scratch_store(forms.sparkSession)
        rows, failed = forms, F.col("error").isNotNull()
        if self.straighten:
            rows = self._kept(forms, "straightened", self.straighten, ["content", "suffix"])
        if self.ocr:
            read = self._kept(rows, "ocr", self.ocr, ["text", "seconds", "error", "error_class"], failed)
            read = read.select("form_id", "text", F.col("seconds").alias("ocr_seconds"), F.col("error").alias("ocr_error"), F.col("error_class").alias("ocr_class"))
            rows = rows.join(read, "form_id", "left")
        else:
            rows = rows.withColumns({"text": F.lit(None).cast("string"), "ocr_seconds": F.lit(0.0), "ocr_error": F.lit(None).cast("string"), "ocr_class": F.lit(None).cast("string")})
        fine = rows.where(F.col("ocr_error").isNull())
        made = self._kept(fine, "structured", self.structure, ["record", "input_tokens", "output_tokens", "seconds", "error", "error_class"], failed)
        out = rows.select("form_id", "ocr_seconds", "ocr_error", "ocr_class").join(made, "form_id", "left")
        out = out.withColumns({"error": F.coalesce("ocr_error", "error"), "error_class": F.coalesce("ocr_class", "error_class")}).drop("ocr_error", "ocr_class")
        crops = F.array().cast("array<struct<rule:string,path:string,before:string,after:string>>")
        if self.refine:
            answers = self._kept(rows, "refined", self.refine, ["answers", "refine_failed"], F.coalesce("refine_failed", F.lit(False)))
            out = out.join(answers, "form_id", "left")
            record, crops = overlay.refine_overlay(F.col("record"), {p: F.col("answers")[p] for p in self.refine_paths})
            out = out.withColumns({"crops": crops, "record": F.when(F.col("record").isNotNull(), record)})
            crops = F.col("crops")
        if self.marks:
            out = out.join(self.marks(rows).select("form_id", "marks"), "form_id", "left")
            seen = F.col("record").isNotNull() & F.col("marks").isNotNull()
            out = out.withColumn("record", F.when(seen, overlay.marks_overlay(F.col("record"), F.col("marks"))).otherwise(F.col("record")))
        out = R.repair(out.withColumn("crops", crops), self.rules)
        return out.select("form_id", "record", F.col("record").isNotNull().alias("produced_output"), "crops", "changes", "input_tokens", "output_tokens", (F.coalesce("ocr_seconds", F.lit(0.0)) + F.col("seconds")).alias("seconds"), "error", "error_class")

    def run(self, forms: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame, dict]:
        """Predictions, cells (of the forms with an answer key) and the summary document."""
        done = self.predict(forms)
        self.store.write_json(done, "evaluated", [c for c in done.columns if c != "form_id"])
        kept = self.store.read("evaluated").select("form_id", F.from_json("json", done.drop("form_id").schema).alias("r"))
        done = kept.select("form_id", "r.*")
        self.store.write_errors(done.where(F.col("error").isNotNull()).select("form_id", "error", F.col("error_class").alias("type")))
        scored = truth.join(done, "form_id", "left").withColumn("produced_output", F.coalesce("produced_output", F.lit(False)))
        paths = [(p, k, F.col(f"truth.{p}"), F.col(f"record.{p}")) for p, _, k in S.PATHS]
        cells = scoring.complete(scoring.cells(scored, paths))
        return done, cells, metrics.summary_document(cells, scored, *self.prices)
