"""Records to cells: one generator for all fields, then scoring by kind. No UDF, no union of branches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formgrain import schema as S
from formgrain.functions.text import field_name, normalize

CELL_COLUMNS = ("path", "name", "kind", "expected_text", "predicted_text", "expected_ticks", "predicted_ticks", "expected_int", "predicted_int")


def leaf(record: str, path: str) -> Column:
    """A field by its path; a null vehicle has null fields."""
    return F.col(f"{record}.{path}")


def cell(path: str, kind: str, expected: Column, predicted: Column) -> Column:
    """A field's two values in the columns of its kind."""
    none = lambda t: F.lit(None).cast(t)
    text = kind not in (S.TICKS, S.TICK_COUNT)
    values = []
    for side, value in (("expected", expected), ("predicted", predicted)):
        values.append((value.cast("string") if text else none("string")).alias(f"{side}_text"))
        values.append((F.sort_array(F.array_distinct(value.cast("array<int>"))) if kind == S.TICKS else none("array<int>")).alias(f"{side}_ticks"))
        values.append((value.cast("int") if kind == S.TICK_COUNT else none("int")).alias(f"{side}_int"))
    return F.struct(F.lit(path).alias("path"), F.lit(kind).alias("kind"), *values)


def cells(forms: DataFrame, fields: Sequence[tuple[str, str, Column, Column]], keep: Sequence[str] = ("form_id",)) -> DataFrame:
    """One row per form and field; ``fields``: (path, kind, expected, predicted)."""
    rows = forms.select(*keep, F.posexplode(F.array(*[cell(*f) for f in fields])).alias("position", "cell")).select(*keep, "position", "cell.*")
    return score(rows.withColumn("name", field_name(F.col("path"))))


def record_cells(forms: DataFrame, truth: str = "truth", predicted: str = "predicted", keep: Sequence[str] = ("form_id",)) -> DataFrame:
    """The 60 cells of each form from two record columns."""
    return cells(forms, [(path, kind, leaf(truth, path), leaf(predicted, path)) for path, _, kind in S.PATHS], keep)


def score(rows: DataFrame) -> DataFrame:
    """``correct``, ``edit_distance`` and ``reference_length`` of each cell; texts become normalised."""
    rows = rows.withColumns({c: normalize(F.col(c)) for c in ("expected_text", "predicted_text")})
    kind, want, got = F.col("kind"), F.col("expected_text"), F.col("predicted_text")
    same = F.when(kind == S.TICKS, F.col("expected_ticks") == F.col("predicted_ticks")).when(kind == S.TICK_COUNT, F.col("expected_int") == F.col("predicted_int")).otherwise(want == got)
    edits = F.when(F.coalesce(got, F.lit("")) == "", F.length(want)).otherwise(F.levenshtein(want, got))
    text = kind.isin(*S.TEXT_KINDS)
    return rows.withColumns({"correct": F.coalesce(same, F.lit(False)), "edit_distance": F.when(text, edits).otherwise(0).cast("long"), "reference_length": F.when(text, F.length(want)).otherwise(0).cast("long")})


def complete(rows: DataFrame) -> DataFrame:
    """Raises while it runs if the answer key lacks a value; otherwise the rows as they are."""
    lacking = F.coalesce("expected_text", F.col("expected_int").cast("string"), F.when(F.col("expected_ticks").isNotNull(), "")).isNull()
    said = F.concat(F.lit("EvaluationError: ["), F.col("form_id").cast("string"), F.lit("] the answer key has no value for "), F.col("path"))
    return rows.where(F.when(lacking, F.raise_error(said).cast("boolean")).otherwise(True))


def is_empty(record: str) -> Column:
    """All leaves null and both vehicles absent."""
    whole = F.col(record).isNull()
    tops = [leaf(record, n).isNull() for n in (*S.TOP_FIELDS, *S.VEHICLES)]
    out = tops[0]
    for x in tops[1:]:
        out = out & x
    return whole | out


def in_vocabulary(record: str) -> Column:
    """Closed fields hold null or one of their words."""
    out = F.lit(True)
    for v in S.VEHICLES:
        for name, words in S.VOCABULARIES.items():
            value = leaf(record, f"{v}.{name}")
            out = out & (value.isNull() | value.isin(*words))
    return out


def from_evaluations(saved: DataFrame) -> DataFrame:
    """Saved evaluation documents (``EVALUATION_SCHEMA``) to cells."""
    rows = saved.select("form_id", "produced_output", "usage", F.posexplode("fields").alias("position", "f"))
    pick = lambda side, kind, t: F.when(F.col("f.kind") == kind, F.from_json(f"f.{side}", t) if t != "int" else F.col(f"f.{side}").cast("int"))
    other = ~F.col("f.kind").isin(S.TICKS, S.TICK_COUNT)
    sides = [x for s in ("expected", "predicted") for x in (F.when(other, F.col(f"f.{s}")).alias(f"{s}_text"), pick(s, S.TICKS, "array<int>").alias(f"{s}_ticks"), pick(s, S.TICK_COUNT, "int").alias(f"{s}_int"))]
    return rows.select("form_id", "position", F.col("f.path").alias("path"), field_name(F.col("f.path")).alias("name"), F.col("f.kind").alias("kind"), *sides, "f.correct", "f.edit_distance", "f.reference_length")
