"""The six metrics as DataFrame functions, and the summary that puts them together.

Each takes cells (or forms with their usage) and makes one pass: grouping sets instead of unions, partial aggregation before
the shuffle, ratios only at the end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formgrain import schema as S
from formgrain.functions.text import safe_ratio

METRICS: dict[str, Callable[..., DataFrame]] = {}


def metric(name: str):
    """Register a metric under a name."""

    def put(f):
        METRICS[name] = f
        return f

    return put


def group_of(kind: str = "kind"):
    return F.when(F.col(kind) == S.CRITICAL, "critical").otherwise("minor")


def _texts(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("kind").isin(*S.TEXT_KINDS))


@metric("field_accuracy")
def field_accuracy(cells: DataFrame) -> DataFrame:
    """scope (group or field), key, correct, total, accuracy."""
    rows = _texts(cells).select(group_of().alias("grp"), "name", F.col("correct").cast("int").alias("ok"))
    out = rows.groupingSets([["grp"], ["name"]], "grp", "name").agg(F.grouping("grp").alias("by_field"), F.sum("ok").cast("long").alias("correct"), F.count(F.lit(1)).alias("total"))
    return out.select(F.when(F.col("by_field") == 1, "field").otherwise("group").alias("scope"), F.coalesce("grp", "name").alias("key"), "correct", "total", safe_ratio(F.col("correct"), F.col("total")).alias("accuracy"))


@metric("forms_without_critical_error")
def forms_without_critical_error(cells: DataFrame, forms: DataFrame) -> DataFrame:
    """forms, without_critical_error, share; a form without critical cells counts as clean."""
    bad = cells.where((F.col("kind") == S.CRITICAL) & ~F.col("correct")).select("form_id").distinct()
    marked = forms.select("form_id").join(bad.withColumn("bad", F.lit(1)), "form_id", "left")
    out = marked.agg(F.count(F.lit(1)).alias("forms"), F.count_if(F.col("bad").isNull()).alias("without_critical_error"))
    return out.withColumn("share", safe_ratio(F.col("without_critical_error"), F.col("forms")))


@metric("character_error_rate")
def character_error_rate(cells: DataFrame) -> DataFrame:
    """key (overall, critical, minor), edits, characters, rate: a ratio of sums."""
    rows = _texts(cells).select(group_of().alias("grp"), "edit_distance", "reference_length")
    out = rows.rollup("grp").agg(F.grouping("grp").alias("all"), F.sum("edit_distance").alias("edits"), F.sum("reference_length").alias("characters"))
    key = F.when(F.col("all") == 1, "overall").otherwise(F.col("grp"))
    return out.select(key.alias("key"), F.coalesce("edits", F.lit(0)).alias("edits"), F.coalesce("characters", F.lit(0)).alias("characters"), safe_ratio(F.col("edits"), F.col("characters")).alias("rate"))


@metric("checkbox_score")
def checkbox_score(cells: DataFrame) -> DataFrame:
    """Ticks found, missed and extra, precision, recall, and how often the written count is right."""
    none = F.array().cast("array<int>")
    want, got = F.coalesce("expected_ticks", none), F.coalesce("predicted_ticks", none)
    tick, count = F.col("kind") == S.TICKS, F.col("kind") == S.TICK_COUNT
    total = lambda x: F.coalesce(F.sum(F.when(tick, F.size(x))), F.lit(0)).cast("long")
    out = cells.where(F.col("kind").isin(S.TICKS, S.TICK_COUNT)).agg(
        total(F.array_intersect(want, got)).alias("ticks_found"),
        total(F.array_except(want, got)).alias("ticks_missed"),
        total(F.array_except(got, want)).alias("ticks_extra"),
        F.count_if(count & F.col("correct")).alias("tick_count_correct"),
        F.count_if(count).alias("tick_count_total"),
    )
    found = F.col("ticks_found")
    return out.withColumns({"precision": safe_ratio(found, found + F.col("ticks_extra")), "recall": safe_ratio(found, found + F.col("ticks_missed"))})


@metric("category_accuracy")
def category_accuracy(cells: DataFrame, order: tuple[str, ...] = ("form_id", "position")) -> DataFrame:
    """Per field: correct, total, accuracy, the commonest expected answer (of equals the first met) and its share."""
    rows = cells.where(F.col("kind") == S.CATEGORY)
    answers = rows.groupBy("name", F.col("expected_text").alias("answer")).agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("ok"), F.min(F.struct(*order)).alias("first"))
    best = F.struct((-F.col("n")).alias("n"), "first", "answer")
    out = answers.groupBy("name").agg(F.sum("ok").alias("correct"), F.sum("n").alias("total"), F.min(best).alias("top"))
    return out.select("name", "correct", "total", safe_ratio(F.col("correct"), F.col("total")).alias("accuracy"), F.col("top.answer").alias("most_common_answer"), safe_ratio(-F.col("top.n"), F.col("total")).alias("guess_most_common_accuracy"))


@metric("cost_and_time")
def cost_and_time(forms: DataFrame, input_price: float, output_price: float) -> DataFrame:
    """Over forms with usage (input_tokens, output_tokens, seconds): sums, dollars, mean and nearest-rank 95th percentile."""
    used = forms.where(F.col("input_tokens").isNotNull())
    dollars = (F.col("input_tokens") * input_price + F.col("output_tokens") * output_price) / 1e6
    return used.agg(
        F.count(F.lit(1)).alias("forms_measured"),
        F.sum("input_tokens").cast("long").alias("input_tokens"),
        F.sum("output_tokens").cast("long").alias("output_tokens"),
        F.sum(dollars).alias("dollars_total"),
        F.avg(dollars).alias("dollars_per_form"),
        F.avg("seconds").alias("seconds_mean"),
        F.expr("percentile_disc(0.95) within group (order by seconds)").alias("seconds_p95"),
    )


def _contributions(cells: DataFrame) -> DataFrame:
    """What cells and forms add to the metrics, as (metric, key, sums): one aggregate over the cells, by two grouping sets.

    One set is by field and, for closed fields, expected answer; the other by form, which tells the forms with a critical error.
    """
    none = F.array().cast("array<int>")
    want, got = F.coalesce("expected_ticks", none), F.coalesce("predicted_ticks", none)
    rows = cells.withColumns({"answer": F.when(F.col("kind") == S.CATEGORY, F.col("expected_text")), "bad": (F.col("kind") == S.CRITICAL) & ~F.col("correct")})
    ticks = lambda x: F.sum(F.when(F.col("kind") == S.TICKS, F.size(x)))
    groups = rows.groupingSets([["name", "kind", "answer"], ["form_id"]], "name", "kind", "answer", "form_id").agg(
        F.grouping("form_id").alias("by_field"),
        F.count(F.lit(1)).alias("n"),
        F.count_if("correct").alias("ok"),
        F.sum("edit_distance").alias("edits"),
        F.sum("reference_length").alias("characters"),
        ticks(F.array_intersect(want, got)).alias("found"),
        ticks(F.array_except(want, got)).alias("missed"),
        ticks(F.array_except(got, want)).alias("extra"),
        F.max("bad").alias("bad"),
        F.min(F.struct("form_id", "position")).alias("first"),
    )
    kind = F.col("kind")
    to = lambda name, key: F.struct(F.lit(name).alias("metric"), key.alias("key"))
    empty = F.lit("")
    text = F.array(to("field_accuracy", F.concat(F.lit("group:"), group_of())), to("field_accuracy", F.concat(F.lit("field:"), F.col("name"))), to("character_error_rate", F.lit("overall")), to("character_error_rate", group_of()))
    goes_to = F.when(F.col("by_field") == 0, F.array(to("forms_without_critical_error", empty))).when(kind.isin(*S.TEXT_KINDS), text)
    goes_to = goes_to.when(kind == S.CATEGORY, F.array(to("category_accuracy", F.col("name")))).otherwise(F.array(to("checkbox_score", empty)))
    parts = groups.select(F.explode(goes_to).alias("to"), "*")
    count = kind == S.TICK_COUNT
    return parts.groupBy("to.metric", "to.key").agg(
        F.sum("n").alias("n"),
        F.sum("ok").alias("ok"),
        F.sum("edits").alias("edits"),
        F.sum("characters").alias("characters"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("found", "missed", "extra")],
        F.coalesce(F.sum(F.when(count, F.col("ok"))), F.lit(0)).alias("count_ok"),
        F.coalesce(F.sum(F.when(count, F.col("n"))), F.lit(0)).alias("count_n"),
        F.count(F.lit(1)).alias("groups"),
        F.count_if("bad").alias("bad"),
        F.min(F.when(kind == S.CATEGORY, F.struct((-F.col("n")).alias("n"), "first", "answer"))).alias("top"),
    )


#: Measures that are counts; the others are ratios, dollars or seconds.
COUNTS = frozenset(["forms", "forms_with_output", "correct", "total", "without_critical_error", "edits", "characters", "ticks_found", "ticks_missed", "ticks_extra", "tick_count_correct", "tick_count_total", "forms_measured", "input_tokens", "output_tokens"])


def measures(cells: DataFrame, forms: DataFrame, input_price: float, output_price: float) -> DataFrame:
    """All metrics as rows (metric, key, measure, value, text): one pass over the cells and one over the forms."""
    c = F.col
    of = {
        "field_accuracy": {"correct": c("ok"), "total": c("n"), "accuracy": safe_ratio(c("ok"), c("n"))},
        "forms_without_critical_error": {"forms": c("groups"), "without_critical_error": c("groups") - c("bad"), "share": safe_ratio(c("groups") - c("bad"), c("groups"))},
        "character_error_rate": {"edits": c("edits"), "characters": c("characters"), "rate": safe_ratio(c("edits"), c("characters"))},
        "checkbox_score": {"ticks_found": c("found"), "ticks_missed": c("missed"), "ticks_extra": c("extra"), "tick_count_correct": c("count_ok"), "tick_count_total": c("count_n"), "precision": safe_ratio(c("found"), c("found") + c("extra")), "recall": safe_ratio(c("found"), c("found") + c("missed"))},
        "category_accuracy": {"correct": c("ok"), "total": c("n"), "accuracy": safe_ratio(c("ok"), c("n")), "guess_most_common_accuracy": safe_ratio(-c("top.n"), c("n"))},
    }
    answer = c("top.answer")
    pair = lambda name, value, text=None: F.struct(F.lit(name).alias("measure"), value.cast("double").alias("value"), (F.lit(None).cast("string") if text is None else text).alias("text"))
    rows = None
    for name, some in of.items():
        listed = F.array(*[pair(m, v, answer if name == "category_accuracy" else None) for m, v in some.items()])
        rows = F.when(c("metric") == name, listed) if rows is None else rows.when(c("metric") == name, listed)
    scored = _contributions(cells).select("metric", "key", F.explode(rows).alias("m")).select("metric", "key", "m.*")

    used = c("input_tokens").isNotNull()
    dollars = (F.when(used, c("input_tokens")) * input_price + c("output_tokens") * output_price) / 1e6
    totals = forms.withColumns({"_used": used, "_dollars": dollars, "_seconds": F.when(used, c("seconds"))}).agg(
        F.count(F.lit(1)).alias("forms"), F.count_if("produced_output").alias("forms_with_output"), F.count_if("_used").alias("forms_measured"),
        F.sum("input_tokens").alias("input_tokens"), F.sum(F.when(c("_used"), c("output_tokens"))).alias("output_tokens"), F.sum("_dollars").alias("dollars_total"), F.avg("_dollars").alias("dollars_per_form"),
        F.avg("_seconds").alias("seconds_mean"), F.expr("percentile_disc(0.95) within group (order by _seconds)").alias("seconds_p95"),
    )
    both = [F.struct(F.lit("run" if m in ("forms", "forms_with_output") else "cost_and_time").alias("metric"), F.lit("").alias("key"), pair(m, c(m)).alias("m")) for m in totals.columns]
    usage = totals.select(F.explode(F.array(*both)).alias("x")).select("x.metric", "x.key", "x.m.*")
    return usage.unionByName(scored)


def summary(cells: DataFrame, forms: DataFrame, input_price: float, output_price: float) -> DataFrame:
    """All metrics as rows (metric, key, measure, value)."""
    return measures(cells, forms, input_price, output_price).drop("text")


def summary_document(cells: DataFrame, forms: DataFrame, input_price: float, output_price: float) -> dict:
    """The summary as the nested document that a run writes, from one action; only metric rows (a few per field) reach the driver."""
    found: dict[str, dict[str, dict]] = {}
    for r in measures(cells, forms, input_price, output_price).collect():
        entry = found.setdefault(r.metric, {}).setdefault(r.key, {})
        entry[r.measure] = int(r.value) if r.measure in COUNTS and r.value is not None else r.value
        if r.metric == "category_accuracy":
            entry["most_common_answer"] = r.text
    accuracy, rates = found.get("field_accuracy", {}), found.get("character_error_rate", {})
    score = lambda key: accuracy.get(key, {"correct": 0, "total": 0, "accuracy": None})
    cost = found["cost_and_time"][""]
    no_ticks = dict.fromkeys(("ticks_found", "ticks_missed", "ticks_extra", "tick_count_correct", "tick_count_total"), 0) | {"precision": None, "recall": None}
    return found["run"][""] | {
        "field_accuracy": {"critical": score("group:critical"), "minor": score("group:minor"), "per_field": {k.partition(":")[2]: accuracy[k] for k in sorted(accuracy) if k.startswith("field:")}},
        "forms_without_critical_error": found.get("forms_without_critical_error", {}).get("", {"forms": 0, "without_critical_error": 0, "share": None}),
        "character_error_rate": {k: rates.get(k, {"edits": 0, "characters": 0, "rate": None}) for k in ("overall", "critical", "minor")},
        "checkbox_score": found.get("checkbox_score", {}).get("", no_ticks),
        "category_accuracy": dict(sorted(found.get("category_accuracy", {}).items())),
        "cost_and_time": cost if cost["forms_measured"] else {"forms_measured": 0},
    }
