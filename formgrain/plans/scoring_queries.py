"""Queries over the form view: cells, metrics, splits, reuse, repair, overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formgrain import schema as S
from formgrain.functions import text as X
from formgrain.operators import analysis, metrics, ordering, overlay, scoring
from formgrain.operators import repair as R
from formgrain.plans import views as V

PRICES = 0.15, 0.60  # dollars per million tokens in and out

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that checks it."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return V.cells(V.forms(spark, sf))


def _ticks(c: str) -> F.Column:
    """Arrays as text, so that both engines hash them alike."""
    return F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ",").alias(c)


@query(V.WITH_CELLS + """ SELECT form_id, path, name, kind, expected_text, predicted_text, array_to_string(expected_ticks, ',') AS expected_ticks,
 array_to_string(predicted_ticks, ',') AS predicted_ticks, expected_int, predicted_int, correct, edit_distance, reference_length FROM cells""")
def cells(spark, sf):
    joined = V.cells(V.forms(spark, sf))
    return joined.select("form_id", "path", "name", "kind", "expected_text", "predicted_text", _ticks("expected_ticks"), _ticks("predicted_ticks"), "expected_int", "predicted_int", "correct", "edit_distance", "reference_length")


_GROUP = "CASE WHEN kind = 'critical_text' THEN 'critical' ELSE 'minor' END"
_TEXT = "kind IN ('critical_text', 'minor_text')"


@query(V.WITH_CELLS + f""", x AS (SELECT 'group' AS scope, {_GROUP} AS key, correct FROM cells WHERE {_TEXT} UNION ALL SELECT 'field', name, correct FROM cells WHERE {_TEXT})
SELECT scope, key, CAST(count(*) FILTER (correct) AS BIGINT) AS correct, count(*) AS total, count(*) FILTER (correct) / count(*)::DOUBLE AS accuracy FROM x GROUP BY ALL""")
def field_accuracy(spark, sf):
    return metrics.field_accuracy(_cells(spark, sf))


@query(V.WITH_CELLS + f""", x AS (SELECT 'overall' AS key, * FROM cells WHERE {_TEXT} UNION ALL SELECT {_GROUP}, * FROM cells WHERE {_TEXT})
SELECT key, CAST(sum(edit_distance) AS BIGINT) AS edits, CAST(sum(reference_length) AS BIGINT) AS characters, sum(edit_distance) / sum(reference_length)::DOUBLE AS rate FROM x GROUP BY key""")
def character_error_rate(spark, sf):
    return metrics.character_error_rate(_cells(spark, sf))


@query(V.WITH_CELLS + """, f AS (SELECT form_id, coalesce(bool_and(correct) FILTER (kind = 'critical_text'), true) AS clean FROM cells GROUP BY 1)
SELECT count(*) AS forms, count(*) FILTER (clean) AS without_critical_error, count(*) FILTER (clean) / count(*)::DOUBLE AS share FROM f""")
def forms_without_critical_error(spark, sf):
    forms = V.forms(spark, sf)
    return metrics.forms_without_critical_error(V.cells(forms), forms)


_CHECKBOX = """SELECT CAST(sum(len(list_intersect(expected_ticks, coalesce(predicted_ticks, [])))) FILTER (kind = 'ticks') AS BIGINT) AS found,
  CAST(sum(len(expected_ticks) - len(list_intersect(expected_ticks, coalesce(predicted_ticks, [])))) FILTER (kind = 'ticks') AS BIGINT) AS missed,
  CAST(sum(len(coalesce(predicted_ticks, [])) - len(list_intersect(expected_ticks, coalesce(predicted_ticks, [])))) FILTER (kind = 'ticks') AS BIGINT) AS extra,
  count(*) FILTER (kind = 'tick_count' AND correct) AS tick_count_correct, count(*) FILTER (kind = 'tick_count') AS tick_count_total FROM cells"""


@query(V.WITH_CELLS + f""", x AS ({_CHECKBOX}) SELECT found AS ticks_found, missed AS ticks_missed, extra AS ticks_extra,
 tick_count_correct, tick_count_total, found / (found + extra)::DOUBLE AS precision, found / (found + missed)::DOUBLE AS recall FROM x""")
def checkbox_score(spark, sf):
    return metrics.checkbox_score(_cells(spark, sf))


_CATEGORY = """c AS (SELECT name, expected_text AS answer, count(*) AS n, count(*) FILTER (correct) AS ok, min(form_id) AS first FROM cells WHERE kind = 'category' GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, first) AS rn FROM c),
category AS (SELECT name, CAST(sum(ok) AS BIGINT) AS correct, CAST(sum(n) AS BIGINT) AS total, sum(ok) / sum(n)::DOUBLE AS accuracy, max(answer) FILTER (rn = 1) AS most_common_answer, max(n) FILTER (rn = 1) / sum(n)::DOUBLE AS guess_most_common_accuracy FROM r GROUP BY name)"""


@query(V.WITH_CELLS + f", {_CATEGORY} SELECT * FROM category")
def category_accuracy(spark, sf):
    return metrics.category_accuracy(_cells(spark, sf))


_DOLLARS = f"(input_tokens * {PRICES[0]}::DOUBLE + output_tokens * {PRICES[1]}::DOUBLE) / 1000000.0::DOUBLE"
_COST = f"""SELECT count(*) AS forms_measured, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
 round(sum({_DOLLARS}), 6) AS dollars_total, round(avg({_DOLLARS}), 9) AS dollars_per_form, round(avg(seconds), 6) AS seconds_mean, percentile_disc(0.95) WITHIN GROUP (ORDER BY seconds) AS seconds_p95 FROM pred"""


@query(V.WITH_PRED + " " + _COST)
def cost_and_time(spark, sf):
    out = metrics.cost_and_time(V.forms(spark, sf), *PRICES)
    return out.withColumns({"dollars_total": F.round("dollars_total", 6), "dollars_per_form": F.round("dollars_per_form", 9), "seconds_mean": F.round("seconds_mean", 6)})


def _tidy(metric: str, key: str, measures: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{metric}' AS metric, {key} AS key, '{m}' AS measure, CAST({e} AS DOUBLE) AS value FROM {source}" for m, e in measures.items())


_SUMMARY = [
    _tidy("run", "''", {"forms": "(SELECT count(*) FROM truth)", "forms_with_output": "(SELECT count(*) FROM pred)"}, "(SELECT 1) one"),
    _tidy("field_accuracy", "scope || ':' || key", {m: m for m in ("correct", "total", "accuracy")}, "accuracy"),
    _tidy("forms_without_critical_error", "''", {"forms": "forms", "without_critical_error": "clean", "share": "clean / forms::DOUBLE"}, "clean_forms"),
    _tidy("character_error_rate", "key", {m: m for m in ("edits", "characters", "rate")}, "rates"),
    _tidy("checkbox_score", "''", {"ticks_found": "found", "ticks_missed": "missed", "ticks_extra": "extra", "tick_count_correct": "tick_count_correct", "tick_count_total": "tick_count_total", "precision": "found / (found + extra)::DOUBLE", "recall": "found / (found + missed)::DOUBLE"}, "boxes"),
    _tidy("category_accuracy", "name", {m: m for m in ("correct", "total", "accuracy", "guess_most_common_accuracy")}, "category"),
    _tidy("cost_and_time", "''", {m: m for m in ("forms_measured", "input_tokens", "output_tokens", "dollars_total", "dollars_per_form", "seconds_mean", "seconds_p95")}, "cost"),
]


@query(V.WITH_CELLS + f""", x AS (SELECT 'group' AS scope, {_GROUP} AS key, correct FROM cells WHERE {_TEXT} UNION ALL SELECT 'field', name, correct FROM cells WHERE {_TEXT}),
accuracy AS (SELECT scope, key, count(*) FILTER (correct) AS correct, count(*) AS total, count(*) FILTER (correct) / count(*)::DOUBLE AS accuracy FROM x GROUP BY ALL),
f AS (SELECT form_id, coalesce(bool_and(correct) FILTER (kind = 'critical_text'), true) AS ok FROM cells GROUP BY 1),
clean_forms AS (SELECT count(*) AS forms, count(*) FILTER (ok) AS clean FROM f),
y AS (SELECT 'overall' AS key, * FROM cells WHERE {_TEXT} UNION ALL SELECT {_GROUP}, * FROM cells WHERE {_TEXT}),
rates AS (SELECT key, sum(edit_distance) AS edits, sum(reference_length) AS characters, sum(edit_distance) / sum(reference_length)::DOUBLE AS rate FROM y GROUP BY key),
boxes AS ({_CHECKBOX}), {_CATEGORY}, cost AS ({_COST}), s AS ({' UNION ALL '.join(_SUMMARY)})
SELECT metric, key, measure, round(value, 6) AS value FROM s""")
def summary(spark, sf):
    """All metrics of a run as rows: the flagship."""
    forms = V.forms(spark, sf)
    return metrics.summary(V.cells(forms), forms, *PRICES).withColumn("value", F.round("value", 6))


# ------------------------------------------------------------------------------------------- splits and reuse


@query(f"WITH {V.TRUTH_SQL} SELECT form_id, split FROM truth QUALIFY row_number() OVER (PARTITION BY split ORDER BY form_id) <= 20")
def first_per_split(spark, sf):
    """The first twenty forms of each split (a limit is the operator)."""
    return ordering.first_of_each(_splits(spark, sf), "split", ["form_id"], 20)


def _splits(spark, sf):
    return V.table(spark, sf, "orders").select(F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("form_id"), F.when(F.col("o_orderkey") % 5 == 0, "dev").otherwise("test").alias("split"))


@query(f"WITH {V.TRUTH_SQL} SELECT form_id, split, row_number() OVER (ORDER BY split, form_id) AS position FROM truth")
def form_position(spark, sf):
    return ordering.numbered(_splits(spark, sf), [F.col("split"), F.col("form_id")])


@query(f"WITH {V.TRUTH_SQL} SELECT DISTINCT split FROM truth")
def splits(spark, sf):
    return _splits(spark, sf).select("split").distinct()


@query(f"WITH {V.TRUTH_SQL} SELECT form_id, split, CASE split WHEN 'dev' THEN 0 ELSE 1 END AS split_rank FROM truth")
def union_splits(spark, sf):
    """Dev forms, then test forms, as a bag union with a rank."""
    rows = _splits(spark, sf)
    part = lambda s, i: rows.where(F.col("split") == s).withColumn("split_rank", F.lit(i))
    return part("dev", 0).unionByName(part("test", 1))


_DONE = "done AS (SELECT form_id FROM truth WHERE k % 4 = 0 INTERSECT SELECT form_id FROM truth WHERE k % 6 = 0)"


def _reuse(spark, sf):
    """A step that needs two artifacts is done where both are there."""
    rows = V.table(spark, sf, "orders").select("o_orderkey", F.lpad(F.col("o_orderkey").cast("string"), 8, "0").alias("form_id"))
    text, usage = rows.where("o_orderkey % 4 = 0").select("form_id"), rows.where("o_orderkey % 6 = 0").select("form_id")
    return overlay.reuse(rows.select("form_id"), text.join(usage, "form_id", "left_semi"))


@query(f"WITH {V.TRUTH_SQL}, {_DONE} SELECT form_id FROM truth WHERE form_id NOT IN (SELECT form_id FROM done)")
def reuse_todo(spark, sf):
    return _reuse(spark, sf)[0]


@query(f"WITH {V.TRUTH_SQL}, {_DONE} SELECT form_id FROM done")
def reuse_done(spark, sf):
    return _reuse(spark, sf)[1]


# ------------------------------------------------------------------------------------------------------ repair

RULES = ("validity-dates", "phone-digits", "policy-spaces", "attestation-format")


def _records(spark, sf, keep=()):
    """Predictions as nested records: the view's vehicle fields are those of vehicle A. ``keep``: columns of the truth."""
    guess = V.corrupted()
    rows = V.truth(spark, sf).where(~V.every(97)).select("k", "form_id", *keep, *[guess[n].alias(n) for n in V.NAMES])
    has = set(V.NAMES)
    top = [(F.col(n) if n in has else F.lit(None)).cast(S.field_type(n)).alias(n) for n in S.TOP_FIELDS]
    side = F.struct(*[(F.col(n) if n in has else F.lit(None)).cast(S.field_type(n)).alias(n) for n in S.VEHICLE_FIELDS])
    kept = [c for c in rows.columns if c.startswith("t_")]
    return rows.select("k", "form_id", *kept, F.struct(*top, side.alias("vehicle_a"), F.lit(None).cast(S.VEHICLE_SCHEMA).alias("vehicle_b")).alias("record"))


def _repaired(spark, sf):
    return R.repair(_records(spark, sf), RULES)


@query(V.WITH_PRED + r" SELECT form_id, regexp_replace(phone_a, '[\s.\-]', '', 'g') AS phone_a FROM pred")
def repair_phone(spark, sf):
    return R.repair(_records(spark, sf), ["phone-digits"]).select("form_id", "record.phone_a")


@query(V.WITH_PRED + r" SELECT form_id, regexp_replace(policy_no, '\s', '', 'g') AS policy_no FROM pred")
def repair_policy(spark, sf):
    return R.repair(_records(spark, sf), ["policy-spaces"]).select("form_id", "record.vehicle_a.policy_no")


_ATTESTATION = r"CASE WHEN regexp_full_match(replace(attestation_no, ' ', ''), '\d{2}[A-Za-z]\d+') THEN upper(left(replace(attestation_no, ' ', ''), 3)) || ' ' || substr(replace(attestation_no, ' ', ''), 4) ELSE attestation_no END"


@query(V.WITH_PRED + f" SELECT form_id, {_ATTESTATION} AS attestation_no FROM pred")
def repair_attestation(spark, sf):
    return R.repair(_records(spark, sf), ["attestation-format"]).select("form_id", "record.vehicle_a.attestation_no")


_SWAP = "coalesce(try_strptime(valid_from, '%d/%m/%Y') > try_strptime(valid_to, '%d/%m/%Y'), false)"


@query(V.WITH_PRED + f" SELECT form_id, CASE WHEN {_SWAP} THEN valid_to ELSE valid_from END AS valid_from, CASE WHEN {_SWAP} THEN valid_from ELSE valid_to END AS valid_to FROM pred")
def repair_dates(spark, sf):
    return R.repair(_records(spark, sf), ["validity-dates"]).select("form_id", "record.vehicle_a.valid_from", "record.vehicle_a.valid_to")


_FIXED = rf"""fixed AS (SELECT form_id, k, date, policy_no AS policy_0, insurer, place, vehicle_type, other_damage, circumstances, circumstance_count,
  valid_from AS from_0, valid_to AS to_0, attestation_no AS attestation_0, phone_a AS phone_0, regexp_replace(policy_no, '\s', '', 'g') AS policy_no,
  CASE WHEN {_SWAP} THEN valid_to ELSE valid_from END AS valid_from, CASE WHEN {_SWAP} THEN valid_from ELSE valid_to END AS valid_to,
  {_ATTESTATION} AS attestation_no, regexp_replace(phone_a, '[\s.\-]', '', 'g') AS phone_a FROM pred),
changed AS (
  SELECT form_id, 'validity-dates' AS rule, 'vehicle_a.valid_from' AS path, from_0 AS before, valid_from AS after FROM fixed
  UNION ALL SELECT form_id, 'validity-dates', 'vehicle_a.valid_to', to_0, valid_to FROM fixed
  UNION ALL SELECT form_id, 'phone-digits', 'phone_a', phone_0, phone_a FROM fixed
  UNION ALL SELECT form_id, 'policy-spaces', 'vehicle_a.policy_no', policy_0, policy_no FROM fixed
  UNION ALL SELECT form_id, 'attestation-format', 'vehicle_a.attestation_no', attestation_0, attestation_no FROM fixed)"""


@query(V.WITH_PRED + f", {_FIXED} SELECT * FROM changed WHERE before IS DISTINCT FROM after")
def repair_changes(spark, sf):
    return R.changes(_repaired(spark, sf)).drop("step")


@query(V.WITH_CELLS + f""", {_FIXED}, c AS (SELECT form_id, rule, replace(path, 'vehicle_a.', '') AS name, {V._norm('after')} AS after FROM changed WHERE before IS DISTINCT FROM after)
SELECT rule, count(*) AS changed, count(*) FILTER (NOT correct AND after = expected_text) AS became_right, count(*) FILTER (correct AND after <> expected_text) AS became_wrong,
 count(*) FILTER (correct = (after = expected_text)) AS no_effect FROM c JOIN cells USING (form_id, name) GROUP BY rule""")
def changes_per_rule(spark, sf):
    truth = {n if n in S.TOP_FIELDS else f"vehicle_a.{n}": F.col(f"t_{n}") for n, k in V.FIELDS if k in S.TEXT_KINDS}
    key = F.create_map(*[x for p, c in truth.items() for x in (F.lit(p), c)])
    rows = R.repair(_records(spark, sf, keep=[F.col(n).alias(f"t_{n}") for n in V.NAMES]), RULES).withColumn("key", key)
    changed = R.changes(rows, ("form_id", "key"))
    return R.per_rule(changed.withColumn("expected_text", X.normalize(F.col("key")[F.col("path")])))


# ---------------------------------------------------------------------------------------------------- overlays


@query(V.WITH_PRED + """ SELECT form_id, vehicle_type AS type_a, array_to_string(coalesce(circumstances, []), ',') AS ticks_a, CAST(len(coalesce(circumstances, [])) AS INTEGER) AS count_a,
 place, 'car' AS type_b, 'rear' AS zone_b, '5,9' AS ticks_b, 2 AS count_b, k % 3 = 0 AS other_damage FROM pred""")
def marks_overlay(spark, sf):
    """Marks over records whose vehicle B is absent: it is made."""
    rows = _records(spark, sf)
    none = F.array().cast("array<int>")
    mark = lambda t, z, c: F.struct(t.alias("vehicle_type"), F.lit(None).cast("string").alias("license_category"), F.lit(z).alias("impact_zone"), c.alias("circumstances"))
    marks = F.struct(mark(F.col("record.vehicle_a.vehicle_type"), "front", F.coalesce("record.vehicle_a.circumstances", none)).alias("vehicle_a"), mark(F.lit("car"), "rear", F.array(F.lit(5), F.lit(9))).alias("vehicle_b"), (F.col("k") % 3 == 0).alias("other_damage"))
    out = rows.select("form_id", overlay.marks_overlay(F.col("record"), marks).alias("r"))
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select("form_id", F.col("r.vehicle_a.vehicle_type").alias("type_a"), join(F.col("r.vehicle_a.circumstances")).alias("ticks_a"), F.col("r.vehicle_a.circumstance_count").alias("count_a"), "r.place", F.col("r.vehicle_b.vehicle_type").alias("type_b"), F.col("r.vehicle_b.impact_zone").alias("zone_b"), join(F.col("r.vehicle_b.circumstances")).alias("ticks_b"), F.col("r.vehicle_b.circumstance_count").alias("count_b"), "r.other_damage")


_READ = "CASE WHEN k % 5 = 0 THEN '   ' WHEN k % 5 = 1 THEN NULL WHEN k % 5 = 2 THEN policy_no ELSE ' ' || t_policy || ' ' END"


@query(V.WITH_PRED + f""", r AS (SELECT p.form_id, p.policy_no, trim({_READ.replace('policy_no', 'p.policy_no').replace('k %', 'p.k %').replace('t_policy', 't.policy_no')}) AS v FROM pred p JOIN truth t USING (form_id)),
a AS (SELECT form_id, policy_no, CASE WHEN v <> '' AND v IS DISTINCT FROM policy_no THEN v END AS v FROM r)
SELECT form_id, coalesce(v, policy_no) AS policy_no, CAST(v IS NOT NULL AS INTEGER) AS n_changes, policy_no AS before FROM a""")
def refine_overlay(spark, sf):
    """Re-read policy numbers: blank, missing, equal and new answers."""
    rows = _records(spark, sf).join(V.truth(spark, sf).select("form_id", F.col("policy_no").alias("t_policy")), "form_id")
    now = F.col("record.vehicle_a.policy_no")
    read = F.expr(_READ.replace("policy_no", "record.vehicle_a.policy_no"))
    record, changed = overlay.refine_overlay(F.col("record"), {"vehicle_a.policy_no": read})
    return rows.select("form_id", record["vehicle_a"]["policy_no"].alias("policy_no"), F.size(changed).alias("n_changes"), now.alias("before"))


@query("""WITH s AS (SELECT l_orderkey, list(l_discount * 2 ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS s FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_filter(range(1, len(s) + 1), lambda i: s[i] >= 0.14), ',') AS ticks FROM s""")
def tick_threshold(spark, sf):
    lines = V.table(spark, sf, "lineitem")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", (F.col("l_discount") * 2).alias("s"))
    scores = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["s"]).alias("s"))
    return scores.select("l_orderkey", F.array_join(F.transform(overlay.ticks(F.col("s")), lambda x: x.cast("string")), ",").alias("ticks"))


_ZONES = ", ".join(f"({i}, '{n}', {a}, {b}, {c}, {d})" for i, (n, (a, b, c, d)) in enumerate(overlay.ZONES))


@query(f"""WITH z(i, zone, a, b, c, d) AS (VALUES {_ZONES}), p AS (SELECT p_partkey, p_partkey % 180 AS x0, p_partkey * 7 % 280 AS y0, p_partkey % 180 + 10 + p_size AS x1, p_partkey * 7 % 280 + 20 + p_size AS y1 FROM part),
s AS (SELECT *, greatest(0, least(x1, c) - greatest(x0, a)) * greatest(0, least(y1, d) - greatest(y0, b)) AS shared FROM p, z),
r AS (SELECT *, shared / ((x1 - x0) * (y1 - y0) + (c - a) * (d - b) - shared)::DOUBLE AS iou FROM s)
SELECT p_partkey, zone FROM r QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY iou DESC, i) = 1""")
def zone_iou(spark, sf):
    p = V.table(spark, sf, "part")
    x, y = (F.col("p_partkey") % 180).cast("double"), (F.col("p_partkey") * 7 % 280).cast("double")
    return p.select("p_partkey", overlay.best_zone((x, y, x + 10 + F.col("p_size"), y + 20 + F.col("p_size"))).alias("zone"))


# ---------------------------------------------------------------------------------------------------- analysis

_NOTE = "upper(place) || ' ' || CASE WHEN k % 2 = 0 THEN insurer ELSE lower(insurer) || '.' END || CASE WHEN k % 3 = 0 THEN ' ' || policy_no ELSE '' END || ' ' || date"


def _texts(spark, sf):
    """A text for each form, with some of its values."""
    return V.truth(spark, sf).select("form_id", F.expr(_NOTE).alias("text"))


def _compact(x: str) -> str:
    return f"replace({V._norm(x)}, ' ', '')"


@query(V.WITH_CELLS + f""", t AS (SELECT form_id, {_NOTE} AS text FROM truth),
r AS (SELECT {_GROUP} || '/top' AS grp, CASE WHEN correct THEN 'correct' WHEN NOT contains({_compact('text')}, {_compact('expected_text')}) THEN 'value not in the OCR text'
  WHEN predicted_text IS NULL THEN 'in the OCR text, no value returned' ELSE 'in the OCR text, wrong value returned' END AS outcome FROM cells JOIN t USING (form_id) WHERE {_TEXT})
SELECT grp, outcome, count(*) AS cells FROM r GROUP BY ALL""")
def attribution(spark, sf):
    return analysis.attribution(_cells(spark, sf), _texts(spark, sf))


@query(V.WITH_CELLS + f""", b AS (SELECT CASE WHEN predicted_text IS NULL THEN 'no value returned' WHEN edit_distance = 1 THEN '1 edit' WHEN edit_distance = 2 THEN '2 edits' ELSE '3 or more edits' END AS bucket FROM cells WHERE {_TEXT} AND NOT correct)
SELECT bucket, count(*) AS n, count(*) / (SELECT count(*) FROM b)::DOUBLE AS share FROM b GROUP BY bucket""")
def near_miss_final(spark, sf):
    wrong = _cells(spark, sf).where(F.col("kind").isin(*S.TEXT_KINDS) & ~F.col("correct"))
    return analysis.histogram(wrong.select(analysis.final_bucket(F.col("predicted_text"), F.col("edit_distance")).alias("final")), "final")


def _stretch_sql(value: str, text: str) -> str:
    """Edits to the best stretch of a text, 3 for more: one that is at most 2 edits away is at most 2 longer or shorter than the value."""
    stretch = f"list_min(list_transform(range(1, length({text}) + 1), lambda i: list_min(list_transform(range(greatest(length({value}) - 2, 0), length({value}) + 3), lambda n: levenshtein({value}, substr({text}, i, n))))))"
    return f"least(3, length({value}), coalesce({stretch}, 3))"


@query(V.WITH_CELLS + f""", t AS (SELECT form_id, {_NOTE} AS text FROM truth),
w AS (SELECT name, {_compact('expected_text')} AS want, {_compact('text')} AS have, regexp_replace({V._norm('expected_text')}, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS want_letters, regexp_replace({V._norm('text')}, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS have_letters
  FROM cells JOIN t USING (form_id) WHERE {_TEXT} AND NOT correct),
b AS (SELECT name, CASE WHEN contains(have, want) THEN 0 WHEN contains(have_letters, want_letters) THEN 1 ELSE 1 + {_stretch_sql('want', 'have')} END AS near FROM w)
SELECT name, count(*) AS wrong, count(*) FILTER (near = 0) AS exact, count(*) FILTER (near = 1) AS punctuation, count(*) FILTER (near IN (2, 3)) AS near, count(*) FILTER (near > 3) AS far FROM b GROUP BY name""")
def near_miss_text(spark, sf):
    """Wrong cells by field and closeness to the text (exact distances, in Arrow batches)."""
    return analysis.per_field(analysis.near_misses(_cells(spark, sf), _texts(spark, sf)))


_MARKED = "('circumstances', 'vehicle_type', 'circumstance_count', 'other_damage')"


@query(V.WITH_CELLS + f""", m AS (SELECT *, list_intersect(expected_ticks, coalesce(predicted_ticks, [])) AS shared, row_number() OVER (PARTITION BY name, correct ORDER BY form_id || ':' || path) AS rn FROM cells WHERE name IN {_MARKED})
SELECT name, count(*) FILTER (correct) AS right, count(*) AS total, CAST(coalesce(sum(len(shared)), 0) AS BIGINT) AS found, CAST(coalesce(sum(len(expected_ticks) - len(shared)), 0) AS BIGINT) AS missed,
 CAST(coalesce(sum(len(coalesce(predicted_ticks, [])) - len(shared)), 0) AS BIGINT) AS extra, string_agg(form_id || ':' || path, ' ' ORDER BY form_id) FILTER (NOT correct AND rn <= 5) AS first_wrong FROM m GROUP BY name""")
def marks_accuracy(spark, sf):
    return analysis.marks_accuracy(_cells(spark, sf))


@query(f"WITH {V.TRUTH_SQL} SELECT form_id, {V._norm('place')} AS normalised, {_compact('place')} AS compacted, regexp_replace({V._norm('place')}, '[^\\p{{L}}\\p{{N}}]', '', 'g') AS letters FROM truth")
def text_forms(spark, sf):
    rows = V.truth(spark, sf)
    return rows.select("form_id", X.normalize(F.col("place")).alias("normalised"), X.compact(F.col("place")).alias("compacted"), X.letters_and_digits(F.col("place")).alias("letters"))
