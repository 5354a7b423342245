"""Form-shaped views of the relational tables, for queries and benchmarks: a truth, a deterministic corruption of it, and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formgrain import schema as S
from formgrain.operators.scoring import cells as make_cells

#: (path, kind) of the view's cells, in order.
FIELDS = [
    ("date", S.CRITICAL), ("policy_no", S.CRITICAL), ("insurer", S.CRITICAL), ("place", S.MINOR), ("vehicle_type", S.CATEGORY),
    ("other_damage", S.CATEGORY), ("circumstances", S.TICKS), ("circumstance_count", S.TICK_COUNT), ("valid_from", S.CRITICAL),
    ("valid_to", S.CRITICAL), ("attestation_no", S.CRITICAL), ("phone_a", S.MINOR),
]
NAMES = [p for p, _ in FIELDS]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def every(n: int, rest: int = 0) -> Column:
    return F.col("k") % n == rest


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order; its tick set is aggregated before the join, on the join's key."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_set("l_linenumber")).alias("t"))  # a set of at most 7
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment"), "o_custkey").join(lines, "o_orderkey", "left")
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    ticks = F.coalesce("t", F.array().cast("array<int>"))
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return rows.select(
        k.alias("k"),
        pad(k, 8).alias("form_id"),
        F.when(k % 5 == 0, "dev").otherwise("test").alias("split"),
        F.date_format(day, "dd/MM/yyyy").alias("date"),
        pad(F.col("o_custkey") * 7919 + k, 12).alias("policy_no"),
        F.col("c_mktsegment").alias("insurer"),
        F.col("c_name").alias("place"),
        F.col("o_orderpriority").alias("vehicle_type"),
        (F.col("o_orderstatus") == "F").alias("other_damage"),
        ticks.alias("circumstances"),
        F.size(ticks).alias("circumstance_count"),
        F.date_format(day, "dd/MM/yyyy").alias("valid_from"),
        F.date_format(F.date_add(day, 364), "dd/MM/yyyy").alias("valid_to"),
        F.concat((10 + k % 90).cast("string"), F.when(k % 2 == 0, "A").otherwise("B"), F.lit(" "), pad(k, 9)).alias("attestation_no"),
        F.concat(F.lit("06"), pad(k, 8)).alias("phone_a"),
        (1000 + k % 997).alias("input_tokens"),
        (100 + k % 89).alias("output_tokens"),
        ((k % 1000) / 10).alias("seconds"),
    )


def corrupted() -> dict[str, Column]:
    """What the prediction has for each field (over the truth's columns)."""
    c = F.col
    last = F.substring(c("date"), -1, 1).cast("int")
    swap = every(13)
    policy = F.when(every(17), F.concat(F.left(c("policy_no"), F.lit(6)), F.lit(" "), F.substring(c("policy_no"), 7, 99))).otherwise(c("policy_no"))
    ticks = F.concat(F.slice(c("circumstances"), 2, 99), F.array(F.lit(23)))
    none = F.lit(None)
    return {
        "date": F.when(every(7), F.concat(F.left(c("date"), F.lit(9)), ((last + 1) % 10).cast("string"))).otherwise(c("date")),
        "policy_no": F.when(~every(11), policy),
        "insurer": F.when(every(8, 3), F.substring(c("insurer"), 2, 99)).otherwise(c("insurer")),
        "place": F.when(every(3), F.concat(F.lit("  "), F.upper("place"))).otherwise(c("place")),
        "vehicle_type": F.when(every(23), "1-URGENT").otherwise(c("vehicle_type")),
        "other_damage": F.when(~every(29), c("other_damage")),
        "circumstances": F.when(every(31), none).when(every(2), ticks).otherwise(c("circumstances")),
        "circumstance_count": c("circumstance_count"),
        "valid_from": F.when(swap, c("valid_to")).otherwise(c("valid_from")),
        "valid_to": F.when(swap, c("valid_from")).otherwise(c("valid_to")),
        "attestation_no": F.when(every(19), F.lower(F.replace(c("attestation_no"), F.lit(" "), F.lit("")))).otherwise(c("attestation_no")),
        "phone_a": F.when(every(17), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.substring(c("phone_a"), 2 * i + 1, F.lit(2))), " ")).otherwise(c("phone_a")),
    }


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corrupted view: fewer rows than the truth."""
    return truth(spark, sf_dir).where(~every(97)).select("k", "form_id", "split", *[v.alias(n) for n, v in corrupted().items()], "input_tokens", "output_tokens", "seconds")


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth left-joined with the prediction on form_id: form_id, split, produced_output, t_* and p_* of each field, usage (null without output)."""
    t = truth(spark, sf_dir)
    p = predictions(spark, sf_dir)
    left = t.select("k", "form_id", "split", *[F.col(n).alias(f"t_{n}") for n in NAMES])
    right = p.select("form_id", F.lit(True).alias("made"), *[F.col(n).alias(f"p_{n}") for n in NAMES], "input_tokens", "output_tokens", "seconds")
    return left.join(right, "form_id", "left").withColumn("produced_output", F.coalesce("made", F.lit(False))).drop("made")


def cells(joined: DataFrame) -> DataFrame:
    return make_cells(joined, [(n, k, F.col(f"t_{n}"), F.col(f"p_{n}")) for n, k in FIELDS])


# ------------------------------------------------------------------------------------------------------------- SQL

TRUTH_SQL = """l AS (SELECT l_orderkey, list_sort(list_distinct(list(CAST(l_linenumber AS INTEGER)))) AS t FROM lineitem GROUP BY 1),
truth AS (
  SELECT o_orderkey AS k, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS form_id, CASE WHEN o_orderkey % 5 = 0 THEN 'dev' ELSE 'test' END AS split,
    strftime(CAST(o_orderdate AS DATE), '%d/%m/%Y') AS date, lpad(CAST(o_custkey * 7919 + o_orderkey AS VARCHAR), 12, '0') AS policy_no,
    c_mktsegment AS insurer, c_name AS place, o_orderpriority AS vehicle_type, o_orderstatus = 'F' AS other_damage,
    coalesce(t, CAST([] AS INTEGER[])) AS circumstances, CAST(len(coalesce(t, CAST([] AS INTEGER[]))) AS INTEGER) AS circumstance_count,
    strftime(CAST(o_orderdate AS DATE), '%d/%m/%Y') AS valid_from, strftime(CAST(o_orderdate AS DATE) + 364, '%d/%m/%Y') AS valid_to,
    CAST(10 + o_orderkey % 90 AS VARCHAR) || CASE WHEN o_orderkey % 2 = 0 THEN 'A' ELSE 'B' END || ' ' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS attestation_no,
    '06' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS phone_a,
    1000 + o_orderkey % 997 AS input_tokens, 100 + o_orderkey % 89 AS output_tokens, (o_orderkey % 1000) / 10.0::DOUBLE AS seconds
  FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN l ON l_orderkey = o_orderkey)"""

PRED_SQL = """pred AS (
  SELECT k, form_id, split,
    CASE WHEN k % 7 = 0 THEN left(date, 9) || CAST((CAST(right(date, 1) AS INTEGER) + 1) % 10 AS VARCHAR) ELSE date END AS date,
    CASE WHEN k % 11 = 0 THEN NULL WHEN k % 17 = 0 THEN left(policy_no, 6) || ' ' || substr(policy_no, 7) ELSE policy_no END AS policy_no,
    CASE WHEN k % 8 = 3 THEN substr(insurer, 2) ELSE insurer END AS insurer,
    CASE WHEN k % 3 = 0 THEN '  ' || upper(place) ELSE place END AS place,
    CASE WHEN k % 23 = 0 THEN '1-URGENT' ELSE vehicle_type END AS vehicle_type,
    CASE WHEN k % 29 = 0 THEN NULL ELSE other_damage END AS other_damage,
    CASE WHEN k % 31 = 0 THEN NULL WHEN k % 2 = 0 THEN list_append(circumstances[2:], 23) ELSE circumstances END AS circumstances,
    circumstance_count,
    CASE WHEN k % 13 = 0 THEN valid_to ELSE valid_from END AS valid_from, CASE WHEN k % 13 = 0 THEN valid_from ELSE valid_to END AS valid_to,
    CASE WHEN k % 19 = 0 THEN lower(replace(attestation_no, ' ', '')) ELSE attestation_no END AS attestation_no,
    CASE WHEN k % 17 = 0 THEN phone_a[1:2] || ' ' || phone_a[3:4] || ' ' || phone_a[5:6] || ' ' || phone_a[7:8] || ' ' || phone_a[9:10] ELSE phone_a END AS phone_a,
    input_tokens, output_tokens, seconds
  FROM truth WHERE k % 97 <> 0)"""


def _norm(x: str) -> str:
    return f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"


def _cell_sql(i: int, name: str, kind: str) -> str:
    text = kind not in (S.TICKS, S.TICK_COUNT)
    want = _norm(f"CAST(t.{name} AS VARCHAR)") if text else "CAST(NULL AS VARCHAR)"
    got = _norm(f"CAST(p.{name} AS VARCHAR)") if text else "CAST(NULL AS VARCHAR)"
    ticks = [f"list_sort(list_distinct({a}.{name}))" if kind == S.TICKS else "CAST(NULL AS INTEGER[])" for a in "tp"]
    number = [f"{a}.{name}" if kind == S.TICK_COUNT else "CAST(NULL AS INTEGER)" for a in "tp"]
    return f"SELECT t.k, t.form_id, {i} AS position, '{name}' AS path, '{name}' AS name, '{kind}' AS kind, {want} AS expected_text, {got} AS predicted_text, {ticks[0]} AS expected_ticks, {ticks[1]} AS predicted_ticks, {number[0]} AS expected_int, {number[1]} AS predicted_int FROM truth t LEFT JOIN pred p USING (form_id)"


CELLS_SQL = f"""raw AS ({' UNION ALL '.join(_cell_sql(i, n, k) for i, (n, k) in enumerate(FIELDS))}),
cells AS (
  SELECT *, coalesce(CASE kind WHEN 'ticks' THEN expected_ticks = predicted_ticks WHEN 'tick_count' THEN expected_int = predicted_int ELSE expected_text = predicted_text END, false) AS correct,
    CAST(CASE WHEN kind NOT IN ('critical_text', 'minor_text') THEN 0 WHEN coalesce(predicted_text, '') = '' THEN length(expected_text) ELSE levenshtein(expected_text, predicted_text) END AS BIGINT) AS edit_distance,
    CAST(CASE WHEN kind NOT IN ('critical_text', 'minor_text') THEN 0 ELSE length(expected_text) END AS BIGINT) AS reference_length
  FROM raw)"""

WITH_PRED = f"WITH {TRUTH_SQL},\n{PRED_SQL}"
WITH_CELLS = f"{WITH_PRED},\n{CELLS_SQL}"
