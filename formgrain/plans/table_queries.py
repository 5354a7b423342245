"""Queries over the other tables: texts, pages, events, labels, geometry, digests and the synthetic source."""

from __future__ import annotations

from pyspark.sql import functions as F

from formgrain.functions import geometry as G
from formgrain.functions import text as X
from formgrain.operators import analysis, layout, ordering, scoring
from formgrain.plans.scoring_queries import query
from formgrain.plans.views import table
from formgrain.sources import generator


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def contained_items(spark, sf):
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("item"))
    return analysis.contained(table(spark, sf, "documents").select("doc_id", "text"), items)


_LOOPED = """len(list_filter(range(1, 251), lambda n: length({t}) >= n * (5 + 12 // n) AND right({t}, n * (5 + 12 // n)) = repeat(right({t}, n), 5 + 12 // n))) > 0"""
_TAIL = "t AS (SELECT *, right(text, 1250) AS a, CASE WHEN length(text) > 50 THEN right(left(text, length(text) - 50), 1250) ELSE '' END AS b FROM {})"


@query(f"WITH {_TAIL.format('documents')} SELECT doc_id, {_LOOPED.format(t='a')} AS repeats, {_LOOPED.format(t='a')} OR (length(text) > 50 AND {_LOOPED.format(t='b')}) AS looped FROM t")
def looped_documents(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", X.repeats(F.col("text")).alias("repeats"), X.looped(F.col("text")).alias("looped"))


@query(f"WITH {_TAIL.format('conversations')} SELECT conv_id, turn, {_LOOPED.format(t='a')} OR (length(text) > 50 AND {_LOOPED.format(t='b')}) AS looped FROM t")
def looped_turns(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", X.looped(F.col("text")).alias("looped"))


_BOX = "l_orderkey, l_extendedprice % 1000 / 1000.0 AS x, l_quantity / 50.0 AS y, CAST(l_partkey AS VARCHAR) AS text"
_ZONE = "CASE WHEN y < 0.17 THEN 'header' WHEN x < 0.31 THEN 'vehicle_a' WHEN x < 0.69 THEN 'circumstances' ELSE 'vehicle_b' END"


def _boxes(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", (F.floor("l_extendedprice") % 1000 / 1000.0).alias("x"), (F.col("l_quantity") / 50.0).alias("y"), F.col("l_partkey").cast("string").alias("text"))


_BOXES = "b AS (SELECT l_orderkey, CAST(floor(l_extendedprice) AS BIGINT) % 1000 / 1000.0::DOUBLE AS x, l_quantity / 50.0::DOUBLE AS y, CAST(l_partkey AS VARCHAR) AS text FROM lineitem)"
_BLOCK = "coalesce(string_agg(text, chr(10) ORDER BY y, x, text) FILTER (zone = '{}'), '')"


@query(f"WITH {_BOXES}, z AS (SELECT *, {_ZONE} AS zone FROM b) SELECT l_orderkey, " + " || chr(10) || chr(10) || ".join(f"'## {z}' || chr(10) || {_BLOCK.format(z)}" for z in layout.ZONES) + " AS page_text FROM z GROUP BY 1")
def zone_text(spark, sf):
    boxes = _boxes(spark, sf).withColumn("zone", layout.zone_of(F.col("x"), F.col("y"), 0.31, 0.69, 0.17))
    return layout.zone_text(boxes, ["l_orderkey"])


@query(f"WITH {_BOXES} SELECT l_orderkey, string_agg(text, ' ' ORDER BY y, x, text) AS words FROM b GROUP BY 1")
def reading_order(spark, sf):
    page = _boxes(spark, sf).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("y", "x", "text"))).alias("b"))
    return page.select("l_orderkey", F.array_join(F.transform("b", lambda x: x["text"]), " ").alias("words"))


_PART_HTML = """'<div data-bbox="' || (p_partkey % 900) || ' ' || (p_size * 10) || ' ' || (p_partkey % 900 + 50) || ' ' || (p_size * 10 + 20) || '"><p>' || p_name || '</p><p>  ' || p_brand || ' <b>' || p_type || '</b></p><input type="checkbox" checked> ' || p_size || '<table><tr><td>a</td><td>b</td></tr></table></div><div data-bbox="1 2 3 4">open'"""


@query("""SELECT p_partkey, CAST(p_partkey % 900 AS DOUBLE) AS x0, CAST(p_size * 10 AS DOUBLE) AS y0,
 regexp_replace(p_name, '\\s+', ' ', 'g') || chr(10) || p_brand || ' ' || p_type || chr(10) || '[x] ' || p_size || chr(10) || 'a b' AS text FROM part""")
def html_blocks(spark, sf):
    """Blocks of layout HTML made from parts; a block that is cut off is dropped."""
    pages = table(spark, sf, "part").select("p_partkey", F.expr(_PART_HTML).alias("html"))
    blocks = layout.html_blocks(pages, "html", ["p_partkey"])
    return blocks.select("p_partkey", F.col("bbox")[0].alias("x0"), F.col("bbox")[1].alias("y0"), "text")


@query("""SELECT page_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM (
 SELECT page_id, unnest(generate_series(1, len(string_split(html, chr(10))))) AS pos, trim(regexp_replace(unnest(string_split(html, chr(10))), '\\s+', ' ', 'g')) AS line FROM pages) WHERE line <> '' GROUP BY 1""")
def clean_pages(spark, sf):
    """Lines of a page with single spaces, none empty."""
    return table(spark, sf, "pages").select("page_id", X.clean_lines(F.col("html")).alias("text")).where("text <> ''")


@query("""WITH m AS (SELECT user_id, event_id, ts, CASE WHEN epoch_ms(ts) - lag(epoch_ms(ts)) OVER w > 3600000 THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS island FROM m""")
def event_islands(spark, sf):
    """Runs of a user's events without a gap of more than an hour."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = table(spark, sf, "events").withColumn("fresh", F.coalesce((ms - F.lag(ms).over(w) > 3_600_000).cast("int"), F.lit(0)))
    return rows.select("user_id", "event_id", F.sum("fresh").over(w).cast("long").alias("island"))


@query("""WITH p AS (SELECT DISTINCT l_orderkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem), m AS (SELECT *, CASE WHEN q - lag(q) OVER (PARTITION BY l_orderkey ORDER BY q) > 5 THEN 1 ELSE 0 END AS fresh FROM p)
SELECT l_orderkey, q, CAST(sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY q) AS BIGINT) AS island FROM m""")
def number_islands(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("q")).distinct()
    return ordering.islands(rows, ["l_orderkey"], F.col("q"), 5)


@query("SELECT sha256(string_agg(sha256(n_name), '' ORDER BY n_nationkey)) AS fingerprint FROM nation")
def fingerprint(spark, sf):
    rows = table(spark, sf, "nation").select("n_nationkey", F.sha2("n_name", 256).alias("h"))
    return generator.fingerprint(rows, "h", "n_nationkey")


@query("SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR) || '|' || o_orderpriority) AS digest, 'data:image/png;base64,' || to_base64(encode(o_orderpriority)) AS url FROM orders")
def digests(spark, sf):
    rows = table(spark, sf, "orders")
    return rows.select("o_orderkey", F.sha2(F.concat_ws("|", "o_orderkey", "o_orderpriority"), 256).alias("digest"), X.data_url(F.lit("a/b.png"), F.col("o_orderpriority").cast("binary")).alias("url"))


@query("""WITH j AS (SELECT lang, quality FROM documents JOIN labels USING (doc_id)), c AS (SELECT lang, quality, count(*) AS n FROM j GROUP BY ALL)
SELECT lang, CAST(sum(n) AS BIGINT) AS total, CAST(first(quality ORDER BY n DESC, quality) AS BIGINT) AS most_common, max(n) / sum(n)::DOUBLE AS share FROM c GROUP BY lang""")
def majority_baseline(spark, sf):
    """The commonest label of each language and its share."""
    counts = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id").groupBy("lang", "quality").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    best = ordering.best_of_each(counts, ["lang"], F.col("n"), [F.col("quality")])
    return best.join(total, "lang").select("lang", "total", F.col("quality").cast("long").alias("most_common"), X.safe_ratio(F.col("n"), F.col("total")).alias("share"))


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def label_confusion(spark, sf):
    return table(spark, sf, "labels").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_custkey, levenshtein(lower(c_name), lower(c_mktsegment)) AS edits,
 CASE levenshtein(lower(c_name), lower(c_mktsegment)) WHEN 1 THEN '1 edit' WHEN 2 THEN '2 edits' ELSE '3 or more edits' END AS bucket FROM customer""")
def edit_buckets(spark, sf):
    edits = F.levenshtein(X.normalize(F.col("c_name")), X.normalize(F.col("c_mktsegment")))
    return table(spark, sf, "customer").select("c_custkey", edits.cast("long").alias("edits"), analysis.final_bucket(F.col("c_name"), edits).alias("bucket"))


@query("""WITH w AS (SELECT p_partkey, string_split(trim(regexp_replace(p_name, '\\s+', ' ', 'g')), ' ') AS w FROM part),
c AS (SELECT p_partkey, w, unnest(generate_series(1, greatest(len(w) - 1, 1))) AS i FROM w),
r AS (SELECT p_partkey, array_to_string(w[1:i], ' ') AS a, array_to_string(w[i + 1:], ' ') AS b, i FROM c)
SELECT p_partkey, a AS line_1, b AS line_2 FROM r QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY abs(length(a) - length(b)), i) = 1""")
def balanced_wrap(spark, sf):
    lines = X.balanced_wrap(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", lines[0].alias("line_1"), lines[1].alias("line_2"))


_RAD = "radians(p_partkey % 360)"


@query(f"""SELECT p_partkey, round(cos({_RAD}) * p_size - sin({_RAD}) * 8, 6) AS x, round(sin({_RAD}) * p_size + cos({_RAD}) * 8, 6) AS y,
 round(abs(cos({_RAD})) * 18 + abs(sin({_RAD})) * 8, 6) AS half_x,
 round((degrees(atan2(p_size - 20.5, p_partkey % 91 - 45)) + 360) % 360, 6) AS heading, CAST(round_even(p_size * (200 / 72.0::DOUBLE), 0) AS INTEGER) AS pixels FROM part""")
def geometry(spark, sf):
    degrees = (F.col("p_partkey") % 360).cast("double")
    x, y = G.rotate(F.col("p_size"), F.lit(8.0), degrees)
    return table(spark, sf, "part").select("p_partkey", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(G.half_extents(36, 16, degrees)[0], 6).alias("half_x"), F.round(G.heading((F.col("p_partkey") % 91 - 45).cast("double"), F.col("p_size") - 20.5), 6).alias("heading"), G.to_pixels(F.col("p_size")).alias("pixels"))


@query("""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders), p AS (SELECT o_orderkey, d, CASE o_orderkey % 3 WHEN 0 THEN strftime(d, '%d/%m/%Y') WHEN 1 THEN strftime(d, '%-d/%-m/%Y') ELSE strftime(d, '%Y-%m-%d') END AS t FROM d)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN strftime(d, '%d/%m/%Y') END AS parsed, strftime(d + INTERVAL 10 YEAR, '%d/%m/%Y') AS ten_years_on FROM p""")
def dates(spark, sf):
    """Strict parsing of three ways to write a date, and ten years on."""
    d = F.col("o_orderdate").cast("date")
    written = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(d, "dd/MM/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format(d, "d/M/yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    return table(spark, sf, "orders").select("o_orderkey", X.format_date(X.parse_date(written)).alias("parsed"), X.format_date(X.add_years(d, 10)).alias("ten_years_on"))


_POINTS = [(f"(p_partkey * {3 + 4 * i} + {i * 17}) % 101", f"(p_partkey * {5 + 6 * i} + {i * 29}) % 103") for i in range(4)]
_PICKS = "x + y, x, y", "y - x, x, y", "-x - y, x, y", "x - y, x, y"


@query(f"""WITH p AS ({' UNION ALL '.join(f"SELECT p_partkey, {x} AS x, {y} AS y FROM part" for x, y in _POINTS)}),
r AS (SELECT *, {', '.join(f"row_number() OVER (PARTITION BY p_partkey ORDER BY {k}) AS r{i}" for i, k in enumerate(_PICKS))} FROM p)
SELECT p_partkey, {" || ' ' || ".join(f"max(CASE WHEN r{i} = 1 THEN x || ',' || y END)" for i in range(4))} AS corners FROM r GROUP BY p_partkey""")
def corner_order(spark, sf):
    """Four points of each part as top left, top right, bottom right, bottom left; of equals the one further left, then further up."""
    points = F.array(*[F.struct(F.expr(x).cast("long").alias("x"), F.expr(y).cast("long").alias("y")) for x, y in _POINTS])
    placed = ordering.corners(points)
    text = F.array_join(F.transform(placed, lambda c: F.concat_ws(",", c["x"], c["y"])), " ")
    return table(spark, sf, "part").select("p_partkey", text.alias("corners"))


_WANT = "replace(lower(p_type), ' ', '')"
_HAVE = "replace(lower(p_name || ' ' || substr(p_type, 1 + p_partkey % 4, 9 + p_partkey % 11) || ' ' || p_brand), ' ', '')"


@query(f"""WITH p AS (SELECT p_partkey, {_WANT} AS want, {_HAVE} AS have FROM part)
SELECT p_partkey, CAST(list_min(list_transform(range(1, length(have) + 2), lambda i: list_min(list_transform(range(0, length(have) + 2 - i), lambda n: levenshtein(want, substr(have, i, n)))))) AS INTEGER) AS edits FROM p""")
def nearest_text(spark, sf):
    """For each part, the edits between its type and the best stretch of a text that holds a part of it."""
    parts = table(spark, sf, "part").select("p_partkey", F.expr(_WANT).alias("want"), F.expr(_HAVE).alias("have"))
    return parts.select("p_partkey", analysis.nearest_distance(F.col("want"), F.col("have")).alias("edits"))


@query()
def generated_records(spark, sf):
    """The answer keys of the 500 synthetic forms."""
    return generator.dataset(spark).select("id", "split", "seed", "truth_sha256")


@query("SELECT '3ba968bd8c4281e6ed76a1c94c0b60e6101a80011b6593a2751a8212ed73e291' AS fingerprint")
def generated_fingerprint(spark, sf):
    """The dataset's fingerprint, which is a published value."""
    return generator.fingerprint(generator.dataset(spark))


@query("SELECT split, count(*) AS forms, count(*) AS in_vocabulary, 0 AS empty, min(id) AS first_id, max(id) AS last_id FROM (SELECT lpad(CAST(i AS VARCHAR), 6, '0') AS id, CASE WHEN i < 100 THEN 'dev' ELSE 'test' END AS split FROM range(500) t(i)) GROUP BY split")
def generated_checks(spark, sf):
    """Of the synthetic records of each split: how many there are, how many keep to the closed vocabularies, how many hold nothing."""
    rows = generator.dataset(spark).select("id", "split", "record")
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("forms"), F.count_if(scoring.in_vocabulary("record")).alias("in_vocabulary"), F.count_if(scoring.is_empty("record")).cast("int").alias("empty"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("SELECT '' AS id, '' AS rule WHERE false")
def generated_invariants(spark, sf):
    """Rules of consistency that a synthetic record breaks: none."""
    return generator.invariants(generator.dataset(spark))
