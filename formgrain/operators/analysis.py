"""Where errors come from: outcome of each text cell against the text that was read, near misses, marks accuracy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formgrain import schema as S
from formgrain.functions.text import compact, letters_and_digits, normalize, safe_ratio
from formgrain.operators.ordering import first_of_each

# Names of outcomes and buckets.
OUTCOMES = ("correct", "value not in the OCR text", "in the OCR text, no value returned", "in the OCR text, wrong value returned")
FINAL = ("no value returned", "1 edit", "2 edits", "3 or more edits")
NEAR = ("exact in the text", "in the text, punctuation differs", "1 edit away", "2 edits away", "3 or more edits away")

#: Bytes of items that are sent to every task.
SENT_BYTES = 8 << 20


def outcome(expected: Column, got: Column, text: Column) -> Column:
    """Of a text cell: right; else not in the text; else not returned; else wrong."""
    right = F.coalesce(normalize(got) == normalize(expected), F.lit(False))
    absent = ~F.coalesce(compact(text).contains(compact(expected)), F.lit(False))
    return F.when(right, OUTCOMES[0]).when(absent, OUTCOMES[1]).when(got.isNull(), OUTCOMES[2]).otherwise(OUTCOMES[3])


def place_of(path: Column) -> Column:
    return F.when(path.contains("."), F.substring_index(path, ".", 1)).otherwise("top")


def attribution(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """Cells and (form_id, text) -> group, outcome, cells. The stage whose record was scored is the caller's choice."""
    rows = cells.where(F.col("kind").isin(*S.TEXT_KINDS)).join(texts, "form_id", "left")
    group = F.concat_ws("/", F.when(F.col("kind") == S.CRITICAL, "critical").otherwise("minor"), place_of(F.col("path")))
    return rows.groupBy(group.alias("grp"), outcome(F.col("expected_text"), F.col("predicted_text"), F.col("text")).alias("outcome")).agg(F.count(F.lit(1)).alias("cells"))


def final_bucket(predicted: Column, edits: Column) -> Column:
    return F.when(predicted.isNull(), FINAL[0]).when(edits == 1, FINAL[1]).when(edits == 2, FINAL[2]).otherwise(FINAL[3])


def _best_stretch(value: str, text: str) -> int:
    """Edits between ``value`` and its best stretch of ``text``: the text may start and end anywhere for nothing."""
    if not value or not text:
        return len(value or "")
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    steps = np.arange(len(codes) + 1)
    row = np.zeros(len(codes) + 1, np.int64)
    for i, c in enumerate(value, start=1):
        new = np.empty_like(row)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (codes != ord(c)), row[1:] + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return int(row.min())


def nearest_distance(value: Column, text: Column) -> Column:
    """Exact edit distance to the best stretch; Arrow batches, one row of the table at a time."""
    @F.pandas_udf("int")
    def nearest(values: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([_best_stretch(v or "", t or "") for v, t in zip(values, texts)], dtype="int32")

    return nearest(value, text)


def near_bucket(expected: Column, text: Column, distance: Column) -> Column:
    """How close the truth is to the text; the distance is only looked at where containment fails."""
    held = lambda f: F.coalesce(f(text).contains(f(expected)), F.lit(False))
    return F.when(held(compact), NEAR[0]).when(held(letters_and_digits), NEAR[1]).when(distance == 1, NEAR[2]).when(distance == 2, NEAR[3]).otherwise(NEAR[4])


def near_misses(cells: DataFrame, texts: DataFrame) -> DataFrame:
    """Wrong text cells with their two buckets; the distance is computed for those that the text doesn't hold."""
    wrong = cells.where(F.col("kind").isin(*S.TEXT_KINDS) & ~F.col("correct")).join(texts, "form_id", "left")
    rows = wrong.withColumns({"want": compact(F.col("expected_text")), "have": F.coalesce(compact(F.col("text")), F.lit(""))})
    held = F.col("have").contains(F.col("want")) | F.coalesce(letters_and_digits(F.col("text")).contains(letters_and_digits(F.col("expected_text"))), F.lit(False))
    rows = rows.withColumn("held", held)
    open_ = rows.where(~F.col("held")).withColumn("distance", nearest_distance(F.col("want"), F.col("have")))
    rows = rows.where("held").withColumn("distance", F.lit(0)).unionByName(open_)
    return rows.select("form_id", "path", "name", final_bucket(F.col("predicted_text"), F.col("edit_distance")).alias("final"), near_bucket(F.col("expected_text"), F.col("text"), F.col("distance")).alias("near"))


def histogram(rows: DataFrame, bucket: str) -> DataFrame:
    """bucket, n, share (null when there is nothing)."""
    counts = rows.groupBy(F.col(bucket).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).select("bucket", "n", safe_ratio(F.col("n"), F.col("total")).alias("share"))


def per_field(rows: DataFrame) -> DataFrame:
    """Wrong cells by field: how many, and how many of each closeness; the worst field first."""
    count = lambda *names: F.count_if(F.col("near").isin(*names))
    out = rows.groupBy("name").agg(F.count(F.lit(1)).alias("wrong"), count(NEAR[0]).alias("exact"), count(NEAR[1]).alias("punctuation"), count(NEAR[2], NEAR[3]).alias("near"), count(NEAR[4]).alias("far"))
    return out.orderBy(F.desc("wrong"), "name")


def contained(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, text) and (item_id, item) -> pairs where the text holds the item.

    An item of three words or more is met on its longest inner word. Items of up to ``SENT_BYTES`` in all are sent to the tasks, so that only
    pairs that share the word leave the scan; more of them meet the words in an equi-join that Spark can split. Shorter items are
    compared with every text.
    """
    words = F.split(F.col("item"), r"\s+")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(1)))
    longest = F.array_min(F.transform(inner, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))["w"]
    keyed = items.withColumns({"n_words": F.size(words), "word": longest})
    size = items.agg(F.sum(F.octet_length("item"))).first()[0] or 0
    if size <= SENT_BYTES:
        keyed = F.broadcast(keyed)
    tokens = texts.select("doc_id", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("word"))
    met = tokens.join(keyed.where("n_words >= 3").select("item_id", "word"), "word").select("doc_id", "item_id").distinct()
    pairs = met.join(texts, "doc_id").join(items, "item_id").where(F.col("text").contains(F.col("item"))).select("doc_id", "item_id")
    short = keyed.where("n_words < 3").select("item_id", "item")
    return pairs.unionByName(texts.join(short, F.col("text").contains(F.col("item"))).select("doc_id", "item_id"))


def marks_accuracy(cells: DataFrame) -> DataFrame:
    """Per marked field: right, total, the first five wrong forms; ticks found, missed and extra."""
    rows = cells.where(F.col("name").isin("circumstances", "vehicle_type", "license_category", "impact_zone", "circumstance_count", "other_damage"))
    none = F.array().cast("array<int>")
    want, got = F.coalesce("expected_ticks", none), F.coalesce("predicted_ticks", none)
    place = F.concat_ws(":", "form_id", "path")
    size = lambda x: F.sum(F.size(x)).cast("long")
    five = first_of_each(rows.where(~F.col("correct")).select("name", place.alias("place")), "name", ["place"], 5)
    firsts = five.groupBy("name").agg(F.array_join(F.array_sort(F.collect_list("place")), " ").alias("first_wrong"))
    out = rows.groupBy("name").agg(F.count_if("correct").alias("right"), F.count(F.lit(1)).alias("total"), size(F.array_intersect(want, got)).alias("found"), size(F.array_except(want, got)).alias("missed"), size(F.array_except(got, want)).alias("extra"))
    return out.join(firsts, "name", "left")
