"""Circulant MinHash near-dedup.

A document is its set of distinct ``k``-word shingles (ASCII lower case). One permutation scatters the shingles over 2**32
places; a second permutation, shifted around the circle by 1, 2, ... yields every signature coordinate, so that two
permutations serve for all ``BANDS * ROWS`` coordinates. Bands of ``ROWS`` coordinates become buckets.

Documents with the same set are one class from the start and only its smallest id goes on. In each bucket every member is
paired with the bucket's smallest id, its hub; each pair is confirmed by the exact Jaccard similarity of the full sets, and the
links give components. Members of one hub that are still in different components are compared in blocks, exactly, through what
each lacks of the hub's set and has beside it. So no pair that shares a bucket and could join two components goes untested, while
a large group of near copies makes a number of rows in proportion to its size. A pair at the threshold shares no bucket with a
chance of (1 - s**3)**24: under 1e-9 at 0.85, 4e-8 at 0.8.

Defined cases: null, empty and blank texts have an empty set, link with nothing and keep themselves; texts with fewer than ``k``
words have their whole word sequence as one shingle; rows that repeat an id are one document if their texts agree,
else the id carries the links of all of them; a null id is kept and linked with nothing; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formgrain.llm.common import Words, blocks, materialise, mix, prepare, shingle_set, signed, table, utf8
from formgrain.llm.graph import components

ROWS = 3
BANDS = 24
#: Members of a hub in one block, where blocks are compared.
BLOCK_MEMBERS = 256
#: Text bytes whose sets a task keeps for further pairs.
CACHE_BYTES = 16 << 20

_SHIFTS = np.arange(1, ROWS * BANDS + 1, dtype=np.uint32)[:, None]


def scatter(shingles: np.ndarray) -> np.ndarray:
    """The first permutation: places of the shingles on the circle of 2**32."""
    return (mix(shingles ^ np.uint64(0x51A3C9E70B2D4F68)) >> np.uint64(32)).astype(np.uint32)


def circulate(places: np.ndarray) -> np.ndarray:
    """The second permutation, shifted by 1, 2, ...: the smallest value of each shift is a coordinate."""
    best = None
    for at in range(0, len(places), 4096):
        x = places[None, at : at + 4096] + _SHIFTS
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        low = x.min(axis=1)
        best = low if best is None else np.minimum(best, low)
    return best


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit bucket key per band."""
    s = signature.astype(np.uint64).reshape(BANDS, ROWS)
    x = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + s[:, i])
    return x


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """doc_id, n_shingles, two numbers that stand for the set, the bucket keys."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            n, s0, s1, keys = [], [], [], []
            for a, b in blocks(offsets):
                words = Words(raw, offsets, a, b)
                for i in range(b - a):
                    found = shingle_set(words.hash[words.first[i] : words.last[i]], k)
                    n.append(len(found))
                    s0.append(found.sum(dtype=np.uint64))
                    s1.append(np.bitwise_xor.reduce(mix(found ^ np.uint64(0xA5A5A5A5A5A5A5A5))) if len(found) else np.uint64(0))
                    keys.append(signed(band_keys(circulate(scatter(found)))) if len(found) else np.empty(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *keys])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(signed(np.array(s0, np.uint64))), pa.array(signed(np.array(s1, np.uint64))), lists], ["doc_id", "n", "s0", "s1", "keys"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n long, s0 long, s1 long, keys array<long>")


def compare(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, k: int, per_cent: int) -> DataFrame:
    """Of (id, hub): sizes of the full sets, whether they link, and what the member lacks of the hub and has beside it."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    both = pairs.join(texts.toDF("id", "text"), "id").join(texts.toDF("hub", "hub_text"), "hub")
    kind = pairs.schema["id"].dataType.simpleString()

    def sets(column, cache: dict) -> list[np.ndarray]:
        texts = column.to_pylist()
        if sum(map(len, cache)) > CACHE_BYTES:
            cache.clear()
        fresh = [x for x in dict.fromkeys(texts) if x not in cache]
        raw, offsets = utf8(pa.array(fresh, pa.large_string()))
        for a, b in blocks(offsets):
            words = Words(raw, offsets, a, b)
            for i in range(b - a):
                cache[fresh[a + i]] = shingle_set(words.hash[words.first[i] : words.last[i]], k)
        return [cache[x] for x in texts]

    def run(batches):
        members: dict = {}
        hubs: dict = {}
        for batch in batches:
            for part in (batch.slice(at, 200) for at in range(0, batch.num_rows, 200)):
                n, m, links, lacks, adds = [], [], [], [], []
                for x, h in zip(sets(part.column(2), members), sets(part.column(3), hubs)):
                    there = h[np.minimum(np.searchsorted(h, x), len(h) - 1)] == x
                    back = x[np.minimum(np.searchsorted(x, h), len(x) - 1)] == h
                    shared = int(there.sum())
                    n.append(len(x))
                    m.append(len(h))
                    links.append(100 * shared >= per_cent * (len(x) + len(h) - shared))
                    lacks.append(signed(h[~back]))
                    adds.append(signed(x[~there]))
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, v)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *v]))) for v in (lacks, adds)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int32()), pa.array(m, pa.int32()), pa.array(links, pa.bool_()), *lists], ["id", "hub", "n", "hub_n", "links", "lacks", "adds"])

    schema = f"id {kind}, hub {kind}, n int, hub_n int, links boolean, lacks array<long>, adds array<long>"
    return both.select("id", "hub", "text", "hub_text").mapInArrow(run, schema)


def block_links(hub_n: int, left: list[dict], right: list[dict], per_cent: int) -> list[tuple]:
    """Links across components between two blocks of members of one hub; enough of them to join what is joined.

    With x = hub - lacks + adds for each member, two members share hub_n - |lacks x| - |lacks y| + common lacks + common adds
    shingles, so the sets themselves aren't needed.
    """
    rows = []
    for side in (left, right):
        own = np.repeat(np.arange(len(side)), [len(x["lacks"]) + len(x["adds"]) for x in side])
        items = np.concatenate([np.empty(0, np.int64), *(np.array(x[c], np.int64) for x in side for c in ("lacks", "adds"))])
        order = np.argsort(items, kind="stable")
        rows.append((items[order], own[order]))
    (a, own_a), (b, own_b) = rows
    common = np.zeros((len(left), len(right)), np.int32)
    lo, hi = np.searchsorted(b, a), np.searchsorted(b, a, "right")
    size = hi - lo
    hit = np.flatnonzero(size)
    if len(hit):
        i = np.repeat(own_a[hit], size[hit])
        j = np.repeat(lo[hit], size[hit]) + np.arange(int(size[hit].sum())) - np.repeat(np.cumsum(size[hit]) - size[hit], size[hit])
        common += np.bincount(i * len(right) + own_b[j], minlength=common.size).reshape(common.shape).astype(np.int32)
    size_of = lambda side, f: np.array([f(x) for x in side], np.int64)
    shared = hub_n - size_of(left, lambda x: len(x["lacks"]))[:, None] - size_of(right, lambda x: len(x["lacks"]))[None, :] + common
    total = size_of(left, lambda x: x["n"])[:, None] + size_of(right, lambda x: x["n"])[None, :]
    apart = np.array([x["r"] for x in left], object)[:, None] != np.array([x["r"] for x in right], object)[None, :]
    root: dict = {}

    def top(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero((100 * shared >= per_cent * (total - shared)) & apart)):
        x, y = top(left[i]["r"]), top(right[j]["r"])
        if x != y:
            root[x] = y
            out.append((left[i]["id"], right[j]["id"]))
    return out


def across(tested: DataFrame, roots: DataFrame, per_cent: int, block: int = BLOCK_MEMBERS) -> DataFrame:
    """(a, b) links between members of one hub that are still in different components.

    Members of the hub's own component need no test with each other. All others meet all members of the hub in blocks: a row
    for two blocks, never one for two members.
    """
    kind = tested.schema["id"].dataType.simpleString()
    items = (F.size("lacks") + F.size("adds")).alias("items")
    named = tested.select("id", "hub", items).join(roots.toDF("id", "r"), "id", "left").join(roots.toDF("hub", "hub_r"), "hub", "left")
    root, hub_root = F.coalesce("r", "id"), F.coalesce("hub_r", "hub")
    named = materialise(named.select("id", "hub", root.alias("r"), (root != hub_root).alias("open"), "items"), "named")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("items") / (400 * block))).cast("int")
    counts = materialise(named.groupBy("hub", "open").agg(parts.alias("parts")), "counts")
    opened = counts.where("open").select("hub", F.col("parts").alias("lefts"))
    sized = named.join(counts.join(opened, "hub"), ["hub", "open"]).withColumn("at", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    placed = sized.select("id", "hub", "r", "open", "at", "lefts").join(tested.select("id", "hub", "n", "hub_n", "lacks", "adds"), ["id", "hub"])
    blocks_ = placed.groupBy("hub", "hub_n", "open", "at", "lefts").agg(F.collect_list(F.struct("id", "r", "n", "lacks", "adds")).alias("rows"))  # about ``block`` rows, or 400 * ``block`` differences
    blocks_ = materialise(blocks_, "blocks")
    # A block of open members meets those after it and all of the hub's component: dealt by hub and block, so no hub is in one task.
    left = blocks_.where("open").select("hub", "hub_n", F.col("at").alias("i"), F.col("rows").alias("left"))
    last = F.when(F.col("open"), F.col("at")).otherwise(F.col("lefts") - 1)
    right = blocks_.select("hub", F.explode(F.sequence(F.lit(0), last)).alias("i"), F.col("rows").alias("right"))
    met = left.join(right, ["hub", "i"]).select("hub_n", "left", "right")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                found = block_links(row["hub_n"], row["left"], row["right"], per_cent)
                if found:
                    key = batch.schema.field("left").type.value_type.field("id").type
                    yield pa.RecordBatch.from_arrays([pa.array(c, key) for c in zip(*found)], ["a", "b"])

    return met.mapInArrow(run, f"a {kind}, b {kind}")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, per_cent: int = 80, block: int = BLOCK_MEMBERS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    prepare(spark)
    base = materialise(signatures(docs, id_col, text_col, k), "signatures")
    some = base.where("n > 0 and doc_id is not null")
    classes = materialise(some.groupBy("n", "s0", "s1").agg(F.min("doc_id").alias("a")), "classes")
    same = some.join(classes, ["n", "s0", "s1"]).select("doc_id", "a").where("doc_id <> a")
    firsts = classes.select(F.col("a").alias("doc_id"), "n", "s0", "s1")
    members = some.join(firsts, ["doc_id", "n", "s0", "s1"], "left_semi").select(F.explode(F.array_distinct("keys")).alias("key"), F.col("doc_id").alias("id"))

    # Each member with the smallest id of its bucket.
    hubs = members.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub <> last").select("key", "hub")
    pairs = materialise(members.join(hubs, "key").where("id <> hub").select("id", "hub").distinct(), "pairs")
    tested = materialise(compare(pairs, docs, id_col, text_col, k, per_cent), "tested")
    links = tested.where("links").select(F.col("id").alias("a"), F.col("hub").alias("b"))
    roots = components(links.unionByName(same.select(F.col("doc_id").alias("a"), F.col("a").alias("b"))))
    # Members of one hub that are still apart.
    found = materialise(across(tested, roots, per_cent, block), "across")
    if not found.isEmpty():
        roots = components(roots.toDF("a", "b").unionByName(found))
    out = base.join(roots.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component_id", F.coalesce("root", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), k=3, per_cent=85)


ORACLE = {
    "op2_minhash_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) END AS sh
  FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS shared
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 85 * (na + nb - shared)),
sym AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, sym.b FROM r JOIN sym ON r.b = sym.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c USING (doc_id)""",
}
