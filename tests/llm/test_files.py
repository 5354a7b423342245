import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from formgrain.llm import best_fit_packing as P
from formgrain.llm import warc
from tests.llm.conftest import edited, prose


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


PAGES = [
    (5, "u", "x WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nend"),
    (2, None, None), (9, "u v\r\nx", ""), (3, "z", "WARC/1.1\r\n"), (4, "z", "WARC/1.1\r\n"), (None, "z", "héé"),
    (11, "z", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n"), (12, "q", "plain\r\n\r\n"), (13, "q", "x" * 300_000 + "WARC/1.1\r\n" * 50), (1, "r", "plain\r\n\r\n"),
]


@pytest.mark.parametrize("split", ["128m", "64k"])
def test_warc_round_trip(spark, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumnRenamed("url", "url")
        got = {r.page_id: r for r in warc.round_trip(pages.selectExpr("*", "1 as sha", "2 as size")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")
    assert len(got) == len(PAGES)
    first = {}
    for i, _, t in PAGES:
        first[digest(t)] = min(first.get(digest(t), 10**9), 10**9 if i is None else i)
    for i, _, t in PAGES:
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len((t or "").encode()), digest(t))
        again = i is not None and first[digest(t)] != i
        assert (r.record_type, r.refers_to) == (("revisit", first[digest(t)]) if again else ("response", None))
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_of_repeated_and_null_ids(spark):
    rows = [(4, "u", "same"), (4, "u", "same"), (None, "u", "same"), (9, "u", "same"), (None, "u", "alone"), (None, "u", "alone"), (7, "u", "other"), (7, "u", "mine"), (8, "u", "mine")]
    got = sorted(((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()), key=str)
    first = {"same": 4, "alone": None, "other": 7, "mine": 7}
    want = [(i, digest(t), "response" if i == first[t] else "revisit", None if i == first[t] else first[t]) for i, _, t in rows]
    assert got == sorted(want, key=str)


def test_reachable_rejects_what_no_chain_reaches(spark):
    true = [(0, 30), (30, 75), (75, 140), (140, 200)]
    false = [(40, 75), (50, 90), (90, 140), (150, 170), (170, 999)]
    rows = [("f", at // 64, at, to) for at, to in true + false] + [("g", 0, 5, 9)]
    got = {(r.file, r.at) for r in warc.reachable(spark.createDataFrame(rows, "file string, block long, at long, to long")).collect()}
    assert got == {("f", at) for at, _ in true}


def test_pieces_equal_the_tokenizer(docs, rows, clash, empty):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(P.vocabulary())
    got = {}
    for r in P.pack(clash).collect():
        got.setdefault(r.doc_id, set()).add((r.piece, r.start, r.length, r.ids_crc32))
    for i, t, *_ in rows:
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        want = {(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))}
        assert got[i] == want
    assert P.pack(empty).count() == 0


def test_special_token_in_a_text(spark):
    rows = spark.createDataFrame([(1, "a<|endoftext|>b")], "doc_id long, text string")
    from tokenizers import Tokenizer

    ids = np.array([*Tokenizer.from_file(P.vocabulary()).encode("a<|endoftext|>b", add_special_tokens=False).ids, 0], "<u4")
    assert P.pack(rows).first().ids_crc32 == zlib.crc32(ids.tobytes())


def check_packing(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_is_gapless_and_close_to_the_bound(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(i, prose(rng, rng.randrange(1, 90))) for i in range(1500)], "doc_id long, text string")
    for group, slack in ((1 << 16, 1.01), (200, 1.03)):  # one group; several very small ones that exchange
        got = P.pack(rows, capacity=256, group=group).collect()
        assert len({(r.doc_id, r.piece) for r in got}) == len(got)
        n = check_packing(got, 256)
        assert n <= slack * P.lower_bound(np.sort([r.length for r in got])[::-1], 256)


def test_bounds_hold():
    rng = np.random.default_rng(7)
    for _ in range(60):
        sizes = np.sort(rng.integers(1, 101, int(rng.integers(1, 40))))[::-1]
        bins, _ = P.best_fit(sizes, 100)
        assert P.lower_bound(sizes, 100) <= bins.max() + 1
    assert P.lower_bound(np.array([51] * 9), 100) == 9
    assert P.lower_bound(np.array([34] * 9), 100) == 5


@pytest.mark.parametrize("text", [" " * 5_000_000, "\n" * 5_000_000, "x" * 5_000_000, "a  " + " \t" * 400_000 + "b"])
def test_long_runs_equal_the_tokenizer(text):
    from tokenizers import Tokenizer

    path = P.vocabulary()
    assert P.encoder(path)(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_packing_of_rows_that_repeat(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(7, "one and the same")] * 900 + [(None, prose(rng, 30))] * 300 + [(i, prose(rng, rng.randrange(1, 60))) for i in range(300)], "doc_id long, text string")
    got = P.pack(rows, capacity=256, group=100).collect()
    assert len(got) == 1500
    n = check_packing(got, 256)
    assert n <= 1.05 * P.lower_bound(np.sort([r.length for r in got])[::-1], 256)


def test_a_group_opens_at_most_half_of_its_pieces():
    import pandas as pd

    rows = pd.DataFrame({"length": [129] * 50 + [100] * 10, "uid": range(60), "sequence_id": -1, "offset": 0, "g": 3})
    out = P.pack_group(rows, 256, False, 0)
    assert (~out["done"]).sum() <= 30
    again = P.pack_group(out[~out["done"]].drop(columns=["done", "gap"]).assign(g=0), 256, False, 1)
    assert len(again) == (~out["done"]).sum()


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    good = [(i, prose(rng, 60)) for i in range(60)]
    bad = [(100 + i, " ".join(f"{x}@@@" for x in prose(rng, 60).split())) for i in range(40)]
    copies = [(200 + i, good[i][1].replace(" ", "\n", 1)) for i in range(5)]
    near = [(300 + i, edited(rng, good[10 + i][1], 1)) for i in range(5)]
    items = [(i, prose(rng, 25)) for i in range(4)]
    leaks = [(400 + i, f"{prose(rng, 20)} {t} {prose(rng, 20)}") for i, t in items]
    rows = [(i, t, "en", "s", len(t)) for i, t in good + bad + copies + near + leaks]
    spark.createDataFrame(rows + [rows[0]], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in good[:40]] + [(i, 0, 0) for i, _ in bad[:30]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
    fine = [i for i, _ in good]
    assert sorted(set(kept[0])) == sorted(fine + [i for i, _ in copies + near + leaks])
    assert kept[1] == sorted(fine + [i for i, _ in near + leaks])
    assert kept[2] == sorted(fine + [i for i, _ in leaks])
    assert kept[3] == fine
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sorted({r.doc_id for r in packed}) == fine
    check_packing(packed, 2048)
    assert sorted({r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}) == fine


def pipeline_rows(rng):
    """(number, id, text, kind): null ids, an id that many rows share, rows that repeat, near copies, leaks, junk."""
    good = [prose(rng, 60) for _ in range(30)]
    items = [(i, prose(rng, 25)) for i in range(3)]
    texts = [(t, "good") for t in good]
    texts += [(good[i].replace(" ", "\n", 1), "copy") for i in range(6)] + [(good[i], "copy") for i in range(3, 9)]
    texts += [(edited(rng, good[10 + i], 1), "near") for i in range(6)]
    texts += [(f"{prose(rng, 20)} {t} {prose(rng, 20)}", "leak") for _, t in items]
    texts += [(" ".join(f"{x}@@@" for x in prose(rng, 60).split()), "junk") for _ in range(20)]
    ids = [None if i % 3 == 0 else 7 if i % 3 == 1 else 1000 + i for i in range(len(texts))]
    return [(n, i, t, k) for n, (i, (t, k)) in enumerate(zip(ids, texts))], items


def test_pipeline_with_null_and_repeated_ids_and_clashing_names(spark, tmp_path):
    from pyspark.sql import functions as F

    rng = random.Random(23)
    rows, items = pipeline_rows(rng)
    names = ["row", "row_", "_id", "id", "at", "group", "tie", "digest", "key", "n", "hub", "score"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), n) for n, i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long, number long")
    docs = docs.withColumns({x: F.lit("clash") for x in names})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    known = [(900_000 + i, prose(rng, 60), 1) for i in range(40)] + [(910_000 + i, " ".join(f"{x}@@@" for x in prose(rng, 60).split()), 0) for i in range(40)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, q, 0) for i, _, q in known], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    extra = spark.createDataFrame([(i, t, "en", "s", len(t), -1) for i, t, _ in known], "doc_id long, text string, lang string, source string, n_chars long, number long").withColumns({x: F.lit("clash") for x in names})
    extra.write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = sorted(r.number for r in docs.where("number >= 0").collect())
    kinds = {n: k for n, _, _, k in rows}
    assert kept["quality"] == [n for n, *_, k in rows if k != "junk"]
    # Of equal texts: the smallest id, nulls last, then the first row.
    groups = {}
    for n, i, t, k in rows:
        if k != "junk":
            groups.setdefault("".join(t.split()), []).append((i is None, i or 0, n))
    winners = {min(v)[:2]: k for k, v in groups.items()}
    assert len(kept["exact"]) == len(groups) and len(winners) > 0
    by_text = {n: "".join(t.split()) for n, _, t, _ in rows}
    key = {n: (i is None, i or 0) for n, i, _, _ in rows}
    assert all(key[n] == min(v)[:2] for n in kept["exact"] for v in [groups[by_text[n]]])
    assert {by_text[n] for n in kept["near"]} | {by_text[n] for n in kept["exact"] if kinds[n] == "near" or n in range(10, 16)} == {by_text[n] for n in kept["exact"]}
    assert len(kept["near"]) == len(kept["exact"]) - 6
    assert kept["leaks"] == [n for n in kept["near"] if kinds[n] != "leak"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.where("piece = 0").count() == docs.count()


def test_pipeline_of_an_empty_table(spark, tmp_path, empty):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
