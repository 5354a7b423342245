"""The form engine on hand-built cases, and its queries against DuckDB."""

import json
from datetime import date

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from formgrain import catalog
from formgrain import schema as S
from formgrain.errors import ConfigurationError, OcrError
from formgrain.functions import text as X
from formgrain.operators import analysis, kernels, layout, metrics, ordering, overlay, repair, scoring
from formgrain.plans.runner import Flow
from formgrain.sources import dataset, generator, models, store

DATA = "/root/testdata/sf0.001"


def one(spark, column, **values):
    """A column expression over one row."""
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


def record(**changes):
    r = generator.sample_record(1_000_007)
    r.pop("sketch")
    for path, value in changes.items():
        side, _, name = path.rpartition("__")
        (r[side] if side else r)[name] = value
    return r


def frame(spark, rows):
    """(form_id, truth, predicted) with records as structs."""
    kind = S.T.StructType([S.T.StructField("form_id", S.T.StringType()), S.T.StructField("truth", S.RECORD_SCHEMA), S.T.StructField("predicted", S.RECORD_SCHEMA), S.T.StructField("input_tokens", S.T.LongType()), S.T.StructField("output_tokens", S.T.LongType()), S.T.StructField("seconds", S.T.DoubleType())])
    return spark.createDataFrame([(i, t, p, *u) for i, t, p, u in rows], kind).withColumn("produced_output", F.col("predicted").isNotNull())


def scores(spark, rows):
    forms = frame(spark, [(*r, (None, None, None)) if len(r) == 3 else r for r in rows])
    cells = scoring.record_cells(forms).cache()
    return metrics.summary_document(cells, forms, 0.15, 0.60), cells


def test_sixty_cells_by_kind():
    kinds = [k for _, _, k in S.PATHS]
    assert len(kinds) == 60 and [kinds.count(k) for k in (S.CRITICAL, S.MINOR, S.TICKS, S.TICK_COUNT, S.CATEGORY)] == [19, 30, 2, 2, 7]


def test_normalising(spark):
    assert one(spark, X.normalize(F.col("v")), v="  Rue   TARFAYA ") == "rue tarfaya"
    assert one(spark, X.normalize(F.lit(True))) == "true"
    assert one(spark, X.normalize(F.col("v")), v="Straße") == "strasse"
    assert one(spark, X.letters_and_digits(F.col("v")), v="41654 - A - 55") == "41654a55"


def test_perfect_and_one_wrong_digit(spark):
    t = record()
    flipped = t["vehicle_a"]["plate"][:-1] + str((int(t["vehicle_a"]["plate"][-1]) + 1) % 10)
    s, _ = scores(spark, [("1", t, record())])
    assert s["field_accuracy"]["critical"] == {"correct": 19, "total": 19, "accuracy": 1.0} and s["forms_without_critical_error"]["without_critical_error"] == 1
    s, _ = scores(spark, [("1", t, record(vehicle_a__plate=flipped))])
    assert s["field_accuracy"]["critical"]["correct"] == 18 and s["character_error_rate"]["overall"]["edits"] == 1
    assert s["forms_without_critical_error"]["without_critical_error"] == 0 and s["field_accuracy"]["per_field"]["plate"]["correct"] == 1


def test_no_output_counts_as_wrong(spark):
    s, _ = scores(spark, [("1", record(), None)])
    assert s["forms_with_output"] == 0 and s["field_accuracy"]["critical"]["correct"] == 0 and s["character_error_rate"]["overall"]["rate"] == 1.0
    assert s["checkbox_score"]["ticks_found"] == 0 and s["checkbox_score"]["ticks_extra"] == 0 and s["checkbox_score"]["precision"] is None


def test_ticks(spark):
    t, p = record(vehicle_a__circumstances=[8, 10], vehicle_b__circumstances=[]), record(vehicle_a__circumstances=[11, 8, 8], vehicle_b__circumstances=None)
    s, cells = scores(spark, [("1", t, p)])
    assert [s["checkbox_score"][k] for k in ("ticks_found", "ticks_missed", "ticks_extra", "precision", "recall")] == [1, 1, 1, 0.5, 0.5]
    assert not any(r.correct for r in cells.where(F.col("kind") == S.TICKS).collect())


def test_category_baseline_and_ties(spark):
    rows = [(str(i), record(vehicle_a__vehicle_type="car" if i else "moto", vehicle_b__vehicle_type="car"), record(vehicle_a__vehicle_type="car", vehicle_b__vehicle_type="car")) for i in range(4)]
    s, _ = scores(spark, rows)
    got = s["category_accuracy"]["vehicle_type"]
    assert (got["accuracy"], got["most_common_answer"], got["guess_most_common_accuracy"]) == (7 / 8, "car", 7 / 8)
    s, _ = scores(spark, [("1", record(vehicle_a__impact_zone="rear", vehicle_b__impact_zone="front"), record())])
    assert s["category_accuracy"]["impact_zone"]["most_common_answer"] == "rear"  # of equals the first met


def test_cost(spark):
    rows = [("1", record(), record(), (1000, 200, 3.0)), ("2", record(), record(), (3000, 800, 10.0)), ("3", record(), None, (None, None, None))]
    s, _ = scores(spark, rows)
    assert s["cost_and_time"]["forms_measured"] == 2 and s["cost_and_time"]["dollars_per_form"] == pytest.approx(0.0006) and s["cost_and_time"]["seconds_p95"] == 10.0
    assert scores(spark, [("1", record(), None)])[0]["cost_and_time"] == {"forms_measured": 0}


def test_incomplete_answer_key_fails(spark):
    _, cells = scores(spark, [("7", record(vehicle_a__plate=None), record())])
    with pytest.raises(Exception, match="no value for vehicle_a.plate"):
        scoring.complete(cells).collect()


def test_empty_records_and_vocabulary(spark):
    rows = frame(spark, [("1", record(), dict.fromkeys(S.RECORD_SCHEMA.names), (None,) * 3), ("2", record(), {"vehicle_a": {}}, (None,) * 3), ("3", record(), record(vehicle_a__impact_zone="Rear"), (None,) * 3)])
    got = rows.select(scoring.is_empty("predicted").alias("e"), scoring.in_vocabulary("predicted").alias("v")).collect()
    assert [(r.e, r.v) for r in got] == [(True, True), (False, True), (False, False)]


def test_repair_rules_and_their_audit(spark):
    p = record(phone_a="07 85.29-52 21", phone_b=None, vehicle_a__policy_no="6579549 44 0492 94", vehicle_a__attestation_no="59a 15 0196573", vehicle_b__attestation_no="XYZ", vehicle_a__valid_from="16/07/2026", vehicle_a__valid_to="17/07/2025", vehicle_b__valid_from="??/07/2026")
    forms = frame(spark, [("1", record(), p, (None,) * 3), ("2", record(), {"vehicle_a": None, "phone_a": "06 1"}, (None,) * 3)]).withColumnRenamed("predicted", "record")
    done = repair.repair(forms, repair.named("validity-dates, phone-digits,policy-spaces,attestation-format"))
    a, b = done.orderBy("form_id").collect()
    assert a.record.phone_a == "0785295221" and a.record.phone_b is None and a.record.vehicle_a.policy_no == "657954944049294"
    assert a.record.vehicle_a.attestation_no == "59A 150196573" and a.record.vehicle_b.attestation_no == "XYZ"
    assert (a.record.vehicle_a.valid_from, a.record.vehicle_a.valid_to, a.record.vehicle_b.valid_from) == ("17/07/2025", "16/07/2026", "??/07/2026")
    assert b.record.vehicle_a is None and b.record.phone_a == "061"
    assert [(r.rule, r.path) for r in repair.changes(done).where("form_id = '2'").collect()] == [("phone-digits", "phone_a")]
    assert {r.rule: r.changed for r in repair.per_rule(repair.changes(done), spark.createDataFrame([("1", "phone_a", "0785295221")], "form_id string, path string, expected_text string")).collect()} == {"phone-digits": 1}
    with pytest.raises(ConfigurationError, match="known:"):
        repair.named("phone-digits, nothing")


def test_dates(spark):
    got = {v: one(spark, X.parse_date(F.col("v")), v=v) for v in ("16/07/2026", "1/7/2026", "31/02/2026", "2026-07-16", "", "16/07/26")}
    assert got == {"16/07/2026": date(2026, 7, 16), "1/7/2026": date(2026, 7, 1), "31/02/2026": None, "2026-07-16": None, "": None, "16/07/26": None}
    assert one(spark, X.add_years(F.lit(date(2024, 2, 29)), 1)) == date(2025, 2, 28)
    assert one(spark, X.add_years(F.lit(date(2024, 2, 29)), 4)) == date(2028, 2, 28)


def repeats(text):
    for n in range(1, 251):
        k = 4 + 12 // n + 1
        if len(text) >= n * k and text.endswith(text[-n:] * k):
            return True
    return False


def test_loops(spark):
    rng = np.random.default_rng(1)
    texts = ["ab" * 300, "Véhicule B\n" * 40, "", "a" * 16, "a" * 17, "plain", "x" * 40 + "tail " * 3, "سطر " * 300]
    for _ in range(120):
        n = int(rng.integers(1, 60))
        unit = "".join(rng.choice(list("abc"), n))
        texts.append("zz" + unit * int(rng.integers(1, 20)) + "q" * int(rng.integers(0, 2)))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.repeats(F.col("t")).alias("r"), X.looped(F.col("t")).alias("l")).collect()
    for r in rows:
        t = texts[r.i]
        assert r.r == repeats(t) and r.l == (repeats(t) or (len(t) > 50 and repeats(t[:-50]))) == models.looped(t)


def test_zone_text(spark):
    boxes = [(1, 0.1, 0.5, "left b"), (1, 0.1, 0.3, "left a"), (1, 0.5, 0.05, "top"), (1, 0.9, 0.5, "right"), (1, 0.5, 0.6, "middle")]
    df = spark.createDataFrame(boxes, "page int, x double, y double, text string").withColumn("zone", layout.zone_of(F.col("x"), F.col("y"), 0.31, 0.69, 0.17))
    assert layout.zone_text(df, ["page"]).first().page_text == "## header\ntop\n\n## vehicle_a\nleft a\nleft b\n\n## circumstances\nmiddle\n\n## vehicle_b\nright"


def test_html_blocks(spark):
    html = '<div data-bbox="0 0 100 50"><h1>Title</h1>a  b<br>c<div>inner</div><input type="checkbox" checked>x<input type="radio">y<img alt="car"></div><div>no box</div><div data-bbox="0 300 100 320"><table><tr><td>1</td><td>2</td></tr></table></div><div data-bbox="9 9 9 9"> </div><div data-bbox="1 1 2 2">open'
    pages = spark.createDataFrame([(1, html), (2, ""), (3, None)], "page int, html string")
    assert [r.text for r in layout.html_blocks(pages, "html", ["page"]).orderBy("block").collect()] == ["Title\na b\nc\ninner[x]x( )y[image: car]", "1 2"]
    got = {r.page: r.page_text for r in layout.blocks_to_text(pages, "html", ["page"], (0.31, 0.69, 0.17)).collect()}
    assert got[1].startswith("## header\nTitle") and "## vehicle_a\n1 2" in got[1] and got[2] == got[3] == "## header\n\n\n## vehicle_a\n\n\n## circumstances\n\n\n## vehicle_b\n"
    layout.register(spark)
    assert spark.sql("SELECT b.x1, b.text FROM VALUES ('<div data-bbox=\"1 2 3 4\">t</div>') AS v(h), LATERAL html_blocks(h) b").first().asDict() == {"x1": 3.0, "text": "t"}


def test_overlays(spark):
    forms = frame(spark, [("1", record(), {**record(), "vehicle_b": None}, (None,) * 3)])
    mark = {"vehicle_type": "bus", "license_category": "B", "impact_zone": "rear", "circumstances": [1, 5]}
    kind = "struct<vehicle_type:string,license_category:string,impact_zone:string,circumstances:array<int>>"
    marks = F.from_json(F.lit(json.dumps({"vehicle_a": mark, "vehicle_b": mark, "other_damage": True})), f"struct<vehicle_a:{kind},vehicle_b:{kind},other_damage:boolean>")
    got = forms.select(overlay.marks_overlay(F.col("predicted"), marks).alias("r")).first().r
    assert got.vehicle_b.circumstance_count == 2 and got.vehicle_b.make is None and got.vehicle_a.vehicle_type == "bus" and got.vehicle_a.make and got.other_damage
    answers = {"date": F.lit(" 01/01/2020 "), "phone_a": F.lit(None).cast("string"), "vehicle_a.plate": F.lit("  "), "vehicle_b.plate": F.lit("1-A-1")}
    r, changes = overlay.refine_overlay(F.col("predicted"), answers)
    got = forms.select(r.alias("r"), changes.alias("c")).first()
    assert got.r.date == "01/01/2020" and got.r.phone_a == record()["phone_a"] and got.r.vehicle_b.plate == "1-A-1" and [c.path for c in got.c] == ["date", "vehicle_b.plate"]
    assert one(spark, overlay.ticks(F.array(F.lit(0.2), F.lit(0.1), F.lit(0.14)))) == [1, 3]
    assert one(spark, overlay.best_zone(tuple(F.lit(float(v)) for v in (13, 110, 82, 220)))) == "left"
    assert one(spark, overlay.best_zone(tuple(F.lit(float(v)) for v in (82, 240, 150, 314)))) == "rear"


def test_analysis(spark):
    assert one(spark, analysis.nearest_distance(F.col("a"), F.col("b")), a="kitten", b="xx mitten yy") == 1
    assert one(spark, analysis.nearest_distance(F.col("a"), F.col("b")), a="abc", b="") == 3
    _, cells = scores(spark, [("1", record(), record(vehicle_a__plate="9-A-9", date=None))])
    texts = spark.createDataFrame([("1", f"seen {record()['vehicle_a']['plate']}")], "form_id string, text string")
    got = {(r.grp, r.outcome): r.cells for r in analysis.attribution(cells, texts).collect()}
    assert got["critical/vehicle_a", analysis.OUTCOMES[3]] == 1 and got["critical/top", analysis.OUTCOMES[1]] == 1 and got["critical/vehicle_b", "correct"] == 9
    near = {r.path: (r.final, r.near) for r in analysis.near_misses(cells, texts).collect()}
    assert near["vehicle_a.plate"][1] == analysis.NEAR[0] and near["date"][0] == analysis.FINAL[0]
    assert analysis.histogram(analysis.near_misses(cells.where("correct"), texts), "final").count() == 0


def test_ordering(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x"))
    got = ordering.numbered(rows, [F.col("x")]).collect()
    assert all(r.position == r.x + 1 for r in got)
    pts = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((9, 9), (1, 1), (9, 0), (0, 9))])
    assert [(p.x, p.y) for p in one(spark, ordering.corners(pts))] == [(1, 1), (9, 0), (9, 9), (0, 9)]
    assert one(spark, X.balanced_wrap(F.col("v")), v="aa bb cc dd") == ["aa bb", "cc dd"] and one(spark, X.balanced_wrap(F.col("v")), v="aa") == ["aa", ""]


def test_generated_forms(spark):
    rows = generator.dataset(spark, 40, 10, 3)
    assert rows.where("split = 'dev'").count() == 10 and generator.invariants(rows).count() == 0
    assert rows.where("record is null or record.vehicle_a.plate is null").count() == 0
    again = generator.dataset(spark.newSession(), 40, 10, 3).repartition(7)
    assert generator.fingerprint(rows).first() == generator.fingerprint(again).first() != generator.fingerprint(generator.dataset(spark, 40, 10, 4)).first()
    broken = rows.withColumn("record", F.col("record").withField("vehicle_a.plate", F.col("record.vehicle_b.plate")))
    assert broken.transform(generator.invariants).where("rule = 'plates differ'").count() == 40


def test_dataset_and_store(spark, tmp_path):
    with pytest.raises(ConfigurationError):
        dataset.manifest(spark, str(tmp_path))
    lines = [{"id": f"{i:06d}", "split": "dev" if i < 3 else "test", "level": "scan", "seed": i, "image": "", "truth": "", "image_sha256": "", "truth_sha256": ""} for i in range(9)]
    (tmp_path / "manifest.jsonl").write_text("".join(json.dumps(x) + "\n" for x in lines))
    forms = dataset.manifest(spark, str(tmp_path))
    assert [r.id for r in dataset.first(forms, 2, "test").collect()] == ["000003", "000004"] and dataset.chosen(forms, 1, 2).count() == 3
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "000001.json").write_text(generator.truth_text(1))
    got = dataset.records(spark, f"{tmp_path}/t").first()
    assert got.id == "000001" and got.record.vehicle_b.plate == generator.sample_record(1)["vehicle_b"]["plate"]
    s = store.ArtifactStore(spark, f"{tmp_path}/runs", "r1")
    rows = spark.createDataFrame([("a", "one"), ("b", "two")], "form_id string, text string")
    s.write_text(rows, "ocr")
    s.write_json(rows, "usage", ["text"])
    s.write_text(rows.withColumn("text", F.lit("new")), "ocr")
    assert {r.text for r in s.read("ocr").collect()} == {"new"} and s.read("usage").count() == 2
    assert s.exists(spark.createDataFrame([("a",), ("c",)], "form_id string"), "ocr", "usage").collect()[0].form_id == "a"
    store.write_run_files(spark, f"{tmp_path}/runs/r1", store.describe_run("r1", dataset.Settings(api_key="x").public(), [("a", "dev")], "cmd"), {"forms": 1})
    assert json.loads((tmp_path / "runs/r1/summary.json").read_text()) == {"forms": 1} and "api_key" not in (tmp_path / "runs/r1/run.json").read_text()
    assert dataset.Settings.load({"WORKERS": "9", "READ_MARKS": "yes"}).workers == 9
    with pytest.raises(ConfigurationError):
        dataset.Settings.load({"WORKERS": "many"})


def reply(text):
    return {"choices": [{"message": {"content": text}}], "usage": {"prompt_tokens": 7, "completion_tokens": 3}}


def test_page_reader_retries_loops():
    calls = []

    def client(body):
        calls.append((body["temperature"], body["top_p"]))
        return reply("ab" * 300 if len(calls) == 1 else "<div>fine</div>")

    assert models.OCR.build("chandra-ocr-2", client).read("1", b"x", "png") == ("<div>fine</div>", False) and calls == [(0.0, 0.1), (0.2, 0.95)]
    assert models.PageReader(lambda b: reply("ab" * 300), retries=1).read("1", b"", "jpg")[1]
    with pytest.raises(OcrError, match=r"\[9\]"):
        models.PageReader(lambda b: {}).read("9", b"", "png")
    with pytest.raises(ConfigurationError, match="known:"):
        models.OCR.build("nothing")
    assert models.OCR.build("none").read("1", b"", "png") == ("", False)


@pytest.mark.parametrize("bad", ["not json", '{"date": 5}', '{"vehicle_a": {"vehicle_type": "plane"}}', "{}", "[]", '{"vehicle_a": {"circumstance_count": "x"}}'])
def test_bad_answers_fail(bad):
    with pytest.raises(ValueError):
        models.validate(bad)


def test_lax_answers_pass():
    got = models.validate('{"other_damage": "yes", "unknown": 1, "vehicle_a": {"circumstances": ["8", 2.0], "circumstance_count": "2"}}')
    assert got["other_damage"] is True and got["vehicle_a"]["circumstances"] == [8, 2] and got["vehicle_a"]["circumstance_count"] == 2
    assert models.validate('{"vehicle_a": {}}')["vehicle_a"]["plate"] is None
    assert models.json_schema()["properties"]["vehicle_a"]["anyOf"][0]["properties"]["impact_zone"]["anyOf"][0]["enum"] == list(S.IMPACT_ZONES)


def test_field_reader_waits_longer_each_time():
    waits, calls = [], []

    def client(body):
        calls.append(body)
        if len(calls) < 3:
            raise OSError("down")
        return reply('{"date": "1/1/2020", "vehicle_a.plate": null, "vehicle_b.plate": "2-B-2"}')

    reader = models.FieldReader(client, ["date", "plate"], sleep=waits.append)
    assert reader.ask({"date": b"png"}) == {"date": "1/1/2020", "vehicle_b.plate": "2-B-2"} and waits == [5.0, 10.0]
    assert models.FieldReader(lambda b: {}, ["date"], sleep=waits.append).ask({}) is None
    with pytest.raises(ConfigurationError):
        models.FieldReader(client, ["nothing"])


def test_a_run_with_a_failing_form_and_reuse(spark, tmp_path):
    forms = spark.createDataFrame([(str(i), bytearray(b"image%d" % i), "png") for i in range(4)], "form_id string, content binary, suffix string")
    truth = spark.createDataFrame([(str(i), record()) for i in range(4)], S.T.StructType([S.T.StructField("form_id", S.T.StringType()), S.T.StructField("truth", S.RECORD_SCHEMA)]))
    answer = json.dumps(record(phone_a="06 12"))
    mark = str(tmp_path / "calls")

    def make():
        import base64 as b64

        def client(body):
            open(mark, "a").write("x")
            data = b64.b64decode(body["messages"][1]["content"][0]["image_url"]["url"].split(",")[1])
            return reply("no record" if data == b"image2" else answer)

        return models.VisionStructurer(client)

    keep = store.ArtifactStore(spark, f"{tmp_path}/runs", "r")
    flow = Flow(structure=lambda f: models.structure_pages(f, make), rules=("phone-digits",), store=keep, prices=(0.15, 0.6))
    done, cells, summary = flow.run(forms, truth)
    assert summary["forms"] == 4 and summary["forms_with_output"] == 3 and summary["field_accuracy"]["critical"]["correct"] == 57
    assert {r.form_id: r.error_class for r in done.collect()}["2"] == "StructuringError" and keep.read("errors").count() == 1
    assert done.where("form_id = '0'").first().record.phone_a == "0612" and cells.count() == 240
    before = len(open(mark).read())
    flow.reuse = True
    assert flow.run(forms, truth)[2]["forms_with_output"] == 3
    assert len(open(mark).read()) - before == 2  # only the form that failed is asked again, twice


def test_no_form_is_asked_for_twice(spark, tmp_path):
    forms = spark.createDataFrame([(str(i), bytearray(b"image%d" % i), "png") for i in range(3)], "form_id string, content binary, suffix string")
    truth = spark.createDataFrame([(str(i), record()) for i in range(3)], S.T.StructType([S.T.StructField("form_id", S.T.StringType()), S.T.StructField("truth", S.RECORD_SCHEMA)]))
    answer, calls = json.dumps(record(phone_a="06 12")), tmp_path / "calls"
    calls.mkdir()

    def said(name):
        return (calls / name).read_text() if (calls / name).exists() else ""

    def counted(name):
        def step(batches):
            for rows in batches:
                with open(calls / name, "a") as f:
                    f.write("x" * len(rows))
                if name == "straighten":
                    yield rows.assign(content=[bytes(x) + b"!" for x in rows["content"]])[["form_id", "content", "suffix"]]
                else:
                    yield pd.DataFrame({"form_id": rows["form_id"], "answers": [{"date": "31/12/2023"}] * len(rows), "refine_failed": [x == "1" for x in rows["form_id"]]})

        return step

    def make():
        def client(body):
            with open(calls / "structure", "a") as f:
                f.write("x")
            return reply(answer)

        return models.VisionStructurer(client)

    def flow(keep):
        return Flow(
            structure=lambda f: models.structure_pages(f.select("form_id", "content", "suffix", "text"), make),
            straighten=lambda f: f.mapInPandas(counted("straighten"), "form_id string, content binary, suffix string"),
            refine=lambda f: f.select("form_id").mapInPandas(counted("refine"), "form_id string, answers map<string,string>, refine_failed boolean"),
            refine_paths=("date",), store=keep, reuse=keep is not None,
        )

    done, _, summary = flow(None).run(forms, truth)
    assert summary["forms_with_output"] == 3 and [len(said(x)) for x in ("straighten", "structure", "refine")] == [3, 3, 3]
    assert {r.form_id: r.record.date for r in done.collect()} == dict.fromkeys("012", "31/12/2023")
    keep = store.ArtifactStore(spark, f"{tmp_path}/runs", "r")
    flow(keep).run(forms, truth)
    assert bytes(keep.read("straightened").where("form_id = '1'").select(F.unbase64(F.get_json_object("json", "$.content")).alias("c")).first().c) == b"image1!"
    flow(keep).run(forms, truth)
    assert [len(said(x)) for x in ("straighten", "structure", "refine")] == [6, 6, 7]  # only the re-reading that failed is done again


def test_kernels(spark):
    page = np.full((400, 300, 3), 255, np.uint8)
    page[60:380, 80:90] = page[60:380, 200:210] = (60, 160, 60)
    left, right, top = kernels.zone_cuts(page)
    assert abs(left - 80 / 300) < 0.01 and abs(right - 209 / 300) < 0.01 and abs(top - 60 / 400) < 0.01
    with pytest.raises(ValueError):
        kernels.zone_cuts(np.full((100, 100, 3), 255, np.uint8))
    photo = np.zeros((400, 400, 3), np.uint8)
    photo[80:320, 100:300] = 250
    c = kernels.page_corners(photo)
    assert np.abs(c - np.array([(100, 80), (300, 80), (300, 320), (100, 320)])).max() <= 8
    assert kernels.flatten_page(photo, c).mean() > 230
    blank = np.full((100, 200), 255.0)
    blank[40:60, 40:60] = 200
    blank[42:58, 42:58] = 255
    moved = np.roll(blank, (3, -4), (0, 1))
    assert kernels.local_shift(moved, blank, (30, 30, 70, 70)) == (-4, 3)
    moved[46:60, 40:52] = 0
    assert kernels.tick_scores(moved, blank, [(40, 40, 60, 60)])[0] > 0.14 > kernels.tick_scores(blank, blank, [(40, 40, 60, 60)])[0]
    tiles = np.full((50, 100, 3), 128, np.uint8)
    tiles[:, 50:] = (0, 0, 255)
    assert kernels.most_coloured(tiles, {"a": (0, 0, 50, 50), "b": (50, 0, 100, 50)}) == "b"
    ink = np.zeros((120, 240))
    ys, xs = np.mgrid[:120, :240]
    ink[np.abs(np.hypot(xs - 160, ys - 60) - 22) < 2] = 255
    assert kernels.most_circled(ink, [(60, 60), (160, 60)]) == 1
    blank_picture = np.full((662, 464, 3), 255, np.uint8)
    picture = blank_picture.copy()
    picture[220:440, 300:438] = (224, 168, 46)
    rows = spark.createDataFrame([("none", 662, 464, 3, bytearray(blank_picture.tobytes())), ("blue", 662, 464, 3, bytearray(picture.tobytes()))], "origin string, height int, width int, nChannels int, data binary")
    patches = kernels.over_images(rows, lambda x: kernels.blue_patch(x, overlay.IMPACT_SIZE), "array<double>")
    assert {r.origin: r.zone for r in patches.select("origin", overlay.patch_zone(F.col("value")).alias("zone")).collect()} == {"none": "front_left", "blue": "right"}
    crop = kernels.field_crop(np.full((50, 50, 3), 77, np.uint8), (20, 20, 30, 30))
    assert crop.shape == (72, 90, 3) and (crop == 77).all()
    rows = spark.createDataFrame([("a", 400, 300, 3, bytearray(page.tobytes())), ("b", -1, -1, -1, bytearray())], "origin string, height int, width int, nChannels int, data binary")
    got = {r.origin: r for r in kernels.over_images(rows, lambda x: [float(v) for v in kernels.zone_cuts(x)], "array<double>").collect()}
    assert len(got["a"].value) == 3 and got["b"].value is None and "unreadable" in got["b"].error


def test_streamed_evaluations(spark, tmp_path):
    from formgrain.streaming.incremental import append_new, stream_evaluations

    (tmp_path / "in").mkdir()
    line = {"form_id": "1", "produced_output": True, "fields": [{"path": "date", "kind": S.CRITICAL, "expected": "a", "predicted": "b", "correct": False, "edit_distance": 1, "reference_length": 1}, {"path": "vehicle_a.circumstances", "kind": S.TICKS, "expected": [1], "predicted": [1, 2], "correct": False, "edit_distance": 0, "reference_length": 0}], "usage": None}
    seen = []
    for n in range(2):
        (tmp_path / "in" / f"{n}.json").write_text(json.dumps(line | {"form_id": str(n)}) + "\n")
        append_new(stream_evaluations(spark, str(tmp_path / "in")), lambda df, _: seen.extend(df.collect()), str(tmp_path / "check")).awaitTermination()
    assert [r.form_id for r in seen] == ["0", "0", "1", "1"] and seen[1].predicted_ticks == [1, 2]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = duck.execute(sql).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    order = lambda df: df[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(want), order(got), check_dtype=False, rtol=1e-9)


def test_entry(spark):
    assert entry.entry(spark).count() > 20
    assert set(entry.oracle_sql()) <= set(entry.queries())
