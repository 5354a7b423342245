import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from formgrain import schema as S
from formgrain.__main__ import main
from formgrain.errors import ConfigurationError
from formgrain.functions import text as X
from formgrain.operators import kernels, template
from formgrain.plans import assemble
from formgrain.sources import dataset, generator, models


def photo():
    """A green-striped page on a dark desk."""
    image = np.full((300, 240, 3), 20, np.uint8)
    image[20:280, 20:220] = 240
    image[100:250, 90:96] = image[100:250, 150:156] = (60, 160, 60)
    return image


@pytest.fixture(scope="module")
def forms(tmp_path_factory):
    root = tmp_path_factory.mktemp("forms")
    (root / "images").mkdir()
    (root / "truth").mkdir()
    lines = []
    for i in range(4):
        (root / "images" / f"{i:06d}.png").write_bytes(kernels.png(photo()) if i != 3 else b"no image")
        (root / "truth" / f"{i:06d}.json").write_text(generator.truth_text(i))
        lines.append(json.dumps({"id": f"{i:06d}", "split": "dev" if i < 2 else "test", "level": "scan", "seed": i, "image": f"images/{i:06d}.png", "truth": f"truth/{i:06d}.json"}))
    (root / "manifest.jsonl").write_text("\n".join(lines))
    (root / "dataset.json").write_text(json.dumps({"count": 4, "dev": 2, "base_seed": 0, "level": "scan", "fingerprint": "abc"}))
    return root


@pytest.fixture
def server():
    """A model server that answers each form with its answer key's first fields, and crops with one value."""
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, self.headers.get("Authorization"), body))
            name = body["response_format"].get("json_schema", {}).get("name")
            answer = {"vehicle_a.plate": "1-A-1"} if name == "crops" else {k: v for k, v in generator.sample_record(0).items() if k != "sketch"}
            reply = {"choices": [{"message": {"content": json.dumps(answer)}}], "usage": {"prompt_tokens": 10, "completion_tokens": 5}}
            data = json.dumps(reply).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", asked
    http.shutdown()


def test_images_are_read_flattened_and_cut(spark, forms):
    images = dataset.images(spark, f"{forms}/images")
    rows = {r.origin[-10:-4]: r for r in images.collect()}
    assert "cannot read" in rows["000003"].error and rows["000000"].error is None
    assert np.frombuffer(rows["000000"].data, np.uint8).reshape(300, 240, 3).tolist() == photo().tolist()
    raw = dataset.image_bytes(spark, f"{forms}/images")
    assert raw.count() == 4 and bytes(raw.where("path like '%000001.png'").first().content) == kernels.png(photo())
    kept = dataset.decoded_photos(spark, str(forms), dataset.manifest(spark, str(forms)))
    flat = {r.form_id: r for r in models.STRAIGHTENERS["corners"](kept).collect()}
    assert flat["000003"].error_class == "StraighteningError" and flat["000003"].content is None
    page = kernels.from_png(bytes(flat["000000"].content))
    assert abs(page.shape[0] - 260) < 20 and abs(page.shape[1] - 200) < 20 and (page[5:20, 5:20] > 200).all()
    gray = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert kernels.from_png(kernels.png(gray)).tolist() == gray.tolist()
    with pytest.raises(ValueError):
        kernels.from_png(b"x" * 60)


def test_pages_read_by_columns(spark, forms):
    kept = dataset.decoded_photos(spark, str(forms), dataset.manifest(spark, str(forms)))
    engine = lambda image: [(0.2, 0.6, "left"), (0.2, 0.5, "above"), (0.5, 0.6, "middle"), (0.9, 0.6, "right"), (0.5, 0.05, "top")]
    got = {r.form_id: r for r in models.column_pages(kept, engine).collect()}
    assert got["000000"].text == "## header\ntop\n\n## vehicle_a\nabove\nleft\n\n## circumstances\nmiddle\n\n## vehicle_b\nright"
    assert got["000003"].text is None and "unreadable" in got["000003"].error
    nothing = models.column_pages(kept, lambda image: []).where("form_id = '000001'").first()
    assert nothing.text == "## header\n\n\n## vehicle_a\n\n\n## circumstances\n\n\n## vehicle_b\n"


def test_the_command_line_runs_the_configured_steps(spark, forms, server, tmp_path, capsys):
    url, asked = server
    settings = dataset.Settings(dataset_dir=str(forms), runs_dir=f"{tmp_path}/runs", straightener="corners", structure_url=url, server_token="t", repair_rules="all", refine_fields="plate", input_price=1.0, output_price=2.0, trace=True)
    assert main(["run", "--run-id", "r1", "--dev", "2", "--test", "1", "--workers", "2"], settings) == 0
    summary = json.loads(capsys.readouterr().out)
    assert summary["forms"] == summary["forms_with_output"] == 3 and summary["cost_and_time"]["input_tokens"] == 30
    assert json.load(open(tmp_path / "runs" / "r1" / "summary.json")) == summary
    described = json.load(open(tmp_path / "runs" / "r1" / "run.json"))
    assert described["dataset_fingerprint"] == "abc" and {"pyspark", "numpy"} <= set(described["versions"]) and "server_token" not in described["settings"]
    assert [x["id"] for x in described["forms"]] == ["000000", "000001", "000002"]
    assert {p for p, *_ in asked} == {"/v1/chat/completions"} and {a for _, a, _ in asked} == {"Bearer t"}
    pictures = [x for *_, b in asked for m in b["messages"] if isinstance(m["content"], list) for x in m["content"] if x["type"] == "image_url"]
    assert len(asked) == 6 and len(pictures) == 3 + 3 * 2  # a page each, and two crops each
    assert main(["run", "--run-id", "r1", "--dev", "2", "--test", "1", "--reuse"], settings) == 0
    assert len(asked) == 6 and json.loads(capsys.readouterr().out) == summary
    bad = dataset.Settings(**{**settings.__dict__, "dataset_dir": str(forms), "runs_dir": f"{tmp_path}/runs"})
    assert assemble.run(spark, bad, "r2", 0, 2)["forms_with_output"] == 1  # of two: one photo can't be read


def test_settings_that_are_not_known_are_errors():
    for wrong in ({"structurer": "x"}, {"ocr_engine": "x"}, {"straightener": "x"}, {"repair_rules": "x"}, {"refine_fields": "x"}, {"refine_fields": "plate"}):
        with pytest.raises(ConfigurationError):
            assemble.flow_of(dataset.Settings(**wrong))
    with pytest.raises(ConfigurationError):
        assemble.client("", dataset.Settings())
    loaded = dataset.Settings.load({"OCR_LANGUAGES": "fra, ara,", "READ_MARKS": "yes", "RETRIES": "4", "TEMPERATURE": "0.5"})
    assert loaded.ocr_languages == ("fra", "ara") and loaded.read_marks and loaded.retries == 4 and loaded.temperature == 0.5
    assert len(loaded.public()) == 24


def test_sample_and_dataset_commands(spark, tmp_path):
    assert main(["sample", "--seed", "5", "--out", f"{tmp_path}/s"], dataset.Settings()) == 0
    assert (tmp_path / "s" / "000005.json").read_text() == generator.truth_text(5)
    assert main(["dataset", "--count", "6", "--dev", "2", "--out", f"{tmp_path}/d"], dataset.Settings()) == 0
    rows = spark.read.json(f"{tmp_path}/d")
    assert rows.count() == 6 and rows.where("split = 'dev'").count() == 2 and rows.where("sha2(truth, 256) <> truth_sha256").count() == 0


def test_places_of_the_form_meet_every_page(spark):
    places = template.places(spark)
    fields = {r.path for r in places.where("kind = 'field'").collect()}
    assert len(fields) == 5 + 2 * 22 and fields <= {p for p, *_ in S.PATHS} and places.where("kind = 'letter'").count() == 14 and places.where("kind = 'answer'").count() == 4
    met = template.on_pages(spark.createDataFrame([("a",), ("b",)], "form_id string"), places, 2.0)
    assert met.count() == 2 * places.count()
    assert met.where("form_id = 'a' and path = 'vehicle_b.plate'").select("x0", "y0", "x1", "y1").first() == (860, 406, 982, 426)


def test_tick_squares_are_counted_once(spark):
    boxes = [("fs", 20.0 + side * 400, 100.0 + 10 * i, 27.2 + side * 400, 107.1 + 10 * i) for side in (0, 1) for i in range(23)]
    extra = [("fs", 20.2, 100.2, 27.4, 107.3), ("f", 20.0, 400.0, 27.0, 407.0), ("fs", 20.0, 400.0, 50.0, 407.0)]
    got = template.tick_squares(spark.createDataFrame(boxes + extra, "type string, x0 double, y0 double, x1 double, y1 double"))
    assert got.count() == 46
    assert {(r.vehicle, r.number): r.y0 for r in got.collect()}["vehicle_b", 23] == 320


def test_known_forms(spark):
    forms = spark.createDataFrame([("1", "dev"), ("2", "dev")], "id string, split string")
    assert dataset.known_forms(spark.createDataFrame([("2",)], "id string"), forms).collect() == [("2", "dev")]
    with pytest.raises(Exception, match="no form 9"):
        dataset.known_forms(spark.createDataFrame([("9",)], "id string"), forms).collect()


def test_normalised_texts_equal_full_case_folding(spark):
    texts = ["Straße", "ΣΊΣΥΦΟΣ Σ", "ﬁn ﬄ", "İstanbul ıI", "ŉ ǰ ΐ", "ẞ ß", "Ꭰ ꭰ", "plain TEXT", "ſ Kelvin K", "ᾳ ᾼ", "", None, "É é"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.n for r in rows.select("i", X.normalize(F.col("t")).alias("n")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else " ".join(t.split()).casefold()), t


def test_output_format_names_every_key():
    text = models.format_instructions()
    assert all(f"vehicle_a.{n} " in text for n in S.VEHICLE_FIELDS) and all(f"\n{n} " in text for n in S.TOP_FIELDS)
    assert set(models.MEANINGS) == {*S.TOP_FIELDS, *S.VEHICLE_FIELDS, *S.VEHICLES}
    assert json.loads(text.split("\n")[1])["vehicle_b"] == dict.fromkeys(S.VEHICLE_FIELDS)
    assert models.VisionStructurer(None).prompt == models.PROMPTS["image"] and models.TextStructurer(None, prompt="zones").prompt == models.PROMPTS["zones"]


def test_text_structurer_asks_in_json_mode_and_needs_a_text():
    bodies = []

    def client(body):
        bodies.append(body)
        return {"choices": [{"message": {"content": json.dumps({"date": "01/02/2023"})}}], "usage": {"prompt_tokens": 3, "completion_tokens": 2}}

    step = models.STRUCTURERS.build("text", client, "m", "blocks")
    record, tokens_in, tokens_out = step.structure("7", b"", "png", "## header\n01/02/2023")
    assert record["date"] == "01/02/2023" and (tokens_in, tokens_out) == (3, 2)
    assert bodies[0]["response_format"] == {"type": "json_object"} and bodies[0]["messages"][1]["content"] == "## header\n01/02/2023" and bodies[0]["messages"][0]["content"].startswith(models.PROMPTS["blocks"])
    with pytest.raises(models.StructuringError, match=r"\[7\]"):
        step.structure("7", b"", "png", None)


def test_reports_and_other_damage(spark, tmp_path):
    from formgrain.operators import overlay
    from formgrain.sources import store

    rows = spark.createDataFrame([("a", [0.4, 0.2], [0.1, 0.3]), ("b", [0.1], [0.1]), ("c", [0.0], [0.5])], "form_id string, yes array<double>, no array<double>")
    marked = rows.select("form_id", overlay.other_damage(F.col("yes"), F.col("no")).alias("damage"))
    store.write_report(marked, f"{tmp_path}/report")
    assert {r.form_id: r.damage for r in spark.read.json(f"{tmp_path}/report").collect()} == {"a": True, "b": False, "c": False}
