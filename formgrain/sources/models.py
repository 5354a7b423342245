"""Model steps: readers of pages, structurers and re-readers behind served models, as Arrow functions over rows.

A step takes rows and returns rows with its result and, where it failed, the error and its class; a form that fails is a row, and
the run goes on. Clients are made once in each worker from a factory, which tests replace by a fake.
"""

from __future__ import annotations

import base64
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from formgrain import schema as S
from formgrain.errors import ConfigurationError, OcrError, PipelineError, StraighteningError, StructuringError
from formgrain.functions.text import LOOP_PATTERN
from formgrain.operators import kernels, layout

# ------------------------------------------------------------------------------------------------ registries


class Client(Protocol):
    """Sends one request body, returns the decoded reply; raises OSError or ValueError."""

    def __call__(self, body: dict) -> dict: ...


class Registry(dict):
    """Names of a kind of step; an unknown one names the known."""

    def __init__(self, kind: str):
        super().__init__()
        self.kind = kind

    def register(self, name: str):
        def put(f):
            self[name] = f
            return f

        return put

    def build(self, name: str, *args, **options):
        if name not in self:
            raise ConfigurationError(f"unknown {self.kind} {name!r}; known: {', '.join(sorted(self))}")
        return self[name](*args, **options)


OCR, STRUCTURERS, STRAIGHTENERS = Registry("OCR engine"), Registry("structurer"), Registry("straightener")


class HttpClient:
    """POST to a chat-completions server."""

    def __init__(self, url: str, token: str = "", timeout: float = 1800.0):
        self.url, self.timeout = url.rstrip("/") + "/v1/chat/completions", timeout
        self.headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {token}"} if token else {})

    def __call__(self, body: dict) -> dict:
        request = urllib.request.Request(self.url, json.dumps(body).encode(), self.headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)


FAILURES = (OSError, urllib.error.URLError, KeyError, IndexError, TypeError, ValueError)


def content(reply: dict) -> str:
    return reply["choices"][0]["message"]["content"]


def image_part(data: bytes, suffix: str) -> dict:
    mime = "image/png" if suffix.lower() == "png" else "image/jpeg"
    return {"type": "image_url", "image_url": {"url": f"data:{mime};base64,{base64.b64encode(data).decode()}"}}


# ------------------------------------------------------------------------------------- output format and validation

#: How a key's type is named to a model.
TYPE_NAMES = {"string": "text", "int": "integer", "boolean": "true or false", "array<int>": "list of integers"}
#: What each key means, for the prompt.
MEANINGS = {
    "date": "day of the accident, as dd/mm/yyyy", "time": "time of the accident, as 14h30", "place": "street and town of the accident",
    "phone_a": "telephone of the first driver, digits only", "phone_b": "telephone of the second driver, digits only", "other_damage": "whether things other than the two vehicles were damaged",
    "vehicle_a": "the vehicle in the left column", "vehicle_b": "the vehicle in the right column", "vehicle_type": "the kind of vehicle whose box is ticked", "make": "maker of the vehicle", "model": "model of the vehicle",
    "plate": "registration number, parts joined by hyphens", "coming_from": "street it came from", "going_to": "street it was going to", "insured_last_name": "family name of the insured", "insured_first_name": "given name of the insured",
    "insured_address": "address of the insured", "insurer": "insurance company", "attestation_no": "number of the insurance certificate", "policy_no": "number of the policy", "valid_from": "first day of cover, as dd/mm/yyyy", "valid_to": "last day of cover, as dd/mm/yyyy",
    "agency": "agency that issued the policy", "driver_last_name": "family name of the driver", "driver_first_name": "given name of the driver", "driver_address": "address of the driver", "license_no": "number of the driving licence",
    "license_category": "circled category of the licence", "license_issued": "day the licence was issued, as dd/mm/yyyy", "license_prefecture": "town that issued the licence", "license_valid_until": "day the licence ends, as dd/mm/yyyy", "damage": "visible damage, as written",
    "circumstances": "numbers of the ticked boxes, from the top", "circumstance_count": "the number written under the ticked boxes", "impact_zone": "where the vehicle was hit first",
}


def _type_name(name: str) -> str:
    if name in S.VOCABULARIES:
        return " | ".join(S.VOCABULARIES[name])
    return TYPE_NAMES[S.field_type(name).simpleString()]


def empty_record() -> dict:
    """The record with every value null, put together from the paths of its cells."""
    out: dict = {}
    for path, name, _ in S.PATHS:
        *above, _ = path.split(".")
        (out.setdefault(above[0], {}) if above else out)[name] = None
    return out


def key_table() -> list[tuple[str, str, str]]:
    """Key, type and meaning of each key that a model is told about; the second vehicle has the keys of the first."""
    first, *others = S.VEHICLES
    rows = [(n, _type_name(n), MEANINGS[n]) for n in S.TOP_FIELDS]
    rows += [(first, "object", MEANINGS[first]), *((f"{first}.{n}", _type_name(n), MEANINGS[n]) for n in S.VEHICLE_FIELDS)]
    return rows + [(v, "object", f"{MEANINGS[v]}; keys as in {first}") for v in others]


def format_instructions() -> str:
    """What a model is told about its output; made from the tables of fields, so a new field needs one more meaning and nothing else."""
    table = "\n".join(f"{key} [{kind}] {meaning}" for key, kind, meaning in key_table())
    return f"Reply with this JSON object, filled in, and with nothing around it. Keep every key; leave null what is missing or unreadable.\n{json.dumps(empty_record())}\n\n{table}"


#: What a model is asked to do, by the kind of input that it gets.
PROMPTS = {
    "image": "The image shows a filled-in accident form with one column for each vehicle. Read what is written, ticked and circled by hand; the print is not an answer.",
    "text": "The text was read from a filled-in accident form by machine, without regard to its columns. Letters may be wrong; take each value from the words printed beside it.",
    "zones": "The text was read from a filled-in accident form by machine. It has one part for each zone of the page, under a heading that names the zone; values of a vehicle stand in its own part.",
    "blocks": "The text holds the blocks of a filled-in accident form by zone, each in reading order, with ticked boxes as [x] and empty ones as [ ].",
}


def json_schema(schema: T.StructType = S.RECORD_SCHEMA) -> dict:
    """For guided decoding: every key nullable, closed vocabularies as enumerations."""
    types = {"string": {"type": "string"}, "int": {"type": "integer"}, "boolean": {"type": "boolean"}, "array<int>": {"type": "array", "items": {"type": "integer"}}}

    def of(f: T.StructField) -> dict:
        if isinstance(f.dataType, T.StructType):
            one = json_schema(f.dataType)
        else:
            one = types[f.dataType.simpleString()] | ({"enum": list(S.VOCABULARIES[f.name])} if f.name in S.VOCABULARIES else {})
        return {"anyOf": [one, {"type": "null"}], "default": None}

    return {"type": "object", "properties": {f.name: of(f) for f in schema}}


_TRUE, _FALSE = {"true", "t", "yes", "y", "on", "1"}, {"false", "f", "no", "n", "off", "0"}


def _value(value, f: T.StructField):
    """One leaf, lax as to its type where nothing is lost; else ValueError."""
    kind = f.dataType.simpleString()
    if value is None:
        return None
    if isinstance(f.dataType, T.StructType):
        return _object(value, f.dataType)
    if kind == "string":
        if not isinstance(value, str) or (f.name in S.VOCABULARIES and value not in S.VOCABULARIES[f.name]):
            raise ValueError(f"{f.name}: {value!r}")
        return value
    if kind == "boolean":
        if isinstance(value, bool):
            return value
        if str(value).lower() in _TRUE | _FALSE and isinstance(value, (str, int)):
            return str(value).lower() in _TRUE
    if kind == "int":
        if isinstance(value, (bool, int)):
            return int(value)
        if isinstance(value, float) and value.is_integer():
            return int(value)
        if isinstance(value, str):
            return int(value.strip())
    if kind == "array<int>" and isinstance(value, list):
        item = T.StructField(f.name, T.IntegerType())
        if None not in value:
            return [_value(x, item) for x in value]
    raise ValueError(f"{f.name}: {value!r}")


def _object(value, schema: T.StructType) -> dict:
    if not isinstance(value, dict):
        raise ValueError(f"not an object: {value!r}")
    return {f.name: _value(value.get(f.name), f) for f in schema}


def validate(text: str) -> dict:
    """A model's answer as a record; a wrong type or word fails the whole form, and so does a record without any value."""
    raw = json.loads(text)
    record = _object(raw, S.RECORD_SCHEMA)
    if all(v is None for v in record.values()):
        raise ValueError("a record with no value at all")
    return record


# -------------------------------------------------------------------------------------------------------- readers


def looped(text: str) -> bool:
    """The loop detector on one Python string: the same pattern as the column function."""
    import re

    pattern = re.compile(LOOP_PATTERN.replace("^(?s)", ""), re.S)
    return any(bool(pattern.match(t[-1250:][::-1])) for t in ([text, text[:-50]] if len(text) > 50 else [text]))


def sampling(attempt: int) -> tuple[float, float]:
    """Temperature and top-p: cold first, then warmer each time."""
    return (0.0, 0.1) if attempt == 0 else (min(0.2 * attempt, 0.8), 0.95)


@STRAIGHTENERS.register("corners")
def straighten_images(images: DataFrame) -> DataFrame:
    """Decoded images (form_id and the columns of the image source) -> form_id, content (a PNG file of the flat page), suffix, error, error_class."""
    done = kernels.over_images(images, kernels.straight, "binary", keep=("form_id",))
    kind = F.when(F.col("error").isNotNull(), StraighteningError.__name__)
    return done.select("form_id", F.col("value").alias("content"), F.lit("png").alias("suffix"), "error", kind.alias("error_class"))


def column_pages(images: DataFrame, engine: Callable[[object], list[tuple[float, float, str]]]) -> DataFrame:
    """Decoded images -> form_id, text by zones, error: boxes (centre x and y in shares of the page, text) of any local ``engine``, and the form's own strips.

    The engine and the search for the strips run on each image; zones and reading order are DataFrame operations.
    """

    def look(image):
        return {"cuts": [float(x) for x in kernels.zone_cuts(image)], "boxes": [{"x": float(x), "y": float(y), "text": t} for x, y, t in engine(image)]}

    seen = kernels.over_images(images, look, "struct<cuts: array<double>, boxes: array<struct<x: double, y: double, text: string>>>", keep=("form_id",))
    boxes = seen.where("error is null").select("form_id", F.col("value.cuts").alias("cuts"), F.explode("value.boxes").alias("b")).select("form_id", "cuts", "b.*")
    cut = [F.col("cuts")[i] for i in range(3)]
    texts = layout.zone_text(boxes.withColumn("zone", layout.zone_of(F.col("x"), F.col("y"), *cut)), ["form_id"])
    blank = "\n\n".join(f"## {z}\n" for z in layout.ZONES)
    found = seen.select("form_id", "error").join(texts, "form_id", "left")
    return found.select("form_id", F.when(F.col("error").isNull(), F.coalesce("page_text", F.lit(blank))).alias("text"), "error")


@OCR.register("none")
class NullReader:
    """No text, without looking at the image."""

    def read(self, form_id: str, image: bytes, suffix: str) -> tuple[str, bool]:
        return "", False


@OCR.register("chandra-ocr-2")
class PageReader:
    """A page to layout HTML by a served model; an answer that ends in a loop is asked for again, warmer."""

    def __init__(self, client: Client, model: str = "chandra-ocr-2", prompt: str = "Give the page as HTML blocks with their boxes.", most_tokens: int = 8000, retries: int = 6):
        self.client, self.model, self.prompt, self.most_tokens, self.retries = client, model, prompt, most_tokens, retries

    def read(self, form_id: str, image: bytes, suffix: str) -> tuple[str, bool]:
        """The answer, and whether it still ends in a loop (the last one is used all the same)."""
        text = ""
        for attempt in range(self.retries + 1):
            temperature, top_p = sampling(attempt)
            message = {"role": "user", "content": [image_part(image, suffix), {"type": "text", "text": self.prompt}]}
            try:
                text = content(self.client({"model": self.model, "temperature": temperature, "top_p": top_p, "max_tokens": self.most_tokens, "messages": [message]}))
            except FAILURES as e:
                raise OcrError(f"page reader failed: {e!r}", form_id) from e
            if not looped(text):
                return text, False
        return text, True


def _missing(name: str):
    def build(*_, **__):
        raise ConfigurationError(f"the library of the OCR engine {name!r} is not installed")

    return build


for _name in ("tesseract", "rapidocr", "rapidocr-v6", "rapidocr-v6-columns", "doctr"):  # local engines: an optional install
    OCR[_name] = _missing(_name)


@STRUCTURERS.register("vision")
class VisionStructurer:
    """An image to a record by a served model with guided decoding."""

    needs_text = False

    def __init__(self, client: Client, model: str = "", prompt: str = "image", most_tokens: int = 4000):
        self.client, self.model, self.prompt, self.most_tokens = client, model, PROMPTS.get(prompt, prompt), most_tokens

    def body(self, image: bytes, suffix: str, text: str | None) -> dict:
        ask = [image_part(image, suffix), {"type": "text", "text": "Fill the record for this form."}]
        messages = [{"role": "system", "content": f"{self.prompt}\n{format_instructions()}"}, {"role": "user", "content": ask}]
        guide = {"type": "json_schema", "json_schema": {"name": "record", "schema": json_schema()}}
        return {"model": self.model, "temperature": 0, "max_tokens": self.most_tokens, "response_format": guide, "chat_template_kwargs": {"enable_thinking": False}, "messages": messages}

    def structure(self, form_id: str, image: bytes, suffix: str, text: str | None) -> tuple[dict, int, int]:
        """Record, tokens in, tokens out."""
        if self.needs_text and text is None:
            raise StructuringError("no text to structure", form_id)
        try:
            reply = self.client(self.body(image, suffix, text))
            record = validate(content(reply))
        except FAILURES as e:
            raise StructuringError(f"model output is no record: {e!r}", form_id) from e
        usage = reply.get("usage") or {}
        return record, usage.get("prompt_tokens", 0), usage.get("completion_tokens", 0)


@STRUCTURERS.register("text")
class TextStructurer(VisionStructurer):
    """Text of a page to a record, in JSON mode."""

    needs_text = True

    def __init__(self, client: Client, model: str = "", prompt: str = "text", most_tokens: int = 4000):
        super().__init__(client, model, prompt, most_tokens)

    def body(self, image: bytes, suffix: str, text: str | None) -> dict:
        messages = [{"role": "system", "content": f"{self.prompt}\n{format_instructions()}"}, {"role": "user", "content": text}]
        return {"model": self.model, "temperature": 0, "max_tokens": self.most_tokens, "response_format": {"type": "json_object"}, "messages": messages}


class FieldReader:
    """Reads fields again from crops of a page: one call for a form; a call that fails is tried again, later each time."""

    def __init__(self, client: Client, names: list[str], model: str = "", tries: int = 3, wait: float = 5.0, sleep: Callable[[float], None] = time.sleep):
        if unknown := [n for n in names if n not in S.FIELD_KINDS]:
            raise ConfigurationError(f"no such field: {unknown[0]!r}")
        self.client, self.model, self.tries, self.wait, self.sleep = client, model, tries, wait, sleep
        header = [n for n in names if n in S.TOP_FIELDS]
        self.paths = [*header, *(f"{v}.{n}" for v in S.VEHICLES for n in names if n in S.VEHICLE_FIELDS)]

    def schema(self) -> dict:
        """One flat object: a string or null for each path that is read again."""
        return {"type": "object", "properties": {p: {"type": ["string", "null"]} for p in self.paths}, "required": self.paths, "additionalProperties": False}

    def body(self, crops: dict[str, bytes]) -> dict:
        """One user message: each crop under its path."""
        message: list[dict] = []
        for path in self.paths:
            if path in crops:
                message += [{"type": "text", "text": path}, image_part(crops[path], "png")]
        message.append({"type": "text", "text": "Give the handwriting of each crop under its path, or null."})
        guide = {"type": "json_schema", "json_schema": {"name": "crops", "schema": self.schema()}}
        return {"model": self.model, "temperature": 0, "max_tokens": 3000, "response_format": guide, "messages": [{"role": "user", "content": message}]}

    def ask(self, crops: dict[str, bytes]) -> dict[str, str] | None:
        """Answers by path, or None when every try failed. ``crops``: PNG images by path."""
        waits = [self.wait * 2**i for i in range(self.tries - 1)]
        for wait in [*waits, None]:
            try:
                answer = json.loads(content(self.client(self.body(crops))))
                return {p: answer[p] for p in self.paths if isinstance(answer.get(p), str)}
            except (*FAILURES, AttributeError):
                if wait is not None:
                    self.sleep(wait)
        return None


# ------------------------------------------------------------------------------------------------ steps over rows

READ = "form_id string, text string, seconds double, looped boolean, error string, error_class string"
STRUCTURED = "form_id string, record string, input_tokens long, output_tokens long, seconds double, error string, error_class string"


def _attempt(call, tries: int = 1):
    """(result, seconds, error, class): a pipeline error is tried again ``tries`` times in all, then returned."""
    start = time.perf_counter()
    for n in range(tries):
        try:
            return call(), time.perf_counter() - start, None, None
        except PipelineError as e:
            if n + 1 == tries:
                return None, None, str(e), type(e).__name__
        except Exception as e:  # any other failure of a step is a row as well
            return None, None, repr(e), type(e).__name__


def read_pages(images: DataFrame, make: Callable[[], object]) -> DataFrame:
    """(form_id, content, suffix) -> READ. ``make`` builds the reader in the worker."""

    def run(batches: Iterator[pd.DataFrame]):
        reader = make()
        for rows in batches:
            out = []
            for r in rows.itertuples():
                found, seconds, error, kind = _attempt(lambda r=r: reader.read(r.form_id, r.content, r.suffix))
                out.append((r.form_id, found and found[0], seconds, found and found[1], error, kind))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in READ.split(", ")])

    return images.select("form_id", "content", "suffix").mapInPandas(run, READ)


def structure_pages(pages: DataFrame, make: Callable[[], VisionStructurer], tries: int = 2) -> DataFrame:
    """(form_id, content, suffix, text) -> STRUCTURED with ``record`` as a struct."""

    def run(batches: Iterator[pd.DataFrame]):
        step = make()
        for rows in batches:
            out = []
            for r in rows.itertuples():
                found, seconds, error, kind = _attempt(lambda r=r: step.structure(r.form_id, r.content, r.suffix, r.text), tries)
                out.append((r.form_id, found and json.dumps(found[0]), found and found[1], found and found[2], seconds, error, kind))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in STRUCTURED.split(", ")]).astype({"input_tokens": "Int64", "output_tokens": "Int64"})

    rows = pages.select("form_id", "content", "suffix", "text").mapInPandas(run, STRUCTURED)
    return rows.withColumn("record", F.from_json("record", S.RECORD_SCHEMA))
