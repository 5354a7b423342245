"""The record, its fields and how each is scored. Everything else is generated from these tables."""

from __future__ import annotations

from pyspark.sql import types as T

CRITICAL, MINOR, TICKS, TICK_COUNT, CATEGORY = "critical_text", "minor_text", "ticks", "tick_count", "category"
TEXT_KINDS = (CRITICAL, MINOR)

# Field names, kinds and vocabularies of the form.
VEHICLE_TYPES = ("car", "moto", "tricycle", "bus", "truck")
IMPACT_ZONES = ("front", "rear", "left", "right", "front_left", "front_right", "rear_left", "rear_right")
LICENSE_CATEGORIES = ("A1", "A", "B", "C", "D", "E", "F")
VEHICLES = ("vehicle_a", "vehicle_b")
TOP_FIELDS = {"date": CRITICAL, "time": MINOR, "place": MINOR, "phone_a": MINOR, "phone_b": MINOR, "other_damage": CATEGORY}
VEHICLE_FIELDS = {
    "vehicle_type": CATEGORY, "make": MINOR, "model": MINOR, "plate": CRITICAL, "coming_from": MINOR, "going_to": MINOR,
    "insured_last_name": MINOR, "insured_first_name": MINOR, "insured_address": MINOR, "insurer": CRITICAL, "attestation_no": CRITICAL,
    "policy_no": CRITICAL, "valid_from": CRITICAL, "valid_to": CRITICAL, "agency": MINOR, "driver_last_name": MINOR, "driver_first_name": MINOR,
    "driver_address": MINOR, "license_no": CRITICAL, "license_category": CATEGORY, "license_issued": CRITICAL, "license_prefecture": MINOR,
    "license_valid_until": CRITICAL, "damage": MINOR, "circumstances": TICKS, "circumstance_count": TICK_COUNT, "impact_zone": CATEGORY,
}
VOCABULARIES = {"vehicle_type": VEHICLE_TYPES, "impact_zone": IMPACT_ZONES, "license_category": LICENSE_CATEGORIES}

FIELD_KINDS = TOP_FIELDS | VEHICLE_FIELDS
_SPECIAL = {"circumstances": T.ArrayType(T.IntegerType()), "circumstance_count": T.IntegerType(), "other_damage": T.BooleanType()}


def field_type(name: str) -> T.DataType:
    return _SPECIAL.get(name, T.StringType())


VEHICLE_SCHEMA = T.StructType([T.StructField(n, field_type(n)) for n in VEHICLE_FIELDS])
RECORD_SCHEMA = T.StructType([T.StructField(n, field_type(n)) for n in TOP_FIELDS] + [T.StructField(v, VEHICLE_SCHEMA) for v in VEHICLES])

#: (path, name, kind) of the 60 cells of a form, in scoring order.
PATHS = [(n, n, k) for n, k in TOP_FIELDS.items()] + [(f"{v}.{n}", n, k) for v in VEHICLES for n, k in VEHICLE_FIELDS.items()]

MANIFEST_SCHEMA = T.StructType([T.StructField(n, T.LongType() if n == "seed" else T.StringType()) for n in ("id", "split", "level", "seed", "image", "truth", "image_sha256", "truth_sha256")])
USAGE_SCHEMA = T.StructType([T.StructField("ocr_seconds", T.DoubleType()), T.StructField("structure_seconds", T.DoubleType()), T.StructField("input_tokens", T.LongType()), T.StructField("output_tokens", T.LongType())])
_CELL = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("path", "kind", "expected", "predicted")]
    + [T.StructField("correct", T.BooleanType()), T.StructField("edit_distance", T.LongType()), T.StructField("reference_length", T.LongType())]
)
#: A saved evaluation; ``expected`` and ``predicted`` arrive as JSON text where they are lists.
EVALUATION_SCHEMA = T.StructType([T.StructField("form_id", T.StringType()), T.StructField("produced_output", T.BooleanType()), T.StructField("fields", T.ArrayType(_CELL)), T.StructField("usage", USAGE_SCHEMA)])
