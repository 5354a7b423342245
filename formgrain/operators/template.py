"""Geometry of the printed form as tables: where values are written, letters circled and answers ticked. Pages meet it by a broadcast join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formgrain import schema as S

# Places on the page in points (x0, y0, x1, y1). The left column ends at the first edge, the right one starts at the second.
COLUMN_EDGES = 185, 430
HEADER = {"date": (90, 77, 135, 88), "time": (168, 77, 212, 88), "place": (58, 90, 300, 101), "phone_a": (75, 133, 300, 144), "phone_b": (430, 133, 548, 144)}
#: Name: top, bottom and left edge in the left column; top, bottom and right edge in the right one.
LINES = {
    "model": ((170, 182, 70), (172, 182, 548)), "make": ((190, 200, 67), (191, 201, 542)), "plate": ((202, 212, 130), (203, 213, 491)), "coming_from": ((213, 223, 55), (215, 225, 543)), "going_to": ((224, 234, 57), (227, 237, 539)),
    "insured_last_name": ((260, 270, 39), (264, 274, 487)), "insured_first_name": ((279, 289, 48), (276, 286, 530)), "insured_address": ((290, 300, 49), (288, 298, 553)), "insurer": ((301, 311, 78), (300, 310, 536)), "attestation_no": ((312, 322, 78), (312, 322, 540)),
    "policy_no": ((323, 333, 65), (324, 334, 544)), "agency": ((364, 375, 49), (359, 369, 508)), "driver_last_name": ((402, 412, 39), (398, 408, 487)), "driver_first_name": ((421, 431, 48), (410, 420, 530)), "driver_address": ((432, 442, 49), (422, 432, 553)),
    "license_no": ((444, 454, 100), (434, 444, 521)), "license_issued": ((466, 477, 54), (458, 468, 541)), "license_prefecture": ((476, 486, 86), (467, 477, 547)), "license_valid_until": ((487, 497, 97), (479, 489, 518)),
}
#: Those that do not end at a column's edge.
BOXES = {"valid_from": ((92, 346, 127, 357), (488, 348, 524, 358)), "valid_to": ((140, 346, 185, 357), (432, 348, 473, 358)), "damage": ((21, 626, 185, 650), (430, 621, 574, 633))}
LETTER_X = (27, 38, 49, 60.5, 71.5, 83, 94), (568.5, 557.5, 546, 534.5, 523.5, 512.5, 501)
LETTER_Y = 459, 449
OTHER_DAMAGE = {True: [(236, 105.5, 250.5, 116.5), (397.5, 105.5, 412.5, 116.5)], False: [(288.5, 105.5, 303, 116.5), (348.5, 105.5, 363, 116.5)]}
#: The vehicle-type picture is 362 x 336; its tiles.
PICKER_SIZE = 362, 336
TILES = {"moto": (5, 5, 178, 105), "tricycle": (184, 5, 357, 105), "car": (5, 116, 178, 216), "bus": (184, 116, 357, 216), "truck": (5, 227, 357, 327)}
SQUARE = 6, 9  # least and greatest side of a tick box
MIDDLE = 300
PAGE = 1653, 2339  # the page in pixels at 200 to the inch

BOX_TABLE = "kind string, path string, x0 double, y0 double, x1 double, y1 double"


def rows() -> list[tuple]:
    """(kind, path, x0, y0, x1, y1) of every place: fields, licence letters (a point each) and yes/no cells."""
    out = [("field", name, *box) for name, box in HEADER.items()]
    for side, vehicle in enumerate(S.VEHICLES):
        for name in S.VEHICLE_FIELDS:
            if name in LINES:
                top, bottom, edge = LINES[name][side]
                left, right = ((edge, COLUMN_EDGES[0]), (COLUMN_EDGES[1], edge))[side]
                out.append(("field", f"{vehicle}.{name}", left, top, right, bottom))
            elif name in BOXES:
                out.append(("field", f"{vehicle}.{name}", *BOXES[name][side]))
        out += [("letter", f"{vehicle}.{letter}", x, LETTER_Y[side], x, LETTER_Y[side]) for letter, x in zip(S.LICENSE_CATEGORIES, LETTER_X[side])]
    out += [("answer", f"other_damage.{str(answer).lower()}", *cell) for answer, cells in OTHER_DAMAGE.items() for cell in cells]
    return [(kind, path, *map(float, box)) for kind, path, *box in out]


def places(spark: SparkSession) -> DataFrame:
    """The places as a table of about seventy rows, in points."""
    return spark.createDataFrame(rows(), BOX_TABLE)


def on_pages(pages: DataFrame, boxes: DataFrame, scale: float) -> DataFrame:
    """Every page with every place, in pixels: each small table of places goes to the pages, which stay where they are."""
    pixel = [F.round(F.col(c) * scale).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")]
    return pages.crossJoin(F.broadcast(boxes.select("kind", "path", *pixel)))


def tick_squares(drawings: DataFrame) -> DataFrame:
    """Tick boxes of a template, from its drawn rectangles (type, x0, y0, x1, y1 in points): side, number (from 1, top to bottom) and the box.

    A square that is drawn twice, or that differs by less than half a point, is one.
    """
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    inside = lambda x: (x > SQUARE[0]) & (x < SQUARE[1])
    squares = drawings.where((F.col("type") == "fs") & inside(width) & inside(height)).select(*[F.bround(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")]).distinct()
    sided = squares.withColumn("vehicle", F.when(F.col("x0") < MIDDLE, S.VEHICLES[0]).otherwise(S.VEHICLES[1]))
    return sided.withColumn("number", F.row_number().over(Window.partitionBy("vehicle").orderBy("y0", "x0")))
