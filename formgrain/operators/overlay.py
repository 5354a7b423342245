"""Overlays: marks and re-read values that replace fields of a record, and the choices made from scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formgrain import schema as S
from formgrain.functions.geometry import overlap_share

TICK_THRESHOLD = 0.14
MARK_FIELDS = ("vehicle_type", "license_category", "impact_zone", "circumstances")

# The impact picture is 232 x 331; rectangles (x0, y0, x1, y1) of the front and side zones. The rear ones mirror the front.
IMPACT_SIZE = (232, 331)
_FRONT = {"front_left": (13, 17, 150, 91), "front": (82, 17, 150, 91), "front_right": (82, 17, 219, 91)}
_SIDES = {"left": (13, 110, 82, 220), "right": (150, 110, 219, 220)}
#: Zones in declared order, which settles ties.
ZONES = [
    *_FRONT.items(),
    *((name.replace("front", "rear"), (x0, IMPACT_SIZE[1] - y1, x1, IMPACT_SIZE[1] - y0)) for name, (x0, y0, x1, y1) in _FRONT.items()),
    *_SIDES.items(),
]


def ticks(scores: Column, threshold: float = TICK_THRESHOLD) -> Column:
    """Numbers (from 1) of the boxes whose ink share reaches the threshold."""
    marked = F.transform(scores, lambda s, i: F.when(s >= threshold, i + 1))
    return F.filter(marked, lambda x: x.isNotNull())


def _with_leaves(record: Column, new: dict[str, Column], made: dict[str, Column]) -> Column:
    """A record with new leaves, put together once; ``made``: when each vehicle is there."""
    leaf = lambda path: new.get(path, record[path] if "." not in path else record[path.split(".")[0]][path.split(".")[1]])
    tops = [leaf(n).alias(n) for n in S.TOP_FIELDS]
    sides = [F.when(made[v], F.struct(*[leaf(f"{v}.{n}").alias(n) for n in S.VEHICLE_FIELDS])).alias(v) for v in S.VEHICLES]
    return F.struct(*tops, *sides)


def marks_overlay(record: Column, marks: Column) -> Column:
    """Marks replace their fields in both vehicles, which are made if absent; the written count is the number of ticks."""
    new = {f"{v}.{n}": marks[v][n] for v in S.VEHICLES for n in MARK_FIELDS}
    new |= {f"{v}.circumstance_count": F.size(marks[v]["circumstances"]) for v in S.VEHICLES}
    return _with_leaves(record, new | {"other_damage": marks["other_damage"]}, {v: F.lit(True) for v in S.VEHICLES})


def accepted(read: Column, current: Column) -> Column:
    """A re-read value counts when it isn't blank and differs from the current one; else null."""
    value = F.trim(read)
    return F.when((value != "") & ~value.eqNullSafe(current), value)


def refine_overlay(record: Column, answers: dict[str, Column]) -> tuple[Column, Column]:
    """Accepted answers (by path) in place of current values, and the changes as array<struct<rule, path, before, after>>.

    A vehicle that is absent is made when one of its answers is accepted.
    """
    now = {p: record[p] if "." not in p else record[p.split(".")[0]][p.split(".")[1]] for p in answers}
    taken = {p: accepted(read, now[p]) for p, read in answers.items()}
    changes = [F.when(x.isNotNull(), F.struct(F.lit("crop").alias("rule"), F.lit(p).alias("path"), now[p].alias("before"), x.alias("after"))) for p, x in taken.items()]
    made = {}
    for v in S.VEHICLES:
        made[v] = record[v].isNotNull()
        for p, x in taken.items():
            made[v] = made[v] | x.isNotNull() if p.startswith(f"{v}.") else made[v]
    new = {p: F.coalesce(x, now[p]) for p, x in taken.items()}
    return _with_leaves(record, new, made), F.filter(F.array(*changes), lambda x: x.isNotNull())


def best_zone(patch: tuple[Column, ...], zones: list[tuple[str, tuple[float, ...]]] = ZONES) -> Column:
    """The zone that overlaps a patch best; of equals the first declared. A fixed list of zones needs no join."""
    scored = F.array(*[F.struct((-F.coalesce(overlap_share(patch, tuple(F.lit(float(v)) for v in box)), F.lit(0.0))).alias("s"), F.lit(i).alias("i"), F.lit(name).alias("zone")) for i, (name, box) in enumerate(zones)])
    return F.array_min(scored)["zone"]


def patch_zone(patch: Column, without: str = "front_left") -> Column:
    """Zone of a patch (array x0, y0, x1, y1), and of a picture that has none."""
    return F.when(patch.isNull(), without).otherwise(best_zone(tuple(patch[i] for i in range(4))))


def other_damage(yes: Column, no: Column) -> Column:
    """True when the yes cells hold more ink on average than the no cells."""
    mean = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)
    return mean(yes) > mean(no)


def reuse(forms: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("form_id",)) -> tuple[DataFrame, DataFrame]:
    """(to do, done before): a step that has all its artifacts isn't run again."""
    return forms.join(done, list(keys), "left_anti"), forms.join(done, list(keys), "left_semi")
