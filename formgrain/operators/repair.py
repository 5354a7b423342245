"""Repair rules: deterministic corrections of a record, each a registered function of columns, and the audit of what they change."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formgrain import schema as S
from formgrain.errors import ConfigurationError
from formgrain.functions import text as X

#: name -> function of a getter (path -> current column) that returns the new columns of the fields it may change.
RULES: dict[str, Callable[[Callable[[str], Column]], dict[str, Column]]] = {}


def rule(name: str):
    """Register a repair rule under a name."""

    def put(f):
        RULES[name] = f
        return f

    return put


def named(wanted: str) -> list[str]:
    """Rule names from a setting such as ``"phone-digits, policy-spaces"``; a name that isn't known is an error."""
    names = [x.strip() for x in wanted.split(",") if x.strip()]
    if unknown := [x for x in names if x not in RULES]:
        raise ConfigurationError(f"unknown repair rule {unknown[0]!r}; known: {', '.join(sorted(RULES))}")
    return names


@rule("validity-dates")
def validity_dates(get) -> dict[str, Column]:
    """Start and end change places when the start is after the end."""
    out = {}
    for v in S.VEHICLES:
        start, end = get(f"{v}.valid_from"), get(f"{v}.valid_to")
        wrong = F.coalesce(X.parse_date(start) > X.parse_date(end), F.lit(False))
        out |= {f"{v}.valid_from": F.when(wrong, end).otherwise(start), f"{v}.valid_to": F.when(wrong, start).otherwise(end)}
    return out


@rule("phone-digits")
def phone_digits(get) -> dict[str, Column]:
    """Phone numbers without spaces, dots and dashes."""
    return {p: X.without_separators(get(p)) for p in ("phone_a", "phone_b")}


@rule("policy-spaces")
def policy_spaces(get) -> dict[str, Column]:
    """Policy numbers without spaces."""
    return {f"{v}.policy_no": X.without_spaces(get(f"{v}.policy_no")) for v in S.VEHICLES}


@rule("attestation-format")
def attestation_format(get) -> dict[str, Column]:
    """Attestation numbers as three characters, a space and the digits (the format of synthetic forms)."""
    return {f"{v}.attestation_no": X.attestation(get(f"{v}.attestation_no")) for v in S.VEHICLES}


def repaired_leaves(rules: Sequence[str], record: str = "record") -> tuple[dict[str, Column], list[Column]]:
    """Every field by path after all rules, and for each field that a rule may change a struct, null where it doesn't."""
    leaves = {path: F.col(f"{record}.{path}") for path, _, _ in S.PATHS}
    found = []
    for step, name in enumerate(rules):
        new = RULES[name](leaves.__getitem__)
        for path, value in new.items():
            differs = ~leaves[path].eqNullSafe(value)
            found.append(F.when(differs, F.struct(F.lit(name).alias("rule"), F.lit(step).alias("step"), F.lit(path).alias("path"), leaves[path].cast("string").alias("before"), value.cast("string").alias("after"))))
        leaves |= new
    return leaves, found


def repair(forms: DataFrame, rules: Sequence[str], record: str = "record") -> DataFrame:
    """``record`` after all rules, and ``changes``: array<struct<rule, step, path, before, after>> in the order of the rules.

    Only the fields that a rule names are computed; the record is put together once. An absent vehicle stays absent.
    """
    leaves, found = repaired_leaves(rules, record)
    tops = [leaves[n].alias(n) for n in S.TOP_FIELDS]
    sides = [F.when(F.col(f"{record}.{v}").isNotNull(), F.struct(*[leaves[f"{v}.{n}"].alias(n) for n in S.VEHICLE_FIELDS])).alias(v) for v in S.VEHICLES]
    none = F.array().cast("array<struct<rule:string,step:int,path:string,before:string,after:string>>")
    changes = F.filter(F.array(*found), lambda x: x.isNotNull()) if found else none
    return forms.withColumns({"changes": changes, record: F.when(F.col(record).isNotNull(), F.struct(*tops, *sides))})


def changes(repaired: DataFrame, keep: Sequence[str] = ("form_id",)) -> DataFrame:
    """One row per field that a rule changed: rule, step, path, before, after."""
    return repaired.select(*keep, F.explode("changes").alias("c")).select(*keep, "c.*")


def per_rule(changed: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """rule, changed, became_right, became_wrong, no_effect: changes against the answer key's (form_id, path, expected_text).

    Without ``expected`` the changes have the column expected_text already.
    """
    right = lambda c: F.coalesce(X.normalize(F.col(c)) == F.col("expected_text"), F.lit(False))
    rows = (changed if expected is None else changed.join(expected, ["form_id", "path"])).select("rule", right("before").alias("was"), right("after").alias("now"))
    return rows.groupBy("rule").agg(
        F.count(F.lit(1)).alias("changed"),
        F.count_if(~F.col("was") & F.col("now")).alias("became_right"),
        F.count_if(F.col("was") & ~F.col("now")).alias("became_wrong"),
        F.count_if(F.col("was") == F.col("now")).alias("no_effect"),
    )
