"""Scalar functions on text, as Column expressions: all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the four separators that Java leaves out.
_SPACE = r"(?U)[\s\x1c-\x1f]+"


#: Lower-case characters that case folding changes further, from Python's own tables: one character for one, and one for several.
_FOLDED = {chr(c): chr(c).casefold() for c in range(0x80, 0x1F000) if chr(c).lower() == chr(c) and chr(c).casefold() != chr(c)}
_ONE = {a: b for a, b in _FOLDED.items() if len(b) == 1}
_SEVERAL = {a: b for a, b in _FOLDED.items() if len(b) > 1}


def casefold(text: Column) -> Column:
    """Full case folding. Texts of ASCII, nearly all, are lowered only."""
    single = F.translate(F.lower(text), "".join(_ONE), "".join(_ONE.values()))
    table = F.create_map(*[F.lit(x) for pair in _SEVERAL.items() for x in pair])
    spread = F.array_join(F.transform(F.split(single, ""), lambda c: F.coalesce(F.element_at(table, c), c)), "")
    several = F.when(single.rlike("[" + "".join(_SEVERAL) + "]"), spread).otherwise(single)
    return F.when(text.rlike(r"[^\x00-\x7f]"), several).otherwise(F.lower(text))


def normalize(value: Column) -> Column:
    """One space for any white space, no space at the ends, case folded."""
    return casefold(F.trim(F.regexp_replace(value.cast("string"), _SPACE, " ")))


def compact(value: Column) -> Column:
    """Normalised, without spaces."""
    return F.replace(normalize(value), F.lit(" "), F.lit(""))


def letters_and_digits(value: Column) -> Column:
    """Normalised, only letters and numbers."""
    return F.regexp_replace(normalize(value), r"[^\p{L}\p{N}]", "")


def field_name(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def safe_ratio(over: Column, under: Column) -> Column:
    """Null where there is nothing to divide by."""
    return F.try_divide(over.cast("double"), under.cast("double"))


def parse_date(value: Column) -> Column:
    """A strict day/month/year, else null."""
    return F.when(value.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.try_to_date(value, "d/M/yyyy"))


def format_date(value: Column) -> Column:
    return F.date_format(value, "dd/MM/yyyy")


def add_years(value: Column, n: int | Column) -> Column:
    """The same day n years on; 29 February becomes the 28th."""
    moved = F.add_months(value, F.lit(n) * 12)
    leap = (F.month(value) == 2) & (F.dayofmonth(value) == 29)
    return F.when(leap & (F.dayofmonth(moved) == 29), F.date_sub(moved, 1)).otherwise(moved)


def without_separators(phone: Column) -> Column:
    return F.regexp_replace(phone, r"(?U)[\s.\-]", "")


def without_spaces(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)\s", "")


def attestation(value: Column) -> Column:
    """Three characters, a space, the digits; other numbers stay as they are."""
    packed = without_spaces(value)
    return F.when(packed.rlike(r"^\d{2}[A-Za-z]\d+$"), F.concat(F.upper(F.substring(packed, 1, 3)), F.lit(" "), F.substring(packed, 4, 1 << 30))).otherwise(value)


# A tail of ``size`` characters is a loop when it stands 5 + 12 // size times in a row (4 * (1 + 3 / size), whole, and one more).
# Sizes that need equally many share one alternative; on the reversed text the pattern is anchored.
LOOP_SPAN = 1250


def _loop_pattern(longest: int = 250) -> str:
    groups: dict[int, list[int]] = {}
    for size in range(1, longest + 1):
        groups.setdefault(4 + 12 // size, []).append(size)
    parts = [f"(.{{{sizes[0]},{sizes[-1]}}})\\{i}{{{more}}}" for i, (more, sizes) in enumerate(groups.items(), start=1)]
    return f"^(?s)(?:{'|'.join(parts)})"


LOOP_PATTERN = _loop_pattern()


def repeats(text: Column) -> Column:
    """Whether a text ends in a loop: one pattern of up to 250 characters again and again."""
    return F.reverse(F.substring(text, -LOOP_SPAN, LOOP_SPAN)).rlike(LOOP_PATTERN)


def looped(text: Column) -> Column:
    """``repeats``, or that once the last 50 characters are cut off."""
    return repeats(text) | ((F.length(text) > 50) & F.reverse(F.substring(F.left(text, F.length(text) - 50), -LOOP_SPAN, LOOP_SPAN)).rlike(LOOP_PATTERN))


def clean_lines(text: Column) -> Column:
    """Single spaces in each line, no empty lines."""
    lines = F.transform(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: F.trim(F.regexp_replace(x, _SPACE, " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def balanced_wrap(text: Column) -> Column:
    """Two lines (array of two) cut at the space that makes their lengths most equal, the first such; one word leaves the second empty."""
    words = F.split(F.trim(F.regexp_replace(text, _SPACE, " ")), " ")
    join = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    gap = lambda i: F.abs(F.length(join(F.lit(1), i)) - F.length(join(i + 1, F.size(words))))
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.struct(gap(i).alias("gap"), i.alias("at")))
    at = F.array_min(cuts)["at"]
    return F.array(join(F.lit(1), at), join(at + 1, F.size(words)))


def mime_of(path: Column) -> Column:
    """MIME type from a file's suffix."""
    suffix = F.lower(F.element_at(F.split(path, r"\."), -1))
    return F.when(suffix == "png", "image/png").when(suffix.isin("jpg", "jpeg"), "image/jpeg")


def data_url(path: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime_of(path), F.lit(";base64,"), F.base64(content))
