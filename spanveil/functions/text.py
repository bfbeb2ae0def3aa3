"""Text functions over Columns: those of ``plain`` a batch at a time through Arrow, and what built-in functions can say.

Null in gives null out.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from . import plain

PLACEHOLDER = r"<[A-Z][A-Z0-9_]{1,96}>"


def _of_one(c: Column, kind: str, f: Callable) -> Column:
    arrow = to_arrow_type(DataType.fromDDL(kind))

    @F.arrow_udf(kind)
    def run(a: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(x) for x in a.to_pylist()], arrow)

    return run(c)


def _of_two(a: Column, b: Column, kind: str, f: Callable) -> Column:
    arrow = to_arrow_type(DataType.fromDDL(kind))

    @F.arrow_udf(kind)
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([None if p is None or q is None else f(p, q) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], arrow)

    return run(a, b)


def strip_accents(c: Column) -> Column:
    return _of_one(c, "string", plain.strip_accents)


def normalize(c: Column) -> Column:
    return _of_one(c, "string", plain.normalize_text)


def tokens(c: Column) -> Column:
    return F.filter(F.split(normalize(c), " "), lambda w: w != "")


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of normalised strings."""
    return _of_two(a, b, "double", plain.similarity)


def phonetic_key(c: Column) -> Column:
    return _of_one(c, "string", plain.phonetic_key)


def phonetic_match(a: Column, b: Column) -> Column:
    return _of_two(a, b, "boolean", plain.sounds_like)


def fuzzy_match(a: Column, b: Column, threshold: float = 0.82, phonetic: bool = True) -> Column:
    """Struct of matched, score and channel: exact, fuzzy, phonetic or none."""

    def met(x: str, y: str) -> dict:
        channel = plain.fuzzy(x, y, threshold, phonetic)
        score = 1.0 if channel == "exact" else plain.similarity(x, y)
        return {"matched": channel is not None, "score": max(score, threshold) if channel == "phonetic" else score, "channel": channel or "none"}

    return _of_two(a, b, "struct<matched: boolean, score: double, channel: string>", met)


def spoken_digits(words: Column) -> Column:
    """Digits of an array of words."""
    return _of_one(words, "string", lambda ws: plain.spoken_digits([w for w in ws if w is not None]))


def spoken_cardinal(c: Column) -> Column:
    return _of_one(c, "int", plain.spoken_cardinal)


def despoken_email(c: Column) -> Column:
    return _of_one(c, "string", plain.despoken_email)


def luhn_ok(c: Column) -> Column:
    digits = F.regexp_replace(c, "[^0-9]", "")
    return (F.length(digits) >= 13) & F.call_function("luhn_check", digits)


def age_bucket(age: Column, size: int = 3) -> Column:
    low = F.floor(age / size) * size
    return F.format_string("<AGE_%d_%d>", low, low + (size - 1))


def daypart(c: Column) -> Column:
    """Band of a clock time: without am or pm, hours up to seven are afternoon ones; null where no time is read."""
    low = F.lower(c)
    hour = F.nullif(F.regexp_extract(low, r"^\s*(\d{1,2})(?:[:.]\d{2})?\s*(?:[ap]m)?\s*$", 1), F.lit("")).cast("int")
    pm, am = low.rlike(r"pm\s*$"), low.rlike(r"am\s*$")
    h = F.when(pm & (hour < 12), hour + 12).when(am & (hour == 12), 0).when(~pm & ~am & (hour <= 7), hour + 12).otherwise(hour)
    return F.when(h < 5, "NIGHT").when(h < 12, "MORNING").when(h < 17, "AFTERNOON").when(h < 21, "EVENING").when(h < 24, "NIGHT")


def stable_offset(c: Column) -> Column:
    return F.conv(F.substring(F.sha2(c, 256), 1, 6), 16, 10).cast("long")


def mask_placeholders(c: Column) -> Column:
    """Placeholders blanked by as many spaces, so offsets hold."""
    parts, marks = F.split(c, PLACEHOLDER, -1), F.regexp_extract_all(c, F.lit(PLACEHOLDER), F.lit(0))
    return F.array_join(F.transform(parts, lambda p, k: F.concat(p, F.repeat(F.lit(" "), F.coalesce(F.length(F.get(marks, k)), F.lit(0))))), "")
