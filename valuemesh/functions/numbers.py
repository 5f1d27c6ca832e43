"""Number and text helpers with the rounding and spelling that identity keys need."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once a row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def round_half_up(x: Column, places: int) -> Column:
    """Half towards positive infinity on the binary value, unlike ``F.round``."""
    scale = 10.0**places
    return F.floor(x * scale + 0.5).cast("double") / scale


def py_round_half_up(x: float, places: int) -> float:
    scale = 10.0**places
    return math.floor(x * scale + 0.5) / scale


def number_text(x: Column) -> Column:
    """Shortest decimal spelling of a number of at most four places: 10, 13.75, -0.5."""
    text = x.cast("decimal(38,4)").cast("string")
    return F.regexp_replace(text, r"\.?0+$", "")


def py_number_text(x: float) -> str:
    text = f"{x:.4f}".rstrip("0").rstrip(".")
    return "0" if text == "-0" else text


def trim_all(text: Column) -> Column:
    """Trims white space of every kind, not only spaces."""
    return F.regexp_replace(text, r"^[\s ﻿]+|[\s ﻿]+$", "")


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def picked(text: Column, pattern: str, group: int) -> Column:
    """A regex group, null where the pattern does not match or the group took no part."""
    got = F.regexp_extract(text, pattern, group)
    return F.when(F.regexp_like(text, F.lit(pattern)) & (got != ""), got)


def relative_distance(x: Column, y: Column) -> Column:
    """|x - y| over the larger magnitude, or over 1 if both are smaller; null if either is null."""
    d = F.abs(x - y) / F.greatest(F.abs(x), F.abs(y), F.lit(1.0))
    return F.when(x.isNotNull() & y.isNotNull(), d)


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length, 0 for two empty strings."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(a.isNull() | b.isNull(), None).when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / F.nullif(longest, F.lit(0)))
