"""Canonical forms of lengths, ratios, durations and fonts, as column expressions.

Each returns a struct with the identity ``key``, or null where the text is no such value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from valuemesh.functions.numbers import number_text, picked, round_half_up, trim_all

ROOT_PX = 16.0
NUMBER = r"(-?\d*\.?\d+)"
LENGTH = rf"^{NUMBER}\s*(px|rem|em|pt|%)?$"
# Names of font weights.
WEIGHTS = {"thin": 100, "extralight": 200, "light": 300, "normal": 400, "regular": 400, "medium": 500, "semibold": 600, "bold": 700, "extrabold": 800, "black": 900}


def parse_dimension(raw: Column, scope: Column | str = "dim", root_px: float = ROOT_PX) -> Column:
    """struct<key,px,base_assumed>: px, bare numbers, rem and em of the root size, pt; percent keeps its number."""
    s = trim_all(raw)
    n = picked(s, LENGTH, 1).cast("double")
    unit = F.regexp_extract(s, LENGTH, 2)
    px = F.when(unit.isin("rem", "em"), n * root_px).when(unit == "pt", n / 0.75).otherwise(n)
    percent = unit == "%"
    scope = F.lit(scope) if isinstance(scope, str) else F.coalesce(scope, F.lit("dim"))
    shown = number_text(round_half_up(n, 4))
    key = F.when(percent, F.concat(shown, F.lit("%@"), scope)).otherwise(F.concat(number_text(round_half_up(px, 4)), F.lit("px@"), scope))
    value = F.when(percent, n).otherwise(round_half_up(px, 4))
    assumed = F.when(unit.isin("rem", "em"), True)
    return F.when(n.isNotNull(), F.struct(key.alias("key"), value.alias("px"), assumed.alias("base_assumed")))


def parse_ratio(raw: Column, scope: Column | str = "ratio") -> Column:
    """struct<key,value>: a/b, percent or plain number, to four places; null for a zero divisor."""
    s = trim_all(raw)
    pair = r"^(\d*\.?\d+)\s*/\s*(\d*\.?\d+)$"
    value = F.when(F.regexp_like(s, F.lit(pair)), F.try_divide(picked(s, pair, 1).cast("double"), picked(s, pair, 2).cast("double")))
    value = value.when(F.regexp_like(s, F.lit(rf"^{NUMBER}%$")), picked(s, rf"^{NUMBER}%$", 1).cast("double") / 100)
    value = round_half_up(value.otherwise(picked(s, rf"^{NUMBER}$", 1).cast("double")), 4)
    scope = F.lit(scope) if isinstance(scope, str) else F.coalesce(scope, F.lit("ratio"))
    return F.when(value.isNotNull(), F.struct(F.concat(number_text(value), F.lit("@"), scope).alias("key"), value.alias("value")))


def parse_duration(raw: Column) -> Column:
    """struct<key,ms>: ms, s, or a bare number of ms."""
    s, pattern = trim_all(raw), rf"^{NUMBER}(ms|s)?$"
    n = picked(s, pattern, 1).cast("double")
    ms = round_half_up(F.when(F.regexp_extract(s, pattern, 2) == "s", n * 1000).otherwise(n), 4)
    return F.when(n.isNotNull(), F.struct(F.concat(number_text(ms), F.lit("ms")).alias("key"), ms.alias("ms")))


def font_family(raw: Column) -> Column:
    """First family of a stack, without quotes, in lower case."""
    first = F.lower(F.regexp_replace(trim_all(F.get(F.split(raw, ","), F.lit(0))), "^['\"]|['\"]$", ""))
    return F.when(first != "", first)


def font_weight(raw: Column) -> Column:
    """A number as it is, or a named weight's number."""
    s = F.lower(trim_all(raw))
    named = F.lit(None).cast("bigint")
    for name, value in WEIGHTS.items():
        named = F.when(s == name, F.lit(value).cast("bigint")).otherwise(named)
    return F.when(F.regexp_like(s, F.lit(r"^\d+$")), s.try_cast("bigint")).otherwise(named)
