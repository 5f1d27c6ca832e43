"""Native span search: every match of a Java regex with code-point offsets.

Spark returns matched strings without positions. Splitting by the same pattern gives the pieces
between the matches, so lengths of pieces and matches add up to offsets. Patterns must never match
the empty string and should be possessive where a group repeats: the Java engine recurses for other
repeated groups and very long texts would overflow its stack.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from valuemesh.functions.numbers import let

#: Parts to a block when offsets are summed.
BLOCK = 128
SPAN = "struct<start:bigint,end:bigint,hit:string,group:string>"


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start,end,hit,group>> of the leftmost non-overlapping matches, in order.

    No match gives an empty array. ``group`` adds that group's text beside the whole match.
    """
    regex = F.lit(pattern)
    none = F.array().cast(f"array<{SPAN}>")
    parts = F.zip_with(
        F.split(text, pattern, -1),
        F.arrays_zip(
            F.regexp_extract_all(text, regex, F.lit(0)).alias("hit"),
            F.regexp_extract_all(text, regex, F.lit(group)).alias("group"),
        ),
        lambda gap, m: F.struct(F.length(gap).cast("long").alias("gap"), m["hit"].alias("hit"), m["group"].alias("group")),
    )
    return F.when(F.regexp_like(text, regex), let(parts, _spans)).otherwise(none)


def _spans(parts: Column) -> Column:
    # Offsets are running sums, and an aggregate that appends copies its array: so blocks of the parts
    # are summed first and then filled, which stays near linear for texts with very many matches.
    blocks = F.transform(F.sequence(F.lit(1), F.size(parts), F.lit(BLOCK)), lambda i: F.slice(parts, i, BLOCK))
    zero = F.lit(0).cast("long")
    wide = lambda b: F.aggregate(b, zero, lambda a, x: a + x["gap"] + F.coalesce(F.length(x["hit"]), F.lit(0)))
    sums = lambda width: F.transform(width, lambda _, i: F.aggregate(F.slice(width, 1, i), zero, lambda a, x: a + x))
    return let(blocks, lambda bs: F.flatten(F.zip_with(bs, let(F.transform(bs, wide), sums), _fill)))


def _fill(block: Column, before: Column) -> Column:
    def step(acc: Column, part: Column) -> Column:
        at = acc["pos"] + part["gap"]
        end = at + F.length(part["hit"])
        span = F.struct(at.alias("start"), end.alias("end"), part["hit"].alias("hit"), part["group"].alias("group"))
        more = part["hit"].isNotNull()
        return F.struct(F.when(more, end).otherwise(at).alias("pos"), F.when(more, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    start = F.struct(before.alias("pos"), F.array().cast(f"array<{SPAN}>").alias("found"))
    return F.aggregate(block, start, step, lambda acc: acc["found"])


def render(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` by start, then by the kind's place in ``kinds``, joined with commas.

    ``spans`` is array<struct<start,kind_no,end,...>>.
    """
    names = F.array(*[F.lit(k) for k in kinds])
    line = lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), line), ",")


def apart(spans: Column, others: Column) -> Column:
    """The spans that overlap none of the others."""
    return F.filter(spans, lambda s: ~F.exists(others, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])))


def tag(spans: Column, kind_no: int) -> Column:
    """array<struct<start,kind_no,end,hit>> for :func:`render`."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind_no).alias("kind_no"), s["end"].alias("end"), s["hit"].alias("hit")))
