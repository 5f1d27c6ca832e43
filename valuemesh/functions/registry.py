"""Value types: how each is canonicalised, how far apart two values are, and how to block for it."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuemesh.functions.colors import color_udf, delta_e_of_pairs
from valuemesh.functions.composites import composite_udf
from valuemesh.functions.numbers import edit_distance, relative_distance, trim_all
from valuemesh.functions.scalars import font_family, font_weight, parse_dimension, parse_duration, parse_ratio
from valuemesh.functions.text import raw_value_id
from valuemesh.schema import PAYLOAD

#: For 0 <= L <= 100, CIEDE2000 is at least |dL| over this.
MOST_S_L = 1.7471
SLACK = 1 + 1e-9


@dataclass(frozen=True)
class Metric:
    """``distance(df, a, b, out)`` adds the distance of two columns; ``bucket``: values nearer than epsilon
    lie in the same or neighbouring buckets. ``value`` is the column compared."""

    value: str
    epsilon: float
    distance: Callable[[DataFrame, str, str, str], DataFrame]
    bucket: Callable[[Column, float], Column]
    inside: Callable[[Column], Column] | None = None
    most_bucket: Callable[[float], int] | None = None


def _column(distance: Callable[[Column, Column], Column]) -> Callable[[DataFrame, str, str, str], DataFrame]:
    return lambda df, a, b, out: df.withColumn(out, distance(F.col(a), F.col(b)))


def _log_bucket(size: Column, epsilon: float) -> Column:
    if not 0 < epsilon < 1:
        return F.lit(0).cast("bigint")
    return F.floor(F.log(size) / (-math.log(1 - epsilon) * SLACK))


def _relative(value: str, epsilon: float) -> Metric:
    return Metric(value, epsilon, _column(relative_distance), lambda v, e: _log_bucket(F.greatest(F.abs(v), F.lit(1.0)), e))


METRICS = {
    "color": Metric(
        "lab",
        10.0,
        delta_e_of_pairs,
        lambda v, e: F.floor(F.get(v, F.lit(0)) / (MOST_S_L * e * SLACK)),
        inside=lambda v: F.get(v, F.lit(0)).between(0, 100),
        most_bucket=lambda e: int(100 / (MOST_S_L * e * SLACK)),
    ),
    "dimension": _relative("px", 0.12),
    "ratio": _relative("ratio", 0.1),
    "duration": _relative("ms", 0.3),
    "fontWeight": Metric("font_weight", 150.0, _column(lambda a, b: F.abs(a - b).cast("double")), lambda v, e: F.floor(v / (e * SLACK))),
    "fontFamily": Metric("family", 0.34, _column(edit_distance), lambda v, e: _log_bucket(F.greatest(F.length(v), F.lit(1)).cast("double"), e)),
}


def canonicalize(df: DataFrame, raw: str = "raw", value_type: str = "value_type", scope: str | None = "scope", keep: list[str] | None = None) -> DataFrame:
    """``df`` with ``id``, ``label`` and the payload columns of the value that ``raw`` spells; the id is
    null where it is none of its type. ``keep``: columns of ``df`` to keep, by default all others."""
    keep = [c for c in df.columns if c not in PAYLOAD and c not in ("id", "label")] if keep is None else keep
    text, kind = F.col(raw), F.col(value_type)
    where = F.col(scope) if scope else F.lit(None).cast("string")
    only = lambda *kinds: F.when(kind.isin(*kinds), text)
    got = df.withColumns(
        {
            "__color": color_udf(only("color")),
            "__composite": composite_udf(F.when(kind.isin("shadow", "gradient", "typography"), kind), only("shadow", "gradient", "typography")),
            "__dimension": parse_dimension(only("dimension"), where),
            "__ratio": parse_ratio(only("ratio"), where),
            "__duration": parse_duration(only("duration")),
            "__family": font_family(only("fontFamily")),
            "__weight": font_weight(only("fontWeight")),
        }
    )
    key = F.coalesce(*[F.col(c) for c in ("__color.key", "__composite.key", "__dimension.key", "__ratio.key", "__duration.key", "__family")], F.col("__weight").cast("string"))
    found = key.isNotNull()
    payload = {
        "value_type": F.when(found, kind),
        "scope": F.when(found & kind.isin("dimension", "ratio"), where),
        **{c: F.col(f"__color.{c}") for c in ("rgba", "lab", "oklch")},
        "px": F.col("__dimension.px"),
        "base_assumed": F.col("__dimension.base_assumed"),
        "ratio": F.col("__ratio.value"),
        "ms": F.col("__duration.ms"),
        "family": F.col("__family"),
        "font_weight": F.col("__weight"),
        **{c: F.col(f"__composite.{c}") for c in ("kind", "layers", "stops", "refs")},
    }
    named = [raw_value_id(kind, key).alias("id"), F.when(found, trim_all(text)).alias("label")]
    return got.select(*[F.col(c).alias(c) if c not in (value_type, scope) else F.col(c).alias(f"in_{c}") for c in keep], *named, *[v.cast(PAYLOAD[k]).alias(k) for k, v in payload.items()])
