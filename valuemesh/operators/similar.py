"""Similarity edges: an exact blocked self-join of values nearer than their type's epsilon."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from valuemesh.functions.numbers import clamp01, round_half_up
from valuemesh.functions.registry import METRICS, MOST_S_L, SLACK
from valuemesh.operators.color_pairs import color_pairs, nearest_colors_of_each


def _compared(values: DataFrame, value_type: str) -> DataFrame:
    """(id, ord, scope, v) of the values of one type."""
    value = F.col(METRICS[value_type].value)
    return values.where((F.col("value_type") == value_type) & value.isNotNull()).select("id", "ord", F.coalesce("scope", F.lit("")).alias("scope"), value.alias("v"))


def similar_pairs(values: DataFrame, value_type: str, epsilon: float | None = None, blocked: bool = True) -> DataFrame:
    """(a, b, scope, d): ids of the pairs of one type and scope with distance below epsilon, a before b.

    Each value has a bucket and meets those of the same and the two neighbouring ones, an equi-join on
    (scope, bucket). Values that the bucket's bound does not cover meet every bucket.
    """
    m = METRICS[value_type]
    epsilon = m.epsilon if epsilon is None else epsilon
    if epsilon <= 0:
        blocked = False
    rows = _compared(values, value_type)
    if blocked and value_type == "color":
        return color_pairs(rows, epsilon, MOST_S_L * epsilon * SLACK)
    bucket = m.bucket(F.col("v"), epsilon).cast("bigint") if blocked else F.lit(0).cast("bigint")
    left = rows.select("scope", F.col("id").alias("a"), F.col("ord").alias("ao"), F.col("v").alias("av"), bucket.alias("bucket"), F.lit(True).alias("ain"))
    right = rows.select("scope", F.col("id").alias("b"), F.col("ord").alias("bo"), F.col("v").alias("bv"), bucket.alias("home"), F.lit(True).alias("bin"))
    near = [F.col("home") + i for i in ((-1, 0, 1) if blocked else (0,))]
    if blocked and m.inside:
        every = F.sequence(F.lit(0), F.lit(m.most_bucket(epsilon))).cast("array<bigint>")
        left = left.withColumn("ain", m.inside(F.col("av"))).withColumn("bucket", F.explode(F.when(F.col("ain"), F.array("bucket")).otherwise(every)))
        right = right.withColumn("bin", m.inside(F.col("bv"))).withColumn("bucket", F.explode(F.when(F.col("bin"), F.array(*near)).otherwise(every)))
    else:
        right = right.withColumn("bucket", F.explode(F.array(*near)))
    once = F.col("ain") | F.when(F.col("bin"), F.col("bucket") == F.col("home")).otherwise(F.col("bucket") == 0)
    met = left.join(right, ["scope", "bucket"]).where((F.col("ao") < F.col("bo")) & once)
    return m.distance(met, "av", "bv", "d").where(F.col("d") < epsilon).select("a", "b", "scope", "d")


def similar_to(values: DataFrame, epsilon: dict[str, float] | None = None) -> DataFrame:
    """``similar-to`` edges over every value type that has a metric; distances to three places, weight
    from the distance as it is."""
    parts = []
    for kind, m in METRICS.items():
        if m.value not in values.columns:
            continue  # a table without such values
        limit = (epsilon or {}).get(kind, m.epsilon)
        shown = round_half_up(F.col("d"), 3)
        parts.append(
            similar_pairs(values, kind, limit).select(
                F.col("a").alias("source"),
                F.lit("similar-to").alias("relation"),
                F.col("b").alias("target"),
                clamp01(1 - F.col("d") / limit).alias("weight"),
                shown.alias("distance"),
                (shown if kind == "color" else F.lit(None).cast("double")).alias("delta_e"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def nearest_neighbours(values: DataFrame, value_type: str, k: int = 5, epsilon: float | None = None) -> DataFrame:
    """(id, other, scope, d, rank): the k nearest values below epsilon for each value."""
    limit = METRICS[value_type].epsilon if epsilon is None else epsilon
    if value_type == "color" and limit > 0:
        return nearest_colors_of_each(_compared(values, value_type), k, limit, MOST_S_L * limit * SLACK)
    pairs = similar_pairs(values, value_type, epsilon)
    both = pairs.select(F.col("a").alias("id"), F.col("b").alias("other"), "scope", "d").union(pairs.select(F.col("b").alias("id"), F.col("a").alias("other"), "scope", "d"))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("id", "scope").orderBy("d", "other"))).where(F.col("rank") <= k)
