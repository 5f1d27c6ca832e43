"""Layers beyond what the reference builds: slot conventions, co-occurrence, reconciliation, findings.

They are described in its design and not implemented there; nothing else depends on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def variant_envelope(uses: DataFrame) -> DataFrame:
    """(component, slot, token, n, share, is_default) from uses (component, slot, token)."""
    n = uses.groupBy("component", "slot", "token").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("component", "slot").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("k"), F.col("token").alias("t"))).alias("best"))
    return n.join(total, ["component", "slot"]).select("component", "slot", "token", "n", (F.col("n") / F.col("total")).alias("share"), (F.col("token") == F.col("best.t")).alias("is_default"))


def commonly_used_with(uses: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, n): tokens together on ``least`` screens or more, from uses (screen, token)."""
    once = uses.select("screen", "token").distinct()
    pairs = once.select("screen", F.col("token").alias("a")).join(once.select("screen", F.col("token").alias("b")), "screen").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def reconcile(one: DataFrame, two: DataFrame) -> DataFrame:
    """(a, b, how): tokens of two sides (id, label, value_id) matched by value and name, else by value."""
    norm = F.regexp_replace(F.lower("label"), r"[\s\-_/]+", "")
    left = one.select(F.col("id").alias("a"), norm.alias("an"), "value_id")
    right = two.select(F.col("id").alias("b"), norm.alias("bn"), "value_id")
    met = left.join(right, "value_id").withColumn("same", F.col("an") == F.col("bn"))
    best = met.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("same"), "b"))).where("r = 1")
    return best.select("a", "b", F.when(F.col("same"), "value+name").otherwise("value").alias("how"))


def findings(nodes: DataFrame, edges: DataFrame, degree: int = 50) -> DataFrame:
    """(finding, id): values without a carrier, tokens without an edge, nodes of very high degree."""
    ends = edges.select(F.col("source").alias("id")).union(edges.select(F.col("target").alias("id")))
    carried = edges.where("relation = 'has-value'").select(F.col("target").alias("id"))
    orphan = nodes.where("type = 'RawValue'").join(carried, "id", "left_anti").select(F.lit("orphan").alias("finding"), "id")
    unused = nodes.where("type = 'Token'").join(ends, "id", "left_anti").select(F.lit("unused").alias("finding"), "id")
    hub = ends.groupBy("id").count().where(F.col("count") >= degree).select(F.lit("hub").alias("finding"), "id")
    return orphan.union(unused).union(hub)


def cosine_seeds(vectors: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """(id, score): the k vectors (id, v) of greatest cosine with the query."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    score = dot(F.col("v"), q) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(q, q))
    return vectors.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)
