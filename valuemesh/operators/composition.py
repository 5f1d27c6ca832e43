"""Composition edges: the values that a composite value refers to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuemesh.functions.registry import canonicalize


def composition(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the values in ``refs`` of RawValue nodes; references that spell none are left out."""
    refs = nodes.where((F.col("type") == "RawValue") & F.col("refs").isNotNull())
    each = refs.select(F.col("id").alias("source"), F.col("ord").alias("sord"), F.posexplode("refs").alias("pos", "ref"))
    flat = each.select("source", (F.col("sord") * 64 + F.col("pos")).alias("ord"), F.col("ref.raw").alias("raw"), F.col("ref.value_type").alias("value_type"), F.col("ref.scope").alias("scope"))
    got = canonicalize(flat, keep=["source", "ord"]).where(F.col("id").isNotNull())
    edges = got.select("source", F.lit("composed-of").alias("relation"), F.col("id").alias("target"), "ord", F.lit("EXTRACTED").alias("confidence"))
    return got.drop("source").withColumn("type", F.lit("RawValue")), edges
