"""Merging graph fragments: one row per node id and per (source, relation, target)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuemesh.schema import EDGES, NODES, PAYLOAD, TOKEN, conform


def _first(c: str) -> Column:
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("ord")))


def _last(c: str) -> Column:
    return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("ord")))


def union_fragments(fragments: list[DataFrame], columns: dict[str, str]) -> DataFrame:
    """Fragments one after the other: ``ord`` orders rows by fragment, then as within it."""
    parts = [conform(f, columns).withColumn("ord", F.coalesce("ord", F.monotonically_increasing_id()) + F.lit(i << 52)) for i, f in enumerate(fragments)]
    return reduce(DataFrame.unionByName, parts)


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """One row per id: first label and confidence, last of each token property, a value's payload as one
    unit from its first row, all sources. Differing types of one id raise an error.

    Every aggregate is partial, so an id that very many fragments share does not meet in one task.
    """
    payload = F.struct(*PAYLOAD)
    merged = conform(nodes, NODES).groupBy("id").agg(
        F.min("ord").alias("ord"),
        F.min("type").alias("type"),
        F.max("type").alias("__other"),
        _first("label").alias("label"),
        _first("confidence").alias("confidence"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"),
        F.min_by(payload, F.when(F.col("value_type").isNotNull(), F.col("ord"))).alias("__payload"),
        *[_last(c).alias(c) for c in TOKEN],
        F.max_by("props", F.when(F.col("props").isNotNull(), F.col("ord"))).alias("props"),
    )
    clash = F.raise_error(F.concat(F.lit("conflicting types for node "), F.col("id"))).cast("string")
    merged = merged.withColumn("type", F.when(F.col("type").eqNullSafe(F.col("__other")), F.col("type")).otherwise(clash))
    return merged.select(*[F.col(f"__payload.{c}").alias(c) if c in PAYLOAD else F.col(c) for c in NODES])


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row per triple: last of each property, and all modes in ``modes``."""
    got = conform(edges, EDGES).groupBy("source", "relation", "target").agg(
        F.min("ord").alias("ord"),
        *[_last(c).alias(c) for c in ("weight", "mode", "distance", "delta_e")],
        _first("confidence").alias("confidence"),
        F.array_sort(F.collect_set("mode")).alias("modes"),
    )
    return got.select(*EDGES)


def merge_fragments(fragments: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of fragments in order of precedence."""
    return merge_nodes(union_fragments([n for n, _ in fragments], NODES)), merge_edges(union_fragments([e for _, e in fragments], EDGES))


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which an endpoint is no node."""
    ids = nodes.select(F.col("id").alias("__id"))
    marked = edges.join(ids, edges["target"] == F.col("__id"), "left_anti")
    rest = edges.join(ids, edges["target"] == F.col("__id"), "left_semi")
    return marked.unionByName(rest.join(ids, rest["source"] == F.col("__id"), "left_anti"))


def attached_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose endpoints are both nodes."""
    ids = nodes.select(F.col("id").alias("__id"))
    return edges.join(ids, edges["source"] == F.col("__id"), "left_semi").join(ids, F.col("target") == F.col("__id"), "left_semi")
