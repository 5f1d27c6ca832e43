"""Traversals: budgeted best-first expansion, hop distances, shortest paths, reverse reachability."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuemesh.functions.numbers import py_round_half_up
from valuemesh.functions.text import label_of
from valuemesh.operators.lookup import resolve_seeds
from valuemesh.schema import CLASS_PRIORITY, EDGE_CLASS

BUDGET = 30
DEPENDENCIES = ["uses-token", "composed-of", "instance-of", "renders-on"]


def _incident(edges: DataFrame, ids: list[str]) -> list:
    """Edges at these nodes; the driver asks only for nodes it has taken, ``budget`` of them at most."""
    return edges.where(F.col("source").isin(ids) | F.col("target").isin(ids)).select("source", "target", "relation", "weight", "ord").collect()


def best_first(nodes: DataFrame, edges: DataFrame, text: str, budget: int = BUDGET) -> DataFrame:
    """(id, label, type, hop, relevance): the neighbourhood of a text's seeds, most relevant edges first.

    Each step takes the frontier edge of highest class priority x weight / (hop + 1), the earliest of
    equal ones, until ``budget`` nodes are taken. Seeds are never cut. The order is sequential by nature:
    a heap on the driver, which looks a taken node's edges up once; at most ``budget`` lookups, whose
    frontier is all that is held.
    """
    seeds = [r["id"] for r in resolve_seeds(nodes, text).collect()]
    hop, relevance = dict.fromkeys(seeds, 0), dict.fromkeys(seeds, 1.0)
    heap: list[tuple[float, int, str, str]] = []
    pushed = 0

    def push(ids: list[str]) -> None:
        nonlocal pushed
        rows = _incident(edges, ids) if ids else []
        for node in ids:
            out = sorted((r for r in rows if r["source"] == node), key=lambda r: r["ord"] or 0)
            into = sorted((r for r in rows if r["target"] == node), key=lambda r: r["ord"] or 0)
            for r, other in [*((r, r["target"]) for r in out), *((r, r["source"]) for r in into)]:
                priority = CLASS_PRIORITY.get(EDGE_CLASS.get(r["relation"], ""), 0.0)
                score = priority * (1.0 if r["weight"] is None else r["weight"]) / (hop[node] + 1)
                heapq.heappush(heap, (-score, pushed, node, other))
                pushed += 1

    push(seeds)
    while heap and len(hop) < budget:
        score, _, source, other = heapq.heappop(heap)
        if other not in hop:
            hop[other], relevance[other] = hop[source] + 1, py_round_half_up(-score, 3)
            push([other])
    spark = nodes.sparkSession
    taken = spark.createDataFrame([(i, h, relevance[i]) for i, h in hop.items()], "id string, hop int, relevance double")
    named = taken.join(nodes.select("id", label_of(F.col("label"), F.col("id")).alias("label"), "type"), "id")
    return named.select("id", "label", "type", "hop", "relevance").orderBy("hop", F.desc("relevance"), F.collate("id", "UNICODE"))


def _step(frontier: DataFrame, edges: DataFrame, seen: DataFrame) -> DataFrame:
    return frontier.join(edges, "id").select(F.col("other").alias("id")).distinct().join(seen, "id", "left_anti")


def hops(edges: DataFrame, starts: DataFrame, most: int, relations: list[str] | None = None, reverse: bool = False, undirected: bool = True) -> DataFrame:
    """(id, hop): nodes within ``most`` hops of ``starts`` (id), level by level, each a join and an anti-join."""
    some = edges if relations is None else edges.where(F.col("relation").isin(relations))
    ahead = some.select(F.col("source").alias("id"), F.col("target").alias("other"))
    back = some.select(F.col("target").alias("id"), F.col("source").alias("other"))
    pairs = ahead.union(back) if undirected else back if reverse else ahead
    pairs = pairs.where("id <> other").distinct()
    seen = starts.select("id").distinct().withColumn("hop", F.lit(0))
    frontier = seen.select("id")
    for level in range(1, most + 1):
        new = _step(frontier, pairs, seen.select("id"))
        if level < most:
            new = new.checkpoint() if _checkpoints(new) else new.persist()
            if new.isEmpty():
                break
        seen = seen.union(new.withColumn("hop", F.lit(level)))
        frontier = new
    return seen


def _checkpoints(df: DataFrame) -> bool:
    """Whether the session names a shared folder to cut lineage in."""
    return df.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir", None) is not None


def impact(nodes: DataFrame, edges: DataFrame, node_id: str, most: int = 6) -> DataFrame:
    """(id, type, hop): what depends on a node, through dependency edges taken backwards."""
    start = nodes.where(F.col("id") == node_id).select("id")
    found = hops(edges, start, most, DEPENDENCIES, reverse=True, undirected=False).where("hop > 0")
    return found.join(nodes.select("id", "type"), "id").select("id", "type", "hop")


def shortest_path(edges: DataFrame, source: str, target: str, most: int = 8) -> list[str] | None:
    """A path of least total 1/weight between two nodes, edges taken either way; None beyond ``most`` hops.

    Each round relaxes every node reached so far over its edges (a join and a minimum), and keeps the
    path with its cost; ties go to the path of lesser ids.
    """
    cost = F.lit(1.0) / F.when(F.coalesce("weight", F.lit(1.0)) > 0, F.coalesce("weight", F.lit(1.0))).otherwise(1e-9)
    ahead = edges.select(F.col("source").alias("id"), F.col("target").alias("other"), cost.alias("step"))
    pairs = ahead.union(edges.select(F.col("target").alias("id"), F.col("source").alias("other"), cost.alias("step")))
    spark = edges.sparkSession
    best = spark.createDataFrame([(source, 0.0, [source])], "id string, cost double, path array<string>")
    for _ in range(most):
        grown = best.join(pairs, "id").where(~F.array_contains("path", F.col("other"))).select(F.col("other").alias("id"), (F.col("cost") + F.col("step")).alias("cost"), F.concat("path", F.array("other")).alias("path"))
        after = best.union(grown).groupBy("id").agg(F.min(F.struct("cost", "path")).alias("m")).select("id", "m.cost", "m.path")
        best = after.checkpoint() if _checkpoints(after) else after.persist()
    row = best.where(F.col("id") == target).select("path").collect()
    return row[0]["path"] if row else None
