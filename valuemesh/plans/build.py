"""Building a graph: detect, extract, merge, compose, link."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from valuemesh.lineage import cut
from valuemesh.operators.composition import composition
from valuemesh.operators.merge import merge_fragments
from valuemesh.operators.similar import similar_to
from valuemesh.schema import EDGES, NODES, conform, ddl
from valuemesh.sources.adapters import Adapter, run_adapters
from valuemesh.sources.graph_io import write_graph


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    activated: list[str]


def link(nodes: DataFrame, edges: DataFrame, color_epsilon: float | None = None) -> tuple[DataFrame, DataFrame]:
    """A merged graph with composition and similarity edges."""
    nodes, edges = merge_fragments([(nodes, edges), composition(nodes)])
    nodes = cut(nodes)  # every value type's join reads them
    near = similar_to(nodes.where("type = 'RawValue'"), None if color_epsilon is None else {"color": color_epsilon})
    return nodes, edges.unionByName(conform(near, EDGES))


def build(spark: SparkSession, root: str, adapters: list[Adapter] | None = None, color_epsilon: float | None = None, out: str | None = None) -> Graph:
    """The graph of a project; written as Parquet where ``out`` is given."""
    found = run_adapters(spark, root, adapters)
    empty = (spark.createDataFrame([], ddl(NODES)), spark.createDataFrame([], ddl(EDGES)))
    nodes, edges = merge_fragments([f for _, f in found] or [empty])
    nodes, edges = link(cut(nodes), cut(edges), color_epsilon)
    edges = cut(edges)
    if out:
        write_graph(nodes, edges, out)
    return Graph(nodes, edges, [n for n, _ in found])
