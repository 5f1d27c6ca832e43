"""Graphs at rest: Parquet tables, and the single-document JSON form; an HTML view."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuemesh.functions.text import label_of
from valuemesh.schema import EDGES, GRAPH_VERSION, NODES, conform, ddl, edge_class

# The view's colours by node type and edge class.
TYPE_COLOR = {"Token": "#6366f1", "RawValue": "#94a3b8", "Component": "#f59e0b", "Instance": "#fbbf24", "Screen": "#10b981", "Asset": "#ec4899"}
CLASS_COLOR = {"structural": "#cbd5e1", "bridge": "#a855f7", "similarity": "#38bdf8", "convention": "#34d399"}


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Parquet tables; edges lie by relation, which lookups filter on."""
    conform(nodes, NODES).write.mode("overwrite").parquet(f"{path}/nodes")
    conform(edges, EDGES).withColumn("rel", F.col("relation")).write.mode("overwrite").partitionBy("rel").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(ddl(NODES)).parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges").drop("rel")


def write_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """JSON lines, a folder each for nodes and edges, and one line with the version."""
    nodes.sparkSession.createDataFrame([(GRAPH_VERSION,)], "version int").coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    conform(nodes, NODES).write.mode("overwrite").json(f"{path}/nodes")
    conform(edges, EDGES).write.mode("overwrite").json(f"{path}/edges")


def read_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(ddl(NODES)).json(f"{path}/nodes"), spark.read.schema(ddl(EDGES)).json(f"{path}/edges")


def read_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A graph in one JSON document: {version, nodes: [...], edges: [...]}, props under ``props``."""
    props = "struct<valueType:string,scope:string,rgba:array<int>,lab:array<double>,oklch:array<double>,px:double,baseAssumed:boolean,ratio:double,ms:double,family:string,weight:bigint,category:string,tier:string,unresolvedValue:string,mode:string,distance:double,deltaE:double>"
    source = "array<struct<adapter:string,file:string,loc:string>>"
    schema = f"version int, nodes array<struct<id:string,type:string,label:string,confidence:string,sources:{source},props:{props}>>, edges array<struct<source:string,target:string,relation:string,weight:double,confidence:string,props:{props}>>"
    doc = spark.read.schema(schema).json(path, multiLine=True)
    n = doc.select(F.posexplode("nodes").alias("ord", "n")).select("ord", "n.*", "n.props.*")
    n = n.withColumnsRenamed({"valueType": "value_type", "baseAssumed": "base_assumed", "weight": "font_weight", "unresolvedValue": "unresolved_value"}).drop("props")
    e = doc.select(F.posexplode("edges").alias("ord", "e"))
    e = e.select("ord", *[f"e.{c}" for c in ("source", "target", "relation", "weight", "confidence")], "e.props.mode", "e.props.distance", F.col("e.props.deltaE").alias("delta_e"))
    return conform(n, NODES), conform(e, EDGES)


def html_view(nodes: DataFrame, edges: DataFrame, most: int = 5000) -> str:
    """A self-contained page that draws up to ``most`` nodes in a circle, with their edges (a view to
    look at small graphs; the limit is what a page can show)."""
    fill = F.when((F.col("type") == "RawValue") & F.col("rgba").isNotNull(), F.concat(F.lit("rgb("), F.array_join(F.slice("rgba", 1, 3).cast("array<string>"), ","), F.lit(")")))
    for kind, color in TYPE_COLOR.items():
        fill = fill.when(F.col("type") == kind, color)
    shown = nodes.orderBy("ord", "id").limit(most).select("id", label_of(F.col("label"), F.col("id")).alias("label"), "type", fill.otherwise("#9ca3af").alias("fill"))
    n = [r.asDict() for r in shown.collect()]
    ids = shown.select("id")
    kept = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    e = [r.asDict() for r in kept.select("source", "target", edge_class(F.col("relation")).alias("cls")).collect()]
    data = json.dumps({"nodes": n, "edges": e, "colors": CLASS_COLOR}).replace("<", "\\u003c")
    script = """const g=DATA,s=document.querySelector('svg'),at={},N='http://www.w3.org/2000/svg';
g.nodes.forEach((n,i)=>{const a=2*Math.PI*i/g.nodes.length;at[n.id]=[500+440*Math.cos(a),500+440*Math.sin(a)]});
const add=(t,o)=>{const x=document.createElementNS(N,t);for(const k in o)x.setAttribute(k,o[k]);s.append(x);return x};
g.edges.forEach(e=>{const[a,b]=[at[e.source],at[e.target]];add('line',{x1:a[0],y1:a[1],x2:b[0],y2:b[1],stroke:g.colors[e.cls]||'#cbd5e1'})});
g.nodes.forEach(n=>{const p=at[n.id],c=add('circle',{cx:p[0],cy:p[1],r:5,fill:n.fill}),t=document.createElementNS(N,'title');t.textContent=n.id;c.append(t)});"""
    return f"<!doctype html><meta charset='utf-8'><title>Value graph</title><p>{len(n)} nodes, {len(e)} edges</p><svg viewBox='0 0 1000 1000'></svg><script>{script.replace('DATA', data)}</script>"
