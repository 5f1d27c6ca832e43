"""Lookups over a graph: seeds, values and their carriers, nearest colours, one node's digest, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuemesh.functions.colors import delta_e, is_color_syntax, parse_color
from valuemesh.functions.numbers import round_half_up
from valuemesh.functions.scalars import parse_dimension
from valuemesh.functions.text import label_of, seed_score
from valuemesh.operators.merge import attached_edges, dangling_edges
from valuemesh.schema import edge_class

NEAREST, NEAREST_EPSILON = 5, 10.0


def resolve_seeds(nodes: DataFrame, term: str, limit: int = 5, threshold: float = 0.5) -> DataFrame:
    """(id, label, score): the best matches of a text, by score and then by id in locale order."""
    label = label_of(F.col("label"), F.col("id"))
    scored = nodes.select("id", label.alias("label"), seed_score(label, F.col("id"), term.strip()).alias("score"))
    return scored.where(F.col("score") >= threshold).orderBy(F.desc("score"), F.collate("id", "UNICODE")).limit(limit)


def tokens_of(nodes: DataFrame, edges: DataFrame, values: DataFrame) -> DataFrame:
    """(value_id, tokens) for the ids in ``values`` (value_id): who carries each, in edge order."""
    carried = edges.where("relation = 'has-value'").join(values.select("value_id").distinct(), F.col("target") == F.col("value_id"))
    named = carried.join(nodes.select(F.col("id").alias("source"), label_of(F.col("label"), F.col("id")).alias("label")), "source")
    refs = F.array_sort(F.collect_list(F.struct("ord", F.col("source").alias("id"), "label", "mode")))
    return named.groupBy("value_id").agg(F.transform(refs, lambda r: F.struct(r["id"].alias("id"), r["label"].alias("label"), r["mode"].alias("mode"))).alias("tokens"))


def similar_neighbours(edges: DataFrame, value_id: str) -> DataFrame:
    """(value_id, distance, ord) of the values linked by similarity, in either direction, nearest first."""
    d = F.coalesce("delta_e", "distance").alias("distance")
    near = edges.where("relation = 'similar-to'")
    out = near.where(F.col("source") == value_id).select(F.col("target").alias("value_id"), d, F.lit(0).alias("way"), "ord")
    into = near.where(F.col("target") == value_id).select(F.col("source").alias("value_id"), d, F.lit(1).alias("way"), "ord")
    return out.union(into).orderBy(F.coalesce("distance", F.lit(0.0)), "way", "ord")


def nearest_colors(nodes: DataFrame, text: str, limit: int = NEAREST, epsilon: float = NEAREST_EPSILON) -> DataFrame:
    """(value_id, distance, ord): colour values nearest to a colour that need not be in the graph."""
    lab = F.array(*[F.lit(float(x)) for x in parse_color(text)["lab"]])
    colors = nodes.where((F.col("type") == "RawValue") & (F.col("value_type") == "color") & F.col("lab").isNotNull())
    scored = colors.select(F.col("id").alias("value_id"), "ord", delta_e(lab, F.col("lab")).alias("d")).where(F.col("d") < epsilon)
    return scored.orderBy("d", "ord").limit(limit).select("value_id", round_half_up(F.col("d"), 2).alias("distance"), "ord")


def _canonical(nodes: DataFrame, text: str) -> tuple[str | None, str | None, float | None]:
    """(value type, id, px) of a literal: a colour in strict syntax or a length, else nothing."""
    row = nodes.sparkSession.range(1).select(is_color_syntax(F.lit(text)).alias("color"), parse_dimension(F.lit(text)).alias("length")).first()
    color = parse_color(text) if row["color"] else None
    if row["color"]:
        return ("color", f"value:color:{color['key']}", None) if color else (None, None, None)
    return ("dimension", f"value:dimension:{row['length']['key']}", row["length"]["px"]) if row["length"] else (None, None, None)


def match(nodes: DataFrame, edges: DataFrame, text: str) -> DataFrame:
    """(role, value_id, label, distance, tokens): ``exact`` and its ``similar`` values where the literal is
    in the graph, else ``nearest`` colours. A length matches by its pixels under any scope."""
    text = text.strip()
    kind, node_id, px = _canonical(nodes, text)
    exact = nodes.where(F.lit(False)) if kind is None else nodes.where((F.col("value_type") == "dimension") & (F.col("px") == px)) if kind == "dimension" else nodes.where(F.col("id") == node_id)
    first = exact.orderBy("ord").limit(1).select("id").collect()
    none = F.lit(None).cast("double")
    if first:
        value = first[0]["id"]
        hits = nodes.sparkSession.range(1).select(F.lit("exact").alias("role"), F.lit(value).alias("value_id"), none.alias("distance"), F.lit(0).cast("bigint").alias("ord"))
        hits = hits.union(similar_neighbours(edges, value).select(F.lit("similar"), "value_id", "distance", "ord"))
    elif kind == "color":
        hits = nearest_colors(nodes, text).select(F.lit("nearest").alias("role"), "value_id", "distance", "ord")
    else:
        hits = nodes.select(F.lit("").alias("role"), F.col("id").alias("value_id"), none.alias("distance"), "ord").limit(0)
    named = hits.join(nodes.select(F.col("id").alias("value_id"), label_of(F.col("label"), F.col("id")).alias("label")), "value_id")
    return named.join(tokens_of(nodes, edges, hits), "value_id", "left").select("role", "value_id", "label", "distance", "ord", "tokens")


def resolve_one(nodes: DataFrame, text: str) -> str | None:
    """A node id as it is, else the best seed's id."""
    if not nodes.where(F.col("id") == text).limit(1).isEmpty():
        return text
    best = resolve_seeds(nodes, text, limit=1).select("id").collect()
    return best[0]["id"] if best else None


def relation_groups(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, relation, neighbors) for the ids in ``ids`` (id): outgoing edges before incoming ones."""
    ids = ids.select("id").distinct()
    out = edges.join(ids, F.col("source") == F.col("id")).select("id", "relation", F.lit(0).alias("way"), "ord", F.col("target").alias("other"), "confidence", "mode")
    into = edges.join(ids, F.col("target") == F.col("id")).select("id", "relation", F.lit(1).alias("way"), "ord", F.col("source").alias("other"), "confidence", "mode")
    named = out.union(into).join(nodes.select(F.col("id").alias("other"), label_of(F.col("label"), F.col("id")).alias("label")), "other")
    refs = F.array_sort(F.collect_list(F.struct("way", "ord", "other", "label", "confidence", "mode")))
    return named.groupBy("id", "relation").agg(refs.alias("neighbors"))


def shares_value_with(edges: DataFrame) -> DataFrame:
    """(id, other): tokens that carry a value in common, distinct."""
    has = edges.where("relation = 'has-value'")
    one, two = has.select(F.col("source").alias("id"), "target"), has.select(F.col("source").alias("other"), "target")
    return one.join(two, "target").where("id <> other").select("id", "other").distinct()


def shares_value_counts(edges: DataFrame) -> DataFrame:
    """(id, n, least): of :func:`shares_value_with`, how many others each token has, and the least of them.

    A token with one value has the value's tokens less itself, so no pair is made; only the others of
    tokens with several values are met as pairs, to count each once."""
    has = edges.where("relation = 'has-value' and source is not null and target is not null").select(F.col("source").alias("id"), "target").distinct()
    values = has.groupBy("target").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("first"))
    second = has.join(values, "target").where("id <> first").groupBy("target").agg(F.min("id").alias("second"))
    about = values.join(second, "target")  # of two tokens or more
    mine = has.groupBy("id").agg(F.min("target").alias("target"), F.max("target").alias("last"))
    least = F.when(F.col("id") == F.col("first"), F.col("second")).otherwise(F.col("first"))
    one = mine.where("target = last").join(about, "target").select("id", (F.col("members") - 1).alias("n"), least.alias("least"))
    several = has.join(mine.where("target <> last").select("id"), "id")
    pairs = several.join(has.withColumnRenamed("id", "other"), "target").where("id <> other").select("id", "other").distinct()
    return one.union(pairs.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("other").alias("least")))


def explain(nodes: DataFrame, edges: DataFrame, text: str) -> DataFrame | None:
    """(relation, neighbors) of one node and, under ``shares-value-with``, its value siblings; None if
    the text names no node."""
    node = resolve_one(nodes, text)
    if node is None:
        return None
    one = nodes.where(F.col("id") == node)
    groups = relation_groups(nodes, edges, one).select("relation", "neighbors")
    mine = edges.where((F.col("relation") == "has-value") & (F.col("source") == node)).select("target")
    siblings = edges.where("relation = 'has-value'").join(mine, "target", "left_semi").where(F.col("source") != node)
    named = siblings.join(one.where("type = 'Token'").select(F.lit(1).alias("token")), F.lit(True)).groupBy("source").agg(F.min("ord").alias("ord"))
    named = named.join(nodes.select(F.col("id").alias("source"), label_of(F.col("label"), F.col("id")).alias("label")), "source")
    refs = F.array_sort(F.collect_list(F.struct(F.lit(0).alias("way"), "ord", F.col("source").alias("other"), "label", F.lit(None).cast("string").alias("confidence"), F.lit(None).cast("string").alias("mode"))))
    return groups.union(named.groupBy(F.lit("shares-value-with").alias("relation")).agg(refs.alias("neighbors")))


def info(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, name, n): nodes by type, edges by class, and how many of each are loaded or left out."""
    kept, gone = attached_edges(nodes, edges), dangling_edges(nodes, edges)
    n = F.count(F.lit(1)).alias("n")
    parts = [
        nodes.groupBy(F.lit("node").alias("kind"), F.col("type").alias("name")).agg(n),
        edges.groupBy(F.lit("edge").alias("kind"), edge_class(F.col("relation")).alias("name")).agg(n),
        nodes.select(F.lit("loaded").alias("kind"), F.lit("order").alias("name")).groupBy("kind", "name").agg(n),
        kept.select(F.lit("loaded").alias("kind"), F.lit("size").alias("name")).groupBy("kind", "name").agg(n),
        gone.select(F.lit("skipped").alias("kind"), F.lit("edges").alias("name")).groupBy("kind", "name").agg(n),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def build_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nodes, unresolved_tokens, similar, dangling) in one row."""
    a = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if((F.col("type") == "Token") & F.col("unresolved_value").isNotNull()).alias("unresolved_tokens"))
    b = edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("relation") == "similar-to").alias("similar"))
    return a.join(b).join(dangling_edges(nodes, edges).agg(F.count(F.lit(1)).alias("dangling")))
