"""Registered queries of the value graph over the driver's tables, and the same in DuckDB's SQL.

A table adapter turns rows into the graph: a part is a token, its size or price a value. Where only
column expressions are needed, the Python parsers are left out of the plan.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuemesh.deploy import ship
from valuemesh.functions import colors, numbers, registry, scalars, text
from valuemesh.operators import composition, conventions, lookup, merge, similar, traverse
from valuemesh.schema import CLASS_PRIORITY, EDGE_CLASS, EDGES, NODES, conform


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(rows: DataFrame, value_type: str, column: str, key) -> DataFrame:
    """Distinct RawValue rows of (ord, scope, column): the value-first dedup before any pair is made."""
    some = rows.groupBy("scope", column).agg(F.min("ord").alias("ord"))
    return some.select(text.raw_value_id(F.lit(value_type), key).alias("id"), "ord", F.lit(value_type).alias("value_type"), "scope", column)


def _sizes(spark, sf_dir) -> DataFrame:
    dim = scalars.parse_dimension(F.concat(F.col("p_size").cast("string"), F.lit("px")), "size")
    rows = _t(spark, sf_dir, "part").select(dim.alias("d"), F.col("p_partkey").alias("ord")).select("ord", F.lit("size").alias("scope"), F.col("d.px").alias("px"), F.col("d.key").alias("key"))
    some = rows.groupBy("key").agg(F.min("ord").alias("ord"), F.first("px").alias("px"), F.first("scope").alias("scope"))
    return some.select(text.raw_value_id(F.lit("dimension"), F.col("key")).alias("id"), "ord", F.lit("dimension").alias("value_type"), "scope", "px")


def _prices(spark, sf_dir) -> DataFrame:
    rows = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("scope"), F.col("p_retailprice").alias("px"))
    key = F.concat(numbers.number_text(F.col("px")), F.lit("px@"), F.col("scope"))
    return _values(rows, "dimension", "px", key)


def _color_values(spark, sf_dir) -> DataFrame:
    """Parts as colours: six hex digits of a multiple of the key, in the brand's scope."""
    hexed = F.lower(F.lpad(F.hex(F.col("p_partkey") * 7919 % 16777216), 6, "0"))
    rows = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("scope"), hexed.alias("hex"))
    return rows.select(F.concat(F.lit("value:color:"), "hex").alias("id"), "ord", F.lit("color").alias("value_type"), "scope", colors.hex_lab(F.col("hex")).alias("lab"))


def _edges(found: DataFrame, epsilon: float) -> DataFrame:
    weight = numbers.round_half_up(numbers.clamp01(1 - F.col("d") / epsilon), 6)
    return found.select(F.col("a").alias("source"), F.col("b").alias("target"), "scope", numbers.round_half_up(F.col("d"), 3).alias("distance"), weight.alias("weight"))


def similar_dimension(spark, sf_dir):
    return _edges(similar.similar_pairs(_sizes(spark, sf_dir), "dimension"), 0.12)


def similar_price(spark, sf_dir):
    return _edges(similar.similar_pairs(_prices(spark, sf_dir), "dimension", 0.01), 0.01)


def similar_ratio_scoped(spark, sf_dir):
    line = _t(spark, sf_dir, "lineitem")
    rows = line.select(F.col("l_discount").alias("ratio"), F.concat(F.lit("discount/"), "l_returnflag").alias("scope")).union(line.select("l_tax", F.concat(F.lit("tax/"), "l_returnflag")))
    rows = rows.withColumn("ord", F.floor(F.col("ratio") * 10000 + 0.5))
    key = F.concat(numbers.number_text(F.col("ratio")), F.lit("@"), F.col("scope"))
    return _edges(similar.similar_pairs(_values(rows, "ratio", "ratio", key), "ratio", 0.025), 0.025)


def similar_duration(spark, sf_dir):
    ms = scalars.parse_duration(F.concat(numbers.number_text(numbers.round_half_up(F.col("value"), 0)), F.lit("ms")))
    rows = _t(spark, sf_dir, "events").where("value is not null").select(ms["ms"].alias("ms"), F.col("event_type").alias("scope"))
    rows = rows.withColumn("ord", F.col("ms").cast("bigint"))
    key = F.concat(numbers.number_text(F.col("ms")), F.lit("ms/"), F.col("scope"))
    return _edges(similar.similar_pairs(_values(rows, "duration", "ms", key), "duration", 0.05), 0.05)


def similar_family_edit(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select(scalars.font_family(F.col("p_name")).alias("family"), F.lit("name").alias("scope"), F.col("p_partkey").alias("ord"))
    return _edges(similar.similar_pairs(_values(rows, "fontFamily", "family", F.col("family")), "fontFamily", 0.5), 0.5)


def similar_weight(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select(scalars.font_weight((F.col("p_size") * 20).cast("string")).alias("font_weight"), F.col("p_brand").alias("scope"))
    rows = rows.withColumn("ord", F.col("font_weight"))
    key = F.concat(F.col("font_weight").cast("string"), F.lit("/"), F.col("scope"))
    return _edges(similar.similar_pairs(_values(rows, "fontWeight", "font_weight", key), "fontWeight"), 150.0)


def similar_color(spark, sf_dir):
    return _edges(similar.similar_pairs(_color_values(spark, sf_dir), "color"), 10.0)


def nearest_color(spark, sf_dir):
    nodes = _color_values(spark, sf_dir).withColumn("type", F.lit("RawValue"))
    return lookup.nearest_colors(nodes, "#2563eb").select("value_id", "distance")


def color_neighbours(spark, sf_dir):
    """Up to three nearest colours of each part's colour in its brand."""
    got = similar.nearest_neighbours(_color_values(spark, sf_dir), "color", 3)
    return got.select("id", "other", "scope", numbers.round_half_up(F.col("d"), 3).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


def _size_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Parts as tokens that carry sizes as values, and the sizes' similarity."""
    values = _sizes(spark, sf_dir)
    part = _t(spark, sf_dir, "part")
    tokens = part.select(F.concat(F.lit("token:part:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_partkey").alias("ord"), F.lit("Token").alias("type"), F.col("p_name").alias("label"), F.lit("part").alias("category"))
    raws = values.withColumn("type", F.lit("RawValue")).withColumn("label", F.element_at(F.split("id", ":"), -1))
    has = part.select(F.concat(F.lit("token:part:"), F.col("p_partkey").cast("string")).alias("source"), F.lit("has-value").alias("relation"), F.concat(F.lit("value:dimension:"), F.col("p_size").cast("string"), F.lit("px@size")).alias("target"), F.col("p_partkey").alias("ord"))
    near = similar.similar_to(values)
    return conform(tokens, NODES).unionByName(conform(raws, NODES)), conform(has, EDGES).unionByName(conform(near, EDGES))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar sizes and how many parts carry each."""
    nodes, edges = _size_graph(spark, sf_dir)
    carried = edges.where("relation = 'has-value'").groupBy(F.col("target").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    near = edges.where("relation = 'similar-to'").select("source", "target", "distance", numbers.round_half_up(F.col("weight"), 6).alias("weight"))
    one = near.join(carried.select(F.col("value").alias("source"), F.col("n").alias("source_parts")), "source")
    return one.join(carried.select(F.col("value").alias("target"), F.col("n").alias("target_parts")), "target").select("source", "target", "distance", "weight", "source_parts", "target_parts")


def match_exact(spark, sf_dir):
    nodes, edges = _size_graph(spark, sf_dir)
    got = lookup.match(nodes, edges, "14px")
    return got.select("role", "value_id", "label", "distance", F.size("tokens").cast("bigint").alias("n_tokens"))


def seeds(spark, sf_dir):
    nodes, _ = _size_graph(spark, sf_dir)
    return lookup.resolve_seeds(nodes, "blue", limit=50).select("id", "label", "score")


def explain_group(spark, sf_dir):
    """Every size's and part's edges by relation: how many, and the first and last neighbour."""
    nodes, edges = _size_graph(spark, sf_dir)
    got = lookup.relation_groups(nodes, edges, nodes.where("type = 'RawValue'").select("id"))
    ids = F.transform("neighbors", lambda n: n["other"])
    return got.select("id", "relation", F.size("neighbors").cast("bigint").alias("n"), F.array_min(ids).alias("least"), F.array_max(ids).alias("most"))


def shares_value(spark, sf_dir):
    """Per part, how many parts share its brand and size, by the brand's own graph."""
    part = _t(spark, sf_dir, "part")
    has = part.select(F.concat(F.lit("token:part:"), F.col("p_partkey").cast("string")).alias("source"), F.lit("has-value").alias("relation"), F.concat_ws("/", "p_brand", "p_size").alias("target"))
    return lookup.shares_value_counts(has)


def merge_dedup(spark, sf_dir):
    """Documents and labels as two fragments of one graph."""
    doc = F.concat(F.lit("asset:"), F.col("doc_id").cast("string"))
    one = _t(spark, sf_dir, "documents").select(doc.alias("id"), F.lit("Asset").alias("type"), F.col("source").alias("label"), F.col("lang").alias("category"), F.col("doc_id").alias("ord"))
    two = _t(spark, sf_dir, "labels").select(doc.alias("id"), F.lit("Asset").alias("type"), F.lit("labelled").alias("label"), F.when(F.col("toxic") == 1, "toxic").alias("category"), F.col("quality").cast("string").alias("tier"), F.col("doc_id").alias("ord"))
    got = merge.merge_nodes(merge.union_fragments([one, two], NODES))
    return got.select("id", "type", "label", "category", "tier")


def _order_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Customers and orders; some orders' customers are left out of the nodes."""
    customer, orders = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders")
    c = lambda col: F.concat(F.lit("c:"), F.col(col).cast("string"))
    o = F.concat(F.lit("o:"), F.col("o_orderkey").cast("string"))
    nodes = customer.where("c_acctbal > 0").select(c("c_custkey").alias("id"), F.lit("Component").alias("type")).union(orders.select(o, F.lit("Instance")))
    edges = orders.select(o.alias("source"), F.lit("instance-of").alias("relation"), c("o_custkey").alias("target"), F.col("o_orderkey").alias("ord"))
    return conform(nodes, NODES), conform(edges, EDGES)


def dangling(spark, sf_dir):
    nodes, edges = _order_graph(spark, sf_dir)
    return merge.dangling_edges(nodes, edges).select("source", "relation", "target")


def info_counts(spark, sf_dir):
    return lookup.info(*_order_graph(spark, sf_dir))


def build_counts(spark, sf_dir):
    return lookup.build_summary(*_order_graph(spark, sf_dir))


def composition_parts(spark, sf_dir):
    """A part's size and price as a composite: its sub-values and how many parts hold each."""
    ref = lambda value, scope: F.struct(F.lit("dimension").alias("value_type"), F.concat(numbers.number_text(value), F.lit("px")).alias("raw"), F.lit(scope).alias("scope"))
    refs = F.array(ref(F.col("p_size").cast("double"), "fontSize"), ref(F.col("p_retailprice"), "lineHeight"))
    nodes = _t(spark, sf_dir, "part").select(F.concat(F.lit("value:typography:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_partkey").alias("ord"), F.lit("RawValue").alias("type"), refs.alias("refs"))
    _, edges = composition.composition(conform(nodes, NODES))
    return edges.groupBy("target").agg(F.countDistinct("source").alias("n"))


def merge_modes(spark, sf_dir):
    """Suppliers' use of return flags, a fragment for each half of the lines, as one edge a triple."""
    line = _t(spark, sf_dir, "lineitem")
    edges = line.select(F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("source"), F.lit("uses-token").alias("relation"), F.concat(F.lit("f:"), "l_returnflag").alias("target"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), F.col("l_quantity").cast("double").alias("weight"), F.col("l_linestatus").alias("mode"))
    got = merge.merge_edges(conform(edges, EDGES))
    return got.select("source", "target", "ord", "weight", F.array_join("modes", ",").alias("modes"))


def explain_part(spark, sf_dir):
    """The first part's relations, and how many neighbours each has."""
    got = lookup.explain(*_size_graph(spark, sf_dir), "token:part:1")
    ids = F.transform("neighbors", lambda n: n["other"])
    return got.select("relation", F.size("neighbors").cast("bigint").alias("n"), F.array_min(ids).alias("least"), F.array_max(ids).alias("most"))


def path_between(spark, sf_dir):
    """The shortest path from the first supplier to the first customer of its region."""
    supplier, nation, customer = (_t(spark, sf_dir, t) for t in ("supplier", "nation", "customer"))
    region = supplier.where("s_suppkey = 1").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("r"))
    near = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r"))
    to = near.agg(F.min("c_custkey")).first()[0]
    path = traverse.shortest_path(_nation_graph(spark, sf_dir)[1], "s:1", f"c:{to}", 4)
    return spark.createDataFrame(list(enumerate(path or [])), "place bigint, id string")


def relevance(spark, sf_dir):
    """Relevance of the places' edges at one to three hops."""
    _, edges = _nation_graph(spark, sf_dir)
    got = edges.select("source", "relation", text.edge_relevance(F.col("relation"), F.lit(0.5), F.length("source") % 3).alias("r"))
    return got.select("source", "relation", numbers.round_half_up(F.col("r"), 6).alias("relevance"))


def category_types(spark, sf_dir):
    """Value types of categories that parts are dealt to."""
    names = F.array(*[F.lit(c) for c in (*text.VALUE_TYPE_OF, "breakpoint", "icon")])
    category = F.get(names, (F.col("p_partkey") % F.size(names)).cast("int"))
    rows = _t(spark, sf_dir, "part").select(category.alias("category"), text.category_to_value_type(category).alias("value_type"))
    return rows.groupBy("category", "value_type").agg(F.count(F.lit(1)).alias("n"))


def color_syntax(spark, sf_dir):
    """Which texts made from parts spell a colour."""
    size = F.col("p_size").cast("string")
    kind, hexed = F.col("p_partkey") % 5, F.lpad(F.lower(F.hex("p_partkey")), 6, "0")
    raw = F.when(kind == 0, F.concat(F.lit("#"), hexed)).when(kind == 1, hexed).when(kind == 2, F.concat(F.lit("rgb("), size, F.lit(" 2 3)"))).when(kind == 3, F.concat(size, F.lit("px"))).otherwise(F.lit(" Navy "))
    return _t(spark, sf_dir, "part").select("p_partkey", F.coalesce(colors.is_color_syntax(raw), F.lit(False)).alias("is_color"))


def canonical_dimension(spark, sf_dir):
    """Lengths in several units from parts, to their keys."""
    unit = F.element_at(F.array(*[F.lit(u) for u in ("px", "rem", "pt", "%", "em", "")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    raw = F.concat(numbers.number_text(F.col("p_retailprice") / 4), unit)
    got = scalars.parse_dimension(raw, "s")
    return _t(spark, sf_dir, "part").select("p_partkey", got["key"].alias("key"), got["px"].alias("px"))


def canonical_ratio(spark, sf_dir):
    raw = F.concat_ws("/", F.col("p_size").cast("string"), (F.col("p_partkey") % 7).cast("string"))
    got = scalars.parse_ratio(raw, "aspect")
    return _t(spark, sf_dir, "part").select("p_partkey", got["key"].alias("key"), got["value"].alias("value"))


def value_types(spark, sf_dir):
    """How the parsers, Python ones included, canonicalise mixed texts made from parts."""
    kinds = ["color", "dimension", "ratio", "duration", "fontWeight", "shadow"]
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("p_partkey") % 6 + 1).cast("int"))
    n = F.col("p_size").cast("string")
    raw = F.when(kind == "color", F.concat(F.lit("rgb("), n, F.lit(", 20, 30)"))).when(kind == "shadow", F.concat(F.lit("0 "), n, F.lit("px #000"))).when(kind == "dimension", F.concat(n, F.lit("px"))).otherwise(n)
    rows = _t(spark, sf_dir, "part").select(kind.alias("value_type"), raw.alias("raw"), F.lit(None).cast("string").alias("scope"))
    got = registry.canonicalize(rows, keep=[])
    return got.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def _nation_graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Regions, nations, suppliers and customers: each points to its place."""
    region, nation = _t(spark, sf_dir, "region"), _t(spark, sf_dir, "nation")
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [
        nation.select(key("n:", "n_nationkey").alias("source"), F.lit("composed-of").alias("relation"), key("r:", "n_regionkey").alias("target")),
        _t(spark, sf_dir, "supplier").select(key("s:", "s_suppkey"), F.lit("uses-token"), key("n:", "s_nationkey")),
        _t(spark, sf_dir, "customer").select(key("c:", "c_custkey"), F.lit("uses-token"), key("n:", "c_nationkey")),
    ]
    edges = parts[0].union(parts[1]).union(parts[2])
    names = region.select(key("r:", "r_regionkey").alias("id"), F.col("r_name").alias("label")).union(nation.select(key("n:", "n_nationkey"), F.col("n_name")))
    ids = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct()
    nodes = ids.join(names, "id", "left").withColumn("type", F.lit("Component"))
    ordered = edges.withColumn("ord", F.xxhash64("source", "target"))
    return conform(nodes, NODES), conform(ordered, EDGES)


def bfs_hops(spark, sf_dir):
    """Nodes by their distance from the first region, edges taken either way."""
    _, edges = _nation_graph(spark, sf_dir)
    starts = _t(spark, sf_dir, "region").where("r_regionkey = 0").select(F.lit("r:0").alias("id"))
    return traverse.hops(edges, starts, 3).groupBy(F.col("hop").cast("bigint").alias("hop")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))


def impact(spark, sf_dir):
    nodes, edges = _nation_graph(spark, sf_dir)
    return traverse.impact(nodes, edges, "r:1").select("id", "type", F.col("hop").cast("bigint").alias("hop"))


def best_first(spark, sf_dir):
    return traverse.best_first(*_size_graph(spark, sf_dir), "14px@size", 30)


def envelope(spark, sf_dir):
    line = _t(spark, sf_dir, "lineitem")
    uses = line.select(F.col("l_returnflag").alias("component"), F.col("l_linestatus").alias("slot"), F.col("l_discount").cast("string").alias("token"))
    got = conventions.variant_envelope(uses)
    return got.select("component", "slot", "token", "n", numbers.round_half_up(F.col("share"), 6).alias("share"), "is_default")


def cooccurrence(spark, sf_dir):
    """Brands that are in one order together, by number of orders."""
    line, part = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "part")
    uses = line.join(part, line["l_partkey"] == part["p_partkey"]).select(F.col("l_orderkey").alias("screen"), F.col("p_brand").alias("token"))
    return conventions.commonly_used_with(uses)


def findings(spark, sf_dir):
    nodes, edges = _order_graph(spark, sf_dir)
    tokens = nodes.withColumn("type", F.when(F.col("type") == "Component", "Token").otherwise(F.col("type")))
    return conventions.findings(tokens, edges, 15)


def cosine_seeds(spark, sf_dir):
    vectors = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    query = [float(i % 7 - 3) for i in range(64)]
    return conventions.cosine_seeds(vectors, query, 10).select("id", numbers.round_half_up(F.col("score"), 6).alias("score"))


QUERIES = [
    similar_dimension, similar_price, similar_ratio_scoped, similar_duration, similar_family_edit, similar_weight, similar_color, nearest_color, color_neighbours,
    flagship, match_exact, seeds, explain_group, shares_value, merge_dedup, dangling, info_counts, build_counts, composition_parts, merge_modes, explain_part, path_between, relevance, category_types, color_syntax, canonical_dimension, canonical_ratio,
    value_types, bfs_hops, impact, best_first, envelope, cooccurrence, findings, cosine_seeds,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def _text(x: str) -> str:
    """A number of four places at most, without trailing zeros."""
    return f"regexp_replace(cast(cast({x} as decimal(38,4)) as varchar), '\\.?0+$', '')"


def _half(x: str, places: int) -> str:
    return f"floor(({x}) * {10.0**places} + 0.5) / {10.0**places}"


def _pairs(values: str, d: str, epsilon: float) -> str:
    weight = _half(f"greatest(0.0, least(1.0, 1 - d / {epsilon}))", 6)
    return f"WITH v AS ({values}), p AS (SELECT a.id AS source, b.id AS target, a.scope AS scope, {d} AS d FROM v a JOIN v b ON a.scope = b.scope AND a.ord < b.ord) SELECT source, target, scope, {_half('d', 3)} AS distance, {weight} AS weight FROM p WHERE d < {epsilon}"


_RELATIVE = "abs(a.v - b.v) / greatest(abs(a.v), abs(b.v), 1.0)"
_SIZES = "SELECT 'value:dimension:' || p_size || 'px@size' AS id, min(p_partkey) AS ord, 'size' AS scope, cast(p_size AS double) AS v FROM part GROUP BY p_size"


def _lab_sql() -> str:
    """(id, ord, scope, l, a, b) of the parts' colours."""
    coded = ", ".join(f"(({n} // {d}) % 256) / 255.0 AS {c}" for c, n, d in (("r", "k", 65536), ("g", "k", 256), ("bl", "k", 1)))
    linear = ", ".join(f"CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END AS l{c}" for c in ("r", "g", "bl"))
    xyz = ", ".join(f"(lr * {m[0]!r} + lg * {m[1]!r} + lbl * {m[2]!r}) / {w!r} AS t{i}" for i, (m, w) in enumerate(zip(colors.RGB_TO_XYZ_D50, colors.WHITE_D50)))
    f = ", ".join(f"CASE WHEN t{i} > {colors.EPSILON!r} THEN pow(t{i}, {1 / 3!r}) ELSE (t{i} * {colors.KAPPA!r} + 16.0) / 116.0 END AS f{i}" for i in range(3))
    grey = "CASE WHEN r = g AND g = bl THEN 0.0 ELSE"
    return (
        f"SELECT 'value:color:' || lower(lpad(printf('%x', k), 6, '0')) AS id, ord, scope, {_half('f1 * 116.0 - 16.0', 3)} AS l, {grey} {_half('(f0 - f1) * 500.0', 3)} END AS a, {grey} {_half('(f1 - f2) * 200.0', 3)} END AS b "
        f"FROM (SELECT *, {f} FROM (SELECT *, {xyz} FROM (SELECT *, {linear} FROM (SELECT *, {coded} FROM (SELECT p_partkey AS ord, p_brand AS scope, p_partkey * 7919 % 16777216 AS k FROM part)))))"
    )


def _delta_e_sql(pairs: str) -> str:
    """``pairs`` gives l1 a1 b1 l2 a2 b2 beside other columns; adds d."""
    steps = [
        "sqrt(a1 * a1 + b1 * b1) AS q1, sqrt(a2 * a2 + b2 * b2) AS q2",
        "0.5 * (1 - sqrt(pow((q1 + q2) / 2, 7) / (pow((q1 + q2) / 2, 7) + 6103515625.0))) AS gg",
        "a1 * (1 + gg) AS x1, a2 * (1 + gg) AS x2",
        "sqrt(x1 * x1 + b1 * b1) AS c1, sqrt(x2 * x2 + b2 * b2) AS c2, CASE WHEN x1 = 0 AND b1 = 0 THEN 0.0 ELSE degrees(atan2(b1, x1)) + CASE WHEN atan2(b1, x1) < 0 THEN 360.0 ELSE 0.0 END END AS h1, CASE WHEN x2 = 0 AND b2 = 0 THEN 0.0 ELSE degrees(atan2(b2, x2)) + CASE WHEN atan2(b2, x2) < 0 THEN 360.0 ELSE 0.0 END END AS h2",
        "CASE WHEN c1 * c2 = 0 THEN 0.0 WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 ELSE h2 - h1 + 360 END AS dh, CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h2 - h1) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS mh, (l1 + l2) / 2 AS ml, (c1 + c2) / 2 AS mc",
        "1 - 0.17 * cos(radians(mh - 30)) + 0.24 * cos(radians(2 * mh)) + 0.32 * cos(radians(3 * mh + 6)) - 0.20 * cos(radians(4 * mh - 63)) AS tt, 2 * sqrt(c1 * c2) * sin(radians(dh / 2)) AS big",
        "(l2 - l1) / (1 + 0.015 * (ml - 50) * (ml - 50) / sqrt(20 + (ml - 50) * (ml - 50))) AS pl, (c2 - c1) / (1 + 0.045 * mc) AS pc, big / (1 + 0.015 * mc * tt) AS ph, -sin(radians(60 * exp(-((mh - 275) / 25) * ((mh - 275) / 25)))) * 2 * sqrt(pow(mc, 7) / (pow(mc, 7) + 6103515625.0)) AS rt",
        "sqrt(greatest(0.0, pl * pl + pc * pc + ph * ph + rt * pc * ph)) AS d",
    ]
    for step in steps:
        pairs = f"SELECT *, {step} FROM ({pairs})"
    return pairs


def _color_pairs_sql() -> str:
    v = _lab_sql()
    return _delta_e_sql(f"SELECT x.id AS source, y.id AS target, x.scope AS scope, x.l AS l1, x.a AS a1, x.b AS b1, y.l AS l2, y.a AS a2, y.b AS b2 FROM ({v}) x JOIN ({v}) y ON x.scope = y.scope AND x.ord < y.ord")


def _priority(relation: str) -> float:
    return CLASS_PRIORITY[EDGE_CLASS[relation]]


def _size_nodes_sql() -> str:
    return "SELECT 'token:part:' || p_partkey AS id, p_name AS label, 'Token' AS type FROM part UNION ALL SELECT DISTINCT 'value:dimension:' || p_size || 'px@size', p_size || 'px@size', 'RawValue' FROM part"


def _size_edges_sql() -> str:
    near = _pairs(_SIZES, _RELATIVE, 0.12)
    return f"SELECT 'token:part:' || p_partkey AS source, 'has-value' AS relation, 'value:dimension:' || p_size || 'px@size' AS target FROM part UNION ALL SELECT source, 'similar-to', target FROM ({near})"


_ORDER_NODES = "SELECT 'c:' || c_custkey AS id, 'Component' AS type FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'o:' || o_orderkey, 'Instance' FROM orders"
_ORDER_EDGES = "SELECT 'o:' || o_orderkey AS source, 'instance-of' AS relation, 'c:' || o_custkey AS target FROM orders"
_NATION_EDGES = "SELECT 'n:' || n_nationkey AS source, 'composed-of' AS relation, 'r:' || n_regionkey AS target FROM nation UNION ALL SELECT 's:' || s_suppkey, 'uses-token', 'n:' || s_nationkey FROM supplier UNION ALL SELECT 'c:' || c_custkey, 'uses-token', 'n:' || c_nationkey FROM customer"


def oracle_sql() -> dict[str, str]:
    price = f"SELECT 'value:dimension:' || {_text('p_retailprice')} || 'px@' || p_brand AS id, min(p_partkey) AS ord, p_brand AS scope, p_retailprice AS v FROM part GROUP BY p_brand, p_retailprice"
    ratio = f"SELECT 'value:ratio:' || {_text('v')} || '@' || scope AS id, floor(v * 10000 + 0.5) AS ord, scope, v FROM (SELECT DISTINCT l_discount AS v, 'discount/' || l_returnflag AS scope FROM lineitem UNION SELECT DISTINCT l_tax, 'tax/' || l_returnflag FROM lineitem)"
    duration = f"SELECT 'value:duration:' || {_text('v')} || 'ms/' || scope AS id, v AS ord, scope, v FROM (SELECT DISTINCT floor(value + 0.5) AS v, event_type AS scope FROM events WHERE value IS NOT NULL)"
    family = "SELECT 'value:fontFamily:' || v AS id, ord, 'name' AS scope, v FROM (SELECT lower(trim(split_part(p_name, ',', 1))) AS v, min(p_partkey) AS ord FROM part GROUP BY 1)"
    weight = "SELECT 'value:fontWeight:' || v || '/' || scope AS id, v AS ord, scope, v FROM (SELECT DISTINCT p_size * 20 AS v, p_brand AS scope FROM part)"
    target = colors.parse_color("#2563eb")["lab"]
    near = _delta_e_sql(f"SELECT id, ord, l AS l2, a AS a2, b AS b2, {target[0]!r}::double AS l1, {target[1]!r}::double AS a1, {target[2]!r}::double AS b1 FROM ({_lab_sql()})")
    both = f"SELECT source AS id, target AS other, scope, d FROM ({_color_pairs_sql()}) WHERE d < 10 UNION ALL SELECT target, source, scope, d FROM ({_color_pairs_sql()}) WHERE d < 10"
    similar_sizes = _pairs(_SIZES, _RELATIVE, 0.12)
    size_px = "value:dimension:14px@size"
    unit = "CASE p_partkey % 6 WHEN 0 THEN 'px' WHEN 1 THEN 'rem' WHEN 2 THEN 'pt' WHEN 3 THEN '%' WHEN 4 THEN 'em' ELSE '' END"
    shown = "cast(cast(p_retailprice / 4 AS decimal(38,4)) AS double)"
    px = f"CASE WHEN {unit} IN ('rem', 'em') THEN {_half(f'{shown} * 16.0', 4)} WHEN {unit} = 'pt' THEN {_half(f'{shown} / 0.75', 4)} WHEN {unit} = '%' THEN {shown} ELSE {_half(shown, 4)} END"
    dot = "list_sum(list_transform(range(1, 65), lambda i: cast(embedding[i] AS double) * (((i - 1) % 7) - 3)))"
    norm = "list_sum(list_transform(embedding, lambda x: cast(x AS double) * cast(x AS double)))"
    query_norm = float(sum((i % 7 - 3) ** 2 for i in range(64)))
    kinds = "CASE p_partkey % 6 WHEN 0 THEN 'value:color:' || p_size || ',20,30,255' WHEN 1 THEN 'value:dimension:' || p_size || 'px@dim' WHEN 2 THEN 'value:ratio:' || p_size || '@ratio' WHEN 3 THEN 'value:duration:' || p_size || 'ms' WHEN 4 THEN 'value:fontWeight:' || p_size ELSE 'value:shadow:0,' || p_size || ',0,0,0,0,0,255' END"
    kinds_of = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate([*text.VALUE_TYPE_OF, "breakpoint", "icon"]))
    types_of = " ".join(f"WHEN '{c}' THEN '{v}'" for c, v in text.VALUE_TYPE_OF.items())
    home = "SELECT n_nationkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey = 1"
    undirected = f"SELECT source AS a, target AS b FROM ({_NATION_EDGES}) UNION ALL SELECT target, source FROM ({_NATION_EDGES})"
    return {
        "similar_dimension": similar_sizes,
        "similar_price": _pairs(price, _RELATIVE, 0.01),
        "similar_ratio_scoped": _pairs(ratio, _RELATIVE, 0.025),
        "similar_duration": _pairs(duration, _RELATIVE, 0.05),
        "similar_family_edit": _pairs(family, "levenshtein(a.v, b.v) / cast(greatest(length(a.v), length(b.v)) AS double)", 0.5),
        "similar_weight": _pairs(weight, "cast(abs(a.v - b.v) AS double)", 150.0),
        "similar_color": f"SELECT source, target, scope, {_half('d', 3)} AS distance, {_half('greatest(0.0, least(1.0, 1 - d / 10.0))', 6)} AS weight FROM ({_color_pairs_sql()}) WHERE d < 10",
        "nearest_color": f"SELECT id AS value_id, {_half('d', 2)} AS distance FROM ({near}) WHERE d < 10 ORDER BY d, ord LIMIT 5",
        "color_neighbours": f"SELECT id, other, scope, {_half('d', 3)} AS distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY id, scope ORDER BY d, other) AS rank FROM ({both})) WHERE rank <= 3",
        "flagship": f"WITH n AS (SELECT 'value:dimension:' || p_size || 'px@size' AS value, count(*) AS n FROM part GROUP BY 1) SELECT e.source, e.target, e.distance, e.weight, a.n AS source_parts, b.n AS target_parts FROM ({similar_sizes}) e JOIN n a ON a.value = e.source JOIN n b ON b.value = e.target",
        "match_exact": f"WITH n AS (SELECT 'value:dimension:' || p_size || 'px@size' AS value_id, p_size || 'px@size' AS label, count(*) AS n_tokens FROM part GROUP BY 1, 2), h AS (SELECT 'exact' AS role, '{size_px}' AS value_id, cast(NULL AS double) AS distance UNION ALL SELECT 'similar', CASE WHEN source = '{size_px}' THEN target ELSE source END, distance FROM ({similar_sizes}) WHERE source = '{size_px}' OR target = '{size_px}') SELECT h.role, h.value_id, n.label, h.distance, n.n_tokens FROM h JOIN n USING (value_id)",
        "seeds": f"SELECT id, label, score FROM (SELECT id, label, CASE WHEN label = 'blue' OR id = 'blue' THEN 1.0 WHEN regexp_replace(lower(label), '[\\s\\-_/]+', '', 'g') = 'blue' THEN 0.9 WHEN contains(regexp_replace(lower(label), '[\\s\\-_/]+', '', 'g'), 'blue') OR contains('blue', regexp_replace(lower(label), '[\\s\\-_/]+', '', 'g')) THEN 0.6::double ELSE 0.0 END AS score FROM ({_size_nodes_sql()})) WHERE score >= 0.5 ORDER BY score DESC, id LIMIT 50",
        "explain_group": f"WITH e AS ({_size_edges_sql()}) SELECT id, relation, count(*) AS n, min(other) AS least, max(other) AS most FROM (SELECT source AS id, relation, target AS other FROM e UNION ALL SELECT target, relation, source FROM e) WHERE id LIKE 'value:%' GROUP BY id, relation",
        "shares_value": "SELECT 'token:part:' || a.p_partkey AS id, count(*) AS n, min('token:part:' || b.p_partkey) AS least FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey GROUP BY 1",
        "merge_dedup": "SELECT 'asset:' || coalesce(d.doc_id, l.doc_id) AS id, 'Asset' AS type, coalesce(d.source, CASE WHEN l.doc_id IS NOT NULL THEN 'labelled' END) AS label, CASE WHEN l.toxic = 1 THEN 'toxic' ELSE d.lang END AS category, cast(l.quality AS varchar) AS tier FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id",
        "dangling": f"SELECT source, relation, target FROM ({_ORDER_EDGES}) WHERE target NOT IN (SELECT id FROM ({_ORDER_NODES})) OR source NOT IN (SELECT id FROM ({_ORDER_NODES}))",
        "info_counts": f"WITH n AS ({_ORDER_NODES}), e AS ({_ORDER_EDGES}), g AS (SELECT * FROM e WHERE target NOT IN (SELECT id FROM n)) SELECT 'node' AS kind, type AS name, count(*) AS n FROM n GROUP BY type UNION ALL SELECT 'edge', 'structural', count(*) FROM e UNION ALL SELECT 'loaded', 'order', count(*) FROM n UNION ALL SELECT 'loaded', 'size', (SELECT count(*) FROM e) - (SELECT count(*) FROM g) UNION ALL SELECT 'skipped', 'edges', count(*) FROM g HAVING count(*) > 0",
        "build_counts": f"WITH n AS ({_ORDER_NODES}), e AS ({_ORDER_EDGES}) SELECT (SELECT count(*) FROM n) AS nodes, cast(0 AS bigint) AS unresolved_tokens, (SELECT count(*) FROM e) AS edges, cast(0 AS bigint) AS similar, (SELECT count(*) FROM e WHERE target NOT IN (SELECT id FROM n)) AS dangling",
        "composition_parts": f"SELECT target, count(*) AS n FROM (SELECT 'value:dimension:' || p_size || 'px@fontSize' AS target FROM part UNION ALL SELECT 'value:dimension:' || {_text('p_retailprice')} || 'px@lineHeight' FROM part) GROUP BY target",
        "merge_modes": "SELECT 's:' || l_suppkey AS source, 'f:' || l_returnflag AS target, min(l_orderkey * 8 + l_linenumber) AS ord, arg_max(cast(l_quantity AS double), l_orderkey * 8 + l_linenumber) AS weight, array_to_string(list_sort(list(DISTINCT l_linestatus)), ',') AS modes FROM lineitem GROUP BY 1, 2",
        "explain_part": "SELECT 'has-value' AS relation, cast(1 AS bigint) AS n, 'value:dimension:' || p_size || 'px@size' AS least, 'value:dimension:' || p_size || 'px@size' AS most FROM part WHERE p_partkey = 1 UNION ALL SELECT 'shares-value-with', count(*), min('token:part:' || b.p_partkey), max('token:part:' || b.p_partkey) FROM part a JOIN part b ON a.p_size = b.p_size AND b.p_partkey <> 1 WHERE a.p_partkey = 1 HAVING count(*) > 0",
        "path_between": f"WITH h AS ({home}), c AS (SELECT c_custkey, c_nationkey FROM customer JOIN nation n ON c_nationkey = n.n_nationkey JOIN h ON n.n_regionkey = h.n_regionkey ORDER BY c_custkey LIMIT 1), p AS (SELECT CASE WHEN c_nationkey = n_nationkey THEN ['s:1', 'n:' || n_nationkey, 'c:' || c_custkey] ELSE ['s:1', 'n:' || n_nationkey, 'r:' || n_regionkey, 'n:' || c_nationkey, 'c:' || c_custkey] END AS ids FROM h, c) SELECT unnest(range(len(ids))) AS place, unnest(ids) AS id FROM p",
        "relevance": f"SELECT source, relation, {_half("CASE relation WHEN 'composed-of' THEN " + str(_priority('composed-of')) + " ELSE " + str(_priority('uses-token')) + " END * 0.5 / (length(source) % 3 + 1)", 6)} AS relevance FROM ({_NATION_EDGES})",
        "category_types": f"SELECT category, CASE category {types_of} ELSE 'other' END AS value_type, count(*) AS n FROM (SELECT CASE p_partkey % {len(text.VALUE_TYPE_OF) + 2} {kinds_of} END AS category FROM part) GROUP BY 1, 2",
        "color_syntax": "SELECT p_partkey, CASE p_partkey % 5 WHEN 1 THEN regexp_full_match(lower(lpad(printf('%x', p_partkey), 6, '0')), '[a-f]{6}') WHEN 3 THEN false ELSE true END AS is_color FROM part",
        "canonical_dimension": f"SELECT p_partkey, {_text('px')} || CASE WHEN u = '%' THEN '%@s' ELSE 'px@s' END AS key, px FROM (SELECT p_partkey, {unit} AS u, {px} AS px FROM part)",
        "canonical_ratio": f"SELECT p_partkey, CASE WHEN v IS NOT NULL THEN {_text('v')} || '@aspect' END AS key, v AS value FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN {_half('cast(p_size AS double) / (p_partkey % 7)', 4)} END AS v FROM part)",
        "value_types": f"SELECT {kinds} AS id, count(*) AS n FROM part GROUP BY 1",
        "bfs_hops": f"WITH RECURSIVE e AS ({undirected}), w AS (SELECT 'r:0' AS id, 0 AS hop UNION SELECT e.b, w.hop + 1 FROM w JOIN e ON e.a = w.id WHERE w.hop < 3), m AS (SELECT id, min(hop) AS hop FROM w GROUP BY id) SELECT cast(hop AS bigint) AS hop, count(*) AS n, min(id) AS least FROM m GROUP BY hop",
        "impact": f"WITH RECURSIVE e AS ({_NATION_EDGES}), w AS (SELECT 'r:1' AS id, 0 AS hop UNION SELECT e.source, w.hop + 1 FROM w JOIN e ON e.target = w.id WHERE w.hop < 6) SELECT id, 'Component' AS type, cast(min(hop) AS bigint) AS hop FROM w GROUP BY id HAVING min(hop) > 0",
        "envelope": f"WITH c AS (SELECT l_returnflag AS component, l_linestatus AS slot, cast(l_discount AS varchar) AS token, count(*) AS n FROM lineitem GROUP BY 1, 2, 3) SELECT component, slot, token, n, {_half('cast(n AS double) / sum(n) OVER (PARTITION BY component, slot)', 6)} AS share, row_number() OVER (PARTITION BY component, slot ORDER BY n DESC, token) = 1 AS is_default FROM c",
        "cooccurrence": "WITH u AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT x.p_brand AS a, y.p_brand AS b, count(*) AS n FROM u x JOIN u y ON x.l_orderkey = y.l_orderkey AND x.p_brand < y.p_brand GROUP BY 1, 2 HAVING count(*) >= 2",
        "findings": f"WITH n AS ({_ORDER_NODES}), x AS (SELECT source AS id FROM ({_ORDER_EDGES}) UNION ALL SELECT target FROM ({_ORDER_EDGES})) SELECT 'unused' AS finding, id FROM n WHERE type = 'Component' AND id NOT IN (SELECT id FROM x) UNION ALL SELECT 'hub', id FROM x GROUP BY id HAVING count(*) >= 15",
        "cosine_seeds": f"SELECT vec_id AS id, {_half('s', 6)} AS score FROM (SELECT vec_id, {dot} / sqrt({norm} * {query_norm}) AS s FROM embeddings) ORDER BY s DESC, vec_id LIMIT 10",
    }
