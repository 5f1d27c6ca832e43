"""Merging, similarity, composition, lookups and traversals on small graphs."""

import random

import pytest
from pyspark.sql import functions as F

from valuemesh.functions.registry import METRICS, canonicalize
from valuemesh.operators import color_pairs, conventions, lookup, merge, similar, traverse
from valuemesh.plans.build import link
from valuemesh.schema import EDGES, NODES, conform
from valuemesh.sources import graph_io


def nodes_of(spark, rows):
    return conform(spark.createDataFrame(rows, "id string, ord bigint, type string, label string, category string, tier string, sources array<struct<adapter:string,file:string,loc:string>>"), NODES)


def edges_of(spark, rows):
    return conform(spark.createDataFrame(rows, "source string, target string, relation string, ord bigint, weight double, mode string"), EDGES)


def values_of(spark, rows):
    raw = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord bigint, raw string, value_type string, scope string")
    return canonicalize(raw, keep=["ord"]).where("id is not null").withColumn("type", F.lit("RawValue"))


def test_merge(spark):
    src = [("a", "f", None)]
    one = nodes_of(spark, [("x", 0, "Token", "X", "color", None, src), ("y", 1, "Token", None, None, None, None)])
    two = nodes_of(spark, [("x", 0, "Token", None, None, "semantic", [("b", "g", None), ("a", "f", None)])])
    e1 = edges_of(spark, [("x", "y", "aliases", 0, None, "light")])
    e2 = edges_of(spark, [("x", "y", "aliases", 0, 0.5, "dark"), ("x", "ghost", "aliases", 1, None, None)])
    nodes, edges = merge.merge_fragments([(one, e1), (two, e2)])
    x = nodes.where("id = 'x'").first()
    assert (x.label, x.category, x.tier, len(x.sources)) == ("X", "color", "semantic", 2)
    e = edges.where("target = 'y'").first()
    assert (e.weight, e.mode, e.modes) == (0.5, "dark", ["dark", "light"]) and edges.count() == 2
    assert [r.target for r in merge.dangling_edges(nodes, edges).collect()] == ["ghost"]
    assert merge.attached_edges(nodes, edges).count() == 1
    assert sorted(map(tuple, merge.merge_nodes(nodes).select("id", "label", "tier").collect())) == sorted(map(tuple, nodes.select("id", "label", "tier").collect()))
    with pytest.raises(Exception, match="conflicting types"):
        merge.merge_nodes(nodes_of(spark, [("x", 0, "Token", None, None, None, None), ("x", 1, "Component", None, None, None, None)])).collect()


NEAR = [("15px", "16px", "dimension", "fontSize"), ("1.4", "1.5", "ratio", "lineHeight"), ("200ms", "250ms", "duration", None), ("400", "500", "fontWeight", None), ("inter", "intern", "fontFamily", None), ("oklch(0.97 0 0)", "oklch(0.95 0 0)", "color", None)]
FAR = [("2px", "4px", "dimension", "spacing"), ("100ms", "500ms", "duration", None), ("400", "700", "fontWeight", None), ("inter", "roboto", "fontFamily", None), ("oklch(0.97 0 0)", "oklch(0.5 0.2 260)", "color", None)]


@pytest.mark.parametrize("case", NEAR + FAR)
def test_similar(spark, case):
    a, b, kind, scope = case
    got = similar.similar_to(values_of(spark, [(a, kind, scope), (b, kind, scope)])).collect()
    assert len(got) == (case in NEAR)


def test_similar_scopes_and_epsilon(spark):
    apart = values_of(spark, [("14px", "dimension", "radius"), ("13.75px", "dimension", "fontSize"), ("1.5", "ratio", "lineHeight"), ("1.5", "ratio", "opacity")])
    assert similar.similar_to(apart).count() == 0
    greys = values_of(spark, [("oklch(0.97 0 0)", "color", None), ("oklch(0.95 0 0)", "color", None), ("oklch(0.5 0 0)", "color", None)])
    assert similar.similar_to(greys, {"color": 50.0}).count() == 3
    assert similar.similar_to(greys, {"color": 0.5}).count() == 0


@pytest.mark.parametrize("kind", list(METRICS))
def test_blocked_equals_unblocked(spark, kind):
    import random

    rng = random.Random(5)
    raws = {
        "color": lambda: f"lab({rng.choice([rng.uniform(0, 100), 100, 0, 104])} {rng.uniform(-20, 20)} {rng.uniform(-20, 20)})",
        "dimension": lambda: f"{rng.uniform(-3, 60):.2f}px",
        "ratio": lambda: f"{rng.uniform(0, 5):.3f}",
        "duration": lambda: f"{rng.uniform(0, 900):.1f}ms",
        "fontWeight": lambda: str(rng.randrange(1, 1500)),
        "fontFamily": lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))),
    }[kind]
    values = values_of(spark, [(raws(), kind, "s") for _ in range(120)]).dropDuplicates(["id"]).cache()
    for epsilon in (METRICS[kind].epsilon, METRICS[kind].epsilon * 1.7):
        a = {(r.a, r.b) for r in similar.similar_pairs(values, kind, epsilon).collect()}
        rows = similar.similar_pairs(values, kind, epsilon).count()
        b = {(r.a, r.b) for r in similar.similar_pairs(values, kind, epsilon, blocked=False).collect()}
        assert a == b and rows == len(a) and a


@pytest.fixture(scope="module")
def graph(spark):
    raws = values_of(spark, [("#2563eb", "color", None), ("oklch(0.97 0 0)", "color", None), ("oklch(0.95 0 0)", "color", None)])
    tokens = nodes_of(spark, [(f"token:color:{n}", 10 + i, "Token", n, "color", "semantic", None) for i, n in enumerate(["primary", "secondary", "muted", "subtle"])])
    ids = [r.id for r in raws.orderBy("ord").collect()]
    edges = edges_of(spark, [(f"token:color:{n}", ids[v], "has-value", i, None, "light") for i, (n, v) in enumerate([("primary", 0), ("secondary", 1), ("muted", 1), ("subtle", 2)])])
    nodes, edges = link(conform(raws, NODES).unionByName(tokens), edges)
    return nodes.cache(), edges.cache()


def test_seeds_and_match(graph):
    nodes, edges = graph
    assert lookup.resolve_seeds(nodes, "primary").first().id == "token:color:primary"
    assert "token:color:muted" in {r.id for r in lookup.resolve_seeds(nodes, "mut").collect()}
    hits = {r.role: r for r in lookup.match(nodes, edges, " oklch(0.97 0 0) ").collect()}
    assert {t.label for t in hits["exact"].tokens} == {"muted", "secondary"}
    assert [t.label for t in hits["similar"].tokens] == ["subtle"] and hits["similar"].distance < 10
    near = lookup.match(nodes, edges, "#f5f5f6").orderBy("distance").collect()
    assert near[0].role == "nearest" and near[0].distance < 2 and "secondary" in {t.label for t in near[0].tokens}
    assert lookup.match(nodes, edges, "definitely-not-a-value").count() == 0


def test_explain(graph):
    nodes, edges = graph
    groups = {r.relation: r.neighbors for r in lookup.explain(nodes, edges, "secondary").collect()}
    assert set(groups) == {"has-value", "shares-value-with"}
    assert [n.label for n in groups["shares-value-with"]] == ["muted"]
    assert lookup.explain(nodes, edges, "zzz-nonexistent") is None
    assert {(r.id, r.other) for r in lookup.shares_value_with(edges).collect()} == {("token:color:secondary", "token:color:muted"), ("token:color:muted", "token:color:secondary")}


def test_traversals(graph, spark):
    nodes, edges = graph
    got = traverse.best_first(nodes, edges, "primary", 10).collect()
    assert (got[0].id, got[0].hop, got[0].relevance) == ("token:color:primary", 0, 1.0)
    assert [(r.type, r.hop, r.relevance) for r in got[1:]] == [("RawValue", 1, 0.8)]
    assert traverse.best_first(nodes, edges, "primary", 2).count() == 2
    assert traverse.best_first(nodes, edges, "zzz").count() == 0
    assert traverse.shortest_path(edges, "token:color:secondary", "token:color:muted")[1].startswith("value:color:")
    assert traverse.shortest_path(edges, "token:color:primary", "token:color:muted") is None
    deps = edges_of(spark, [("c", "t", "uses-token", 0, None, None), ("i", "c", "instance-of", 1, None, None), ("s", "i", "has-value", 2, None, None)])
    all_nodes = nodes_of(spark, [(n, i, "Component", n, None, None, None) for i, n in enumerate("ctis")])
    assert {(r.id, r.hop) for r in traverse.impact(all_nodes, deps, "t").collect()} == {("c", 1), ("i", 2)}


def test_info_and_io(graph, spark, tmp_path):
    nodes, edges = graph
    got = {(r.kind, r.name): r.n for r in lookup.info(nodes, edges).collect()}
    assert got[("node", "Token")] == 4 and got[("edge", "structural")] == 4 and got[("edge", "similarity")] >= 1
    assert lookup.build_summary(nodes, edges).first().dangling == 0
    graph_io.write_graph(nodes, edges, str(tmp_path / "g"))
    n, e = graph_io.read_graph(spark, str(tmp_path / "g"))
    assert n.exceptAll(nodes.select(n.columns)).count() == 0 if "map" not in str(n.dtypes) else n.count() == nodes.count()
    assert e.count() == edges.count() and e.columns == list(EDGES)
    graph_io.write_json(nodes, edges, str(tmp_path / "j"))
    n, e = graph_io.read_json(spark, str(tmp_path / "j"))
    assert (n.count(), e.count()) == (nodes.count(), edges.count())
    (tmp_path / "doc.json").write_text('{"version":1,"nodes":[{"id":"a","type":"RawValue","props":{"valueType":"dimension","px":4}}],"edges":[{"source":"a","target":"b","relation":"similar-to","weight":0.5,"props":{"distance":0.1}}]}')
    n, e = graph_io.read_document(spark, str(tmp_path / "doc.json"))
    assert (n.first().px, n.first().value_type, e.first().distance) == (4.0, "dimension", 0.1)
    page = graph_io.html_view(nodes, edges)
    assert "token:color:primary" in page and "rgb(37,99,235)" in page


def test_composition(spark):
    shadow = values_of(spark, [("0 1px 2px oklch(0.95 0 0)", "shadow", None), ("600 15px/1.5 Inter", "typography", None), ("oklch(0.97 0 0)", "color", None)])
    nodes, edges = link(conform(shadow, NODES), edges_of(spark, []))
    rel = [(r.source.split(":")[1], r.relation, r.target.split(":")[1]) for r in edges.collect()]
    assert sorted(rel) == sorted([("shadow", "composed-of", "color"), *(("typography", "composed-of", t) for t in ("dimension", "fontFamily", "fontWeight", "ratio")), next(r for r in rel if r[1] == "similar-to")])
    assert merge.dangling_edges(nodes, edges).count() == 0


def test_conventions(spark):
    uses = spark.createDataFrame([("c", "bg", "t1", "s1"), ("c", "bg", "t1", "s2"), ("c", "bg", "t2", "s1"), ("c", "fg", "t2", "s2")], "component string, slot string, token string, screen string")
    env = {(r.slot, r.token): (r.n, round(r.share, 3), r.is_default) for r in conventions.variant_envelope(uses).collect()}
    assert env == {("bg", "t1"): (2, 0.667, True), ("bg", "t2"): (1, 0.333, False), ("fg", "t2"): (1, 1.0, True)}
    assert [tuple(r) for r in conventions.commonly_used_with(uses).collect()] == [("t1", "t2", 2)]
    side = spark.createDataFrame([("a1", "Pri mary", "v1"), ("a2", "x", "v9")], "id string, label string, value_id string")
    other = spark.createDataFrame([("b1", "other", "v1"), ("b2", "primary", "v1")], "id string, label string, value_id string")
    assert [tuple(r) for r in conventions.reconcile(side, other).collect()] == [("a1", "b2", "value+name")]


def test_shares_value_counts(spark):
    """The counts are those of the pairs, tokens with several values, repeated edges and lone ones included."""
    carried = [("a", "1"), ("b", "1"), ("b", "1"), ("b", "2"), ("c", "2"), ("c", "1"), ("d", "3"), ("e", "4"), ("f", "4"), (None, "4"), ("g", None)]
    edges = edges_of(spark, [(s, t, "has-value", i, None, None) for i, (s, t) in enumerate(carried)])
    pairs = lookup.shares_value_with(edges).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("other").alias("least"))
    got = sorted(map(tuple, lookup.shares_value_counts(edges).collect()))
    assert got == sorted(map(tuple, pairs.collect())) and len(got) == 5
    many = spark.range(300000).select(F.col("id").cast("string").alias("source"), F.lit("has-value").alias("relation"), F.lit("v").alias("target"))
    assert lookup.shares_value_counts(many).where("n = 299999").count() == 300000


def test_color_blocks(spark, monkeypatch):
    """Colours in several blocks and bands, outside L 0..100, equal, of equal ord, and without a component: as every
    pair tells. No candidate pair leaves the workers."""
    monkeypatch.setattr(color_pairs, "BLOCK", 40)
    rng, rows = random.Random(3), []
    for i in range(420):
        far = i % 40 == 0
        lab = [rng.choice([-30.0, -5.0, 104.0, 130.0]) if far else rng.uniform(0, 100), rng.uniform(-90, 90), rng.uniform(-110, 90)]
        rows.append((f"c{i}", i - i % 3, "s" if i % 4 else None, lab))
    rows += [("twin", 900, "s", rows[1][3]), ("nan", 901, "s", [50.0, float("nan"), 0.0]), ("part", 902, "s", [50.0, None, 0.0]), ("none", 903, "s", None), ("inf", 904, "s", [float("inf"), 0.0, 0.0])]
    values = spark.createDataFrame(rows, "id string, ord bigint, scope string, lab array<double>").withColumn("value_type", F.lit("color")).cache()
    near = similar.similar_pairs(values, "color", 14.0)
    assert "ArrowEvalPython" not in near._jdf.queryExecution().executedPlan().toString()
    every = [(r.a, r.b, r.scope, round(r.d, 9)) for r in similar.similar_pairs(values, "color", 14.0, blocked=False).collect()]
    assert sorted((r.a, r.b, r.scope, round(r.d, 9)) for r in near.collect()) == sorted(every) and len(every) > 300
    by = {}
    for a, b, scope, d in every:
        by.setdefault((a, scope), []).append((d, b))
        by.setdefault((b, scope), []).append((d, a))
    want = sorted((i, o, s, r + 1) for (i, s), others in by.items() for r, (_, o) in enumerate(sorted(others)[:3]))
    assert sorted((r.id, r.other, r.scope, r.rank) for r in similar.nearest_neighbours(values, "color", 3, 14.0).collect()) == want
