"""CSS and theme sources, the build, and the stream of changed files."""

import json

from valuemesh.operators import lookup, merge
from valuemesh.plans.build import build
from valuemesh.sources import adapters, css_theme, theme_json
from valuemesh.streaming import incremental

CSS = """/* :root { --hidden: 1px } */
:root {
  --paper: #102030;
  --ink: rgb(1, 2, 3);
  --line: #abcdef;
  --edge: #ABCDEF;
  --radius: 1rem;
  --menu-tone: #0a0b0c;
}
.dark { --paper: #405060; --ink: #ffffff }
@theme inline {
  --color-paper: var(--paper);
  --color-ink: var(--ink);
  --color-line: var(--line);
  --color-edge: var(--edge);
  --radius-tight: calc(var(--radius) - 5px);
  --radius-wide: var(--radius);
  --text-note: 11.5px;
  --mark-flash: #ff0080;
  --pace-slow: 7;
}
"""
THEME = {
    "colors": {"sea": {"light": "#00ffff", "deep": {"DEFAULT": "#000080", "far": "#000040"}}, "sun": "#ffff00"},
    "spacing": {"half": "2rem"},
    "fontSize": {"note": ["0.75rem", {"lineHeight": "1rem"}]},
    "fontFamily": {"text": ["Gentium", "serif"]},
    "boxShadow": {"lift": "0 3px 5px #01020380"},
    "zIndex": {"top": 40},
    "screens": {"wide": "90rem"},
}


def project(tmp_path):
    (tmp_path / "app").mkdir()
    (tmp_path / "app" / "_vars.css").write_text(CSS)
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.css").write_text(CSS)
    (tmp_path / "plain.css").write_text("p { margin: 0 }")
    return str(tmp_path)


def carried(edges):
    out = {}
    for e in edges.where("relation = 'has-value'").collect():
        out.setdefault(e.source, {})[e.mode] = e.target
    return out


def test_css(spark, tmp_path):
    root = project(tmp_path)
    assert [a.detect(root) for a in adapters.DEFAULT_ADAPTERS] == [True, False]
    nodes, edges = css_theme.CssThemes().extract(spark, root)
    t = {r.id: r for r in nodes.where("type = 'Token'").collect()}
    has = carried(edges)
    # an alias of a variable of two modes carries one value a mode, and hides the variable's own token
    assert has["token:color:paper"] == {"light": "value:color:16,32,48,255", "dark": "value:color:64,80,96,255"}
    assert has["token:color:ink"] == {"light": "value:color:1,2,3,255", "dark": "value:color:255,255,255,255"}
    paper = t["token:color:paper"]
    assert (paper.tier, paper.namespace, paper.utility) == ("semantic", "color", "paper")
    assert (paper.sources[0].file, paper.sources[0].loc) == ("app/_vars.css", "--color-paper")
    # one spelling of a colour or another is one value; 1rem is 16px
    assert has["token:color:line"] == has["token:color:edge"] == {"light": "value:color:171,205,239,255"}
    assert has["token:radius:wide"] == {"light": "value:dimension:16px@radius"} and "token:radius:radius" not in t
    assert has["token:radius:tight"] == {None: "value:dimension:11px@radius"} and has["token:fontSize:note"] == {None: "value:dimension:11.5px@fontSize"}
    # a variable that no theme entry names is a primitive; unknown namespaces get a category from their value
    assert t["token:color:menu-tone"].tier == "primitive"
    flash = t["token:color:flash"]
    assert (flash.uncategorized_namespace, flash.category_inferred, flash.confidence) == ("mark", True, "INFERRED")
    assert t["token:other:slow"].unresolved_value == "7" and "token:other:slow" not in has
    assert merge.dangling_edges(*merge.merge_fragments([(nodes, edges)])).count() == 0


def test_theme(spark):
    nodes, edges = theme_json.walk_themes(spark.createDataFrame([("c.js", json.dumps(THEME))], "file string, theme string"))
    t = {r.id: r for r in nodes.where("type = 'Token'").collect()}
    has = {k: v[None] for k, v in carried(edges).items()}
    # nested names are joined by dashes, a DEFAULT stands for its parent, sections without a category go
    assert set(t) == {"token:color:sea-light", "token:color:sea-deep", "token:color:sea-deep-far", "token:color:sun", "token:spacing:half", "token:fontSize:note", "token:fontFamily:text", "token:shadow:lift", "token:z:top"}
    assert has["token:color:sea-deep"] == "value:color:0,0,128,255" and has["token:spacing:half"] == "value:dimension:32px@spacing"
    assert has["token:fontSize:note"] == "value:dimension:12px@fontSize" and has["token:fontFamily:text"] == "value:fontFamily:gentium"
    assert has["token:shadow:lift"] == "value:shadow:0,3,5,0,1,2,3,128" and t["token:z:top"].unresolved_value == "40"


def test_build(spark, tmp_path):
    root = project(tmp_path)
    (tmp_path / "tailwind.config.cjs").write_text("never run")
    (tmp_path / theme_json.RESOLVED).write_text(json.dumps(THEME))
    g = build(spark, root, out=str(tmp_path / "out"))
    assert g.activated == ["tailwind-v4", "tailwind-config"]
    s = lookup.build_summary(g.nodes, g.edges).first()
    assert (s.dangling, s.unresolved_tokens) == (0, 2) and s.similar > 0
    assert g.edges.where("relation = 'composed-of'").count() == 1
    assert adapters.run_adapters(spark, str(tmp_path / "none")) == []


def test_declarations_nest():
    got = list(css_theme.declarations(".a .darker { --x: 1px; b { --y: url(a;b) } } @media x { :root, y { --z: \"}\" !important } } @theme { --q: 1; @keyframes k { to { --r: 2 } } }"))
    assert got == [("dark", "x", "1px"), ("dark", "y", "url(a;b)"), ("light", "z", '"}"'), ("theme", "q", "1"), ("theme", "r", "2")]


def test_stream_replaces_files(spark, tmp_path):
    feed, table = tmp_path / "feed", str(tmp_path / "table")
    feed.mkdir()

    def send(n, rows):
        (feed / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("root", "path", "file", "ord", "content"), r))) for r in rows))
        files = spark.readStream.schema(css_theme.FILES).json(str(feed))
        incremental.follow(spark, files, table, str(tmp_path / "ck")).awaitTermination()

    send(1, [("r", "a.css", "a.css", 0, ":root { --gap: 4px }"), ("r", "b.css", "b.css", 1, ":root { --radius: 8px }")])
    send(2, [("r", "a.css", "a.css", 0, ":root { --gap: 6px; --tone: red }")])
    nodes, _ = incremental.fragment(spark, table)
    assert {r.id for r in nodes.collect()} == {"token:spacing:gap", "token:radius:radius", "token:color:tone", "value:dimension:6px@spacing", "value:dimension:8px@radius", "value:color:255,0,0,255"}
