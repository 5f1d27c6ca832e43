"""Scalar functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from valuemesh.functions import colors, composites, numbers, scalars, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def dim(spark, raw, scope="dim"):
    r = one(spark, scalars.parse_dimension(F.lit(raw), scope))
    return r and (r["key"], r["px"], r["base_assumed"])


def test_dimensions(spark):
    assert dim(spark, "1.25rem", "gap") == ("20px@gap", 20.0, True)
    assert dim(spark, " 7 ") == ("7px@dim", 7.0, None)
    assert dim(spark, "9pt") == ("12px@dim", 12.0, None)
    assert dim(spark, "35%", "w") == ("35%@w", 35.0, None)
    assert dim(spark, "-.25em") == ("-4px@dim", -4.0, True)
    for bad in ("calc(3px * 2)", "var(--gap)", "wide", "", "3 4", "em"):
        assert dim(spark, bad) is None


def test_ratios_and_durations(spark):
    ratio = lambda s: one(spark, scalars.parse_ratio(F.lit(s), "lead"))
    assert ratio("1.25")["key"] == "1.25@lead" and ratio("35%")["value"] == 0.35
    assert ratio("7/3")["value"] == 2.3333 and ratio("7/0") is None and ratio("wide") is None
    ms = lambda s: (one(spark, scalars.parse_duration(F.lit(s))) or {"key": None})["key"]
    assert [ms(s) for s in ("340ms", "0.34s", "75", "slow")] == ["340ms", "340ms", "75ms", None]


def test_fonts(spark):
    assert one(spark, scalars.font_family(F.lit("'Gentium Plus', serif"))) == "gentium plus"
    assert one(spark, scalars.font_family(F.lit(" , x"))) is None
    assert [one(spark, scalars.font_weight(F.lit(w))) for w in ("medium", " Black", "350", "stout")] == [500, 900, 350, None]


def test_numbers(spark):
    half = lambda x, p: one(spark, numbers.round_half_up(F.lit(x), p))
    assert half(-2.5, 0) == -2.0 and half(1.005, 2) == 1.0
    assert [one(spark, numbers.number_text(F.lit(x))) for x in (10.0, 13.75, 100.0, -0.0, 0.5)] == ["10", "13.75", "100", "0", "0.5"]
    assert one(spark, numbers.edit_distance(F.lit(""), F.lit(""))) == 0.0
    assert one(spark, numbers.relative_distance(F.lit(0.5), F.lit(0.55))) == pytest.approx(0.05)


COLORS = {
    "#2563eb": "37,99,235,255",
    "rgb(37, 99, 235)": "37,99,235,255",
    "rgb(37 99 235 / 50%)": "37,99,235,128",
    "oklch(54.616% 0.21529 262.896)": "37,99,235,255",
    "oklch(62.31% 0.1881 259.83)": "59,130,246,255",
    "oklch(0.6 0.2 30)": "222,62,45,255",
    "oklch(1 0 0)": "255,255,255,255",
    "#fff8": "255,255,255,136",
    "100": "17,0,0,255",
    "tomato": "255,99,71,255",
    "transparent": "0,0,0,0",
    "hsl(0 100% 50%)": "255,0,0,255",
    "hsla(120, 100%, 25%, 0.3)": "0,128,0,77",
    "hwb(240 0% 0%)": "0,0,255,255",
    "color(srgb 1 0.5 0)": "255,128,0,255",
    "lab(100 0 0)": "255,255,255,255",
    "rgba(0,0,0,.05)": "0,0,0,13",
}


def test_colors():
    for raw, key in COLORS.items():
        assert colors.parse_color(raw)["key"] == key, raw
    assert colors.parse_color("oklch(50.54% 0.19049 27.505 / 0.102)")["rgba"][3] == 26
    for bad in ("not-a-color", "", "rgb(1 2)", "#12345", "16px", None, "rgb(a b c)"):
        assert colors.parse_color(bad) is None
    assert colors.parse_color("#808080")["lab"][1:] == [0.0, 0.0]


def test_color_syntax(spark):
    yes, no = ["#2563eb", "oklch(0.5 0.2 260)", "tomato", "RED"], ["100", "0.5", "auto", "16px", ""]
    rows = spark.createDataFrame([(s,) for s in yes + no], "s string").select("s", colors.is_color_syntax(F.col("s")).alias("is")).collect()
    assert {r["s"] for r in rows if r["is"]} == set(yes)


#: Published pairs: Lab, Lab, CIEDE2000.
SHARMA = [
    ((50.0, 2.6772, -79.7751), (50.0, 0.0, -82.7485), 2.0425),
    ((50.0, 3.1571, -77.2803), (50.0, 0.0, -82.7485), 2.8615),
    ((50.0, 0.0, 0.0), (50.0, -1.0, 2.0), 2.3669),
    ((50.0, 2.49, -0.001), (50.0, -2.49, 0.0009), 7.1792),
    ((50.0, 2.5, 0.0), (73.0, 25.0, -18.0), 27.1492),
    ((60.2574, -34.0099, 36.2677), (60.4626, -34.1751, 39.4387), 1.2644),
    ((22.7233, 20.0904, -46.694), (23.0331, 14.973, -42.5619), 2.0373),
    ((90.8027, -2.0831, 1.441), (91.1528, -1.6435, 0.0447), 1.4441),
]


def test_delta_e(spark):
    rows = spark.createDataFrame([(list(a), list(b), d) for a, b, d in SHARMA], "a array<double>, b array<double>, d double")
    for r in rows.select("d", colors.delta_e(F.col("a"), F.col("b")).alias("x"), colors.delta_e(F.col("b"), F.col("a")).alias("y")).collect():
        assert r["x"] == pytest.approx(r["d"], abs=1e-4) and r["y"] == pytest.approx(r["x"], abs=1e-9)
    batch = colors.delta_e_of_pairs(rows.union(spark.createDataFrame([(None, [1.0, 0.0, 0.0], None), ([0.0, 0.0, 0.0], [0.0, 0.0, 0.0], 0.0)], rows.schema)), "a", "b", "x").collect()
    assert batch[-2]["x"] is None
    assert [r["x"] for r in batch if r["d"] is not None] == pytest.approx([r["d"] for r in batch if r["d"] is not None], abs=1e-4)
    light, dark = (colors.parse_color(c)["lab"] for c in ("oklch(54.616% 0.21529 262.896)", "oklch(62.31% 0.1881 259.83)"))
    assert 9 < one(spark, colors.delta_e(F.array(*map(F.lit, light)), F.array(*map(F.lit, dark)))) < 13


def test_hex_lab_equals_parser(spark):
    codes = ["2563eb", "000000", "ffffff", "808080", "010203", "f5f5f6"]
    rows = spark.createDataFrame([(c,) for c in codes], "c string").select("c", colors.hex_lab(F.col("c")).alias("lab")).collect()
    for r in rows:
        assert r["lab"] == pytest.approx(colors.parse_color("#" + r["c"])["lab"], abs=2e-3)


def test_composites():
    s = composites.parse_shadow("1px 3px 9px -2px rgb(9, 8, 7)")
    assert s["key"] == "1,3,9,-2,9,8,7,255" and len(s["layers"]) == 1 and [r["raw"] for r in s["refs"]] == ["rgb(9, 8, 7)"]
    two = composites.parse_shadow("2px 4px, inset #00f 1rem 0 0 0 3px lime")
    assert two["key"] == "2,4,0,0,|inset:16,0,0,0,0,255,0,255" and len(two["refs"]) == 2
    assert [v["inset"] for v in two["layers"]] == [False, True]
    for bad in ("none", "", "3px teal", "3px 4px wobbly", "3px 4px, 5px"):
        assert composites.parse_shadow(bad) is None, bad
    g = composites.parse_gradient("radial-gradient(circle at top, teal 5%, #123 10% 40%, 70%, lime)")
    assert g["key"] == "radial:0,128,128,255@5%,17,34,51,255@40%,0,255,0,255"
    assert g["kind"] == "radial" and g["stops"][0] == {"color": "0,128,128,255", "position": "5%"}
    assert composites.parse_gradient("teal") is None and composites.parse_gradient("conic-gradient(from 9deg)") is None
    t = composites.parse_typography("bold 1.5rem/120% Gentium Plus")
    assert t["key"] == "bold 1.5rem/120% gentium plus" and [r["value_type"] for r in t["refs"]] == ["fontFamily", "dimension", "fontWeight", "ratio"]
    assert composites.parse_typography("Gentium") is None and composites.parse_typography("1.5rem") is None


def test_references_and_calc():
    table = {"gap": "2rem", "near": "var(--gap)", "far": "var( --near )", "loop": "var(--pool)", "pool": "var(--loop)", "half": "calc(var(--gap) / 2)"}
    go = composites.resolve_vars
    assert go("var(--far) var(--gap)", table) == "2rem 2rem" and go("plain", table) == "plain"
    assert go("var(--no, 3px)", table) == "3px" and go("var(--no, var(--near))", table) == "2rem"
    for bad in ("var(--no)", "var(--loop)", "var(--loop, 1px)", "1px var(--gap) var(--no)"):
        assert go(bad, table) is None, bad
    chain = {f"n{i}": f"var(--n{i + 1})" for i in range(40)} | {"n40": "1px"}
    assert go("var(--n20)", chain) == "1px" and go("var(--n2)", chain) is None
    doubled = {f"d{i}": f"var(--d{i + 1}) var(--d{i + 1})" for i in range(12)} | {"d12": "x"}
    assert go("var(--d0)", doubled).count("x") == 1 << 12
    assert composites.resolve_value("var(--half)", table) == "16px"
    calc = composites.eval_calc
    assert calc("calc(1.5rem - 4px)") == "20px" and calc("calc(3 * (1px + 0.5em))") == "27px"
    assert calc("calc(9px / 2)") == "4.5px" and calc("7px") == "7px"
    for bad in ("calc(50% + 1px)", "calc(2rem-1px)", "calc(calc(2px) * 2)", "3px calc(3px)", "calc(3px *)", "calc()", "calc(1px / 0)"):
        assert calc(bad) is None, bad


def test_text(spark):
    assert one(spark, text.label_of(F.lit(None).cast("string"), F.lit("a:b:c"))) == "c"
    assert one(spark, text.category_to_value_type(F.lit("easing"))) == "other"
    assert one(spark, text.category_to_value_type(F.lit("blur"))) == "dimension"
    score = lambda label, term: one(spark, text.seed_score(F.lit(label), F.lit("t:x"), term))
    assert [score("primary", "primary"), score("Pri-mary", "primary"), score("primary", "mary"), score("primary", "ma"), score("--", "mary")] == [1.0, 0.9, 0.6, 0.0, 0.6]
    assert one(spark, text.edge_relevance(F.lit("similar-to"), F.lit(0.5), F.lit(1))) == pytest.approx(0.1)
