"""CSS custom properties and theme blocks as tokens and values.

Files are parsed one by one in Python; from the declarations on everything is joins and aggregates by
``root``, so many projects go through one plan.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valuemesh.functions.colors import is_color_syntax
from valuemesh.functions.composites import resolve_udf
from valuemesh.functions.numbers import picked
from valuemesh.functions.registry import canonicalize
from valuemesh.functions.text import category_to_value_type
from valuemesh.lineage import cut
from valuemesh.schema import EDGES, NODES, conform

NAME = "tailwind-v4"
FILES = "root string, path string, file string, ord bigint, content string"
DECLARATIONS = "root string, file string, block string, name string, value string, ord bigint"

# Theme namespaces in the order in which they are tried, folders left out, signals.
NAMESPACES = [
    ("color", "color"),
    ("text", "fontSize"),
    ("font-weight", "fontWeight"),
    ("font", "fontFamily"),
    ("leading", "lineHeight"),
    ("tracking", "letterSpacing"),
    ("spacing", "spacing"),
    ("radius", "radius"),
    ("inset-shadow", "shadow"),
    ("drop-shadow", "shadow"),
    ("shadow", "shadow"),
    ("blur", "blur"),
    ("aspect", "aspectRatio"),
    ("ease", "easing"),
    ("z-index", "z"),
]
SKIPPED = frozenset({"node_modules", ".next", ".git", "dist", ".turbo", "valuemesh-out"})
THEME_SIGNAL, ROOT_SIGNAL = re.compile(r"@theme\b"), re.compile(r":root[^{]*\{[^}]*--", re.S)
HINTS = [("radius", "radius"), ("shadow", "shadow"), ("font|family", "fontFamily"), ("text|size|leading", "fontSize")]
ALIAS = r"^var\(\s*--([\w-]+)\s*\)$"


def find_css(root: str, skipped: frozenset[str] = SKIPPED) -> list[str]:
    """The file that components.json names, else every CSS file below with a theme or root variables, but
    in ``skipped`` folders."""
    try:
        with open(os.path.join(root, "components.json"), encoding="utf-8") as f:
            css = json.load(f)["tailwind"]["css"]
        path = os.path.abspath(os.path.join(root, css))
        if css and os.path.isfile(path):
            return [path]
    except (OSError, ValueError, KeyError, TypeError):
        pass
    found = []
    for at, folders, files in os.walk(root):
        folders[:] = sorted(d for d in folders if d not in skipped)
        for name in sorted(files):
            path = os.path.join(at, name)
            if name.endswith(".css"):
                with open(path, encoding="utf-8") as f:
                    text = f.read()
                if THEME_SIGNAL.search(text) or ROOT_SIGNAL.search(text):
                    found.append(os.path.abspath(path))
    return found


def read_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """FILES rows of local projects. (Spark's own listing would leave out names that begin with _ or a dot.)"""
    rows = []
    for root in roots:
        for i, path in enumerate(find_css(root)):
            with open(path, encoding="utf-8") as f:
                rows.append((root, path, os.path.relpath(path, os.path.abspath(root)), i, f.read()))
    return spark.createDataFrame(rows, FILES)


def _mode(prelude: str) -> str | None:
    parts = [p.strip() for p in prelude.split(",")]
    return "light" if ":root" in parts else "dark" if any(".dark" in p for p in parts) else None


def declarations(css: str) -> Iterator[tuple[str, str, str]]:
    """(block, name, value) of custom properties: rules of light or dark mode first, then theme blocks.

    A declaration counts once for each enclosing rule that has a mode, and for each theme block.
    """
    stack: list[str] = []
    text, quote, depth, i = "", "", 0, 0
    rules, themes = [], []

    def declare() -> None:
        name, colon, value = text.strip().partition(":")
        if colon and name.strip().startswith("--"):
            entry = (name.strip()[2:], re.sub(r"\s*!\s*important\s*$", "", value.strip()))
            for p in stack:
                if not p.startswith("@") and (mode := _mode(p)):
                    rules.append((mode, *entry))
                elif re.match(r"@theme\b", p):
                    themes.append(("theme", *entry))

    while i < len(css):
        c = css[i]
        if quote:
            text += c
            if c == "\\" and i + 1 < len(css):
                i += 1
                text += css[i]
            elif c == quote:
                quote = ""
        elif css.startswith("/*", i):
            end = css.find("*/", i + 2)
            i = (len(css) if end < 0 else end + 2) - 1
        elif c in "\"'":
            quote = c
            text += c
        elif c in "()":
            depth = max(0, depth + (1 if c == "(" else -1))
            text += c
        elif depth and c not in "{}":
            text += c
        elif c == "{":
            stack.append(text.strip())
            text, depth = "", 0
        elif c == "}":
            declare()
            if stack:
                stack.pop()
            text, depth = "", 0
        elif c == ";":
            declare()
            text = ""
        else:
            text += c
        i += 1
    yield from rules
    yield from themes


def parse_files(files: DataFrame) -> DataFrame:
    """DECLARATIONS of FILES."""

    def run(batches):
        for batch in batches:
            rows = []
            for f in batch.itertuples():
                rows += [(f.root, f.file, block, name, value, (f.ord << 24) + i) for i, (block, name, value) in enumerate(declarations(f.content))]
            yield pd.DataFrame(rows, columns=["root", "file", "block", "name", "value", "ord"])

    return files.mapInPandas(run, DECLARATIONS)


def split_namespace(name: Column) -> tuple[Column, Column, Column]:
    """(namespace, category, rest): the first namespace of the list that fits, else the part before a dash."""
    dash = F.instr(name, "-")
    namespace, category, rest = F.when(dash > 0, F.left(name, dash - 1)).otherwise(name), F.lit(None).cast("string"), F.when(dash > 0, F.substr(name, dash + 1)).otherwise(name)
    for ns, cat in reversed(NAMESPACES):
        whole, begins = name == ns, F.startswith(name, F.lit(f"{ns}-"))
        namespace = F.when(whole | begins, ns).otherwise(namespace)
        category = F.when(whole | begins, cat).otherwise(category)
        rest = F.when(whole, ns).when(begins, F.substr(name, F.lit(len(ns) + 2))).otherwise(rest)
    return namespace, category, rest


def infer_category(resolved: Column, name: Column) -> Column:
    """A category from a colour, the name, or a unit; null where nothing tells."""
    out = F.when(is_color_syntax(resolved), "color")
    for pattern, category in HINTS:
        out = out.when(F.regexp_like(name, F.lit(pattern)), category)
    return out.when(F.regexp_like(resolved, F.lit(r"\d\s*(?:ms|s)(?![a-z])")), "duration").when(F.regexp_like(resolved, F.lit(r"\d\s*(?:px|rem|em|%)")), "spacing")


def tokens_and_values(decls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The fragment (nodes, edges) of DECLARATIONS; ids are per root's own graph, ``root`` is kept in props."""
    raw = decls.where("block <> 'theme'").groupBy("root", "name").agg(
        F.max_by("value", F.when(F.col("block") == "light", F.col("ord"))).alias("light"),
        F.max_by("value", F.when(F.col("block") == "dark", F.col("ord"))).alias("dark"),
        F.min_by("file", "ord").alias("file"),
        F.min("ord").alias("ord"),
    )
    theme = decls.where("block = 'theme'").select("root", "name", "value", "file", "ord")
    known = raw.select("root", "name", F.coalesce("light", "dark").alias("value"), F.lit(0).cast("bigint").alias("o")).union(theme.select("root", "name", "value", F.col("ord") + 1))
    last = known.groupBy("root", "name").agg(F.max_by("value", "o").alias("value"))
    table = last.groupBy("root").agg(F.collect_list(F.struct("name", "value")).alias("t")).select("root", F.col("t.name").alias("names"), F.col("t.value").alias("texts"))

    alias = theme.withColumn("alias", picked(F.col("value"), ALIAS, 1))
    backing = raw.select("root", F.col("name").alias("alias"), "light", "dark", F.lit(True).alias("backed"))
    semantic = alias.join(backing, ["root", "alias"], "left").join(table, "root", "left")
    ns, cat, rest = split_namespace(F.col("name"))
    whole = F.coalesce(resolve_udf("value", "names", "texts"), F.col("value"))
    semantic = semantic.withColumn("whole", whole).withColumns({"namespace": ns, "declared": cat, "utility": rest})
    semantic = semantic.select(
        "root", "file", "ord", "names", "texts", "name", "utility", F.col("utility").alias("label"), "namespace",
        F.coalesce("declared", infer_category(F.col("whole"), F.col("name")), F.lit("other")).alias("category"),
        F.lit("semantic").alias("tier"),
        F.col("declared").isNull().alias("inferred"),
        F.when(F.col("backed"), F.array(F.struct(F.lit("light").alias("mode"), F.col("light").alias("v")), F.struct(F.lit("dark").alias("mode"), F.col("dark").alias("v")))).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("mode"), F.col("value").alias("v")))).alias("given"),
    )
    consumed = alias.where("alias is not null").select("root", F.col("alias").alias("name")).distinct()
    primitive = raw.join(consumed, ["root", "name"], "left_anti").join(table, "root", "left")
    primitive = primitive.withColumn("whole", F.coalesce(resolve_udf(F.coalesce("light", "dark"), F.col("names"), F.col("texts")), F.col("light"), F.col("dark")))
    nothing = F.lit(None).cast("string")
    primitive = primitive.select(
        "root", "file", (F.col("ord") + (1 << 48)).alias("ord"), "names", "texts", "name", nothing.alias("utility"), F.col("name").alias("label"), nothing.alias("namespace"),
        F.coalesce(infer_category(F.col("whole"), F.col("name")), F.lit("other")).alias("category"),
        F.lit("primitive").alias("tier"),
        F.lit(False).alias("inferred"),
        F.array(F.struct(F.lit("light").alias("mode"), F.col("light").alias("v")), F.struct(F.lit("dark").alias("mode"), F.col("dark").alias("v"))).alias("given"),
    )
    tokens = semantic.unionByName(primitive).withColumn("token", F.concat_ws(":", F.lit("token"), "category", "label"))
    tokens = cut(tokens)
    each = tokens.select("root", "token", "ord", "category", "names", "texts", F.posexplode("given").alias("pos", "g")).where("g.v is not null")
    each = each.select("root", "token", "ord", "pos", "category", F.col("g.mode").alias("mode"), F.col("g.v").alias("given"), resolve_udf(F.col("g.v"), F.col("names"), F.col("texts")).alias("raw"), category_to_value_type(F.col("category")).alias("value_type"), F.col("category").alias("scope"))
    values = canonicalize(each, keep=["root", "token", "ord", "pos", "mode", "given"])
    return _fragment(tokens, cut(values))  # parsed once for nodes, edges and failures


def _fragment(tokens: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    failed = values.where("id is null").groupBy("root", "token", "ord").agg(F.max_by("given", "pos").alias("unresolved_value"))
    source = F.array(F.struct(F.lit(NAME).alias("adapter"), F.col("file"), F.concat(F.lit("--"), F.col("name")).alias("loc")))
    # a token declared twice is the last declaration, at the place of the first
    keep = tokens.groupBy("root", "token").agg(F.max("ord").alias("ord"), F.min("ord").alias("first"))
    rows = tokens.join(keep, ["root", "token", "ord"]).join(failed, ["root", "token", "ord"], "left")
    nodes = rows.select(
        F.col("token").alias("id"), F.col("first").alias("ord"), F.lit("Token").alias("type"), "label",
        F.when(F.col("inferred"), "INFERRED").otherwise("EXTRACTED").alias("confidence"),
        source.alias("sources"), "category", "tier", "namespace", "utility", "unresolved_value",
        F.when(F.col("inferred"), F.col("namespace")).alias("uncategorized_namespace"),
        F.when(F.col("inferred"), True).alias("category_inferred"),
        F.create_map(F.lit("root"), F.col("root")).alias("props"),
    )
    found = values.where("id is not null")
    at = F.col("ord") * 2 + F.col("pos")
    raws = found.withColumn("type", F.lit("RawValue")).withColumn("ord", at + (1 << 50)).drop("root", "token", "pos", "mode", "given")
    edges = found.select(F.col("token").alias("source"), F.lit("has-value").alias("relation"), F.col("id").alias("target"), at.alias("ord"), F.lit("EXTRACTED").alias("confidence"), "mode")
    return conform(nodes, NODES).unionByName(conform(raws, NODES)), conform(edges, EDGES)


class CssThemes:
    """Source adapter over local project folders."""

    name = NAME

    def detect(self, root: str) -> bool:
        return bool(find_css(root))

    def extract(self, spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
        return tokens_and_values(parse_files(read_files(spark, [root])))
