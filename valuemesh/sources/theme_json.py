"""Resolved themes as nested JSON: sections of named values.

Configuration files are programs of the project; they are found but never run. The resolved theme is
read from JSON beside them.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuemesh.functions.registry import canonicalize
from valuemesh.functions.text import category_to_value_type
from valuemesh.schema import EDGES, NODES, conform

NAME = "tailwind-config"
# Configuration files in order of precedence, and the categories of theme sections.
CONFIGS = ["tailwind.config.js", "tailwind.config.cjs", "tailwind.config.mjs", "tailwind.config.ts"]
SECTIONS = {
    "colors": "color",
    "spacing": "spacing",
    "fontSize": "fontSize",
    "fontFamily": "fontFamily",
    "fontWeight": "fontWeight",
    "lineHeight": "lineHeight",
    "letterSpacing": "letterSpacing",
    "borderRadius": "radius",
    "borderWidth": "borderWidth",
    "blur": "blur",
    "opacity": "opacity",
    "aspectRatio": "aspectRatio",
    "transitionDuration": "duration",
    "transitionTimingFunction": "easing",
    "boxShadow": "shadow",
    "zIndex": "z",
}
RESOLVED = "theme.resolved.json"


def find_config(root: str) -> str | None:
    return next((os.path.join(root, n) for n in CONFIGS if os.path.isfile(os.path.join(root, n))), None)


def leaves(section: dict) -> Iterator[tuple[str, object]]:
    """(dash-joined name, value) of a nested section; a DEFAULT key stands for its parent."""
    todo = [((), section)]
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict):
            todo += [((path if k == "DEFAULT" else (*path, k)), v) for k, v in reversed(value.items())]
        else:
            yield "-".join(path) or "DEFAULT", value


def leaf_text(value: object, category: str) -> str | None:
    """A string or number as text; of an array a whole font stack, else its first string."""
    if isinstance(value, str):
        return value
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return str(int(value)) if float(value).is_integer() else repr(value)
    if isinstance(value, list):
        if category == "fontFamily":
            return ", ".join("" if v is None else str(v) for v in value)
        return value[0] if value and isinstance(value[0], str) else None
    return None


def walk_themes(themes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The fragment (nodes, edges) of themes (file string, theme string of JSON)."""

    def run(batches):
        for batch in batches:
            rows = []
            for file, text in zip(batch["file"], batch["theme"]):
                theme, i = json.loads(text), 0
                for section, category in SECTIONS.items():
                    part = theme.get(section)
                    for name, value in leaves(part) if isinstance(part, dict) else ():
                        raw = leaf_text(value, category)
                        if raw is not None:
                            rows.append((file, section, category, name, raw, i))
                            i += 1
            yield pd.DataFrame(rows, columns=["file", "section", "category", "name", "raw", "ord"])

    flat = themes.select("file", "theme").mapInPandas(run, "file string, section string, category string, name string, raw string, ord bigint")
    flat = flat.withColumn("token", F.concat_ws(":", F.lit("token"), "category", "name"))
    typed = flat.withColumn("value_type", category_to_value_type(F.col("category"))).withColumn("scope", F.col("category"))
    values = canonicalize(typed, keep=["file", "section", "category", "name", "raw", "ord", "token"])
    last = values.groupBy("file", "token").agg(F.max("ord").alias("ord"), F.min("ord").alias("first"))
    tokens = values.join(last, ["file", "token", "ord"]).select(
        F.col("token").alias("id"), F.col("first").alias("ord"), F.lit("Token").alias("type"), F.col("name").alias("label"), F.lit("EXTRACTED").alias("confidence"),
        F.array(F.struct(F.lit(NAME).alias("adapter"), "file", F.concat_ws(".", F.lit("theme"), "section", "name").alias("loc"))).alias("sources"),
        "category", F.lit("primitive").alias("tier"), F.col("section").alias("namespace"), F.col("name").alias("utility"), F.when(F.col("id").isNull(), F.col("raw")).alias("unresolved_value"),
    )
    found = values.where("id is not null")
    raws = found.drop("file", "section", "category", "name", "raw", "token").withColumn("type", F.lit("RawValue")).withColumn("ord", F.col("ord") + (1 << 50))
    edges = found.select(F.col("token").alias("source"), F.lit("has-value").alias("relation"), F.col("id").alias("target"), "ord", F.lit("EXTRACTED").alias("confidence"))
    return conform(tokens, NODES).unionByName(conform(raws, NODES)), conform(edges, EDGES)


class ThemeJson:
    """Source adapter: fires where a configuration file is; reads the resolved theme beside it, if any."""

    name = NAME

    def detect(self, root: str) -> bool:
        return find_config(root) is not None

    def extract(self, spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
        path, rows = os.path.join(root, RESOLVED), []
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as f:
                rows = [(os.path.basename(find_config(root) or RESOLVED), f.read())]
        return walk_themes(spark.createDataFrame(rows, "file string, theme string"))
