"""Source adapters, and tables as a source."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valuemesh.functions.registry import canonicalize
from valuemesh.schema import EDGES, NODES, conform
from valuemesh.sources.css_theme import CssThemes
from valuemesh.sources.theme_json import ThemeJson


class Adapter(Protocol):
    name: str

    def detect(self, root: str) -> bool: ...

    def extract(self, spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]: ...


#: In order of precedence when their fragments are merged.
DEFAULT_ADAPTERS: list[Adapter] = [CssThemes(), ThemeJson()]


def run_adapters(spark: SparkSession, root: str, adapters: list[Adapter] | None = None) -> list[tuple[str, tuple[DataFrame, DataFrame]]]:
    """(name, fragment) of the adapters that apply to ``root``."""
    return [(a.name, a.extract(spark, root)) for a in (DEFAULT_ADAPTERS if adapters is None else adapters) if a.detect(root)]


def table_fragment(table: DataFrame, key: Column, label: Column, kind: str, raw: Column, value_type: str, scope: str | None, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows of a table as tokens (id token:<kind>:<key>) that carry the value which ``raw`` spells."""
    scoped = F.lit(scope).cast("string")
    flat = table.select(F.concat(F.lit(f"token:{kind}:"), key.cast("string")).alias("token"), label.alias("name"), key.cast("bigint").alias("ord"), raw.cast("string").alias("raw"), F.lit(value_type).alias("value_type"), scoped.alias("scope"))
    values = canonicalize(flat, keep=["token", "name", "ord", "raw"])
    tokens = values.select(F.col("token").alias("id"), "ord", F.lit("Token").alias("type"), F.col("name").alias("label"), F.lit("EXTRACTED").alias("confidence"), F.array(F.struct(F.lit(name).alias("adapter"), F.lit(None).cast("string").alias("file"), F.col("token").alias("loc"))).alias("sources"), F.lit(kind).alias("category"), F.when(F.col("id").isNull(), F.col("raw")).alias("unresolved_value"))
    found = values.where("id is not null")
    raws = found.drop("token", "name", "raw").withColumn("type", F.lit("RawValue")).withColumn("ord", F.col("ord") + (1 << 50))
    edges = found.select(F.col("token").alias("source"), F.lit("has-value").alias("relation"), F.col("id").alias("target"), "ord", F.lit("EXTRACTED").alias("confidence"))
    return conform(tokens, NODES).unionByName(conform(raws, NODES)), conform(edges, EDGES)
