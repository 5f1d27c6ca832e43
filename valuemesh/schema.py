"""Vocabularies and Spark schemas of the value graph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAPH_VERSION = 1

# The closed vocabularies of the graph.
NODE_TYPES = ["Token", "RawValue", "Component", "Instance", "Screen", "Asset"]
TOKEN_CATEGORIES = ["color", "spacing", "fontSize", "fontFamily", "fontWeight", "lineHeight", "letterSpacing", "radius", "borderWidth", "blur", "opacity", "aspectRatio", "duration", "easing", "shadow", "gradient", "z", "other"]
TOKEN_TIERS = ["primitive", "semantic", "alias"]
VALUE_TYPES = ["color", "dimension", "ratio", "duration", "fontFamily", "fontWeight", "shadow", "gradient", "typography", "other"]
CONFIDENCE = ["EXTRACTED", "INFERRED", "AMBIGUOUS"]
SIDES = ["code", "figma"]
MODES = ["light", "dark"]
EDGE_CLASS = {
    "has-value": "structural",
    "aliases": "structural",
    "uses-token": "structural",
    "composed-of": "structural",
    "instance-of": "structural",
    "renders-on": "structural",
    "maps-to": "bridge",
    "similar-to": "similarity",
    "commonly-used-with": "convention",
}
CLASS_PRIORITY = {"bridge": 1.0, "structural": 0.8, "convention": 0.6, "similarity": 0.4}

REF = "struct<value_type:string,raw:string,scope:string>"
LAYER = "struct<inset:boolean,offset_x:double,offset_y:double,blur:double,spread:double,color:string>"
STOP = "struct<color:string,position:string>"
SOURCE = "struct<adapter:string,file:string,loc:string>"

#: Columns that a RawValue carries, as one unit: the first fragment's win together.
PAYLOAD = {
    "value_type": "string",
    "scope": "string",
    "rgba": "array<int>",
    "lab": "array<double>",
    "oklch": "array<double>",
    "px": "double",
    "base_assumed": "boolean",
    "ratio": "double",
    "ms": "double",
    "family": "string",
    "font_weight": "bigint",
    "kind": "string",
    "layers": f"array<{LAYER}>",
    "stops": f"array<{STOP}>",
    "refs": f"array<{REF}>",
}
#: Columns of a Token: each the last fragment's value that has one.
TOKEN = {
    "category": "string",
    "tier": "string",
    "namespace": "string",
    "utility": "string",
    "unresolved_value": "string",
    "uncategorized_namespace": "string",
    "category_inferred": "boolean",
}
NODES = {"id": "string", "ord": "bigint", "type": "string", "label": "string", "confidence": "string", "sources": f"array<{SOURCE}>", **PAYLOAD, **TOKEN, "props": "map<string,string>"}
EDGES = {"source": "string", "relation": "string", "target": "string", "ord": "bigint", "weight": "double", "confidence": "string", "mode": "string", "modes": "array<string>", "distance": "double", "delta_e": "double"}


def ddl(columns: dict[str, str]) -> T.StructType:
    return T.StructType.fromDDL(", ".join(f"`{k}` {v}" for k, v in columns.items()))


def conform(df, columns: dict[str, str]):
    """``df`` with exactly these columns: absent ones null, all cast."""
    have = set(df.columns)
    return df.select(*[(F.col(k) if k in have else F.lit(None)).cast(v).alias(k) for k, v in columns.items()])


def lookup(table: dict, key: Column, default=None) -> Column:
    """A literal map's value for ``key``."""
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.try_element_at(m, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def edge_class(relation: Column) -> Column:
    return lookup(EDGE_CLASS, relation, "unknown")
