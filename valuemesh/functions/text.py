"""Text scores, labels and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from valuemesh.schema import CLASS_PRIORITY, edge_class, lookup

# The value type of each token category; categories left out have none.
VALUE_TYPE_OF = {
    "color": "color",
    "spacing": "dimension",
    "radius": "dimension",
    "fontSize": "dimension",
    "borderWidth": "dimension",
    "blur": "dimension",
    "letterSpacing": "dimension",
    "lineHeight": "ratio",
    "opacity": "ratio",
    "aspectRatio": "ratio",
    "duration": "duration",
    "fontFamily": "fontFamily",
    "fontWeight": "fontWeight",
    "shadow": "shadow",
    "gradient": "gradient",
}
EXACT, NORMALIZED, SUBSTRING = 1.0, 0.9, 0.6
LEAST_SUBSTRING = 3


def category_to_value_type(category: Column) -> Column:
    return lookup(VALUE_TYPE_OF, category, "other")


def raw_value_id(value_type: Column, key: Column) -> Column:
    return F.when(key.isNotNull(), F.concat(F.lit("value:"), value_type, F.lit(":"), key))


def normalize(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[\s\-_/]+", "")


def label_of(label: Column, node_id: Column) -> Column:
    return F.coalesce(label, F.element_at(F.split(node_id, ":"), -1))


def seed_score(label: Column, node_id: Column, term: str) -> Column:
    """1 for the same label or id, 0.9 once normalised, 0.6 if one holds the other, else 0."""
    wanted = "".join(c for c in term.lower() if not c.isspace() and c not in "-_/")
    own = normalize(label)
    holds = F.lit(len(wanted) >= LEAST_SUBSTRING) & (F.contains(own, F.lit(wanted)) | F.contains(F.lit(wanted), own))
    return F.when((label == term) | (node_id == term), EXACT).when(own == wanted, NORMALIZED).when(holds, SUBSTRING).otherwise(0.0)


def edge_relevance(relation: Column, weight: Column, hop: Column) -> Column:
    return lookup(CLASS_PRIORITY, edge_class(relation)) * F.coalesce(weight, F.lit(1.0)) / (hop + 1)
