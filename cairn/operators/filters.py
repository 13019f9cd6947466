"""Selecting entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn import functions as fn
from cairn.model import DESCRIPTOR, entity_ids
from cairn.operators.edits import structural_ids
from cairn.operators.links import display_names


def find_entities(nodes: DataFrame, props: DataFrame, type: str = "", text: str = "") -> DataFrame:
    """Entities of a type whose name or id contains a text, by display name.

    Case does not matter; blank filters let everything pass.
    """
    chosen = nodes.filter(F.col("id") != DESCRIPTOR)
    if type:
        chosen = chosen.filter(F.col("type") == type)
    named = display_names(chosen, props)
    wanted = text.strip().lower()
    if wanted:
        named = named.filter(F.lower(F.concat_ws(" ", "display_name", "id")).contains(wanted))
    return named.orderBy("display_name", "graph_id", "id")


def is_structural(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """``structural`` = 1 for root, descriptor, files and folders, else 0."""
    fixed = structural_ids(nodes, roots).withColumn("structural", F.lit(1))
    return (
        entity_ids(nodes)
        .join(fixed, ["graph_id", "id"], "left")
        .withColumn("structural", F.coalesce("structural", F.lit(0)))
    )


def distinct_types(nodes: DataFrame) -> DataFrame:
    """Types in use in each graph, sorted; the descriptor's do not count."""
    kind = fn.trim_all(F.col("type"))
    return (
        nodes.filter(F.col("id") != DESCRIPTOR)
        .select("graph_id", kind.alias("type"))
        .filter("type <> ''")
        .distinct()
        .orderBy("graph_id", "type")
    )
