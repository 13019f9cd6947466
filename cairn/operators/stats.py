"""Counts for the build report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn import functions as fn

UNTYPED = "(none)"


def type_counts(nodes: DataFrame) -> DataFrame:
    """Entities of each graph per type, most first; blank and missing types count as ``(none)``."""
    kind = F.coalesce(F.nullif(fn.trim_all(F.col("type")), F.lit("")), F.lit(UNTYPED))
    return (
        nodes.groupBy("graph_id", kind.alias("type"))
        .agg(F.count("*").alias("count"))
        .orderBy("graph_id", F.desc("count"), "type")
    )


def build_stats(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """Source files and distinct entities of each graph."""
    scanned = files.groupBy("graph_id").agg(F.count("*").alias("files"))
    built = nodes.select("graph_id", "id").distinct().groupBy("graph_id").agg(F.count("*").alias("entities"))
    return scanned.join(built, "graph_id", "full").select(
        "graph_id", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("entities", F.lit(0)).alias("entities")
    )


def character_inventory(texts: DataFrame) -> DataFrame:
    """Occurrences of each character in the texts of each graph; line breaks count, pairs stay whole.

    A text gives a row per different character, with what taking that out
    shortens the text by.
    """
    different = texts.select("graph_id", "text", F.explode(F.array_distinct(F.split("text", ""))).alias("character"))
    times = F.length("text") - F.length(F.replace("text", "character", F.lit("")))
    return (
        different.filter("character <> ''")
        .groupBy("graph_id", "character")
        .agg(F.sum(times.cast("bigint")).alias("count"))
    )
