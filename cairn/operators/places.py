"""Resolving place names against a gazetteer table.

``gazetteer`` is (provider, priority, name, region, latitude, longitude) with
priority 0 for manual records, 1 for the primary service and 2 for the
secondary one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn import functions as fn
from cairn.model import fact, node_rows, prop_rows

HEAD = 3  # characters by which names meet those that are asked for
_CANDIDATE = ["matched_name", "provider", "match_region", "latitude", "longitude"]


def gazetteer_index(gazetteer: DataFrame, asked: DataFrame, region: str | None = None) -> DataFrame:
    """The best record per asked key, so a lookup joins one row per key.

    Steps: 0 manual, 1 primary exact, 2 primary prefix, 3 secondary. The
    beginnings of a primary name are prefix keys, but only those as long as a
    key that is asked for (``asked``: key) and begins with the same ``HEAD``
    characters. Keys that nobody asks for are dropped before the records behind
    a key are compared.
    """
    key = F.lower(fn.trim_all(F.col("name")))
    hit = F.coalesce(F.col("region") == region, F.lit(False)) if region else F.lit(False)
    candidate = F.struct(
        (~hit).alias("off_region"),
        F.col("name").alias("matched_name"),
        "provider",
        F.col("region").alias("match_region"),
        "latitude",
        "longitude",
    )
    rows = gazetteer.select(key.alias("key"), "priority", candidate.alias("candidate")).filter("key <> ''")
    exact = rows.select(
        "key",
        F.when(F.col("priority") == 0, 0).when(F.col("priority") == 1, 1).otherwise(3).alias("step"),
        "candidate",
    )
    wanted = asked.distinct()
    lengths = wanted.groupBy(F.substring("key", 1, HEAD).alias("head")).agg(F.collect_set(F.length("key")).alias("lengths"))
    heads = F.array_distinct(F.array(*[F.substring("key", 1, n) for n in range(1, HEAD + 1)]))
    prefix = (
        rows.filter("priority = 1 AND length(key) > 1")
        .select(F.explode(heads).alias("head"), "key", "candidate")
        .join(lengths, "head")
        .select(F.explode(F.filter("lengths", lambda n: n < F.length("key"))).alias("n"), "key", "candidate")
        .select(F.expr("substr(key, 1, n)").alias("key"), F.lit(2).alias("step"), "candidate")
    )
    return (
        exact.unionByName(prefix)
        .join(wanted, "key", "left_semi")
        .groupBy("key")
        .agg(F.min(F.struct("step", "candidate")).alias("best"))
    )


def lookup_places(names: DataFrame, gazetteer: DataFrame, region: str | None = None) -> DataFrame:
    """One row per resolved (graph_id, name): record, provider and coordinates.

    Over all spellings of a name the earliest step wins, then the better
    spelling, then a record in ``region``, then the record's name.
    """
    spelled = (
        names.select("graph_id", "name")
        .distinct()
        .select("graph_id", "name", F.posexplode(fn.place_variants(F.col("name"))).alias("spelling", "variant"))
        .select("graph_id", "name", "spelling", F.lower("variant").alias("key"))
    )
    found = spelled.join(gazetteer_index(gazetteer, spelled.select("key"), region), "key")
    pick = F.min(F.struct("best.step", "spelling", "best.candidate")).alias("won")
    return (
        found.groupBy("graph_id", "name")
        .agg(pick)
        .select("graph_id", "name", "won.step", *[f"won.candidate.{c}" for c in _CANDIDATE])
    )


def attach_geometry(places: DataFrame, matches: DataFrame) -> dict[str, DataFrame]:
    """Geometry entities for places (graph_id, id, name) that were resolved."""
    found = places.join(matches, ["graph_id", "name"]).withColumn(
        "geo_id", F.concat(F.lit("#location-"), fn.slugify(F.col("name")))
    )
    lat, lon = F.col("latitude"), F.col("longitude")
    shapes = found.groupBy("graph_id", "geo_id").agg(
        F.min(F.struct("latitude", "longitude")).alias("at")
    ).select("graph_id", "geo_id", "at.latitude", "at.longitude")
    links = prop_rows(found, F.col("id"), [fact("geo", ref=F.col("geo_id"))])
    described = prop_rows(
        shapes,
        F.col("geo_id"),
        [
            fact(".latitude", fn.number_text(lat)),
            fact(".longitude", fn.number_text(lon)),
            fact("asWKT", fn.wkt_point(lat, lon)),
        ],
    )
    return {
        "nodes": node_rows(shapes, F.col("geo_id"), "Geometry"),
        "props": links.unionByName(described),
        "enriched": found.select("graph_id", "id"),
    }
