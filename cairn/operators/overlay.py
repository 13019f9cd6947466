"""Laying one graph over another.

A property is replaced as a whole: the key of every overlay is
(graph, entity, property), and the side that yields is an anti join against
the distinct keys of the side that wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.model import LOCAL_ROOT, PROP_COLS, entity_ids

KEY = ["graph_id", "id", "prop"]
MEMBER = "pcdm:hasMember"

# Root properties that the profile or the file scan decides.
_NOT_SEEDED = ["@type", "conformsTo", "hasMember", "pcdm:hasMember"]


def replace_values(target: DataFrame, source: DataFrame) -> DataFrame:
    """``source`` wins on every property it states; the rest survives."""
    stated = source.select(*KEY).distinct()
    return target.join(stated, KEY, "left_anti").unionByName(source.select(*target.columns))


def fill_gaps(target: DataFrame, source: DataFrame) -> DataFrame:
    return replace_values(source.select(*target.columns), target)


def merge_graphs(target: DataFrame, source: DataFrame, source_roots: DataFrame) -> DataFrame:
    """Property rows of the merged graph; what the source says of its own root is not merged."""
    own = source_roots.select("graph_id", F.col("root_id").alias("id"))
    return replace_values(target, source.join(own, ["graph_id", "id"], "left_anti"))


def merge_nodes(target: DataFrame, source: DataFrame, source_roots: DataFrame) -> DataFrame:
    """Entities the target lacks come with all their types; known ones keep theirs."""
    own = source_roots.select("graph_id", F.col("root_id").alias("id"))
    fresh = source.join(own, ["graph_id", "id"], "left_anti").join(
        entity_ids(target), ["graph_id", "id"], "left_anti"
    )
    return target.unionByName(fresh.select(*target.columns))


def merge_counts(target_ids: DataFrame, source_ids: DataFrame, source_roots: DataFrame) -> DataFrame:
    """Per graph: entities the source adds, and known ones it enriches."""
    own = source_roots.select("graph_id", F.col("root_id").alias("id"))
    known = target_ids.select("graph_id", "id").distinct().withColumn("known", F.lit(1))
    return (
        source_ids.select("graph_id", "id")
        .distinct()
        .join(own, ["graph_id", "id"], "left_anti")
        .join(known, ["graph_id", "id"], "left")
        .groupBy("graph_id")
        .agg(
            F.count_if(F.col("known").isNull()).alias("added"),
            F.count_if(F.col("known").isNotNull()).alias("enriched"),
        )
    )


def seed_root(root_props: DataFrame, source_props: DataFrame) -> DataFrame:
    """Source values for properties the root has not got: only what is taken."""
    return source_props.join(root_props.select(*KEY).distinct(), KEY, "left_anti")


def root_properties(props: DataFrame, roots: DataFrame) -> DataFrame:
    """What a graph says of its root, without what profile or scan decide."""
    own = roots.select("graph_id", F.col("root_id").alias("id"))
    return props.filter(~F.col("prop").isin(_NOT_SEEDED)).join(own, ["graph_id", "id"], "left_semi")


def remap_root_refs(source: DataFrame, target_roots: DataFrame) -> DataFrame:
    """Point ``memberOf`` references at the target's root; flag ``remapped`` rows.

    Only references to the local root move, and only where the target's root
    has another id.
    """
    points_at_root = F.coalesce((F.col("prop") == "memberOf") & (F.col("ref") == LOCAL_ROOT), F.lit(False))
    moves = F.coalesce(F.col("root_id") != LOCAL_ROOT, F.lit(False))
    members = source.filter(points_at_root).join(target_roots, "graph_id", "left").select(
        *[c for c in PROP_COLS if c != "ref"],
        F.when(moves, F.col("root_id")).otherwise(F.col("ref")).alias("ref"),
        moves.cast("int").alias("remapped"),
    )
    return members.unionByName(
        source.filter(~points_at_root).select(*PROP_COLS, F.lit(0).alias("remapped"))
    )


def _root_members(props: DataFrame, roots: DataFrame) -> DataFrame:
    own = roots.select("graph_id", F.col("root_id").alias("id"))
    return props.filter(F.col("prop") == MEMBER).join(own, ["graph_id", "id"], "left_semi")


def replace_membership(
    target: DataFrame,
    source: DataFrame,
    nodes: DataFrame,
    target_roots: DataFrame,
    source_roots: DataFrame,
) -> dict[str, DataFrame]:
    """Take the root's members from the source, graph by graph.

    Members nobody describes are ``missing``; a graph whose source names no
    usable member keeps its own. ``props`` is the whole target, ``kept`` the
    members taken.
    """
    named = _root_members(source, source_roots).drop("id").join(target_roots, "graph_id")
    named = named.withColumnRenamed("root_id", "id").select(*PROP_COLS)
    described = entity_ids(nodes).select("graph_id", F.col("id").alias("ref"))
    usable = named.join(described, ["graph_id", "ref"], "left_semi").select(*PROP_COLS)
    missing = named.join(described, ["graph_id", "ref"], "left_anti").select(*PROP_COLS)
    # one key per graph with a usable member: the target's list yields there
    replaced = usable.select(*KEY).distinct()
    return {
        "props": target.join(replaced, KEY, "left_anti").unionByName(usable),
        "kept": usable,
        "missing": missing,
    }
