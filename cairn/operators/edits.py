"""A change log applied to a whole graph at once.

``edits`` (graph_id, seq, op, id, prop, value, ref) holds one requested change
per row. Kinds of change are applied in the order: types, new entities,
properties, renames, deletions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn import functions as fn
from cairn.model import DESCRIPTOR, NODE_COLS, PROP_COLS, STRUCTURAL_TYPES, entity_ids
from cairn.operators.files import rename_everywhere
from cairn.operators.overlay import KEY
from cairn.plans.scale import lacking, scattered, staged


def _ops(edits: DataFrame, *names: str) -> DataFrame:
    return edits.filter(F.col("op").isin(*names))


def last_property_edits(edits: DataFrame) -> DataFrame:
    """The deciding change of each property: all its values, or none.

    The newest ``seq`` wins; several values may share one ``seq``. The newest
    is found by a partial aggregate, so no task sorts all changes of a key.
    """
    own = _ops(edits, "set", "delete_property")
    newest = own.groupBy(*KEY).agg(F.max("seq").alias("seq"))
    return own.join(newest, [*KEY, "seq"])


def edit_properties(nodes: DataFrame, props: DataFrame, edits: DataFrame) -> DataFrame:
    """Replace all values of a property, or drop it; an empty ``set`` drops too.

    Only entities that exist get values; :func:`edits_of_nothing` has the rest.
    """
    deciding = last_property_edits(edits)
    pos = F.coalesce("pos", F.lit(0)) if "pos" in edits.columns else F.lit(0)
    written = deciding.filter("op = 'set' AND (value IS NOT NULL OR ref IS NOT NULL)").select(
        "graph_id", "id", "prop", pos.cast("bigint").alias("pos"), "value", "ref"
    ).join(entity_ids(nodes), ["graph_id", "id"], "left_semi")
    return lacking(props, deciding, KEY).unionByName(written.select(*props.columns))


def edits_of_nothing(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """Changes of properties of ids that no entity has, for the report: (graph_id, seq, id, prop)."""
    asked = _ops(edits, "set", "delete_property").select("graph_id", "seq", "id", "prop")
    return asked.join(entity_ids(nodes), ["graph_id", "id"], "left_anti").select("graph_id", "seq", "id", "prop")


def placeholder_entities(nodes: DataFrame, props: DataFrame) -> DataFrame:
    """A ``Thing`` for every referenced id that no entity has."""
    return (
        props.filter("ref IS NOT NULL")
        .select("graph_id", F.col("ref").alias("id"))
        .distinct()
        .join(entity_ids(nodes), ["graph_id", "id"], "left_anti")
        .select("graph_id", "id", F.lit("Thing").alias("type"), F.lit(0).alias("pos"))
    )


def add_entities(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """Entities to create: ``add`` with a type, or a ``Thing`` that a change refers to."""
    typed = _ops(edits, "add").select(
        "graph_id", "id", F.coalesce("value", F.lit("Thing")).alias("type"), "seq"
    )
    named = (
        _ops(edits, "set")
        .filter("ref IS NOT NULL")
        .select("graph_id", F.col("ref").alias("id"), F.lit("Thing").alias("type"), F.lit(None).cast("bigint").alias("seq"))
    )
    return (
        typed.unionByName(named)
        # hashed first, as text that is picked by order makes an aggregation sort its rows
        .groupBy("graph_id", "id", "type")
        .agg(F.min("seq").alias("seq"))
        .groupBy("graph_id", "id")
        # an explicit type beats the placeholder, the first one given wins
        .agg(F.min_by("type", F.struct(F.col("seq").isNull(), F.col("seq"))).alias("type"))
        .join(entity_ids(nodes), ["graph_id", "id"], "left_anti")
        .select("graph_id", "id", "type", F.lit(0).alias("pos"))
    )


def structural_ids(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Ids that must not be renamed: root, descriptor, files and folders."""
    by_type = nodes.filter(F.col("type").isin(STRUCTURAL_TYPES) | (F.col("id") == DESCRIPTOR))
    own = roots.select("graph_id", F.col("root_id").alias("id"))
    return by_type.select("graph_id", "id").unionByName(own).distinct()


def valid_renames(nodes: DataFrame, roots: DataFrame, edits: DataFrame) -> DataFrame:
    """The renames that hold, as an id map (graph_id, old, new).

    Refused are structural ids, ids already taken and blank or equal ones.
    Of several renames of one entity, or to one id, the first by ``seq`` holds.
    """
    asked = (
        _ops(edits, "rename")
        .select("graph_id", "seq", F.col("id").alias("old"), fn.trim_all(F.col("value")).alias("new"))
        .filter("new <> '' AND new <> old")
    )
    known = entity_ids(nodes)
    free = (
        asked.join(known.withColumnRenamed("id", "old"), ["graph_id", "old"], "left_semi")
        .join(
            structural_ids(nodes, roots).withColumnRenamed("id", "old"), ["graph_id", "old"], "left_anti"
        )
        .join(known.withColumnRenamed("id", "new"), ["graph_id", "new"], "left_anti")
    )
    per_entity = free.groupBy("graph_id", "old").agg(F.min(F.struct("seq", "new")).alias("pick"))
    return (
        per_entity.groupBy("graph_id", F.col("pick.new").alias("new"))
        .agg(F.min(F.struct(F.col("pick.seq"), F.col("old"))).alias("first"))
        .select("graph_id", F.col("first.old").alias("old"), "new")
    )


def rename_ids(nodes: DataFrame, props: DataFrame, roots: DataFrame, edits: DataFrame) -> dict[str, DataFrame]:
    return rename_everywhere(nodes, props, valid_renames(nodes, roots, edits))


def delete_entities(nodes: DataFrame, props: DataFrame, roots: DataFrame, edits: DataFrame) -> dict[str, DataFrame]:
    """Remove entities, their properties and every reference to them; never a root."""
    gone = (
        _ops(edits, "delete_entity")
        .select("graph_id", "id")
        .distinct()
        .join(roots.select("graph_id", F.col("root_id").alias("id")), ["graph_id", "id"], "left_anti")
    )
    key = ["graph_id", "id"]
    named = lacking(props, gone, key).withColumn("_key", scattered(F.col("ref"), F.col("ref").isNotNull(), *PROP_COLS))
    return {
        "nodes": lacking(nodes, gone, key).select(*NODE_COLS),
        "props": lacking(named, gone.withColumnRenamed("id", "_key"), ["graph_id", "_key"]).select(*PROP_COLS),
    }


def retype(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """Replace the types of existing entities by a comma-separated list; the newest wins.

    The newest change of each list is found by a hashed aggregation, so only
    the different lists of an entity are sorted.
    """
    types = F.array_distinct(fn.split_values(F.col("value"), ","))
    newest = (
        _ops(edits, "retype")
        .filter(F.size(types) > 0)
        .groupBy("graph_id", "id", "value")
        .agg(F.max("seq").alias("seq"))
        .groupBy("graph_id", "id")
        .agg(F.max_by("value", "seq").alias("value"))
        .join(entity_ids(nodes), ["graph_id", "id"], "left_semi")
    )
    fresh = newest.select("graph_id", "id", F.posexplode(types).alias("pos", "type"))
    return lacking(nodes, newest, ["graph_id", "id"]).unionByName(fresh.select(*nodes.columns))


def apply_edits(nodes: DataFrame, props: DataFrame, roots: DataFrame, edits: DataFrame) -> dict[str, DataFrame]:
    """All changes of a log. The entity list and the id map are read many times, so they are staged."""
    nodes = staged(retype(nodes, edits))
    nodes = staged(nodes.unionByName(add_entities(nodes, edits)))
    props = edit_properties(nodes, props, edits)
    renamed = rename_everywhere(nodes, props, staged(valid_renames(nodes, roots, edits)))
    return delete_entities(renamed["nodes"], renamed["props"], roots, edits)
