"""The tables a graph is made of.

A graph with an open schema is held in three long tables, so that no property
needs a column of its own and one job can carry any number of graphs:

``nodes``  graph_id, id, type, pos        one row per (entity, type)
``props``  graph_id, id, prop, pos, value, ref   one row per value; exactly
           one of ``value`` (a literal) and ``ref`` (an entity id) is set
``roots``  graph_id, root_id              one row per graph

``prefixes`` graph_id, prefix, uri        one row per prefix of a graph

``pos`` orders the values of one (entity, property); it is unique there but may
have gaps.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_COLS = ["graph_id", "id", "type", "pos"]
PROP_COLS = ["graph_id", "id", "prop", "pos", "value", "ref"]

# Ids, names and URIs the output format prescribes.
DESCRIPTOR = "ro-crate-metadata.json"
LOCAL_ROOT = "./"
OBJECT_TYPE = "RepositoryObject"
COLLECTION_TYPE = "RepositoryCollection"
STRUCTURAL_TYPES = ["File", "RepositoryObject", "RepositoryCollection"]
OBJECT_PROFILE = "https://w3id.org/ldac/profile#Object"
COLLECTION_PROFILE = "https://w3id.org/ldac/profile#Collection"
BUILTIN_PREFIXES = {
    "ldac": "https://w3id.org/ldac/terms#",
    "pcdm": "http://pcdm.org/models#",
    "custom": "arcp://name,custom/terms#",
    "AUSTLANG": "https://collection.aiatsis.gov.au/austlang/language/",
}
DUPLICATE_PROP = "custom:possibleDuplicate"


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    props: DataFrame
    roots: DataFrame
    prefixes: DataFrame

    def with_(self, **tables: DataFrame) -> Graph:
        return replace(self, **tables)

    def plus(self, nodes: DataFrame | None = None, props: DataFrame | None = None) -> Graph:
        """The graph with more rows; the caller vouches that they are new."""
        return replace(
            self,
            nodes=self.nodes if nodes is None else self.nodes.unionByName(nodes),
            props=self.props if props is None else self.props.unionByName(props),
        )


def literal_table(spark: SparkSession, rows: Sequence[Sequence], **columns: str) -> DataFrame:
    """A small table from configuration, as a local relation whose size the planner knows."""
    arrow = {"string": pa.string(), "int": pa.int32()}
    arrays = [pa.array([row[i] for row in rows], arrow[kind]) for i, kind in enumerate(columns.values())]
    return spark.createDataFrame(pa.table(arrays, names=list(columns)))


def builtin_prefixes(graphs: DataFrame) -> DataFrame:
    """The prefixes that every graph has; ``graphs`` has a row per graph, as ``roots`` do."""
    known = F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(u).alias("uri")) for p, u in BUILTIN_PREFIXES.items()])
    return graphs.select("graph_id").distinct().select("graph_id", F.inline(known))


def union_all(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), tables)


def node_rows(df: DataFrame, id: Column, type: Column | str, pos: Column | int = 0) -> DataFrame:
    kind = F.lit(type) if isinstance(type, str) else type
    place = F.lit(pos) if isinstance(pos, int) else pos
    return df.select("graph_id", id.alias("id"), kind.alias("type"), place.cast("int").alias("pos"))


def fact(prop: Column | str, value=None, ref=None, pos=0) -> Column:
    """One property value, for use in :func:`prop_rows`."""

    def text(x):
        return (x if isinstance(x, Column) else F.lit(x)).cast("string")

    return F.struct(
        (prop if isinstance(prop, Column) else F.lit(prop)).alias("prop"),
        (pos if isinstance(pos, Column) else F.lit(pos)).cast("bigint").alias("pos"),
        text(value).alias("value"),
        text(ref).alias("ref"),
    )


def prop_rows(df: DataFrame, id: Column, facts: Sequence[Column]) -> DataFrame:
    """Property rows from the columns of each row; empty facts are left out.

    A literal array is exploded in place, so constant defaults cost neither a
    join nor a second scan.
    """
    long = df.select("graph_id", id.alias("id"), F.inline(F.array(*facts)))
    return long.filter("value IS NOT NULL OR ref IS NOT NULL").select(*PROP_COLS)


def entity_ids(nodes: DataFrame) -> DataFrame:
    return nodes.select("graph_id", "id").distinct()
