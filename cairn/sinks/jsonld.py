"""Graph tables to JSON-LD, one entity per line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Properties whose values are JSON numbers.
NUMERIC_PROPS = [".latitude", ".longitude"]

# Fixed value: the context every document starts from.
CONTEXT = "https://w3id.org/ro/crate/1.2/context"


def _json_string(text: Column) -> Column:
    quoted = F.to_json(F.array(text))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


ORDER = ["graph_id", "id", "rank", "key", "pos"]


def graph_to_json(
    nodes: DataFrame, props: DataFrame, numeric_props: Sequence[str] = NUMERIC_PROPS
) -> DataFrame:
    """One JSON object per entity, as fragments (graph_id, id, rank, key, pos, text).

    In order of these columns, the texts of an entity are its object: an
    opening, a fragment per value, an end. Single values stand alone, several
    form a list in order of ``pos``. A value's brackets and commas follow from
    the first and last position of its property, so a list of any length is
    never gathered in a row or a task.
    """
    number = F.col("prop").isin(list(numeric_props)) & F.col("value").try_cast("double").isNotNull()
    encoded = (
        F.when(F.col("ref").isNotNull(), F.concat(F.lit('{"@id":'), _json_string(F.col("ref")), F.lit("}")))
        .when(number, F.col("value"))
        .otherwise(_json_string(F.col("value")))
    )
    key = ["graph_id", "id", "key"]
    types = nodes.filter("type IS NOT NULL").select(
        "graph_id", "id", F.lit("@type").alias("key"), F.col("pos").cast("bigint").alias("pos"), _json_string(F.col("type")).alias("json")
    )
    values = props.select("graph_id", "id", F.col("prop").alias("key"), "pos", encoded.alias("json")).unionByName(types)
    spans = values.groupBy(*key).agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    several, begins, ends = F.col("first") < F.col("last"), F.col("pos") == F.col("first"), F.col("pos") == F.col("last")
    opening = F.concat(F.lit(","), _json_string(F.col("key")), F.lit(":"), F.when(several, "[").otherwise(""))
    said = values.join(spans, key).select(
        "graph_id",
        "id",
        F.lit(1).alias("rank"),
        "key",
        "pos",
        F.concat(F.when(begins, opening).otherwise(","), "json", F.when(several & ends, "]").otherwise("")).alias("text"),
    )
    # an entity without a type, or without an entity row, still is an object
    ids = nodes.select("graph_id", "id").union(props.select("graph_id", "id")).distinct()
    frame = F.array(
        F.struct(F.lit(0).alias("rank"), F.concat(F.lit('{"@id":'), _json_string(F.col("id"))).alias("text")),
        F.struct(F.lit(2).alias("rank"), F.lit("}").alias("text")),
    )
    framed = ids.select("graph_id", "id", F.inline(frame))
    return said.unionByName(framed, allowMissingColumns=True)


def document_lines(nodes: DataFrame, props: DataFrame, prefixes: DataFrame) -> DataFrame:
    """One JSON-LD document per graph, as lines (graph_id, section, id, rank, key, pos, line).

    In order the lines are the document: its context with the prefixes of the
    graph, the fragments of its entities, and the end.
    """
    entities = graph_to_json(nodes, props)
    first = entities.filter("rank = 0").groupBy("graph_id").agg(F.min("id").alias("first"))
    comma = F.when((F.col("rank") == 0) & (F.col("id") > F.col("first")), ",").otherwise("")
    body = entities.join(first, "graph_id").select(
        "graph_id", F.lit(1).alias("section"), "id", "rank", "key", "pos", F.concat(comma, "text").alias("line")
    )
    # a graph's prefixes are declared by hand, so one row holds them
    terms = prefixes.groupBy("graph_id").agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("prefix", "uri"))))).alias("terms")
    )
    context = F.concat(
        F.lit(f'{{"@context":["{CONTEXT}"'), F.coalesce(F.concat(F.lit(","), "terms"), F.lit("")), F.lit('],"@graph":[')
    )
    heads = first.join(terms, "graph_id", "left").select("graph_id", F.lit(0).alias("section"), context.alias("line"))
    ends = first.select("graph_id", F.lit(2).alias("section"), F.lit("]}").alias("line"))
    return body.unionByName(heads.unionByName(ends), allowMissingColumns=True)


def write_documents(
    nodes: DataFrame, props: DataFrame, prefixes: DataFrame, path: str, mode: str = "overwrite"
) -> None:
    """A folder per graph whose part files, in order of name, are its document."""
    order = ["graph_id", "section", *ORDER[1:]]
    lines = document_lines(nodes, props, prefixes).repartitionByRange(*order).sortWithinPartitions(*order)
    lines.select("graph_id", F.col("line").alias("value")).write.mode(mode).partitionBy("graph_id").text(path)


def write_graph(nodes: DataFrame, props: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines in a folder per graph; the part files, in order of name, hold an entity per line.

    Fragments are set apart by blanks, and only an entity's end breaks the
    line. A line stands in one file; it is written as it is sorted.
    """
    fragments = graph_to_json(nodes, props).repartitionByRange("graph_id", "id").sortWithinPartitions(*ORDER)
    ended = F.when(F.col("rank") == 2, F.concat("text", F.lit("\n"))).otherwise(F.col("text"))
    fragments.select("graph_id", ended.alias("value")).write.mode(mode).partitionBy("graph_id").text(path, lineSep=" ")
