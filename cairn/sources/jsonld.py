"""JSON-LD documents to graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.model import DESCRIPTOR, LOCAL_ROOT, NODE_COLS, PROP_COLS
from cairn.operators.sheets import context_rows

# Candidate metadata files; on equal times the earlier one wins.
METADATA_FILES = [
    "additional-ro-crate-metadata.xlsx",
    "ro-crate-metadata.xlsx",
    "ro-crate-metadata.json",
]
JSON_FILE = "ro-crate-metadata.json"


def _items(value: Column) -> Column:
    """A JSON value as an array of its items; a single value has one."""
    many = F.schema_of_variant(value).startswith("ARRAY")
    return F.when(many, F.try_variant_get(value, "$", "array<variant>")).otherwise(F.array(value))


def _fields(entities: DataFrame, *keep: str) -> DataFrame:
    """One row per field of the object in column ``entity``."""
    view = entities.select(*keep, F.col("entity"))
    return view.lateralJoin(
        view.sparkSession.tvf.variant_explode(F.col("entity").outer())
        .select(F.col("key"), F.col("value").alias("field"))
    ).select(*keep, "key", "field")


def _part(text: str, field: str, kind: str) -> Column:
    """One field of a JSON object; the rest is passed over, however long it is."""
    return F.from_json(text, f"`{field}` {kind}")[field]


def _cut(documents: DataFrame) -> DataFrame:
    """The entities of whole documents as text: graph_id, entity_no, text, entity."""
    cut = documents.select("graph_id", F.posexplode(_part("text", "@graph", "array<string>")).alias("entity_no", "text"))
    return cut.withColumn("entity", F.try_parse_json("text"))


def document_entities(documents: DataFrame) -> DataFrame:
    """Entities of whole documents (graph_id, text): graph_id, entity_no, entity.

    A document is cut into its entities first and each is parsed for itself,
    so a document may be larger than one parsed value may be.
    """
    return _cut(documents).filter("entity IS NOT NULL").select("graph_id", "entity_no", "entity")


def without_graph(documents: DataFrame) -> DataFrame:
    """Documents that as a whole have no readable graph, like ``rejected``."""
    return documents.filter(_part("text", "@graph", "array<string>").isNull()).select(
        "graph_id", F.lit(None).cast("int").alias("entity_no"), F.lit("no readable @graph").alias("reason")
    )


def rejected(documents: DataFrame) -> DataFrame:
    """What of the documents cannot be read: (graph_id, entity_no, reason).

    ``entity_no`` is null where the document as a whole has no readable graph.
    """
    whole = without_graph(documents)
    without_id = F.try_variant_get("entity", "$['@id']", "string").isNull()
    reason = F.when(F.col("entity").isNull(), "does not parse").when(without_id, "no @id")
    return whole.unionByName(
        _cut(documents).select("graph_id", "entity_no", reason.alias("reason")).filter("reason IS NOT NULL")
    )


def line_entities(lines: DataFrame) -> DataFrame:
    """Entities of a graph kept as one JSON object per line (graph_id, text)."""
    return lines.select(
        "graph_id", F.lit(0).alias("entity_no"), F.try_parse_json("text").alias("entity")
    ).filter("entity IS NOT NULL")


def read_entities(entities: DataFrame) -> dict[str, DataFrame]:
    """``nodes`` (with ``entity_no``) and ``props`` of parsed entities.

    Nested objects are references. Numbers and truth values become text.
    Fields of an entity that is spread over several objects are read together.
    """
    identified = entities.withColumn("id", F.try_variant_get("entity", "$['@id']", "string")).filter(
        "id IS NOT NULL"
    )
    fields = _fields(identified, "graph_id", "id", "entity_no")
    values = fields.filter("NOT startswith(key, '@')").select(
        "graph_id", "id", "entity_no", "key", F.posexplode(_items(F.col("field"))).alias("pos", "item")
    )
    text = F.try_variant_get("item", "$", "string")
    # an entity without a type has one row, with a null type
    types = _items(F.try_variant_get("entity", "$['@type']", "variant"))
    nodes = identified.select(
        "graph_id", "id", "entity_no", F.posexplode(types).alias("pos", "item")
    ).select("graph_id", "id", text.alias("type"), "pos", "entity_no")
    ref = F.try_variant_get("item", "$['@id']", "string")
    props = values.select(
        "graph_id",
        "id",
        F.col("key").alias("prop"),
        F.col("pos").cast("bigint").alias("pos"),
        F.when(ref.isNull(), text).alias("value"),
        ref.alias("ref"),
    )
    return {"nodes": nodes, "props": props.filter("value IS NOT NULL OR ref IS NOT NULL").select(*PROP_COLS)}


def find_roots(nodes: DataFrame, props: DataFrame) -> DataFrame:
    """Root of each graph: ``./``, else what the descriptor is about, else the first Dataset.

    ``nodes`` carries ``entity_no``, the order of entities in their document.
    """
    ids = nodes.select("graph_id", "id").distinct()
    about = (
        props.filter((F.col("id") == DESCRIPTOR) & (F.col("prop") == "about"))
        .groupBy("graph_id")
        .agg(F.min_by(F.coalesce("ref", "value"), "pos").alias("id"))
        .join(ids, ["graph_id", "id"], "left_semi")
        .withColumnRenamed("id", "about")
    )
    dataset = (F.col("type") == "Dataset") & (F.col("id") != DESCRIPTOR)
    per_graph = nodes.groupBy("graph_id").agg(
        F.max(F.when(F.col("id") == LOCAL_ROOT, F.col("id"))).alias("local"),
        F.min_by("id", F.when(dataset, F.struct("entity_no", "id"))).alias("first"),
    )
    return (
        per_graph.join(about, "graph_id", "left")
        .select("graph_id", F.coalesce("local", "about", "first").alias("root_id"))
        .filter("root_id IS NOT NULL")
    )


def context_prefixes(documents: DataFrame) -> DataFrame:
    """Prefix declarations of the documents' ``@context`` objects; the last object that has one holds."""
    contexts = documents.select(
        "graph_id",
        F.posexplode(_items(F.try_parse_json(_part("text", "@context", "string")))).alias("pos", "entity"),
    ).filter(F.schema_of_variant("entity").startswith("OBJECT"))
    fields = _fields(contexts, "graph_id", "pos")
    uri = F.try_variant_get("field", "$", "string").alias("uri")
    return context_rows(fields.select("graph_id", "pos", F.col("key").alias("prefix"), uri).filter("uri IS NOT NULL"))


def read_graph(documents: DataFrame) -> dict[str, DataFrame]:
    """``nodes``, ``props``, ``roots`` and ``prefixes`` of JSON-LD documents, and what was ``rejected``."""
    read = read_entities(document_entities(documents))
    return {
        "nodes": read["nodes"].select(*NODE_COLS),
        "props": read["props"],
        "roots": find_roots(read["nodes"], read["props"]),
        "prefixes": context_prefixes(documents),
        "rejected": rejected(documents),
    }


def pick_newest_source(candidates: DataFrame) -> DataFrame:
    """The metadata file to read for each graph: (graph_id, name, last_modified, fell_back).

    ``candidates`` is (graph_id, name, last_modified, content). The newest
    wins, the earlier listed name on equal times. If its content does not
    hold a readable graph, the newest JSON file that does is taken; if there is
    none, nothing.
    """
    ranked = candidates.filter(F.col("name").isin(METADATA_FILES)).select(
        "graph_id",
        "name",
        "last_modified",
        F.struct(
            "last_modified", (-F.array_position(F.lit(METADATA_FILES), F.col("name"))).alias("rank")
        ).alias("order"),
        _part("content", "@graph", "array<string>").isNotNull().alias("parses"),
    )
    usable_json = (F.col("name") == JSON_FILE) & F.col("parses")
    pick = F.struct("name", "last_modified", "parses")
    best = ranked.groupBy("graph_id").agg(
        F.max_by(pick, "order").alias("newest"),
        F.max_by(pick, F.when(usable_json, F.col("order"))).alias("json"),
    )
    chosen = F.when(F.col("newest.parses"), F.col("newest")).otherwise(F.col("json"))
    return (
        best.withColumn("chosen", chosen)
        .filter("chosen IS NOT NULL")
        .select(
            "graph_id",
            "chosen.name",
            "chosen.last_modified",
            (~F.col("newest.parses")).cast("int").alias("fell_back"),
        )
    )
