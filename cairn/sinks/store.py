"""A folder of graphs: ordered files, and a manifest that says which of them count.

Each graph is one JSON-LD document, cut into part files wherever a range of
(section, id, rank, key, pos) ends, so also inside an entity and inside a list: an
entity with most of a graph's values is written and read by many tasks. Read
one after another in the order of the manifest, the files of a graph are its
document. Its lines are indented by what they are, so that a reader knows a
line's kind without the lines before it:

    {"@context":[…],"@graph":[
    {"@id":"#a"           an entity begins
     ,"name":"x"          a property begins (one blank)
      ,"y"]               another value of it (two blanks)
    }

A save writes new files into a folder of its own and then a manifest of the next
version, in one commit: until that is there, readers see the former version, and a
job that dies leaves only files that no manifest names. A save of some graphs
takes over the rows of all others; their files are neither read nor written. Two
saves at once cannot both write one version; the later one fails.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.model import NODE_COLS, PROP_COLS, Graph
from cairn.plans.scale import scan, staged
from cairn.sinks.jsonld import _json_string, document_lines
from cairn.sources.jsonld import context_prefixes, find_roots

MANIFEST = "graph_id string, part_no bigint, file string, bytes bigint"

# --- manifests ----------------------------------------------------------------


def _listed(spark: SparkSession, folder: str) -> list[str]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in system.listStatus(path)] if system.exists(path) else []


def version(spark: SparkSession, path: str) -> int:
    """The newest version whose manifest is complete; 0 if there is none."""
    made = [int(n.removeprefix("version-")) for n in _listed(spark, f"{path}/manifest") if n.startswith("version-")]
    return max((v for v in made if "_SUCCESS" in _listed(spark, f"{path}/manifest/version-{v:012}")), default=0)


def manifest(spark: SparkSession, path: str, at: int | None = None) -> DataFrame:
    """graph_id, part_no, file (below ``path``), bytes: the files of a version, of the newest by default."""
    at = version(spark, path) if at is None else at
    if not at:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest/version-{at:012}")


# --- writing ------------------------------------------------------------------


def indented(lines: DataFrame) -> DataFrame:
    begins = F.col("line").startswith(F.concat(F.lit(","), _json_string(F.col("key")), F.lit(":")))
    indent = F.when(F.col("section") != 1, "").when(F.col("rank") != 1, "").when(begins, " ").otherwise("  ")
    return lines.withColumn("line", F.concat(indent, "line"))


def save_graphs(graph: Graph, path: str, only: DataFrame | None = None) -> int:
    """Write graphs and commit; the new version.

    ``only`` (graph_id) names the graphs that are replaced: those in ``graph`` are
    written, others of ``only`` go, and all else stays as it is. By default
    the store holds just what ``graph`` has.
    """
    spark = graph.nodes.sparkSession
    before = version(spark, path)
    nodes, props, prefixes = graph.nodes, graph.props, graph.prefixes
    if only is not None:
        wanted = only.select("graph_id").distinct()
        nodes, props, prefixes = (t.join(wanted, "graph_id", "left_semi") for t in (nodes, props, prefixes))
    order = ["graph_id", "section", "id", "rank", "key", "pos"]
    # made once: ranges are sampled before the rows are dealt out
    lines = staged(indented(document_lines(nodes, props, prefixes))).repartitionByRange(*order).sortWithinPartitions(*order)
    folder = f"data-{uuid.uuid4().hex}"
    lines.select("graph_id", F.col("line").alias("value")).write.partitionBy("graph_id").text(f"{path}/{folder}")
    rows = _written(spark, path, folder)
    if only is not None:
        kept = manifest(spark, path, before).join(wanted, "graph_id", "left_anti")
        rows = kept.unionByName(rows)
    rows.write.parquet(f"{path}/manifest/version-{before + 1:012}")  # fails if another save was first
    return before + 1


def _written(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """The part files of a folder; their numbers order them, however many digits those have."""
    names = _listed(spark, f"{path}/{folder}")
    if not any(n.startswith("graph_id=") for n in names):
        return spark.createDataFrame([], MANIFEST)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/{folder}")
    below = F.concat(F.lit(f"{folder}/"), F.substring_index("path", f"/{folder}/", -1))
    number = F.regexp_extract("path", r"/part-(\d+)[^/]*$", 1).cast("bigint")
    return files.select(F.col("graph_id").cast("string"), number.alias("part_no"), below.alias("file"), F.col("length").alias("bytes"))


# --- reading ------------------------------------------------------------------


def stored_lines(spark: SparkSession, path: str, only: DataFrame | None = None) -> DataFrame:
    """Lines of the newest version in their place: graph_id, part_no, start (of the byte range), at, line."""
    files = manifest(spark, path)
    if only is not None:
        files = files.join(only.select("graph_id").distinct(), "graph_id", "left_semi")
    listed = files.collect()  # the list of files that a scan holds on the driver anyway
    if not listed:
        return spark.createDataFrame([], "graph_id string, part_no bigint, start bigint, at bigint, line string")
    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))  # the column is a URI
    lines = spark.read.text([f"{path}/{r['file']}" for r in listed]).select(
        F.regexp_extract(name, "/(data-[^/]*/.*)$", 1).alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("line"),
    )
    joined = lines.join(files, "file")
    whole = F.when(F.col("size") == F.col("bytes"), F.col("line")).otherwise(
        F.raise_error(F.concat(F.col("file"), F.lit(" is not as long as the manifest says")))
    )
    return joined.select("graph_id", "part_no", "start", "at", whole.alias("line"))


def _string(json: Column) -> Column:
    return F.get(F.from_json(F.concat(F.lit("["), json, F.lit("]")), "array<string>"), F.lit(0))


def load_graphs(spark: SparkSession, path: str, only: DataFrame | None = None) -> Graph:
    """The graphs of the newest version, or some of them, value by value: no row or task holds an entity or a list."""
    lines = stored_lines(spark, path, only).withColumn("place", F.struct("part_no", "start", "at"))
    indent = F.length("line") - F.length(F.ltrim("line"))
    said = F.ltrim("line")
    kind = (
        F.when(indent == 1, "property").when(indent == 2, "value").when(said.rlike(r'^,?\{"@id":'), "entity").when(said.startswith("{"), "head")
    )
    lines = lines.select("graph_id", "place", kind.alias("kind"), said.alias("said"))
    key = F.regexp_extract("said", r'^,("(?:[^"\\]|\\.)*"):', 1)
    # lines are read for each carried value and for each part of the graph, so what they say is staged
    named = staged(lines.select(
        "*",
        F.when(F.col("kind") == "entity", F.get_json_object(F.concat(F.ltrim(F.col("said"), F.lit(",")), F.lit("}")), "$['@id']")).alias("its_id"),
        F.when(F.col("kind") == "property", key).alias("its_key"),
        F.col("kind").isin("property", "value").cast("int").alias("one"),
    ))
    segment = F.struct("place.part_no", "place.start")
    held = staged(scan(
        named, ["graph_id"], "place", segment, last={"id": F.col("its_id"), "key": F.col("its_key")}, total={"n": F.col("one")}
    ).select("graph_id", "place", "kind", "said", "id", "key", "n"))
    first = F.when(F.col("kind") == "property", F.col("n"))
    held = scan(held, ["graph_id"], "place", segment, last={"first": first}).filter("kind IN ('property', 'value')")
    json = F.when(F.col("kind") == "property", F.expr("substring(said, length(key) + 3)")).otherwise(F.expr("substring(said, 2)"))
    json = F.regexp_replace(F.regexp_replace(json, r"^\[", ""), r"\]$", "")
    values = staged(held.select("graph_id", "id", _string(F.col("key")).alias("prop"), (F.col("n") - F.col("first")).alias("pos"), json.alias("json")))
    ref = F.when(F.col("json").startswith("{"), F.get_json_object("json", "$['@id']"))
    text = F.when(F.col("json").startswith('"'), _string(F.col("json"))).when(ref.isNull(), F.col("json"))
    types = values.filter("prop = '@type'").select("graph_id", "id", text.alias("type"), F.col("pos").cast("int"))
    props = values.filter("prop <> '@type'").select("graph_id", "id", "prop", "pos", text.alias("value"), ref.alias("ref"))
    entities = named.filter("its_id IS NOT NULL").select("graph_id", F.col("its_id").alias("id"), "place")
    untyped = entities.join(types.select("graph_id", "id").distinct(), ["graph_id", "id"], "left_anti")
    nodes = types.unionByName(untyped.select("graph_id", "id", F.lit(None).cast("string").alias("type"), F.lit(0).alias("pos")))
    heads = named.filter("kind = 'head'").select("graph_id", F.concat("said", F.lit("]}")).alias("text"))
    placed = nodes.join(entities.select("graph_id", "id", F.col("place").alias("entity_no")), ["graph_id", "id"])
    return Graph(nodes.select(*NODE_COLS), props.select(*PROP_COLS), find_roots(placed, props), context_prefixes(heads))
