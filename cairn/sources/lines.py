"""Text files of any size as numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.plans.scale import staged


def read_lines(spark: SparkSession, root: str, graph_id: str) -> DataFrame:
    """The lines of all files under ``root``: graph_id, doc_id, line_no, line.

    ``doc_id`` is the path below ``root``, or the file's name if ``root`` is a
    file; ``line_no`` counts from 0. Spark cuts a file into byte ranges and
    reads them in several tasks; within a task the lines come in order, and a
    row per byte range says how many lines stand before it. No task and no row
    holds a file.

    Lines end in ``\\n`` or ``\\r\\n``. As when a text is cut at its line ends, a
    text that ends with one has an empty last line. An empty file has no lines.
    The rows are staged, since their order is that of one reading.
    """
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("size"),
    )
    read = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(root).select(place.alias("place"), "value")
    rows = staged(read.select("place.*", F.monotonically_increasing_id().alias("at"), "value"))
    ranges = rows.groupBy("file", "start").agg(
        F.max("size").alias("size"),
        F.min("at").alias("first"),
        F.count("*").alias("lines"),
        F.sum(F.octet_length("value") + 1).alias("bytes"),
    )
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    begins = ranges.withColumn("before", F.coalesce(F.sum("lines").over(before), F.lit(0))).select("file", "start", "first", "before")
    numbered = rows.join(begins, ["file", "start"]).select("file", (F.col("at") - F.col("first") + F.col("before")).alias("line_no"), "value")
    # the last line of a file without an end is a byte shorter than counted
    files = ranges.groupBy("file").agg(F.sum("lines").alias("line_no"), F.sum("bytes").alias("bytes"), F.max("size").alias("size"))
    ended = files.filter("bytes = size").select("file", "line_no", F.lit("").alias("value"))
    return numbered.unionByName(ended).select(
        F.lit(graph_id).alias("graph_id"), below(root, F.col("file")).alias("doc_id"), "line_no", F.regexp_replace("value", "\r$", "").alias("line")
    )


def below(root: str, file: Column) -> Column:
    """The path below ``root`` of a file that Spark names by its encoded URI."""
    plain = F.regexp_replace(F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B"))), "^file:/+", "file:/")
    top = root.rstrip("/")
    if "://" not in top:
        top = "file:/" + top.removeprefix("file:").lstrip("/")
    inside = plain.startswith(F.lit(top + "/"))
    return F.when(inside, F.substr(plain, F.lit(len(top) + 2))).otherwise(F.regexp_extract(plain, "[^/]*$", 0))
