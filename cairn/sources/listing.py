"""File listings."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn import functions as fn
from cairn.model import union_all
from cairn.plans.scale import staged

# Names that are output or control files, never content. They
# count at every level of a path, for folders as for files.
GENERATED_NAMES = [
    "ro-crate-metadata.json",
    "ro-crate-metadata.jsonld",
    "ro-crate-metadata.xlsx",
    "ro-crate-preview.html",
    "ro-crate-preview_html",
    "additional-ro-crate-metadata.xlsx",
    "config.json",
    "c2c-output",
    "ro-crate-preview_files",
]


def scan_files(paths: DataFrame, excluded: Sequence[str] = GENERATED_NAMES) -> DataFrame:
    """Content files of a path table with ``relative_path``.

    A path goes if any of its parts is hidden, a lock file or an excluded name.
    """

    def unwanted(part):
        return part.startswith(".") | part.startswith("~$") | part.isin(list(excluded))

    return paths.filter(~F.exists(F.split("relative_path", "/"), unwanted))


def list_folder(spark: SparkSession, root: str, graph_id: str) -> DataFrame:
    """The files under ``root`` as a path table; contents stay unread.

    Spark's own listing leaves out names that start with ``_``, and its reader
    empty files; :func:`list_tree` has both.
    """
    found = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select("path", "length", "modificationTime")
    )
    prefix = root.rstrip("/") + "/"
    if "://" not in prefix:
        prefix = "file:" + prefix
    bare = F.regexp_replace("path", r"^file:/+", "file:/")
    relative = F.expr(f"substr(bare, {len(prefix) + 1})")
    return scan_files(
        found.withColumn("bare", bare).select(
            F.lit(graph_id).alias("graph_id"),
            fn.basename(relative).alias("file_name"),
            relative.alias("relative_path"),
            "length",
            F.col("modificationTime").alias("last_modified"),
        )
    )


FOLDERS_PER_TASK = 64
ENTRY = "relative_path string, is_folder boolean, length bigint, last_modified timestamp"


def list_tree(spark: SparkSession, root: str, graph_id: str, excluded: Sequence[str] = GENERATED_NAMES) -> DataFrame:
    """The content files under ``root``, listed on the executors; every name arrives.

    Level by level, the folders found so far are spread over tasks, and each
    task lists its folders. A level is staged, so a lost executor lists only
    what it had to; the driver learns how many folders there are, not which.
    Folders that :func:`scan_files` would drop are not entered. ``root`` is a
    path or URI that executors can list; symbolic links to folders are not
    followed. Rows are as :func:`list_folder` has them, in any order.
    """
    levels = []
    folders, n = spark.range(1).select(F.lit("").alias("relative_path")), 1
    while n:
        spread = folders.repartition(-(-n // FOLDERS_PER_TASK), "relative_path")
        level = staged(scan_files(spread.mapInArrow(entries(root), ENTRY), excluded))
        levels.append(level.filter("NOT is_folder"))
        folders = level.filter("is_folder").select("relative_path")
        n = folders.count()
    return union_all(levels).select(
        F.lit(graph_id).alias("graph_id"),
        fn.basename(F.col("relative_path")).alias("file_name"),
        "relative_path",
        "length",
        "last_modified",
    )


def entries(root: str):
    """What stands in each folder of a batch."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("relative_path", "string"), ("is_folder", "bool"), ("length", "int64"), ("last_modified", pa.timestamp("us", "UTC"))])
        store, top = storage(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                # a folder that went since its level was listed has nothing in it
                selector = fs.FileSelector(f"{top}/{folder}" if folder else top or "/", allow_not_found=bool(folder))
                found = [f for f in store.get_file_info(selector) if not linked_folder(store, f)]
                for at in range(0, len(found), 10_000):
                    some = found[at : at + 10_000]
                    columns = [
                        [f"{folder}/{f.base_name}" if folder else f.base_name for f in some],
                        [f.type == fs.FileType.Directory for f in some],
                        [f.size for f in some],
                        [f.mtime for f in some],
                    ]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, schema, strict=True)], schema=schema)

    return listed


def storage(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    store, top = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    return store, top.rstrip("/")


def linked_folder(store: fs.FileSystem, found: fs.FileInfo) -> bool:
    return store.type_name == "local" and found.type == fs.FileType.Directory and os.path.islink(found.path)
