"""JSON-LD documents of any size, read by byte range.

A document that is one long text need not fit into a cell. Its files are read
as records that end in a closing brace, which every entity does, so Spark cuts
them into byte ranges like any text, and reads them from any store that it
knows. What such a range means depends on what stands before it:

1. *Summary.* Each range is read once without knowing whether it begins inside
   a string. Both ways are followed: how deep it ends, how deep it gets, where
   a ``@graph`` begins. One row per range leaves the executors, about as much
   as the driver holds anyway to plan the scan.
2. *State.* Running over the ranges of a document in order, these rows say how
   each range really begins: in a string or not, how deep, in the graph or not.
3. *Entities.* Each range is read again from its state and gives a row per
   entity. Only what is cut by a border is put together by a shuffle, and the
   little that stands around the graph (context and brackets).

A document is a file, or all part files of a folder in order of their names;
see ``scan_documents``. Ranges must be cut alike in both readings, so the
settings of ``spark.sql.files`` must not change until the result is computed;
a range without a state stops the job rather than being read wrongly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.model import NODE_COLS
from cairn.sources.jsonld import context_prefixes, find_roots, read_entities, without_graph

ESCAPED = re.compile(rb"\\.", re.S)
PLAIN = re.compile(rb'(?:[^"{}\[\]]|"(?:[^"\\]|\\.)*")*', re.S)  # up to the first bracket outside strings
GRAPH = re.compile(rb'"@graph"\s*:\s*\[')
NOT_BRACKETS = bytes(c for c in range(256) if chr(c) not in "{}[]")
CLOSED = b"}"  # what every record ends in
LARGEST_FRAME = 1 << 28  # characters around a graph that are still put into one cell
FRAME_PIECE = 1 << 20  # bytes around a graph that a row holds

# --- records ------------------------------------------------------------------


def brackets(record: bytes, inside: bool, closed: bool = True) -> tuple[bytes, bool]:
    """The brackets of a record that stand outside strings, with the one behind it, and whether it ends inside a string."""
    if b"\\" in record:
        record = ESCAPED.sub(b"", record)
    parts = record.split(b'"')
    found = b"".join(parts[inside::2]).translate(None, NOT_BRACKETS)
    ends_inside = inside ^ (len(parts) % 2 == 0)
    return (found if ends_inside or not closed else found + CLOSED), ends_inside


def depths(found: bytes, depth: int) -> tuple[int, int]:
    """How deep brackets lead from ``depth``, and the least depth on the way."""
    up, down = found.count(b"{") + found.count(b"["), found.count(b"}") + found.count(b"]")
    if not down:
        return depth + up, depth
    if down == 1 and found[-1:] == CLOSED:  # most records open first and close once
        return depth + up - 1, min(depth, depth + up - 1)
    low = depth
    for c in found:
        depth += 1 if c in b"{[" else -1
        low = min(low, depth)
    return depth, low


@dataclass
class Way:
    """A range as read when it begins outside a string, or inside one."""

    inside: bool
    depth: int = 0
    low: int = 0  # least depth
    graph: int | None = None  # least depth at which a graph begins
    low_after: int = 0  # least depth behind it

    def read(self, record: bytes, closed: bool = True) -> None:
        start, depth = self.inside, self.depth
        found, self.inside = brackets(record, start, closed)
        self.depth, low = depths(found, depth)
        self.low, self.low_after = min(self.low, low), min(self.low_after, low)
        if b'"@graph"' in record:
            for at, around in graphs(record, start, depth):
                if self.graph is None or around <= self.graph:
                    self.graph = around
                    self.low_after = depths(brackets(record[at:], False, closed)[0], around + 1)[1]


def graphs(record: bytes, inside: bool, depth: int) -> Iterator[tuple[int, int]]:
    """Where arrays named @graph begin (behind their bracket), and the depth around them."""
    for m in GRAPH.finditer(record):
        before, in_string = brackets(record[: m.start()], inside, closed=False)
        if not in_string:
            yield m.end(), depths(before, depth)[0]


WAY = "struct<inside:boolean,depth:bigint,low:bigint,graph:bigint,low_after:bigint>"
SUMMARY = f"folder string, file string, start bigint, bytes bigint, ways array<{WAY}>"


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per range; two ways more should no brace stand behind its last record."""
    way = pa.struct([("inside", "bool"), ("depth", "int64"), ("low", "int64"), ("graph", "int64"), ("low_after", "int64")])
    schema = pa.schema([("folder", "string"), ("file", "string"), ("start", "int64"), ("bytes", "int64"), ("ways", pa.list_(way))])
    for (folder, file, start), records in ranges(batches):
        ways, size = [Way(False), Way(True)], 0
        for record, last in with_last(records):
            size += len(record) + 1
            if last:
                ways += [replace(w) for w in ways]
            for k, w in enumerate(ways):
                w.read(record, closed=k < 2)
        yield pa.RecordBatch.from_pylist([{"folder": folder, "file": file, "start": start, "bytes": size, "ways": [vars(w) for w in ways]}], schema)


def with_last(records: Iterator[bytes]) -> Iterator[tuple[bytes, bool]]:
    """Each record and whether it is the last."""
    held = next(records, None)
    for record in records:
        yield held, False
        held = record
    if held is not None:
        yield held, True


def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, str, int], Iterator[bytes]]]:
    """The records of each range, which lie one after another; all of them must be taken."""

    def rows():
        for batch in batches:
            for record, *range_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield tuple(range_), record

    waiting = rows()
    head = next(waiting, None)
    while head is not None:
        range_ = head[0]

        def records(first=head, of=range_):
            nonlocal head
            row = first
            while row is not None and row[0] == of:
                yield row[1]
                row = next(waiting, None)
            head = row

        yield range_, records()


# --- the state at the beginning of each range ---------------------------------


def states(summary: DataFrame, sizes: DataFrame) -> DataFrame:
    """folder, file, start, range_no, inside, depth, in_graph, closed: how each range begins, in its document's order.

    ``closed`` is false if no brace stands behind the range's last record: it
    is a file's last, and the file is a byte shorter than its records with one
    each.
    """
    order = Window.partitionBy("folder").orderBy("file", "start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    of_file = Window.partitionBy("folder", "file")
    last = F.col("start") == F.max("start").over(of_file)
    ranges = summary.join(sizes, "file").withColumns(
        {"range_no": (F.row_number().over(order) - 1).cast("bigint"), "closed": ~(last & (F.sum("bytes").over(of_file) > F.col("size")))}
    )
    toggles = F.element_at("ways", F.when(F.col("closed"), 1).otherwise(3))["inside"].cast("int")
    ranges = ranges.withColumn("inside", F.coalesce(F.sum(toggles).over(before), F.lit(0)) % 2 == 1)
    way = F.element_at("ways", F.when(F.col("inside"), 2).otherwise(1) + F.when(F.col("closed"), 0).otherwise(2))
    read = ranges.withColumn("way", way).withColumn("depth", F.coalesce(F.sum("way.depth").over(before), F.lit(0)))
    begins = (F.col("way.graph") + F.col("depth")).eqNullSafe(F.lit(1))
    read = read.withColumn("begins", begins.cast("int")).withColumn("begun", F.coalesce(F.sum("begins").over(before), F.lit(0)))
    ends = ((F.col("begins") == 1) & (F.col("way.low_after") + F.col("depth") <= 1)) | (
        (F.col("begun") > 0) & (F.col("way.low") + F.col("depth") <= 1)
    )
    read = read.withColumn("ended", F.coalesce(F.sum(ends.cast("int")).over(before), F.lit(0)))
    in_graph = (F.col("begun") > 0) & (F.col("ended") == 0)
    return read.select("folder", "file", "start", "range_no", "inside", "depth", in_graph.alias("in_graph"), "closed")


# --- entities -----------------------------------------------------------------

PIECES = "folder string, range_no bigint, seq bigint, kind string, text string"


class Cutter:
    """Cuts the records of a range into entities, parts of them, and what stands around the graph."""

    def __init__(self, inside: bool, depth: int, in_graph: bool):
        self.inside, self.depth, self.in_graph = inside, depth, in_graph
        self.open: list[bytes] = []  # what is read of the entity, or of the frame, so far
        self.size = 0  # of the frame
        self.part = in_graph and (depth > 2 or inside)  # of an entity that begins before
        self.out: list[tuple[str, bytes]] = []

    def emit(self, kind: str) -> None:
        if text := b"".join(self.open):
            self.out.append((kind, text))
        self.open, self.size = [], 0

    def read(self, record: bytes, closed: bool = True) -> None:
        if not self.in_graph and b'"@graph"' in record:
            at = next((at for at, depth in graphs(record, self.inside, self.depth) if depth == 1), None)
            if at is not None:
                self.open.append(record[:at])
                self.emit("frame")
                self.in_graph, self.inside, self.depth = True, False, 2
                record = record[at:]
        text = record + CLOSED if closed else record
        found, ends_inside = brackets(record, self.inside, closed)
        if self.in_graph and self.depth == 2 and not self.inside:
            at = PLAIN.match(text).end()
            self.between(text[:at])
            text = text[at:]
            self.in_graph = found[:1] != b"]"
        self.open.append(text)
        self.depth, self.inside = depths(found, self.depth)[0], ends_inside
        if not self.in_graph:
            self.size += len(text)
            if self.size > FRAME_PIECE:
                self.emit("frame")
        elif self.depth == 2 and not self.inside:
            self.emit("head" if self.part else "entity")
            self.part = False

    def between(self, text: bytes) -> None:
        """Between entities there should be commas only; anything else counts as an entity that is none."""
        for stray in text.split(b","):
            if stray.strip():
                self.out.append(("entity", stray.strip()))

    def end(self) -> None:
        self.emit("frame" if not self.in_graph else "middle" if self.part else "tail")


def pieces(begun: dict[tuple[str, str, int], tuple]):
    """Entities, parts of those that ranges cut (head, middle, tail) and frames, in the order of ``seq``."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["folder", "range_no", "seq", "kind", "text"]
        for range_, records in ranges(batches):
            if range_ not in begun:
                raise ValueError(f"{range_[1]} is cut into other ranges than before; keep spark.sql.files settings as they were")
            range_no, inside, depth, in_graph, closed = begun[range_]
            cutter, seq = Cutter(inside, depth, in_graph), 0

            def rows(cutter=cutter, folder=range_[0], range_no=range_no):
                nonlocal seq
                n = len(cutter.out)
                kinds, texts = zip(*cutter.out, strict=True)
                cutter.out = []
                seq += n
                columns = [[folder] * n, [range_no] * n, range(seq - n, seq), kinds, [t.decode("utf-8", "replace") for t in texts]]
                return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

            for record, last in with_last(records):
                cutter.read(record, closed or not last)
                if len(cutter.out) >= 1024:
                    yield rows()
            cutter.end()
            if cutter.out:
                yield rows()

    return made


def scan_documents(spark: SparkSession, path: str | list[str], folders: bool = False) -> dict[str, DataFrame]:
    """Entities and frames of the documents at ``path``.

    ``entities`` (document, entity_no, text) has a row per entity in the order
    of ``entity_no``, which may have gaps; ``frames`` (document, text) is each
    document without its graph. A document is named by its file's URI, or,
    with ``folders``, by that of its folder, whose files it is cut into.
    """
    file = F.col("_metadata.file_path")
    document = F.regexp_replace(file, "/[^/]*$", "") if folders else file
    records = (
        spark.read.option("lineSep", CLOSED.decode())
        .text(path)
        .select(F.col("value").cast("binary").alias("record"), document.alias("folder"), file.alias("file"), F.col("_metadata.file_block_start").alias("start"))
    )
    sizes = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"), F.col("length").alias("size"))
    rows = states(records.mapInArrow(summaries, SUMMARY), sizes).collect()  # a row per byte range
    begun = {(r["folder"], r["file"], r["start"]): (r["range_no"], r["inside"], r["depth"], r["in_graph"], r["closed"]) for r in rows}
    cut = records.mapInArrow(pieces(begun), PIECES).withColumn("place", F.shiftleft("range_no", 32) + F.col("seq"))

    parts = cut.filter("kind IN ('head', 'middle', 'tail')")
    order = Window.partitionBy("folder").orderBy("place")  # two rows a range at most
    owner = F.last(F.when(F.col("kind") == "tail", F.col("place")), ignorenulls=True).over(order)
    gathered = parts.withColumn("owner", F.coalesce(owner, F.lit(0))).groupBy("folder", "owner")
    put_together = gathered.agg(joined_in_order().alias("text")).select("folder", F.col("owner").alias("entity_no"), "text")
    entities = cut.filter("kind = 'entity'").select("folder", F.col("place").alias("entity_no"), "text").unionByName(put_together)

    frames = cut.filter("kind = 'frame'").withColumn("size", F.length("text"))
    sizes = frames.groupBy("folder").agg(F.sum("size").alias("all"))
    small = frames.join(sizes.filter(F.col("all") <= LARGEST_FRAME), "folder")
    framed = small.groupBy("folder").agg(joined_in_order().alias("text"))
    too_large = sizes.filter(F.col("all") > LARGEST_FRAME).select("folder", F.lit(None).cast("string").alias("text"))
    return {
        "entities": entities.withColumnRenamed("folder", "document"),
        "frames": framed.unionByName(too_large).withColumnRenamed("folder", "document"),
    }


def joined_in_order() -> Column:
    rows = F.array_sort(F.collect_list(F.struct("place", "text")))
    return F.array_join(F.transform(rows, lambda r: r["text"]), "")


def read_graph_files(spark: SparkSession, path: str | list[str], graph_id: Column | None = None, folders: bool = False) -> dict[str, DataFrame]:
    """What ``read_graph`` gives, from files of any size; ``graph_id`` names a graph by its ``document``."""
    scanned = scan_documents(spark, path, folders)
    name = (F.col("document") if graph_id is None else graph_id).alias("graph_id")
    texts = scanned["entities"].select(name, "entity_no", "text", F.try_parse_json("text").alias("entity"))
    frames = scanned["frames"].select(name, "text")
    read = read_entities(texts.filter("entity IS NOT NULL").select("graph_id", "entity_no", "entity"))
    without_id = F.try_variant_get("entity", "$['@id']", "string").isNull()
    reason = F.when(F.col("entity").isNull(), "does not parse").when(without_id, "no @id")
    entities = texts.select("graph_id", "entity_no", reason.alias("reason")).filter("reason IS NOT NULL")
    return {
        "nodes": read["nodes"].select(*NODE_COLS),
        "props": read["props"],
        "roots": find_roots(read["nodes"], read["props"]),
        "prefixes": context_prefixes(frames),
        "rejected": without_graph(frames).withColumn("entity_no", F.col("entity_no").cast("bigint")).unionByName(entities),
    }
