"""Substring deduplication with fixed-block anchors.

Every document is cut into blocks of ten words that do not overlap; the blocks
are the index. Any twenty words in a row hold a whole block, wherever they
begin, so a passage that stands in two places is met when every rolling window
of ten words probes the index. Hits are extended to twenty-word windows, and
windows that stand earlier as well run together to maximal repeats, whose
words go.

Documents are written once as *chunks*: rows of many documents, their words as
numbers into the chunk's own list of distinct words. The table is bucketed by
chunk, so the three passes over it need no shuffle of words.

1. *Probe.* A chunk sorts its rolling windows' hashes and sends each once to
   the bucket that its leading bits name: 31 bits more and whether the window
   is a block somewhere in the chunk. A bucket answers each chunk which of its
   windows stand in another chunk too, with a block among them. What repeats
   within a chunk needs no answer.
2. *Extend.* Only the twenty-word windows around hits go on: each chunk sends
   those that differ once, with 64 bits beyond the bucket's and the first place
   at which it has them. A bucket answers which of them begin in an earlier place.
3. *Cut.* A window goes if the answer says so or if the chunk has it earlier.

A hash in steps 1 and 2 stands for its words; in step 1 a false hit only costs
work, as step 2 decides. A chunk sends a window once, however many documents
share the passage, so a frequent passage makes a row of work per chunk and no
bucket holds more than that; chunks hold ``CHUNK`` words or one document.

Words are cut at the bytes 0x20 and 0x09 to 0x0D and compared as they are. A null
text has no words. Documents with equal ids rank by where the chunks have
them; a null id ranks last. Text ids are not supported (cast to bigint).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.plans.scale import staged, staged_by

WINDOW, BLOCK = 20, 10  # words; a window holds a whole block as 2 * BLOCK - 1 < WINDOW
CHUNK = 1 << 18  # words of a chunk at least, but for the last of a task
BUCKET = 1 << 21  # windows that a bucket of probes has, about
PROBE, EXTEND = 1, 2  # the two kinds of answers
LAST = np.iinfo("int64").max  # rank of a null id

# --- words and windows --------------------------------------------------------

ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))  # any odd numbers, a hash each


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of each number; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(words: np.ndarray, size: int, odd: np.uint64 = ODD[0]) -> np.ndarray:
    """A hash of the ``size`` words from each position that has so many."""
    total = np.zeros(max(len(words) - size + 1, 0), dtype="uint64")
    for k in range(size):
        total = total * odd + words[k : k + len(total)]
    return mixed(total)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by the leading bits, so that they ascend with the hashes."""
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype("int64")


class Distinct:
    """Sorted rows' runs of equal values: where each begins, and the run of each row."""

    def __init__(self, *sorted_columns: np.ndarray):
        n = len(sorted_columns[0])
        new = np.zeros(n, dtype=bool)
        new[:1] = True
        for c in sorted_columns:
            new[1:] |= c[1:] != c[:-1]
        self.first = np.flatnonzero(new)
        self.size = np.diff(np.append(self.first, n))
        self.of = np.cumsum(new) - 1


class Chunk:
    """Documents of one row, their words as hashes."""

    def __init__(self, table: pa.Table):
        self.ids = table.column("doc_ids")[0].values
        self.sizes = table.column("sizes")[0].values.to_numpy()
        self.spelt = table.column("words")[0].values
        self.line = table.column("line")[0].values.to_numpy()
        known = [xxhash.xxh3_64_intdigest(w) for w in self.spelt.to_pylist()]
        self.words = np.array(known, dtype="uint64")[self.line]
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        ends = np.cumsum(self.sizes)
        self.room = ends[self.doc] - np.arange(len(self.line))  # words from here to the document's end
        self.offset = np.arange(len(self.line)) - (ends - self.sizes)[self.doc]

    def places(self, size: int) -> np.ndarray:
        """Where windows of ``size`` words begin."""
        return np.flatnonzero(self.room >= size)

    def rolled(self):
        """Rolling windows of a block's size: places, in the order of hashes, and the runs of equal ones."""
        at = self.places(BLOCK)
        hashes = rolling(self.words, BLOCK)[at]
        order = np.argsort(hashes, kind="stable")
        return at[order], hashes[order], Distinct(hashes[order])

    def candidates(self, answers: pa.Table, buckets: int):
        """Windows around hits, by hashes and place: places, both hashes and the runs of equal ones."""
        at, hashes, runs = self.rolled()
        hit = runs.size > 1
        marked(hit, hashes[runs.first], answers, PROBE, buckets)
        seen = np.zeros(len(self.line) + 1, dtype="int64")
        seen[at + 1] = hit[runs.of]
        seen = np.cumsum(seen)
        at = self.places(WINDOW)
        at = at[seen[at + WINDOW - BLOCK + 1] > seen[at]]
        a, b = (rolling(self.words if odd is ODD[0] else mixed(self.words), WINDOW, odd)[at] for odd in ODD)
        ids = self.ids.fill_null(LAST).to_numpy()
        rank = np.empty(len(ids), dtype="int64")
        rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        order = np.lexsort((at, rank[self.doc[at]], b, a))
        at, a, b = at[order], a[order], b[order]
        return at, a, b, Distinct(a, b), ids


def marked(flags: np.ndarray, hashes: np.ndarray, answers: pa.Table, kind: int, buckets: int) -> None:
    """Set the flags of those ascending hashes that the answers name by their place in a bucket."""
    starts = np.searchsorted(bucket_of(hashes, buckets), np.arange(buckets))
    for bucket, of, places in zip(*(answers.column(c).to_pylist() for c in ("bucket", "kind", "places")), strict=True):
        if of == kind:
            flags[starts[bucket] + np.frombuffer(places, "<u4")] = True


def by_bucket(chunk: int, hashes: np.ndarray, buckets: int, **columns: np.ndarray) -> pa.Table:
    """A row per bucket that has any of the ascending hashes, with its share of the columns."""
    cuts = np.searchsorted(bucket_of(hashes, buckets), np.arange(buckets + 1))
    used = np.flatnonzero(cuts[1:] > cuts[:-1])
    parts = {n: pa.array([c[cuts[k] : cuts[k + 1]].tobytes() for k in used], "binary") for n, c in columns.items()}
    return pa.table({"bucket": pa.array(used, "int32"), "chunk": pa.array(np.full(len(used), chunk), "int64"), **parts})


def answers_to(table: pa.Table, kind: int, row: np.ndarray, place: np.ndarray) -> pa.Table:
    """Places that are answered, a row per row of the bucket that has any; sorted by row and place."""
    order = np.lexsort((place, row))
    row, place = row[order], place[order].astype("<u4")
    used, first = np.unique(row, return_index=True)
    cuts = np.append(first, len(row))
    parts = [place[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    picked = table.select(["chunk", "bucket"]).take(pa.array(used, "int64"))
    return picked.append_column("kind", pa.array(np.full(len(used), kind), "int32")).append_column("places", pa.array(parts, "binary"))


def joined(table: pa.Table, name: str, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A binary column as one array, with each entry's row and its place there."""
    parts = [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    sizes = np.array([len(x) for x in parts])
    row = np.repeat(np.arange(len(parts)), sizes)
    return np.concatenate(parts), row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


# --- tables -------------------------------------------------------------------

CHUNKS = "chunk bigint, n bigint, doc_ids array<bigint>, sizes array<int>, words array<binary>, line array<int>"
ANSWERS = "chunk bigint, bucket int, kind int, places binary"
KEPT = "doc_id bigint, n_words bigint, n_removed bigint, kept string, repeats array<struct<begin:int,end:int>>"


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as chunks, each a row of its own batch."""
    schema = pa.schema(
        [("chunk", "int64"), ("n", "int64"), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("words", pa.list_(pa.binary())), ("line", pa.list_(pa.int32()))]
    )
    made, ids, sizes, number, lines, n = 0, [], [], {}, [], 0

    def row() -> pa.RecordBatch:
        chunk = (TaskContext.get().partitionId() << 32) + made
        line = np.concatenate(lines) if lines else np.zeros(0, dtype="int32")
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((chunk, n, ids, sizes, list(number), line), schema.types, strict=True)], schema=schema)

    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            words = (text.as_py() or b"").split()
            for w in words:
                number.setdefault(w, len(number))
            lines.append(np.fromiter(map(number.__getitem__, words), "int32", len(words)))
            ids.append(doc_id.as_py())
            sizes.append(len(words))
            n += len(words)
            if n >= CHUNK:
                yield row()
                made, ids, sizes, number, lines, n = made + 1, [], [], {}, [], 0
    if ids:
        yield row()


def probe(buckets: int):
    def of_chunk(table: pa.Table) -> pa.Table:
        chunk = Chunk(table)
        at, hashes, runs = chunk.rolled()
        whole = np.zeros(len(runs.first), dtype=bool)
        whole[runs.of[chunk.offset[at] % BLOCK == 0]] = True  # a block of the index
        sent = ((hashes[runs.first] & np.uint64(0x7FFFFFFF)) << np.uint64(1)) | whole
        return by_bucket(table.column("chunk")[0].as_py(), hashes[runs.first], buckets, sent=sent.astype("<u4"))

    return of_chunk


def met(table: pa.Table) -> pa.Table:
    """Of a bucket's windows those that chunks share, one of them as a block."""
    sent, row, place = joined(table, "sent", "<u4")
    order = np.argsort(sent, kind="stable")
    runs = Distinct(sent[order] >> np.uint32(1))
    block = np.logical_or.reduceat((sent[order] & np.uint32(1)).astype(bool), runs.first) if len(sent) else np.zeros(0, dtype=bool)
    hit = order[((runs.size > 1) & block)[runs.of]]
    return answers_to(table, PROBE, row[hit], place[hit])


def extend(buckets: int):
    def of_chunk(table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(table)
        at, a, b, runs, ids = chunk.candidates(answers, buckets)
        first = runs.first
        return by_bucket(table.column("chunk")[0].as_py(), a[first], buckets, sent=b[first], ids=ids[chunk.doc[at[first]]])

    return of_chunk


def earlier(table: pa.Table) -> pa.Table:
    """Of a bucket's windows all but the first of each kind."""
    sent, row, place = joined(table, "sent", "<u8")
    ids, _, _ = joined(table, "ids", "<i8")
    order = np.lexsort((table.column("chunk").to_numpy()[row], ids, sent))
    runs = Distinct(sent[order])
    late = np.ones(len(order), dtype=bool)
    late[runs.first] = False
    return answers_to(table, EXTEND, row[order[late]], place[order[late]])


def cut(buckets: int):
    def of_chunk(table: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Chunk(table)
        at, a, _, runs, _ = chunk.candidates(answers, buckets)
        goes = np.ones(len(at), dtype=bool)
        goes[runs.first] = False
        late = np.zeros(len(runs.first), dtype=bool)
        marked(late, a[runs.first], answers, EXTEND, buckets)
        goes[runs.first[late]] = True
        depth = np.zeros(len(chunk.line) + 1, dtype="int64")
        np.add.at(depth, at[goes], 1)
        np.add.at(depth, at[goes] + WINDOW, -1)
        gone = np.cumsum(depth)[:-1] > 0
        removed = np.bincount(chunk.doc[gone], minlength=len(chunk.sizes))
        fresh = chunk.offset == 0  # repeats of two documents may touch
        begins = np.flatnonzero(gone & (fresh | ~np.append(False, gone[:-1])))
        ends = np.flatnonzero(gone & (np.append(fresh[1:], True) | ~np.append(gone[1:], False))) + 1
        spelt = np.array(chunk.spelt.to_pylist(), dtype=object)
        bounds = np.concatenate([[0], np.cumsum(chunk.sizes)])
        kept, spans = [], [[] for _ in chunk.sizes]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            kept.append(b" ".join(spelt[chunk.line[lo:hi][~gone[lo:hi]]].tolist()).decode())
        for lo, hi in zip(begins, ends, strict=True):
            base = bounds[chunk.doc[lo]]
            spans[chunk.doc[lo]].append({"begin": int(lo - base), "end": int(hi - base)})
        kinds = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        return pa.table(
            {"doc_id": chunk.ids, "n_words": pa.array(chunk.sizes, "int64"), "n_removed": pa.array(removed, "int64"), "kept": pa.array(kept, "string"), "repeats": pa.array(spans, kinds)}
        )

    return of_chunk


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, ``kept`` (words joined by a blank) and ``repeats``: the words that go, as ranges."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    picked = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    chunks = staged_by(picked.mapInArrow(packed, CHUNKS), ["chunk"], tasks)
    words = chunks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(-(-words // BUCKET), tasks)
    probes = chunks.groupBy("chunk").applyInArrow(probe(buckets), "bucket int, chunk bigint, sent binary")
    hits = staged(probes.groupBy("bucket").applyInArrow(met, ANSWERS))
    windows = chunks.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(extend(buckets), "bucket int, chunk bigint, sent binary, ids binary")
    late = staged(windows.groupBy("bucket").applyInArrow(earlier, ANSWERS))
    return chunks.groupBy("chunk").cogroup(hits.unionByName(late).groupBy("chunk")).applyInArrow(cut(buckets), KEPT)
