"""Ranked lexical search over a length-stratified index.

Documents whose normaliser ``m`` is equal form a stratum. A term's postings
lie by stratum and, within it, by how often the term occurs (tf), so that an
impact is computed once per term, stratum and tf, however many documents share
it. For an item, the sum of its terms' highest impacts in a stratum bounds the
score of every document there; strata are visited from the highest bound down,
and those whose bound is below the tenth best score so far are left out. A
bound equal to it is still visited, as a smaller id may win the tie.

Texts are read once: their lengths and the counts of the items' terms are
staged, the documents' counts as a whole, since a document is a row. Each task
then indexes the rows that it reads, batch by batch, and carries each item's
ten best on from one index to the next; Spark merges the tens of all tasks.
So nothing but those tens is shuffled, and a frequent term, a length that many
documents share or a very long document meet no single task.

Items come in blocks of ``BLOCK`` pairs of item and term (and the rest of the
last item), whose terms and weights are what tasks are sent; every block is
run against all documents.

A null text has no terms; such documents count in neither N nor L. The rows of
one item id are one item, with the terms of all its rows; an item without
terms has no result. Documents with equal ids are ranked each for itself; one
without an id counts in N, L and df, but cannot be named in a result.
Scores are 64-bit integers and exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.plans.scale import number_rows, staged

TOP = 10
BLOCK = 1 << 18  # pairs of item and term that tasks are sent at a time
POSTINGS = 1 << 20  # postings of an index in a task
WAVE = 16  # strata of the first visit; each later one takes twice as many

#: letters and digits stay, A to Z in lower case; other ASCII parts terms, all beyond ASCII belongs to them
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


# --- items --------------------------------------------------------------------


def item_terms(items: DataFrame, id: str, text: str) -> DataFrame:
    """(item, term), once each."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(t))) if t else [] for t in batch.column(1).to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            flat = pa.array([t for f in found for t in f], "binary").cast("string")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), flat], ["item", "term"])

    kind = items.schema[id].dataType.simpleString()
    picked = items.select(F.col(id).alias("item"), F.col(text).cast("binary").alias("text"))
    return picked.mapInArrow(made, f"item {kind}, term string").distinct()


def in_blocks(pairs: DataFrame) -> DataFrame:
    """Give each item's pairs one ``block``, by where the first of them stands among all."""
    numbered = number_rows(pairs, [], ["item", "term"])
    starts = numbered.groupBy("item").agg(F.floor(F.min("row_no") / BLOCK).cast("bigint").alias("block"))
    joined = pairs.join(starts, pairs["item"].eqNullSafe(starts["item"]))
    return staged(joined.select(pairs["item"], "term", "block"))


# --- documents ----------------------------------------------------------------


def counted(docs: DataFrame, vocabulary: list[str], id: str, text: str) -> DataFrame:
    """doc_id, n (all terms), and the counts of the vocabulary's terms: ``terms``, ascending, and ``tfs``."""
    sent = docs.sparkSession.sparkContext.broadcast({t.encode(): k for k, t in enumerate(vocabulary)})

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look_up = sent.value.get
        for batch in batches:
            n, found, owner = np.zeros(batch.num_rows, dtype="int64"), [], []
            for row in range(batch.num_rows):
                text = batch.column(1)[row].as_py()
                words = terms_of(text) if text else []
                n[row] = len(words)
                known = np.fromiter((-1 if k is None else k for k in map(look_up, words)), "int64", len(words))
                terms, tfs = np.unique(known[known >= 0], return_counts=True)
                found.append((terms, tfs))
                owner.append(len(terms))
            offsets = pa.array(np.concatenate([[0], np.cumsum(owner)]), "int32")
            lists = [
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[k] for f in found] or [[]]), "int32"))
                for k in (0, 1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *lists], ["doc_id", "n", "terms", "tfs"])

    picked = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    kind = docs.schema[id].dataType.simpleString()
    return staged(picked.mapInArrow(made, f"doc_id {kind}, n bigint, terms array<int>, tfs array<int>"))


def weights(counts: DataFrame, n_docs: int, size: int) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2df + 1))) of each term of the block."""
    found = counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect()  # a row per term of the block
    df = dict(map(tuple, found))
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(size)], dtype="int64")


# --- the index of a batch -----------------------------------------------------


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all given ranges, one range after another."""
    total = np.cumsum(lengths)
    return np.repeat(starts - (total - lengths), lengths) + np.arange(total[-1] if len(total) else 0)


class Index:
    """Postings of some documents by term, stratum and tf."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weight: np.ndarray):
        self.ids = ids
        self.m, stratum = np.unique(m, return_inverse=True)
        doc = np.repeat(np.arange(len(ids)), sizes)
        useful = weight[terms] > 0  # others add nothing to any score
        doc, terms, tfs = doc[useful], terms[useful], tfs[useful]
        order = np.lexsort((tfs, stratum[doc], terms))
        self.doc, terms, tfs = doc[order], terms[order], tfs[order]
        of = stratum[self.doc]
        edge = np.ones(len(terms), dtype=bool)
        edge[1:] = (terms[1:] != terms[:-1]) | (of[1:] != of[:-1]) | (tfs[1:] != tfs[:-1])
        self.start = np.flatnonzero(edge)  # where a group of one term, stratum and tf begins
        self.length = np.diff(np.append(self.start, len(terms)))
        term, self.stratum, tf = terms[self.start], of[self.start], tfs[self.start]
        self.impact = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * self.m[self.stratum]))
        self.groups = np.searchsorted(term, np.arange(len(weight) + 1))  # a term's groups
        self.highest = np.ones(len(term), dtype=bool)  # the last group of a term and stratum has the highest tf
        self.highest[:-1] = (term[1:] != term[:-1]) | (self.stratum[1:] != self.stratum[:-1])

    def best(self, terms: np.ndarray, held: tuple[np.ndarray, np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``top`` highest (score, id) of these documents and of those held already."""
        first, last = self.groups[terms], self.groups[terms + 1]
        group = ranges(first, last - first)
        bound = np.zeros(len(self.m), dtype="int64")
        peak = group[self.highest[group]]
        np.add.at(bound, self.stratum[peak], self.impact[peak])
        order = np.argsort(-bound, kind="stable")
        at, wave = 0, WAVE
        while at < len(order):
            least = max(1, held[0][-1]) if len(held[0]) == top else 1
            visit = order[at : at + wave]
            visit = visit[bound[visit] >= least]
            if not len(visit):
                break
            held = merged(held, *self.scores(group, visit), least, top)
            at, wave = at + wave, 2 * wave
        return held

    def scores(self, group: np.ndarray, visit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of all documents of the strata visited."""
        chosen = np.zeros(len(self.m), dtype=bool)
        chosen[visit] = True
        group = group[chosen[self.stratum[group]]]
        score = np.zeros(len(self.ids), dtype="int64")
        np.add.at(score, self.doc[ranges(self.start[group], self.length[group])], np.repeat(self.impact[group], self.length[group]))
        found = np.flatnonzero(score)
        return score[found], self.ids[found]


def merged(held, score: np.ndarray, ids: np.ndarray, least: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    good = score >= least
    score, ids = np.concatenate([held[0], score[good]]), np.concatenate([held[1], ids[good]])
    order = np.lexsort((ids, -score))[:top]
    return score[order], ids[order]


def searched(counts: DataFrame, items: list[tuple[object, np.ndarray]], weight: np.ndarray, top: int, kind: str) -> DataFrame:
    """Per task and item the ``top`` best documents: item, doc_id, score."""
    sent = counts.sparkSession.sparkContext.broadcast(([t for _, t in items], weight))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weight = sent.value
        held = [(np.zeros(0, dtype="int64"), np.zeros(0, dtype="int64"))] * len(terms)

        def look(parts: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(parts).combine_chunks()
            lists = rows.column("terms").combine_chunks()
            index = Index(
                rows.column("doc_id").to_numpy(),
                rows.column("m").to_numpy(),
                np.asarray(lists.value_lengths(), dtype="int64"),
                np.asarray(lists.flatten(), dtype="int64"),
                np.asarray(rows.column("tfs").combine_chunks().flatten(), dtype="int64"),
                weight,
            )
            for k, wanted in enumerate(terms):
                held[k] = index.best(wanted, held[k], top)

        waiting, size = [], 0
        for batch in batches:
            waiting.append(batch)
            size += len(batch.column("terms").flatten()) + batch.num_rows
            if size >= POSTINGS:
                look(waiting)
                waiting, size = [], 0
        if waiting:
            look(waiting)
        item = np.repeat(np.arange(len(held)), [len(s) for s, _ in held])
        score, ids = (np.concatenate([h[k] for h in held] or [[]]).astype("int64") for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(ids), pa.array(score)], ["place", "doc_id", "score"])

    found = counts.mapInArrow(made, "place bigint, doc_id bigint, score bigint")
    names = counts.sparkSession.createDataFrame([(k, i) for k, (i, _) in enumerate(items)], f"place bigint, item {kind}")
    return found.join(names, "place").select("item", "doc_id", "score")


# --- the whole search ---------------------------------------------------------


def search(
    docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = TOP
) -> DataFrame:
    """Each item's ``top`` best documents: item_id, rank, doc_id, score. Document ids are bigint."""
    spark: SparkSession = docs.sparkSession
    docs = docs.withColumn(id, F.col(id).cast("bigint"))
    kind = items.schema[item].dataType.simpleString()
    pairs = in_blocks(item_terms(items, item, item_text))
    blocks = [r["block"] for r in pairs.select("block").distinct().orderBy("block").collect()]
    out = None
    for block in blocks:
        mine = pairs.filter(F.col("block") == block).select("item", "term").collect()  # BLOCK rows and the rest of an item
        vocabulary = sorted({r["term"] for r in mine})
        number = {t: k for k, t in enumerate(vocabulary)}
        wanted: dict[object, list[int]] = {}
        for r in mine:
            wanted.setdefault(r["item"], []).append(number[r["term"]])
        counts = counted(docs, vocabulary, id, text)
        n_docs, total = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            break
        weight = weights(counts, n_docs, len(vocabulary))
        m = F.lit(10) + F.expr(f"CAST((CAST(90 * n AS DECIMAL(20, 0)) * {n_docs}BD) div {total}BD AS BIGINT)")
        rows = counts.filter(F.size("terms") > 0).select("doc_id", m.cast("bigint").alias("m"), "terms", "tfs")
        rows = rows.filter("doc_id IS NOT NULL")
        found = searched(rows, [(i, np.array(sorted(t), dtype="int64")) for i, t in wanted.items()], weight, top, kind)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"item {kind}, doc_id bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select(F.col("item").alias("item_id"), F.col("rank").cast("int"), "doc_id", "score")
