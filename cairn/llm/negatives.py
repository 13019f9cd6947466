"""Hard-negative mining: exact integer scores by Strassen products, then mergeable heaps.

Anchors and candidates are cut into stripes of bounded size, and a cell is a
pair of stripes; a cell's scores are made tile by tile and never leave it. Of
a cell each anchor keeps only its best few, and such heaps merge: the best of
two heaps' entries are the best of all that went in. Anchors meet all
candidates, which the question asks for; a stripe of candidates is copied once
per stripe of anchors, and nothing is broadcast.

The first round makes the positives in cells of one label, however many rows
a label has; the second looks for negatives in the windows below them.

Tiles are multiplied by Strassen's recursion on int64 with zero padding. All
its steps are ring operations modulo 2**64, so a score that fits in int64 is
exact whatever happens on the way; components must fit too.

Rows with a null id, a null label, a null vector or a null or non-finite
component take no part. Of several rows of an id the least by label and
vector counts. Shorter vectors count as padded with zeros; an empty vector
scores 0. Equal scores rank by the smaller id.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.plans.scale import staged

POSITIVES, NEGATIVES = 5, 3  # kept per anchor, and per anchor and positive
STRIPE = 1 << 20  # numbers in a stripe of vectors
LEAST = 1 << 10  # rows that a stripe has at least, so that few rows make few cells
TILE = (512, 2048)  # anchors and candidates of a tile
CUTOFF = 16  # a side this short is multiplied directly
NONE = np.iinfo("int64").min  # no score

# --- inside a task ------------------------------------------------------------


def padded(x: np.ndarray, rows: int, columns: int) -> np.ndarray:
    if x.shape == (rows, columns):
        return x
    out = np.zeros((rows, columns), dtype="int64")
    out[: x.shape[0], : x.shape[1]] = x
    return out


def direct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` as a sum of outer products, which numpy adds faster than it multiplies int64 matrices."""
    c = np.zeros((a.shape[0], b.shape[1]), dtype="int64")
    part = np.empty_like(c)
    for k in range(a.shape[1]):
        np.multiply(a[:, k : k + 1], b[k : k + 1], out=part)
        c += part
    return c


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b`` of int64 matrices with seven products of halves instead of eight."""
    m, k, n = *a.shape, b.shape[1]
    if min(m, k, n) <= CUTOFF:
        return direct(a, b)
    hm, hk, hn = (m + 1) // 2, (k + 1) // 2, (n + 1) // 2
    a, b = padded(a, 2 * hm, 2 * hk), padded(b, 2 * hk, 2 * hn)
    a11, a12, a21, a22 = a[:hm, :hk], a[:hm, hk:], a[hm:, :hk], a[hm:, hk:]
    b11, b12, b21, b22 = b[:hk, :hn], b[:hk, hn:], b[hk:, :hn], b[hk:, hn:]
    c = np.empty((2 * hm, 2 * hn), dtype="int64")
    p = strassen(a11 + a22, b11 + b22)
    c[:hm, :hn] = p
    c[hm:, hn:] = p
    p = strassen(a21 + a22, b11)
    c[hm:, :hn] = p
    c[hm:, hn:] -= p
    p = strassen(a11, b12 - b22)
    c[:hm, hn:] = p
    c[hm:, hn:] += p
    p = strassen(a22, b21 - b11)
    c[:hm, :hn] += p
    c[hm:, :hn] += p
    p = strassen(a11 + a12, b22)
    c[:hm, :hn] -= p
    c[:hm, hn:] += p
    c[hm:, hn:] += strassen(a21 - a11, b11 + b12)
    c[:hm, :hn] += strassen(a12 - a22, b21 + b22)
    return c[:m, :n]


class Heaps:
    """The best ``size`` (score, id) per row, highest score first, then smallest id."""

    def __init__(self, rows: int, size: int):
        self.score = np.full((rows, size), NONE)
        self.id = np.zeros((rows, size), dtype="int64")

    def push(self, at: slice, score: np.ndarray, ids: np.ndarray) -> None:
        """Merge in a tile's best; ``score`` is used up, ``ids`` of its columns ascend."""
        size, rows = self.score.shape[1], np.arange(len(score))
        found = []
        for _ in range(min(size, score.shape[1])):
            column = score.argmax(axis=1)  # the first of equal scores has the smallest id
            found.append((score[rows, column], ids[column]))
            if (found[-1][0] == NONE).all():
                break
            score[rows, column] = NONE
        scores = np.column_stack([self.score[at], *[s for s, _ in found]])
        held = np.column_stack([self.id[at], *[i for _, i in found]])
        order = np.lexsort((held, ~scores), axis=1)[:, :size]
        self.score[at] = np.take_along_axis(scores, order, axis=1)
        self.id[at] = np.take_along_axis(held, order, axis=1)


def matrix(parts: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows, zeros behind the shorter ones."""
    lists = parts.combine_chunks()
    sizes = np.asarray(lists.value_lengths(), dtype="int64")
    flat = np.asarray(lists.flatten(), dtype="int64")
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype="int64")
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def tiles(anchors: pa.Table, rows: pa.Table, width: int):
    """(anchors' slice, candidates' slice, scores) of all tiles of a cell."""
    a, b = matrix(anchors.column("parts"), width), matrix(rows.column("parts"), width).T.copy()
    for i in range(0, a.shape[0], TILE[0]):
        for j in range(0, b.shape[1], TILE[1]):
            at, of = slice(i, min(i + TILE[0], a.shape[0])), slice(j, min(j + TILE[1], b.shape[1]))
            yield at, of, strassen(a[at], b[:, of])


def positives_in_cell(width: int):
    def cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")
        ids, own = column(rows, "vec_id"), column(anchors, "vec_id")
        heaps = Heaps(len(own), POSITIVES)
        for at, of, scores in tiles(anchors, rows, width):
            scores[own[at, None] == ids[None, of]] = NONE
            heaps.push(at, scores, ids[of])
        held = heaps.score != NONE
        anchor = np.broadcast_to(own[:, None], held.shape)[held]
        return pa.table({"anchor_id": anchor, "positive_id": heaps.id[held], "score": heaps.score[held]})

    return cell


def negatives_in_cell(width: int):
    def cell(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("vec_id")
        ids, labels = column(rows, "vec_id"), column(rows, "label")
        own, own_label = column(anchors, "vec_id"), column(anchors, "label")
        best = anchors.column("positives").combine_chunks()
        sizes = np.asarray(best.value_lengths(), dtype="int64")
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        row = np.repeat(np.arange(len(sizes)), sizes)
        flat = best.flatten()
        positive, score = np.zeros((2, len(own), POSITIVES), dtype="int64")
        positive[row, place], score[row, place] = np.asarray(flat.field("id")), np.asarray(flat.field("score"))
        there = np.arange(POSITIVES) < sizes[:, None]
        low, high = -(-score // 2), score + -score // 20  # half of a score, and nineteen twentieths
        heaps = [Heaps(len(own), NEGATIVES) for _ in range(POSITIVES)]
        for at, of, scores in tiles(anchors, rows, width):
            scores[own_label[at, None] == labels[None, of]] = NONE
            for k in range(POSITIVES):
                inside = (scores >= low[at, k, None]) & (scores <= high[at, k, None]) & there[at, k, None]
                if inside.any():
                    heaps[k].push(at, np.where(inside, scores, NONE), ids[of])
        out = []
        for k in range(POSITIVES):
            held = heaps[k].score != NONE
            spread = lambda x: np.broadcast_to(x[:, None], held.shape)[held]  # noqa: B023, E731
            out.append([spread(own), spread(positive[:, k]), spread(score[:, k]), heaps[k].id[held], heaps[k].score[held]])
        names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        return pa.table(dict(zip(names, map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return cell


# --- tables -------------------------------------------------------------------


def taking_part(vectors: DataFrame, id: str, label: str, vector: str, relabel: Column | None) -> DataFrame:
    """vec_id, label and integer ``parts``, a row per id."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(
        F.col(id).cast("bigint").alias("vec_id"),
        (F.col(label) if relabel is None else relabel).cast("bigint").alias("label"),
        F.when(finite, F.transform(vector, lambda x: F.floor(x.cast("double") * 256))).alias("parts"),
    ).filter("vec_id IS NOT NULL AND label IS NOT NULL AND parts IS NOT NULL")
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "parts")).alias("row")).select("vec_id", "row.*")


def stripes(n: Column, most: int, least: int) -> Column:
    """How many stripes ``n`` rows make: ``most`` rows each, but as many as tasks where there are rows for it."""
    tasks = F.least(F.lit(least), F.ceil(n / LEAST))
    return F.greatest(F.ceil(n / most), tasks, F.lit(1)).cast("int")


def own(rows: DataFrame) -> DataFrame:
    """The same rows with columns of their own, so that a table can meet itself."""
    return rows.select(*[F.col(c).alias(c) for c in rows.columns])


def each(n: Column) -> Column:
    """A row for each of 0 to n - 1."""
    return F.explode(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1))


def first(rows: DataFrame, group: list[str], score: str, id: str, size: int) -> DataFrame:
    """Merge heaps: the best ``size`` rows of each group, with their ``rank``."""
    order = Window.partitionBy(*group).orderBy(F.desc(score), id)
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size)


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    id: str = "vec_id",
    label: str = "label",
    vector: str = "embedding",
    relabel: Column | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on ``vec_id``; ``relabel`` replaces the label.
    """
    rows = staged(taking_part(vectors, id, label, vector, relabel).withColumn("anchor", is_anchor))
    spark = rows.sparkSession
    n, anchors_n, width = rows.agg(
        F.count("*"), F.count_if("anchor"), F.coalesce(F.max(F.size("parts")), F.lit(0))
    ).first()
    most = max(64, STRIPE // max(width, 1))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    per_label = rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors")).filter("anchors > 0")
    cuts = per_label.select(
        "label",
        stripes(F.col("n"), most, max(1, tasks // 8)).alias("of_rows"),
        F.ceil(F.col("anchors") / most).cast("int").alias("of_anchors"),
    )
    placed = rows.join(cuts, "label").withColumn("place", F.xxhash64("vec_id"))
    cell = ["label", "i", "j"]
    left = placed.filter("anchor").select(
        "label", "vec_id", "parts", F.pmod("place", "of_anchors").alias("i"), each(F.col("of_rows")).alias("j")
    )
    right = placed.select(
        "label", "vec_id", "parts", each(F.col("of_anchors")).alias("i"), F.pmod("place", "of_rows").alias("j")
    )
    met = left.groupBy(*cell).cogroup(own(right).groupBy(*cell))
    found = met.applyInArrow(positives_in_cell(width), "anchor_id bigint, positive_id bigint, score bigint")
    positives = (
        first(found, ["anchor_id"], "score", "positive_id", POSITIVES)
        .groupBy("anchor_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", F.col("positive_id").alias("id"), "score"))).alias("positives"))
    )

    of_anchors = max(1, ceil(anchors_n / most))
    of_rows = max(1, ceil(n / most), min(tasks, ceil(n / LEAST)))
    place = F.xxhash64("vec_id")
    left = rows.filter("anchor").join(positives, F.col("vec_id") == F.col("anchor_id")).select(
        "vec_id", "label", "parts", "positives", F.pmod(place, F.lit(of_anchors)).alias("i"), each(F.lit(of_rows)).alias("j")
    )
    right = rows.select(
        "vec_id", "label", "parts", each(F.lit(of_anchors)).alias("i"), F.pmod(place, F.lit(of_rows)).alias("j")
    )
    schema = "anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    found = left.groupBy("i", "j").cogroup(own(right).groupBy("i", "j")).applyInArrow(negatives_in_cell(width), schema)
    return first(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", NEGATIVES).select(
        "anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score"
    )
