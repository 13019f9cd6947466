"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors are turned by a fixed random rotation and cut into blocks of few
dimensions. If two of them lie within a squared distance, then in at least one
block they lie within the block's proportional share of it. Each block is
therefore joined by range under its share, and the pairs found are verified on
the whole vectors. A pair that several blocks find counts in the first of them.

The range join lays a grid over the first coordinates of a block. A vector
sits in its cell and visits the cells, earlier in order, that its range
touches; a pair so meets in one cell. Cells with many rows are cut into chunks
that meet two by two in tasks of their own. Equal vectors are joined once,
with their number. Links are counted and thinned to a spanning forest where
they are found, so pairs never become rows.

Only vectors with one label and one length are compared. Vectors without label,
null, empty, zero, or with null or non-finite components link with nothing. Rows that
repeat an id count as vectors of their own under one id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.components import components, spanning_forest
from cairn.plans.scale import staged

BLOCK = 8  # dimensions of a block
GRID = 3  # coordinates of a block that the grid divides
WIDTH = 4.0  # of a cell, in ranges
CHUNK = 4096  # rows of a cell that one task compares with as many others
SEED = 7


@lru_cache(maxsize=8)
def rotation(dimensions: int) -> np.ndarray:
    turned, _ = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dimensions, dimensions)))
    return turned


def blocks(dimensions: int) -> list[slice]:
    return [slice(i, min(i + BLOCK, dimensions)) for i in range(0, dimensions, BLOCK)]


def units(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def share(part: slice, dimensions: int, cosine: float) -> float:
    """A block's part of the squared distance of unit vectors, and room for rounding."""
    return (2 - 2 * cosine) * (part.stop - part.start) / dimensions + 1e-12


def cells_of(points: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(positions, cells, whether they visit): own cells, then earlier ones within reach."""
    grid = points[:, :GRID]
    width = WIDTH * reach
    own, low, high = (np.floor(x / width).astype("int64") for x in (grid, grid - reach, grid + reach))
    yield np.arange(len(points)), own, False
    steps = np.stack(np.meshgrid(*[[-1, 0, 1]] * grid.shape[1], indexing="ij"), axis=-1).reshape(-1, grid.shape[1])
    for step in steps[: len(steps) // 2]:  # in order, those before the cell itself
        cell = own + step
        at = np.flatnonzero(((cell >= low) & (cell <= high)).all(axis=1))
        if len(at):
            yield at, cell[at], True


def packed(cells: np.ndarray) -> np.ndarray:
    """One number per cell; coordinates of unit vectors give few cells each way."""
    code = np.zeros(len(cells), dtype="int64")
    for column in cells.T:
        code = code * (1 << 20) + (column + (1 << 19))
    return code


PLACE = [("label", "int64"), ("block", "int32"), ("cell", "int64"), ("visits", "bool"), ("rep", "int64"), ("n", "int64")]


def places(cosine: float, whole: bool):
    """Rows of vectors in their cells, with or without the vectors."""
    schema = pa.schema(PLACE + [("vector", "binary")] * whole)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("vector").to_pylist()
            length = np.array([len(v) for v in raw])
            label, rep, n = (np.asarray(batch.column(c)) for c in ("label", "rep", "n"))
            for size in np.unique(length):
                at = np.flatnonzero(length == size)
                dimensions = int(size) // 8
                points = units(np.frombuffer(b"".join(raw[i] for i in at), dtype="<f8").reshape(-1, dimensions)) @ rotation(dimensions)
                for block, part in enumerate(blocks(dimensions)):
                    reach = np.sqrt(share(part, dimensions, cosine))
                    for some, cells, visits in cells_of(points[:, part], reach):
                        rows = at[some]
                        columns = [label[rows], np.full(len(rows), dimensions * 1000 + block), packed(cells), np.full(len(rows), visits), rep[rows], n[rows]]
                        arrays = [pa.array(c, t) for c, (_, t) in zip(columns, PLACE, strict=True)]
                        if whole:
                            arrays.append(batch.column("vector").take(pa.array(rows)))
                        yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return placed


def links_in_cell(plain, points, block, visits, same_chunk, first, second, cosine) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of ``first`` x ``second`` that this block is the first to find, verified on the vectors as they were before the rotation."""
    dimensions = points.shape[1]
    parts = blocks(dimensions)
    here = parts[block]
    limit = share(here, dimensions, cosine)
    coordinates = points[:, here]
    square = (coordinates * coordinates).sum(axis=1)
    step = 1024
    for a in range(0, len(first), step):
        i = first[a : a + step]
        for b in range(a if same_chunk else 0, len(second), step):
            j = second[b : b + step]
            apart = square[i][:, None] + square[j][None, :] - 2 * (coordinates[i] @ coordinates[j].T)
            x, y = np.nonzero(apart <= limit + 1e-9)
            if same_chunk and a == b:
                x, y = x[x < y], y[x < y]
            p, q = i[x], j[y]
            near = ~(visits[p] & visits[q])
            p, q = p[near], q[near]
            for c in range(0, len(p), 1 << 16):
                u, v = p[c : c + (1 << 16)], q[c : c + (1 << 16)]
                good = (plain[u] * plain[v]).sum(axis=1) >= cosine
                u, v = u[good], v[good]
                gap = (points[u] - points[v]) ** 2
                good = gap[:, here].sum(axis=1) <= limit
                for part in parts[:block]:
                    good &= gap[:, part].sum(axis=1) > share(part, dimensions, cosine)
                yield u[good], v[good]


FOUND = "a bigint, b bigint, n bigint"


def linked(cosine: float):
    """Of a task's cells: (a, b, null) links of a forest, (a, null, n) numbers of linked vectors."""
    schema = pa.schema([("a", "int64"), ("b", "int64"), ("n", "int64")])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not sum(batch.num_rows for batch in batches):
            return
        table = pa.Table.from_batches(batches).sort_by([(c, "ascending") for c in ("label", "block", "cell", "i", "j")])
        keys = np.stack([np.asarray(table.column(c)).astype("int64") for c in ("label", "block", "cell", "i", "j")])
        borders = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0), [True]]))
        visits, rep, n, chunk = (np.asarray(table.column(c)) for c in ("visits", "rep", "n", "chunk"))
        for lo, hi in zip(borders[:-1], borders[1:], strict=True):
            if hi - lo < 2 or visits[lo:hi].all():
                continue
            _, block, _, i, j = keys[:, lo]
            dimensions = int(block) // 1000
            raw = b"".join(table.column("vector").slice(lo, hi - lo).to_pylist())
            plain = units(np.frombuffer(raw, dtype="<f8").reshape(-1, dimensions))
            points = plain @ rotation(dimensions)
            first, second = np.flatnonzero(chunk[lo:hi] == i), np.flatnonzero(chunk[lo:hi] == j)
            a = b = np.zeros(0, dtype="int64")
            degree = np.zeros(hi - lo, dtype="int64")
            for u, v in links_in_cell(plain, points, int(block) % 1000, visits[lo:hi], i == j, first, second, cosine):
                np.add.at(degree, u, n[lo:hi][v])
                np.add.at(degree, v, n[lo:hi][u])
                a, b = np.concatenate([a, u]), np.concatenate([b, v])
                if len(a) > 1 << 19:
                    keep = spanning_forest(hi - lo, a, b)
                    a, b = a[keep], b[keep]
            keep = spanning_forest(hi - lo, a, b)
            a, b, own = rep[lo:hi][a[keep]], rep[lo:hi][b[keep]], np.flatnonzero(degree)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), "int64")], schema=schema)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep[lo:hi][own]), pa.nulls(len(own), "int64"), pa.array(degree[own])], schema=schema
            )

    return found


def near_vectors(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.98
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    values = F.col(vector).cast("array<double>")
    fit = F.coalesce(
        F.col(label).isNotNull()
        & (F.size(values) > 0)
        & F.forall(values, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is above infinity
        & F.exists(values, lambda x: x != 0),
        F.lit(False),
    )
    rows = staged(
        vectors.select(
            F.col(id).cast("bigint").alias("vec_id"),
            F.col(label).cast("bigint").alias("label"),
            F.when(fit, F.transform(values, lambda x: x + F.lit(0.0))).alias("values"),  # one zero
        )
    )
    known = rows.filter("values IS NOT NULL")
    groups = staged(
        known.groupBy("label", "values").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("row", F.monotonically_increasing_id())
    )
    bytes_of = groups.mapInArrow(to_bytes, "label bigint, rep bigint, n bigint, vector binary")
    key = ["label", "block", "cell"]
    place = "label bigint, block int, cell bigint, visits boolean, rep bigint, n bigint"
    wide = (
        bytes_of.mapInArrow(places(cosine, False), place)
        .groupBy(*key)
        .agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
        .filter("chunks > 1")
    )
    rows_in_cells = bytes_of.mapInArrow(places(cosine, True), place + ", vector binary").join(staged(wide), key, "left")
    chunks = F.coalesce("chunks", F.lit(1))
    cut = rows_in_cells.withColumn("chunk", F.pmod(F.xxhash64("rep", "vector"), chunks).cast("int"))
    partners = F.transform(
        F.sequence(F.lit(0), chunks - 1),
        lambda other: F.struct(F.least("chunk", other).alias("i"), F.greatest("chunk", other).alias("j")),
    )
    meeting = cut.withColumn("meet", F.explode(partners)).select(*key, "visits", "rep", "n", "vector", "meet.i", "meet.j", "chunk")
    found = staged(meeting.repartition(*key, "i", "j").mapInArrow(linked(cosine), FOUND))
    degrees = found.filter("b IS NULL").groupBy("a").agg(F.sum("n").alias("links"))
    classes = components(found.filter("b IS NOT NULL").select("a", "b"))
    told = staged(
        groups.join(degrees, F.col("rep") == F.col("a"), "left")
        .join(classes, F.col("rep") == F.col("id"), "left")
        .select(
            "label",
            "values",
            (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    joined = known.join(told, ["label", "values"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("values IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("values")
        flat, ends = np.asarray(lists.flatten()), np.cumsum(np.asarray(lists.value_lengths()))
        vectors = [x.tobytes() for x in np.split(flat.astype("<f8"), ends[:-1])]
        names = ["label", "rep", "n", "vector"]
        yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("rep"), batch.column("n"), pa.array(vectors, "binary")], names)
