"""Connected components of links, as Spark jobs, and spanning forests inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.plans.scale import staged

EDGE = "a bigint, b bigint"


def merged(of: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels once the components ``of`` the ends of edges are joined; the smallest label stays."""
    x, y, parent = of[a], of[b], np.arange(len(of))
    while (parent[x] != parent[y]).any():
        low = np.minimum(parent[x], parent[y])
        np.minimum.at(parent, x, low)
        np.minimum.at(parent, y, low)
        parent = parent[parent]
    while (parent != parent[parent]).any():
        parent = parent[parent]
    return parent[of]


def spanning_forest(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Positions of the edges of a minimum spanning forest over nodes 0 to n - 1."""
    order = np.arange(len(a)) if weight is None else np.argsort(weight, kind="stable")
    a, b = a[order], b[order]
    of, live, kept = np.arange(n), np.arange(len(a)), []
    while len(live):
        live = live[of[a[live]] != of[b[live]]]
        if not len(live):
            break
        best = np.full(n, len(a))
        np.minimum.at(best, of[a[live]], live)
        np.minimum.at(best, of[b[live]], live)
        chosen = np.unique(best[best < len(a)])
        kept.append(chosen)
        of = merged(of, a[chosen], b[chosen])
    return order[np.concatenate(kept)] if kept else np.zeros(0, dtype="int64")


def thinned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a partition's edges those of a spanning forest, batch by batch."""
    a = b = np.zeros(0, dtype="int64")
    for batch in batches:
        a, b = np.concatenate([a, batch["a"]]), np.concatenate([b, batch["b"]])
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        keep = spanning_forest(len(nodes), at[: len(a)], at[len(a) :])
        a, b = a[keep], b[keep]
    yield pd.DataFrame({"a": a, "b": b})


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id of ``links`` (a, b): the smallest id reachable.

    Alternates between linking a node's larger neighbours to the smallest one
    and linking its smaller ones there, until every edge ends in a root. Nodes
    of any degree take part: minima are combined before the shuffle, and the
    joins meet a table with one row per node, so a hub's rows can be split.
    """
    ordered = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b")
    edges = staged(ordered.mapInPandas(thinned, EDGE).distinct())
    seen = None
    while True:
        mark = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen:
            break
        seen = mark
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")))
        larger = staged(both.join(lowest, "a").filter("b > a").select(F.col("low").alias("a"), "b").distinct())
        parent = staged(larger.groupBy("b").agg(F.min("a").alias("low")))
        met = larger.join(parent, "b")
        edges = staged(
            met.filter("a > low").select(F.col("low").alias("a"), F.col("a").alias("b"))
            .union(parent.select(F.col("low").alias("a"), "b"))
            .distinct()
        )
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).union(
        edges.select("a", F.col("a").alias("component")).distinct()
    )
