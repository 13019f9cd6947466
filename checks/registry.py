"""Where the checks of each area are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.plans.scale import staged
from checks.views import oracle, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, views: str, sql: str, once: str = ""):
    """Register a query, given a function from a view lookup to a DataFrame.

    ``once`` names views that the query reads several times and that are costly
    to make: their rows are staged at the first lookup.
    """

    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            made: dict[str, DataFrame] = {}

            def look(v: str) -> DataFrame:
                if v not in once.split():
                    return view(spark, sf_dir, v)
                if v not in made:
                    made[v] = staged(view(spark, sf_dir, v))
                return made[v]

            return build(look)

        QUERIES[name] = run
        ORACLES[name] = oracle(views, sql)
        return build

    return register


def graph_rows(made: dict[str, DataFrame]) -> DataFrame:
    """Entities and properties of a result as one long table, types as ``@type``."""
    types = made["nodes"].select(
        "graph_id",
        "id",
        F.lit("@type").alias("prop"),
        F.col("pos").cast("bigint").alias("pos"),
        F.col("type").alias("value"),
        F.lit(None).cast("string").alias("ref"),
    )
    return types.unionByName(made["props"])
