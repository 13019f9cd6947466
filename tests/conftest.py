from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

PROPS = "graph_id string, id string, prop string, pos bigint, value string, ref string"
NODES = "graph_id string, id string, type string, pos int"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("cairn-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tmp_path_factory.mktemp("staging").as_uri())
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)


@pytest.fixture
def props(table):
    """Property rows of graph ``g``: (id, prop, pos, value, ref)."""
    return lambda *rows: table([("g", *r) for r in rows], PROPS)


@pytest.fixture
def nodes(table):
    """Entities of graph ``g``: (id, type)."""
    return lambda *rows: table([("g", i, t, 0) for i, t in rows], NODES)


@pytest.fixture
def root(table):
    return lambda id: table([("g", id)], "graph_id string, root_id string")


@pytest.fixture
def listing(table):
    """A listing of graph ``g``; a pair gives the file name and its path."""

    def make(*paths):
        rows = [p if isinstance(p, tuple) else (p.rsplit("/", 1)[-1], p) for p in paths]
        return table([("g", name, path) for name, path in rows], "graph_id string, file_name string, relative_path string")

    return make


@pytest.fixture
def rows():
    """Rows as a sorted list of tuples, in the order of the given columns."""

    def collect(df, *columns):
        picked = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in picked.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r))

    return collect


@pytest.fixture
def lists():
    """Values per (id, prop) in order: literals as text, references as ('@', id)."""

    def gather(df):
        found = {}
        for r in df.orderBy("id", "prop", "pos").collect():
            found.setdefault((r["id"], r["prop"]), []).append(("@", r["ref"]) if r["ref"] is not None else r["value"])
        return found

    return gather
