"""Graphs saved in ordered files under a manifest."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from cairn.model import NODE_COLS, PROP_COLS, Graph
from cairn.sinks import store


@pytest.fixture
def uncoalesced(spark):
    """Small partitions stay as they are, so that little data makes several files."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.fixture
def graph(table):
    nodes = [("g", "./", "Dataset", 0), ("g", "./", "T", 1), ("g", "#none", None, 0), ("h/1", "./", "Dataset", 0), ("h/1", '#q"{', "X", 0)]
    said = ["plain", 'a "quoted", [list] {brace}\n and \\ line', "", " blank first", ",", "]", '"']
    props = [("g", "./", "name", k, v, None) for k, v in enumerate(said)]
    props += [("g", "./", 'key":["', 0, "x]", None), ("g", "./", "@odd", 0, None, "#a"), ("g", "./", ".latitude", 0, "-27.50", None)]
    props += [("g", "./", "hasPart", k, None, f"#f{k}") for k in range(6_000)]
    props += [("h/1", '#q"{', "hasPart", 0, None, '#"}'), ("h/1", '#q"{', "hasPart", 1, "]", None), ("h/1", "#no node", "name", 0, "n", None)]
    return Graph(
        table(nodes, "graph_id string, id string, type string, pos int").select(*NODE_COLS),
        table(props, "graph_id string, id string, prop string, pos bigint, value string, ref string").select(*PROP_COLS),
        table([("g", "./")], "graph_id string, root_id string"),
        table([("g", "x", "https://x#"), ("h/1", "y", "https://y#")], "graph_id string, prefix string, uri string"),
    )


def test_loaded_as_saved(spark, graph, rows, tmp_path, uncoalesced):
    path = tmp_path.as_uri()
    assert store.version(spark, path) == 0 and store.load_graphs(spark, path).props.count() == 0
    assert store.save_graphs(graph, path) == 1
    found = store.load_graphs(spark, path)
    assert rows(found.props) == rows(graph.props)
    types = graph.nodes.unionByName(spark.createDataFrame([("h/1", "#no node", None, 0)], graph.nodes.schema))
    assert rows(found.nodes) == rows(types)
    assert rows(found.prefixes) == rows(graph.prefixes)
    assert rows(found.roots) == [("g", "./"), ("h/1", "./")]


def test_an_entity_is_cut_between_files_that_make_one_document(spark, graph, tmp_path, uncoalesced):
    store.save_graphs(graph, tmp_path.as_uri())
    files = store.manifest(spark, tmp_path.as_uri()).filter("graph_id = 'g'").orderBy("part_no").collect()
    texts = [(tmp_path / r["file"]).read_text() for r in files]
    assert len(texts) > 1 and sum('"hasPart"' in t for t in texts) == 1 and sum('"#f' in t for t in texts) > 1
    entities = {e["@id"]: e for e in json.loads("".join(texts))["@graph"]}
    assert [p["@id"] for p in entities["./"]["hasPart"]] == [f"#f{k}" for k in range(6_000)]
    assert entities["./"]["name"][1] == 'a "quoted", [list] {brace}\n and \\ line'


def test_saving_one_graph_leaves_the_files_of_others(spark, graph, rows, tmp_path):
    path = tmp_path.as_uri()
    store.save_graphs(graph, path)
    before = {(r["graph_id"], r["file"]) for r in store.manifest(spark, path).collect()}
    only = spark.createDataFrame([("h/1",)], "graph_id string")
    changed = graph.with_(props=graph.props.withColumn("value", F.upper("value")))
    assert store.save_graphs(changed, path, only=only) == 2
    after = {(r["graph_id"], r["file"]) for r in store.manifest(spark, path).collect()}
    assert {f for f in before if f[0] == "g"} == {f for f in after if f[0] == "g"} and before != after
    found = store.load_graphs(spark, path)
    assert rows(found.props.filter("graph_id = 'g'")) == rows(graph.props.filter("graph_id = 'g'"))
    assert rows(found.props.filter("prop = 'name' AND graph_id = 'h/1'"), "value") == [("N",)]
    assert rows(store.load_graphs(spark, path, only).props) == rows(found.props.filter("graph_id = 'h/1'"))
    gone = graph.with_(nodes=graph.nodes.limit(0), props=graph.props.limit(0))
    store.save_graphs(gone, path, only=only)
    assert rows(store.load_graphs(spark, path).props.select("graph_id").distinct()) == [("g",)]


def test_what_is_not_committed_is_not_seen(spark, graph, rows, tmp_path):
    path = tmp_path.as_uri()
    store.save_graphs(graph, path)
    (tmp_path / "manifest" / "version-000000000002").mkdir()  # a save that died
    (tmp_path / "data-dead" / "graph_id=g").mkdir(parents=True)
    (tmp_path / "data-dead" / "graph_id=g" / "part-00000.txt").write_text("{")
    assert store.version(spark, path) == 1
    assert rows(store.load_graphs(spark, path).props) == rows(graph.props)


def test_a_file_that_lost_its_end_is_refused(spark, graph, tmp_path):
    store.save_graphs(graph, tmp_path.as_uri())
    file = tmp_path / store.manifest(spark, tmp_path.as_uri()).first()["file"]
    (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    file.write_text(file.read_text()[:-20])
    with pytest.raises(Exception, match="not as long as the manifest says"):
        store.load_graphs(spark, tmp_path.as_uri()).props.collect()
