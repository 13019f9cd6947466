"""Documents read by byte range, at every kind of border."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from cairn.sources import jsonld, large_json

TRICKY = {
    "@context": ["https://example.org/context", {"x": "https://example.org/x#", "y}": 'a"b'}, [{"z": "https://example.org/z#"}]],
    "first": {"@graph": [{"@id": "#not-this-one"}]},
    "@graph": [
        {"@id": "./", "@type": ["Dataset", "T"], "name": 'a "quoted" } brace', "hasPart": [{"@id": "#a"}, {"@id": "#b"}]},
        {"@id": "#a", "@type": "File", "text": "\\", "more": "\\\" ] } , {", "deep": {"@id": "#b", "x": {"y": [1, {"z": "}"}]}}},
        {"name": "no id"},
        {"@id": "#b", "name": "ünï – 日本  ", "empty": "", "list": [], "null": None, "n": -1.5e3, "flag": True, "@graph": "odd"},
        {"@id": "#c", "@graph": [{"@id": "#nested"}], "tail": "x" * 300},
        {},
        {"@id": "#d" + "d" * 50},
    ],
    "last": [{"@id": "#not-this-one-either"}, "]}", {"@graph": []}],
}


@pytest.fixture
def cut_at(spark):
    """Cut files into ranges of so many bytes."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"]
    before = {n: spark.conf.get(n, None) for n in names}

    def cut(size):
        for name, value in zip(names, (size, 0, 1), strict=True):
            spark.conf.set(name, str(value))

    yield cut
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def everything(graph, rows):
    tables = {k: rows(graph[k]) for k in ("nodes", "props", "roots", "prefixes")}
    return tables | {"rejected": sorted(r["reason"] for r in graph["rejected"].collect())}


@pytest.mark.parametrize("size", [61, 200, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_equal_to_reading_whole_cells(spark, rows, tmp_path, cut_at, size, indent):
    text = json.dumps(TRICKY, indent=indent, ensure_ascii=False)
    (tmp_path / "doc.json").write_text(text + ("\n" if indent else ""))
    cut_at(size)
    found = everything(large_json.read_graph_files(spark, str(tmp_path), F.lit("g")), rows)
    whole = jsonld.read_graph(spark.createDataFrame([("g", text)], "graph_id string, text string"))
    assert found == everything(whole, rows)
    assert found["rejected"] == ["no @id", "no @id"]


def test_a_document_is_read_by_several_tasks(spark, tmp_path, cut_at):
    entities = [{"@id": f"#{k}", "@type": "T", "text": "x" * 90} for k in range(20_000)]
    (tmp_path / "doc.json").write_text(json.dumps({"@graph": entities}))
    cut_at(100_000)
    found = large_json.scan_documents(spark, str(tmp_path))["entities"]
    assert found.rdd.getNumPartitions() > 20
    ordered = [json.loads(r["text"])["@id"] for r in found.orderBy("entity_no").collect()]
    assert ordered == [e["@id"] for e in entities]


@pytest.mark.parametrize("size", [25, 1 << 20])
def test_malformed_tails(spark, rows, tmp_path, cut_at, size):
    """What stands before the fault is read; the document and the entity that does not end are listed."""
    (tmp_path / "cut.json").write_text('{"@context": {"x": "https://x"}, "@graph": [{"@id": "#a", "name": "A"}, {"@id": "#b", "name": "B {')
    (tmp_path / "short.json").write_text('{"@graph": [{"@id": "#c", "name": "C"}]')
    (tmp_path / "none.json").write_text("{ not json")
    (tmp_path / "list.json").write_text('{"@graph": {"@id": "#d"}}')
    (tmp_path / "empty.json").write_text("")
    (tmp_path / "good.json").write_text(' {"@graph" : [ ] } \n')
    cut_at(size)
    graph = large_json.read_graph_files(spark, str(tmp_path), F.regexp_extract("document", "([a-z]+).json$", 1))
    assert rows(graph["props"], "graph_id", "id", "value") == [("cut", "#a", "A"), ("short", "#c", "C")]
    assert rows(graph["rejected"], "graph_id", "reason") == [
        ("cut", "does not parse"),
        ("cut", "no readable @graph"),
        ("list", "no readable @graph"),
        ("none", "no readable @graph"),
        ("short", "no readable @graph"),
    ]


@pytest.mark.parametrize("size", [30, 1 << 20])
def test_a_document_in_several_files(spark, rows, tmp_path, cut_at, size):
    text = json.dumps(TRICKY)
    for k, at in enumerate(range(0, len(text), 217)):
        (tmp_path / f"part-{k:05}.txt").write_text(text[at : at + 217])
    cut_at(size)
    found = large_json.read_graph_files(spark, str(tmp_path), F.lit("g"), folders=True)
    whole = jsonld.read_graph(spark.createDataFrame([("g", text)], "graph_id string, text string"))
    assert everything(found, rows) == everything(whole, rows)


def test_other_ranges_than_before_are_refused(spark, tmp_path, cut_at):
    (tmp_path / "doc.json").write_text(json.dumps({"@graph": [{"@id": f"#{k}"} for k in range(100)]}))
    cut_at(1 << 20)
    found = large_json.scan_documents(spark, str(tmp_path))["entities"]
    cut_at(100)
    with pytest.raises(Exception, match="keep spark.sql.files settings"):
        found.collect()
    cut_at(1 << 20)
    assert found.count() == 100
