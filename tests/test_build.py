"""A whole build, and edits of what it stored."""

from __future__ import annotations

import json

import pytest

from cairn.operators import quality
from cairn.plans.build import Inputs, assemble, build, edit_stored
from cairn.sinks import store

PROFILE = {
    "types": ["Dataset", "RepositoryCollection"],
    "conforms_to": "https://example.org/profile",
    "licence": {"id": "https://example.org/by", "type": "ldac:DataReuseLicense", "name": "BY"},
}
TALK = "Speakers:\nKM: Kim Moss (Field Team) #kim\nMAIN\nKM: good day\nand welcome\nJD: hello\n"


@pytest.fixture
def given(spark, table):
    files = [("g", "a tern.wav", "talks/a tern.wav"), ("g", "plan.txt", "talks/more/plan.txt"), ("h", "x.txt", "x.txt")]
    return Inputs(
        files=table(files, "graph_id string, file_name string, relative_path string"),
        roots=table([("g", "arcp://name,g"), ("h", "arcp://name,h")], "graph_id string, root_id string"),
        profile=PROFILE,
        catalog=table([("T1", "tern", 0)], "code string, name string, is_alternate int"),
        texts=table([("g", "talks/one.txt", TALK)], "graph_id string, doc_id string, text string"),
        sheet=table([("g", "talks/a tern.wav", "At the shore")], "graph_id string, id string, note string"),
        mapping=[{"source": "note", "target": "description"}],
        rules=table([("Dataset", "name", "Text", 1, 0, 1)], "class string, prop string, range_type string, required int, multiple int, min_instances int"),
    )


def test_a_build_from_files_to_outputs(spark, given, rows, tmp_path):
    path = tmp_path.as_uri()
    built = build(given, path, sheets={"File": ["name"]}, language="eng", corpus="Shore")
    read = store.load_graphs(spark, f"{path}/graph")
    assert rows(read.props.select("graph_id", "id", "prop", "value", "ref")) == rows(built.graph.props.select("graph_id", "id", "prop", "value", "ref"))
    said = {(r["id"], r["prop"]): r["value"] or r["ref"] for r in read.props.collect()}
    assert said[("talks/a tern.wav", "description")] == "At the shore"  # the sheet comes after the files
    assert said[("talks/a tern.wav", "ldac:subjectLanguage")] == "T1"
    assert said[("#kim", "name")] == "Kim Moss"
    n = built.graph.props
    assert built.counts == {"files": 3, "types": built.graph.nodes.count(), "values": n.filter("value IS NOT NULL").count(), "references": n.filter("ref IS NOT NULL").count()}
    assert {(r["graph_id"], r["files"]) for r in built.per_graph.collect()} == {("g", 2), ("h", 1)}
    assert rows(built.summary) == rows(quality.quality_summary(quality.quality_report(built.graph.nodes, n, given.rules), given.roots))
    table = "".join(f.read_text() for f in sorted(tmp_path.glob("transcripts/graph_id=g/*/part-*")))
    assert table.splitlines() == ["speakerID,text,section", "#kim,good day and welcome,MAIN", "JD,hello,MAIN"]
    chat = "".join(f.read_text() for f in sorted(tmp_path.glob("chat/graph_id=g/*/part-*")))
    assert "@Languages: eng" in chat and "*KM: good day and welcome" in chat
    assert list(tmp_path.glob("sheets/type=File/part-*")) and list(tmp_path.glob("report/graph_id=*"))


def test_an_edit_of_a_stored_graph_writes_only_that_graph(spark, given, table, rows, tmp_path):
    path = f"{tmp_path.as_uri()}/graph"
    store.save_graphs(assemble(Inputs(given.files, given.roots, given.profile)), path)
    before = store.version(spark, path)
    files = {r["graph_id"]: set() for r in given.roots.collect()}
    for r in store.manifest(spark, path).collect():
        files[r["graph_id"]].add(r["file"])
    log = [("h", 1, "set", "x.txt", "name", "renamed", None), ("absent", 1, "set", "x", "name", "y", None)]
    edits = table(log, "graph_id string, seq bigint, op string, id string, prop string, value string, ref string")
    assert edit_stored(spark, path, edits) == before + 1
    after = store.manifest(spark, path)
    assert {r["file"] for r in after.filter("graph_id = 'g'").collect()} == files["g"]
    assert not {r["file"] for r in after.filter("graph_id = 'h'").collect()} & files["h"]
    read = store.load_graphs(spark, path)
    assert rows(read.props.filter("id = 'x.txt' AND prop = 'name'"), "graph_id", "value") == [("h", "renamed")]
    text = "".join((tmp_path / "graph" / r["file"]).read_text() for r in after.filter("graph_id = 'h'").orderBy("part_no").collect())
    assert {e["@id"] for e in json.loads(text)["@graph"]} >= {"x.txt", "arcp://name,h"}
    assert rows(after.select("graph_id").distinct()) == [("g",), ("h",)]
