import json
import random

import pytest
from pyspark.sql import functions as F

from cairn.model import Graph, builtin_prefixes
from cairn.operators import quality as q
from cairn.operators import stats
from cairn.plans.jobs import check_graph
from cairn.sinks import jsonld as json_sink
from cairn.sinks import sheets as sheet_sink
from cairn.sources import jsonld, listing, tables

NODES = "graph_id string, id string, type string, pos int"
PROPS = "graph_id string, id string, prop string, pos bigint, value string, ref string"
RULES = "class string, prop string, range_type string, required int, multiple int, min_instances int"


@pytest.fixture
def rules(table):
    return table(
        [("Person", "name", "Text", 1, 0, 2), ("Person", "home", "Place", 0, 0, None), ("Person", "home", "URL", 0, 0, 0), ("Person", "born", "Date", 0, 0, 0), ("Place", "name", "Text", 1, 1, 0)],
        RULES,
    )


def test_cardinality(nodes, props, rules, rows):
    said = props(("#a", "name", 0, "x", None), ("#a", "name", 1, "y", None), ("#p", "name", 0, "x", None), ("#p", "name", 1, "y", None))
    found = q.check_cardinality(nodes(("#a", "Person"), ("#b", "Person"), ("#p", "Place")), said, rules)
    assert rows(found, "id", "prop", "problem", "found") == [("#a", "name", "several", 2), ("#b", "name", "missing", 0)]
    assert rows(q.check_instances(nodes(("#a", "Person")), rules), "class", "found", "wanted") == [("Person", 1, 2)]
    assert q.check_instances(nodes(("#a", "Person")), rules.drop("min_instances")).count() == 0


def test_ranges(nodes, props, rules, rows):
    said = props(
        ("#a", "home", 0, None, "#p"),
        ("#a", "home", 1, None, "https://example.org/x"),  # a URL needs no entity
        ("#a", "home", 2, None, "#b"),
        ("#a", "home", 3, "somewhere", None),
        ("#a", "home", 4, "https://example.org/x", None),
        ("#a", "born", 0, "1990-02-30", None),
        ("#a", "born", 1, "1990-02-28", None),
        ("#a", "born", 2, "1990", None),
        ("#a", "other", 0, "free", None),
    )
    found = q.check_ranges(nodes(("#a", "Person"), ("#b", "Person"), ("#p", "Place")), said, rules)
    assert rows(found, "prop", "pos") == [("born", 0), ("home", 2), ("home", 3)]


def test_loose_ends(nodes, props, rules, rows):
    things = nodes(("#a", "Person"), ("v#t", "rdf:Property"))
    said = props(("#a", "author", 0, None, "#nobody"), ("#a", "license", 0, None, "https://l"), ("#a", "conformsTo", 0, None, "https://c"), ("#a", "custom:sentance", 0, "typo", None), ("v#t", "rdfs:label", 0, "t", None), ("#a", "name", 0, "A", None))
    assert rows(q.dangling_refs(things, said), "ref") == [("#nobody",)]
    unknown = rows(q.unknown_properties(things, said, rules), "prop")
    assert ("custom:sentance",) in unknown and ("rdfs:label",) not in unknown and ("name",) not in unknown


def test_the_report_in_one_pass_finds_what_the_checks_find(table, rules, rows, monkeypatch):
    """Random graphs, also with pieces of two values, against each check by itself."""
    rng = random.Random(5)
    kinds, names = ["Person", "Place", "rdf:Property", "Odd", None], ["name", "home", "born", "license", "own", None]
    values = ["x", "2001-02-03", "https://example.org/y", "", None]
    things = [(g, f"#{i}", rng.choice(kinds), k) for g in "gh" for i in range(30) for k in range(rng.randint(0, 3))]
    said = [
        (g, f"#{i}", p, k, *((None, f"#{rng.randint(0, 40)}") if rng.random() < 0.5 else (rng.choice(values), None)))
        for g in "gh" for i in range(35) for p in rng.sample(names, 3) for k in range(rng.randint(1, 5))
    ]
    ruled = rules.union(table([(None, "own", "Text", 1, 0, None), ("Odd", "name", None, 0, 0, 1)], RULES))
    nodes, props = table(things, NODES), table(said, PROPS)
    monkeypatch.setattr(q, "PIECE", 2)

    def picked(df, check, *columns):
        return rows(df.select("graph_id", F.lit(check).alias("check"), *columns))

    none, whole = F.lit(None).cast("string"), q.quality_report(nodes, props, ruled).drop("severity")
    wanted = {
        "cardinality": picked(q.check_cardinality(nodes, props, ruled), "cardinality", "id", "prop", "problem"),
        "range": picked(q.check_ranges(nodes, props, ruled), "range", "id", "prop", F.coalesce("value", "ref")),
        "dangling": picked(q.dangling_refs(nodes, props), "dangling", "id", "prop", "ref"),
        "unknown": picked(q.unknown_properties(nodes, props, ruled), "unknown", "id", "prop", none),
        "instances": picked(q.check_instances(nodes, ruled), "instances", none, none, "class"),
    }
    for check, found in wanted.items():
        assert rows(whole.filter(F.col("check") == check)) == found, check
    assert all(len(wanted[c]) > 3 for c in ("cardinality", "range", "dangling", "unknown"))
    plan = q.judged(nodes, props, ruled)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("value#") and plan.count("LogicalRDD [graph_id#") == 3  # props once, types of entities and of targets


def test_root_class(table, rules, rows):
    types = table([("a", 0, "Dataset"), ("a", 1, "Place"), ("a", 2, "Person"), ("b", 0, "Dataset")], "graph_id string, pos int, type string")
    assert rows(q.root_class(types, rules)) == [
        ("a", "Place", None),
        ("b", None, "root types [Dataset] match no class of the rules [Person, Place]"),
    ]


def test_checking_a_graph(nodes, props, root, rules):
    rules = rules.withColumn("min_instances", F.lit(0))  # a graph need not have every class
    good = Graph(nodes(("#a", "Person"), ("#p", "File")), props(("#a", "name", 0, "A", None), ("#p", "name", 0, "P", None)), root("./"), builtin_prefixes(root("./")))
    assert tuple(check_graph(good, rules).first()) == ("g", 0, 0, 1)
    bad = good.with_(props=props(("#a", "name", 0, "A", None), ("#a", "odd", 0, None, "#x")))
    assert tuple(check_graph(bad, rules).first()) == ("g", 0, 2, 1)
    strict = rules.withColumn("min_instances", F.when(F.col("class") == "Place", 1))
    assert tuple(check_graph(bad, strict).first()) == ("g", 1, 2, 0)


@pytest.fixture
def birds(nodes, props):
    return {
        "nodes": nodes(("./", "Dataset"), ("#magpie", "RepositoryObject"), ("#geo", "Geometry"), ("#org", "Organization")),
        "props": props(
            ("./", "name", 0, "Birds", None),
            ("./", "author", 0, None, "#org"),
            ("#magpie", "custom:translation", 0, 'Mag"pie\n😀', None),
            ("#magpie", "image", 0, None, "files/a.jpg"),
            ("#magpie", "image", 5, None, "files/b.jpg"),
            ("#magpie", "image", 7, "a literal", None),
            ("#magpie", "blank", 0, "", None),
            ("#geo", ".latitude", 0, "-27.4698", None),
            ("#org", "tags", 0, "[x]", None),
            ("#org", "tags", 1, "y", None),
        ),
    }


def objects(graph):
    """The objects that the fragments of a graph make, in order."""
    made = json_sink.graph_to_json(graph["nodes"], graph["props"]).orderBy(*json_sink.ORDER).collect()
    text, at, found = "".join(r["text"] for r in made), 0, []
    while at < len(text):
        one, at = json.JSONDecoder().raw_decode(text, at)
        found.append(one)
    return found


def test_json_collapses_single_values(birds):
    found = {o["@id"]: o for o in objects(birds)}
    assert found["#magpie"] == {
        "@id": "#magpie",
        "@type": "RepositoryObject",
        "blank": "",
        "custom:translation": 'Mag"pie\n😀',
        "image": [{"@id": "files/a.jpg"}, {"@id": "files/b.jpg"}, "a literal"],
    }
    assert found["#geo"][".latitude"] == -27.4698


def test_long_lists_stay_one_object(nodes, props, lists, table):
    """Lists of over 10,000 values and positions with gaps, put together from their fragments."""
    said = props(*[("#c", "hasPart", 3 * i, None, f"f{i}") for i in range(11_000)], ("#c", "name", 0, "C", None), ("#d", "note", 40_000, "x", None))
    c, d = objects({"nodes": nodes(("#c", "RepositoryObject"), ("#d", "X")), "props": said})
    assert [p["@id"] for p in c["hasPart"]] == [f"f{i}" for i in range(11_000)]
    assert c["name"] == "C" and d == {"@id": "#d", "@type": "X", "note": "x"}
    back = jsonld.read_entities(jsonld.line_entities(table([("g", json.dumps(c)), ("g", json.dumps(d))], "graph_id string, text string")))
    assert lists(back["props"]) == lists(said)
    assert back["nodes"].filter("type IS NULL").count() == 0


def test_documents_are_whole(birds, tmp_path, spark, table, lists):
    twice = {k: df.unionByName(df.withColumn("graph_id", F.lit("h"))) for k, df in birds.items()}
    json_sink.write_documents(twice["nodes"], twice["props"], builtin_prefixes(twice["nodes"]), str(tmp_path / "d"))
    for graph in "gh":
        files = sorted((tmp_path / "d" / f"graph_id={graph}").glob("part-*"))
        text = "".join(f.read_text() for f in files)
        document = json.loads(text)
        assert document["@context"][1]["pcdm"] == "http://pcdm.org/models#"
        assert len(document["@graph"]) == 4
        back = read(table, text)
        assert lists(back["props"]) == lists(birds["props"])
        assert [r["root_id"] for r in back["roots"].collect()] == ["./"]


def test_graphs_survive_json(birds, rows, tmp_path, spark, lists):
    path = str(tmp_path / "graph")
    json_sink.write_graph(birds["nodes"], birds["props"], path)
    lines = spark.read.text(path).withColumn("graph_id", F.lit("g")).withColumnRenamed("value", "text")
    read = jsonld.read_entities(jsonld.line_entities(lines))
    assert rows(read["nodes"], "id", "type") == rows(birds["nodes"], "id", "type")
    assert lists(read["props"]) == lists(birds["props"])


def test_graphs_survive_sheets(birds, rows, tmp_path, spark, lists):
    literal = birds["props"].filter("NOT (prop = 'image' AND ref IS NULL)")
    columns = {}
    for r in sheet_sink.sheet_columns(birds["nodes"], literal).collect():
        columns.setdefault(r["type"], []).append(r["column"])
    left_out = columns["RepositoryObject"].pop()
    columns = {kind: columns.get(kind, []) for kind in ("Dataset", "RepositoryObject", "Geometry", "Organization")}
    sheet_sink.write_sheets(birds["nodes"], literal, {k: c for k, c in columns.items() if c}, str(tmp_path))
    read = {k: spark.read.csv(f"{tmp_path}/type={k}", header=True, multiLine=True, escape='"') for k, c in columns.items() if c}
    back = tables.sheets_to_graph(read)
    others = spark.read.csv(f"{tmp_path}/others", header=True, multiLine=True, escape='"')
    assert {r["column"] for r in others.collect()} == {left_out}
    kept = literal.filter(F.when(F.col("ref").isNotNull(), F.concat(F.lit("@"), "prop")).otherwise(F.col("prop")) != left_out)
    assert lists(back["props"]) == lists(kept)


def test_long_lists_and_dotted_columns_survive_sheets(nodes, props, lists, table):
    things, said = nodes(("#c", "X")), props(*[("#c", "hasPart", i, None, f"f{i}") for i in range(11_000)])
    sheet = sheet_sink.graph_to_sheet(things, said, "X", ["@hasPart"])
    assert sheet.count() == 1
    assert lists(tables.sheets_to_graph({"X": sheet})["props"]) == lists(said)
    dotted = table([("g", "#c", "a, b/c"), ("g", "#d", None)], "graph_id string, id string, `.author` string")
    assert lists(tables.sheets_to_graph({"X": dotted})["props"]) == {("#c", ".author"): ["a", "b", "c"]}


DOC = {
    "@context": ["https://w3id.org/ro/crate/1.2/context", {"custom": "arcp://name,custom/terms#", "bad": 1}],
    "@graph": [
        {"@id": "ro-crate-metadata.json", "@type": "CreativeWork", "about": {"@id": "arcp://name,birds/root"}},
        {"@id": "#d", "@type": "Dataset"},
        {"@id": "arcp://name,birds/root", "@type": ["Dataset", "RepositoryCollection"], "name": "Birds", "author": [{"@id": "#a"}, "b"], "open": True, "n": 3},
    ],
}


def read(table, document):
    return jsonld.read_graph(table([("g", document if isinstance(document, str) else json.dumps(document))], "graph_id string, text string"))


def test_reading_a_document(table, rows, lists):
    graph = read(table, DOC)
    assert rows(graph["roots"], "root_id") == [("arcp://name,birds/root",)]
    assert rows(graph["prefixes"]) == [("g", "custom", "arcp://name,custom/terms#")]
    said = lists(graph["props"])
    assert said[("arcp://name,birds/root", "author")] == [("@", "#a"), "b"]
    assert said[("arcp://name,birds/root", "n")] == ["3"]
    assert rows(graph["nodes"].filter("id LIKE 'arcp%'"), "pos", "type") == [(0, "Dataset"), (1, "RepositoryCollection")]


@pytest.mark.parametrize(
    ("entities", "root"),
    [
        ([{"@id": "./", "@type": "X"}, *DOC["@graph"]], "./"),
        ([{**DOC["@graph"][0], "about": {"@id": "#gone"}}, *DOC["@graph"][1:]], "#d"),
        ([{"@id": "#p", "@type": "Person"}], None),
    ],
)
def test_finding_the_root(table, entities, root):
    found = read(table, {"@graph": entities})["roots"].collect()
    assert [r["root_id"] for r in found] == ([root] if root else [])


def test_entities_without_a_type_are_kept(table, rows):
    graph = read(table, {"@graph": [{"@id": "#x"}, {"@id": "#y", "name": "Y"}]})
    assert rows(graph["nodes"], "id", "type") == [("#x", None), ("#y", None)]
    assert objects(graph) == [{"@id": "#x"}, {"@id": "#y", "name": "Y"}]
    assert [tuple(r) for r in stats.type_counts(graph["nodes"]).collect()] == [("g", "(none)", 2)]


def test_malformed_documents_give_nothing(table):
    graph = read(table, "{ not json")
    assert graph["nodes"].count() == graph["props"].count() == graph["roots"].count() == 0
    assert [tuple(r) for r in graph["rejected"].collect()] == [("g", None, "no readable @graph")]


def test_what_cannot_be_read_is_listed(table, rows):
    graph = read(table, {"@graph": [{"@id": "#a", "name": "A"}, {"name": "no id"}, "text", {"@id": "#b"}]})
    assert rows(graph["nodes"], "id") == [("#a",), ("#b",)]
    assert rows(graph["rejected"], "entity_no", "reason") == [(1, "no @id"), (2, "does not parse")]


def test_a_large_document_is_read_whole(spark):
    """Larger than a single parsed value may be."""
    entity = lambda k: F.concat(F.lit('{"@id":"#'), k, F.lit('","@type":"T","text":"'), F.repeat(F.lit("x"), 100_000), F.lit('"}'))
    entities = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1_400)), entity), ",")
    text = F.concat(F.lit('{"@graph":['), entities, F.lit("]}")).alias("text")
    graph = jsonld.read_graph(spark.range(1).select(F.lit("g").alias("graph_id"), text))
    assert graph["nodes"].count() == 1_400 and graph["rejected"].count() == 0


ADD, XLSX, JSON = jsonld.METADATA_FILES
GOOD, BROKEN = '{"@graph": []}', "{ not json"


@pytest.mark.parametrize(
    ("candidates", "picked"),
    [
        ([(ADD, 1, GOOD), (JSON, 2, GOOD)], JSON),
        ([(ADD, 3, GOOD), (JSON, 2, GOOD)], ADD),
        ([(JSON, 5, GOOD), (XLSX, 5, GOOD), (ADD, 5, GOOD)], ADD),
        ([(ADD, 5, BROKEN), (XLSX, 4, GOOD), (JSON, 1, GOOD)], JSON),
        ([(JSON, 1, BROKEN)], None),
        ([("other.json", 9, GOOD)], None),
    ],
)
def test_the_newest_source_is_picked(table, candidates, picked):
    frame = table([("g", *c) for c in candidates], "graph_id string, name string, last_modified int, content string")
    assert [r["name"] for r in jsonld.pick_newest_source(frame).collect()] == ([picked] if picked else [])


def test_columns_that_fit_a_cell(nodes, props, rows):
    said = props(*[("#a", "note", k, "x" * 10, None) for k in range(50)], ("#a", "name", 0, "A", None), ("#b", "name", 0, None, "#a"), ("#b", "note", 0, None, None))
    sizes = sheet_sink.column_sizes(nodes(("#a", "Person"), ("#b", "Person"), ("#b", "Place")), said)
    assert rows(sizes, "type", "column", "entities", "longest", "characters") == [
        ("Person", "@name", 1, 1, 2), ("Person", "name", 1, 1, 1), ("Person", "note", 2, 50, 500), ("Place", "@name", 1, 1, 2), ("Place", "note", 1, 1, 0),
    ]
    assert sheet_sink.fitting_columns(sizes, cell=600) == {"Person": ["@name", "name"], "Place": ["@name", "note"]}
    assert sheet_sink.fitting_columns(sizes)["Person"] == ["@name", "name", "note"]


def test_scanning(table, rows):
    paths = ["a/b.txt", ".git/x", "a/.b/c", "a/~$d.docx", "ro-crate-metadata.json", "x/ro-crate-preview_html/y", "_u.txt", "config.json", "a/config.json.txt", "c2c-output/z.csv"]
    kept = listing.scan_files(table([(p,) for p in paths], "relative_path string"))
    assert rows(kept) == [("_u.txt",), ("a/b.txt",), ("a/config.json.txt",)]


def test_listing_a_folder(spark, tmp_path, rows):
    (tmp_path / "a" / "b c").mkdir(parents=True)
    (tmp_path / "a" / "b c" / "x y.txt").write_text("x")
    (tmp_path / "config.json").write_text("{}")
    (tmp_path / "top.md").write_text("abc")
    found = listing.list_folder(spark, str(tmp_path), "g")
    assert rows(found, "graph_id", "file_name", "relative_path", "length") == [("g", "top.md", "top.md", 3), ("g", "x y.txt", "a/b c/x y.txt", 1)]


def test_sheets_from_files(spark, tmp_path, rows):
    (tmp_path / "s.csv").write_text(' @id ,about , ,.author\nf1," a, b",zz,X\n,lost,,\nf2,,,"Y"\n')
    sheet = tables.read_sheet(spark, str(tmp_path / "s.csv"), "g")
    assert sheet.columns == ["graph_id", "id", "about", ".author"]
    assert rows(sheet, "id", "about", "`.author`") == [("f1", " a, b", "X"), ("f2", None, "Y")]
    with pytest.raises(ValueError, match="@id"):
        tables.clean_sheet(spark.range(1), F.lit("g"))


def test_catalogues(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps([{"source": "S", "languageCode": "B2", "name": "b"}, {"source": "T", "languageCode": "A0", "name": "t"}, {"source": "S", "languageCode": "A1", "name": "a"}]))
    assert [r["code"] for r in tables.read_catalog(spark, str(path), "S").collect()] == ["A1", "B2"]
    with pytest.raises(ValueError, match="no records"):
        tables.read_catalog(spark, str(path), "U")


def test_rules_from_a_profile(spark, tmp_path, rows):
    inputs = [
        {"name": "name", "type": ["Text"], "required": True},
        {"name": "description", "type": ["Text"]},
        {"name": "pcdm:hasMember", "type": ["RepositoryObject"], "required": True},
        {"name": "fixed", "type": ["Value"]},
        {"name": "born", "type": ["Date", "Text"]},
        {"name": "license", "type": ["URL"], "multiple": True},
        {"name": "kind", "type": ["Text"], "values": ["a", "b"]},
        {"name": "creator", "type": ["Person", "Organization"]},
    ]
    (tmp_path / "p.json").write_text(json.dumps({"name": "Dataset", "inputs": inputs}))
    found = tables.read_rules(spark, str(tmp_path / "p.json"), ["description"])
    assert rows(found, "prop", "range_type", "required", "multiple", "kind") == sorted([
        ("name", "Text", 1, 0, "text"),
        ("description", "Text", 0, 0, "textarea"),
        ("born", "Date", 0, 0, "date"),
        ("born", "Text", 0, 0, "date"),
        ("license", "URL", 0, 1, "url"),
        ("kind", "Text", 0, 0, "select"),
        ("creator", "Person", 0, 0, "entity-ref"),
        ("creator", "Organization", 0, 0, "entity-ref"),
    ])
