import random
import re

import pytest

from cairn.model import BUILTIN_PREFIXES, Graph, builtin_prefixes
from cairn.operators import filters, links, places, publish, sheets, terms
from cairn.plans.jobs import add_speakers, add_terms, merge_metadata

CATALOG = "code string, name string, is_alternate int"


def test_terms_match_whole_words(table, rows):
    catalog = table([("A1", "Dyirbal", 0), ("A2", "Warlpiri", 0), ("A3", "Gugu Badhun", 0), ("A4", "Bal", 0), ("A5", "North", 0), ("A6", "Jirrbal", 1)], CATALOG)
    texts = table(
        [("g", "1", "DYIRBAL-story (gugu badhun).mp3"), ("g", "2", "dyirbals.mp3"), ("g", "3", "north bal gugu. x badhun"), ("g", "4", "jirrbal warlpiri warlpiri"), ("g", "5", "")],
        "graph_id string, file_id string, text string",
    )
    usable = terms.usable_terms(catalog)
    assert rows(usable, "code") == [("A1",), ("A2",), ("A3",)]
    assert rows(terms.match_terms(texts, usable), "file_id", "code") == [("1", "A1"), ("1", "A3"), ("4", "A2")]
    wide = terms.usable_terms(catalog, include_alternates=True)
    assert rows(terms.match_terms(texts, wide.filter("code = 'A6'")), "file_id") == [("4",)]
    assert terms.match_terms(texts, catalog.filter("false")).count() == 0


def test_found_terms_are_linked(table, nodes, lists, rows):
    hits = table(
        [("g", "a.mp3", "L:2", "Two"), ("g", "a.mp3", "L:1", "One"), ("g", "b.mp3", "L:1", "One"), ("g", "gone.mp3", "L:1", "One")],
        "graph_id string, file_id string, term_id string, name string",
    )
    geometry = table([("L:1", "#geo-1", "POINT (145.6 -17.6)")], "term_id string, geo_id string, wkt string")
    made = terms.link_terms(nodes(("b.mp3", "File"), ("a.mp3", "File"), ("c.mp3", "File")), hits, geometry)
    said = lists(made["props"])
    assert said[("a.mp3", "ldac:subjectLanguage")] == [("@", "L:1"), ("@", "L:2")]
    assert said[("b.mp3", "ldac:subjectLanguage")] == [("@", "L:1")]
    assert ("gone.mp3", "ldac:subjectLanguage") not in said
    assert said[("#geo-1", "asWKT")] == ["POINT (145.6 -17.6)"]
    assert made["count"].first()["terms"] == 2
    assert made["nodes"].filter("type = 'rdf:Property'").count() == 3
    nothing = terms.link_terms(nodes(("b.mp3", "File")), hits.filter("false"))
    assert nothing["nodes"].count() == 0 and nothing["count"].count() == 0


MAPPING = [
    {"source": "about", "target": "description"},
    {"source": ".location", "target": "contentLocation", "type": "Place"},
    {"source": "note", "target": "custom:note"},
]


@pytest.fixture
def sheet(table):
    return table(
        [
            ("g", "d/a.pdf", 1, "first", "Brisbane / Cairns, Brisbane", " "),
            ("g", "d/a.pdf", 2, "second", None, None),
            ("g", "missing.pdf", 3, "x", "Perth", "n"),
        ],
        "graph_id string, id string, row_no int, about string, `.location` string, note string",
    )


def test_sheets_merge_by_id(spark, nodes, props, root, sheet, lists, rows):
    graph = Graph(nodes(("d/a.pdf", "File"), ("#place-cairns", "Place")), props(("d/a.pdf", "description", 0, "", None)), root("./"), builtin_prefixes(root("./")))
    merged = merge_metadata(graph, sheet, MAPPING)
    said = lists(merged.props)
    assert said[("d/a.pdf", "description")] == ["second"]
    assert said[("d/a.pdf", "contentLocation")] == [("@", "#place-brisbane"), ("@", "#place-cairns")]
    assert said[("#place-brisbane", "name")] == ["Brisbane"]
    assert ("#place-cairns", "name") not in said  # it was there before
    assert ("missing.pdf", "description") not in said
    assert rows(merged.nodes, "id") == [("#place-brisbane",), ("#place-cairns",), ("d/a.pdf",)]


def test_a_sheet_brings_places_and_prefixes(table, nodes, props, root, gazetteer, lists, rows):
    sheet = table([("g", "d/a.pdf", "Brisbane, Nowhere", "text/plain")], "graph_id string, id string, location string, kind string")
    mapping = [{"source": "location", "target": "contentLocation", "type": "Place"}, {"source": "kind", "target": "dc:format"}]
    graph = Graph(nodes(("d/a.pdf", "File")), props(("d/a.pdf", "name", 0, "a", None)), root("./"), builtin_prefixes(root("./")))
    declared = table([("g", "dc", "http://purl.org/dc/"), ("g", "unused", "http://unused")], "graph_id string, prefix string, uri string")
    merged = merge_metadata(graph, sheet, mapping, gazetteer=gazetteer, declared=declared)
    said = lists(merged.props)
    assert said[("#place-brisbane", "geo")] == [("@", "#location-brisbane")] and ("#place-nowhere", "geo") not in said
    assert said[("#location-brisbane", "asWKT")] == ["POINT(153.0251 -27.4698)"]
    assert rows(merged.nodes.filter("type = 'Geometry'"), "id") == [("#location-brisbane",)]
    assert ("g", "dc", "http://purl.org/dc/") in rows(merged.prefixes) and merged.prefixes.filter("prefix = 'unused'").count() == 0


def test_terms_and_speakers_join_a_graph(spark, table, nodes, props, root, lists, rows):
    graph = Graph(nodes(("a.mp3", "File"), ("#s2", "Person")), props(("#s2", "name", 0, "Known", None)), root("./"), builtin_prefixes(root("./")))
    texts = table([("g", "a.mp3", "dyirbal story.mp3")], "graph_id string, file_id string, text string")
    found = add_terms(graph, texts, table([("L:1", "Dyirbal", 0)], CATALOG))
    assert lists(found.props)[("a.mp3", "ldac:subjectLanguage")] == [("@", "L:1")]
    talk = table([("g", "t.docx", "Speakers:\nA: Ann #s1\nB: Bob #s2\nMAIN\nA: hi")], "graph_id string, doc_id string, text string")
    spoken = add_speakers(graph, talk)
    assert rows(spoken.nodes, "id") == [("#s1",), ("#s2",), ("a.mp3",)]
    assert lists(spoken.props)[("#s2", "name")] == ["Known"]


def test_terms_a_graph_has_stay_one_entity(table, nodes, props, root, lists, rows):
    graph = Graph(
        nodes(("a.mp3", "File"), ("L:1", "Language")),
        props(("L:1", "name", 0, "Own name", None), ("a.mp3", "ldac:subjectLanguage", 0, None, "L:old"), ("a.mp3", "ldac:subjectLanguage", 1, None, "L:older")),
        root("./"),
        builtin_prefixes(root("./")),
    )
    texts = table([("g", "a.mp3", "dyirbal and girramay.mp3")], "graph_id string, file_id string, text string")
    catalog = table([("L:1", "Dyirbal", 0), ("L:2", "Girramay", 0)], CATALOG)
    shapes = table([("L:1", "#geo-1", "POINT(1 2)"), ("L:2", "#geo-2", "POINT(3 4)")], "term_id string, geo_id string, wkt string")
    found = add_terms(graph, texts, catalog, geometry=shapes)
    said = lists(found.props)
    assert said[("a.mp3", "ldac:subjectLanguage")] == [("@", "L:1"), ("@", "L:2")]
    assert said[("L:1", "name")] == ["Own name"] and said[("L:2", "name")] == ["Girramay"]
    assert said[("L:1", "geo")] == [("@", "#geo-1")] and said[("#geo-2", "asWKT")] == ["POINT(3 4)"]
    assert rows(found.nodes.filter("type = 'Language'"), "id") == [("L:1",), ("L:2",)]


def test_long_terms_are_found_whole(table, rows):
    run = " ".join(f"w{k}" for k in range(300))
    texts = table([("g", "a", "x " + run + " y"), ("g", "b", run.replace("w7 ", "z ")), ("h", "a", "w0 w1")], "graph_id string, file_id string, text string")
    catalog = table([("L", run), ("M", "w0 w1"), ("N", "w1 w3")], "code string, name string")
    assert rows(terms.match_terms(texts, catalog), "graph_id", "file_id", "code") == [("g", "a", "L"), ("g", "a", "M"), ("g", "b", "M"), ("h", "a", "M")]


def test_custom_properties_get_definitions(table, nodes, props, lists):
    declared = table([("g", "arcp://name,custom/terms#participant", "Participant", "Who takes part")], "graph_id string, id string, name string, description string")
    written = props(("f", "custom:participant", 0, "", None), ("f", "custom:note", 0, "x", None), ("f", "dc:format", 0, "x", None))
    said = lists(sheets.property_definitions(nodes(("f", "File")), written, declared)["props"])
    assert said == {
        ("arcp://name,custom/terms#participant", "name"): ["Participant"],
        ("arcp://name,custom/terms#participant", "description"): ["Who takes part"],
        ("arcp://name,custom/terms#note", "name"): ["note"],
    }
    assert sheets.property_definitions(nodes(("f", "File")), written.filter("prop = 'dc:format'"))["nodes"].count() == 0


def test_both_sides_of_a_mismatch_are_reported(nodes, sheet, rows):
    files = nodes(("d/a.pdf", "File"), ("d/b.pdf", "File"), ("d/c.pdf", "File"))
    found = rows(sheets.unmatched(files, sheet, 1), "side", "total", "sample_no", "id")
    assert found == [("file", 2, 1, "d/b.pdf"), ("row", 1, 1, "missing.pdf")]


def test_prefixes_are_looked_for(table, rows):
    names = ["dc:format", "custom:x", "name", "zz:a", "https://a.b/c", "bad:y"]
    targets = table([("g", n) for n in names] + [("h", "dc:format")], "graph_id string, target string")
    declared = table(
        [("g", 0, "dc", "http://z"), ("g", 1, "dc", " http://purl.org/dc/ "), ("g", 2, "bad", "no uri"), ("g", 3, "1x", "http://x"), ("h", 0, "dc", "urn:h")],
        "graph_id string, pos int, prefix string, uri string",
    )
    assert rows(sheets.discover_prefixes(targets, declared), "graph_id", "prefix", "uri") == [
        ("g", "bad", None),
        ("g", "dc", "http://purl.org/dc/"),  # the last one declared
        ("g", "zz", None),
        ("h", "dc", "urn:h"),
    ]


@pytest.fixture
def gazetteer(table):
    return table(
        [
            ("manual", 0, "Brisbane", "QLD", -27.4698, 153.0251),
            ("primary", 1, "Mount Isa", "QLD", -20.7, 139.5),
            ("primary", 1, "Springfield", "NSW", -33.4, 151.4),
            ("primary", 1, "Springfield", "QLD", -27.6, 152.9),
            ("primary", 1, "Springfield Lakes", "QLD", -27.7, 152.9),
            ("primary", 1, "Cairns North", "QLD", -16.9, 145.7),
            ("secondary", 2, "Cairns", "QLD", -16.92, 145.77),
            ("secondary", 2, "Broome", "WA", -17.9, 122.2),
        ],
        "provider string, priority int, name string, region string, latitude double, longitude double",
    )


def test_places_are_resolved_in_order(table, gazetteer, rows):
    wanted = ["Brisbane", "Mt Isa", "springfield", "Cairns", "Broome", "Nowhere"]
    names = table([("g", n) for n in wanted], "graph_id string, name string")
    found = {r["name"]: (r["step"], r["matched_name"], r["match_region"]) for r in places.lookup_places(names, gazetteer, "QLD").collect()}
    assert found == {
        "Brisbane": (0, "Brisbane", "QLD"),
        "Mt Isa": (1, "Mount Isa", "QLD"),
        "springfield": (1, "Springfield", "QLD"),
        "Cairns": (2, "Cairns North", "QLD"),  # a primary prefix comes before the secondary service
        "Broome": (3, "Broome", "WA"),
    }
    without = {r["name"]: r["match_region"] for r in places.lookup_places(names, gazetteer).collect()}
    assert without["springfield"] == "NSW"


def test_geometry_hangs_on_the_place(table, gazetteer, lists, rows):
    named = table([("g", "#place-brisbane", "Brisbane"), ("g", "#place-oz", "Oz")], "graph_id string, id string, name string")
    made = places.attach_geometry(named, places.lookup_places(named, gazetteer))
    assert rows(made["nodes"], "id", "type") == [("#location-brisbane", "Geometry")]
    assert lists(made["props"]) == {
        ("#place-brisbane", "geo"): [("@", "#location-brisbane")],
        ("#location-brisbane", ".latitude"): ["-27.4698"],
        ("#location-brisbane", ".longitude"): ["153.0251"],
        ("#location-brisbane", "asWKT"): ["POINT(153.0251 -27.4698)"],
    }
    assert rows(made["enriched"], "id") == [("#place-brisbane",)]


def test_media_beside_the_document(table, rows):
    refs = table(
        [("g", i, f, n) for i, (f, n) in enumerate([("doc", "Garden.JPG"), ("doc", "garden"), ("doc", "CLIP.mov"), ("doc/sub", "garden.jpg"), ("", "top.png"), ("doc", "two.gif")])],
        "graph_id string, ref_id int, folder string, name string",
    )
    files = table([("g", p) for p in ("doc/media/garden.jpg", "doc/media/clip.mp4", "garden.jpg", "media/top.png", "doc/media/two.png", "doc/media/two.gif", "other/media/garden.jpg")], "graph_id string, id string")
    assert rows(links.resolve_media(refs, files), "ref_id", "file_id") == [
        (0, "doc/media/garden.jpg"),
        (1, "doc/media/garden.jpg"),
        (2, "doc/media/clip.mp4"),
        (3, None),
        (4, "media/top.png"),
        (5, "doc/media/two.gif"),
    ]


@pytest.fixture
def assets(table):
    own = [("files/images/magpie.jpg", "blob:m"), ("style.css", "blob:s"), ("a%20b.png", "blob:ab"), ("a b.gif", "blob:gif")]
    other = [("h", path, "other:" + target) for path, target in own] + [("h", "nope.png", "other:nope")]
    return table([("g", *row) for row in own] + other, "graph_id string, path string, target string")


def test_links_are_classified(table, assets, rows):
    hrefs = ["../files/images/magpie.jpg?v=2#x", "https://x.org/style.css", "#top", "about.HTML#a", "nope.png", "", "a%20b.png", "a b.gif", "/style.css", "//cdn/x"]
    found = dict((h, (k, r)) for h, k, r in rows(links.resolve_links(table([("g", h) for h in hrefs], "graph_id string, href string"), assets), "href", "kind", "resolved"))
    assert found == {
        "../files/images/magpie.jpg?v=2#x": ("mapped", "blob:m?v=2#x"),
        "https://x.org/style.css": ("absolute", "https://x.org/style.css"),
        "#top": ("absolute", "#top"),
        "about.HTML#a": ("page", "about.HTML#a"),
        "nope.png": ("unknown", "nope.png"),
        "": ("empty", ""),
        "a%20b.png": ("mapped", "blob:ab"),
        "a b.gif": ("mapped", "blob:gif"),
        "/style.css": ("mapped", "blob:s"),
        "//cdn/x": ("absolute", "//cdn/x"),
    }


@pytest.mark.parametrize(
    ("css", "after"),
    [
        ("a{background: url('files/images/magpie.jpg');}", "a{background: url('blob:m');}"),
        ('url("style.css")url(style.css) URL( \'style.css\' )', "url(\"blob:s\")url(blob:s) url('blob:s')"),
        ("x url(https://e.org/b.png) y url(data:image/gif;base64,R0) url('no.jpg') z", "x url(https://e.org/b.png) y url(data:image/gif;base64,R0) url('no.jpg') z"),
        ("color: red;", "color: red;"),
        ("", ""),
        ("url('style.css)", "url('style.css)"),
    ],
)
def test_css_urls(table, assets, css, after):
    sheet = table([("g", 1, css)], "graph_id string, css_id int, css string")
    assert links.rewrite_css_urls(sheet, assets).first()["css"] == after


def test_names_stand_for_references(props, lists, rows):
    said = props(("f", "author", 0, None, "#a"), ("f", "author", 1, None, "#b"), ("f", "note", 0, "#a", None), ("f", "blank", 0, " ", None), ("#a", "name", 0, "  ", None), ("#a", "name", 1, " Ann ", None))
    assert rows(links.resolve_names(said), "id", "prop", "text") == [("#a", "name", "Ann"), ("f", "author", "#b"), ("f", "author", "Ann"), ("f", "note", "Ann")]


def test_entities_are_found(nodes, props, root):
    things, said = nodes(("#a", "Person"), ("#b", "Person"), ("ro-crate-metadata.json", "Person"), ("x/ANN.txt", "File")), props(("#a", "name", 0, "Ann", None), ("#b", "name", 0, "Bob", None))
    found = lambda **by: [r["id"] for r in filters.find_entities(things, said, **by).collect()]
    assert found(text="ann ") == ["#a", "x/ANN.txt"]
    assert found(type="Person") == ["#a", "#b"]
    assert [r["type"] for r in filters.distinct_types(things).collect()] == ["File", "Person"]
    fixed = filters.is_structural(things, root("#b")).filter("structural = 1")
    assert {r["id"] for r in fixed.collect()} == {"#b", "ro-crate-metadata.json", "x/ANN.txt"}


def test_compact_properties_expand(spark, props, lists):
    said = props(("f", "custom:a", 0, "1", None), ("f", "custom:b", 0, "2", None), ("f", "arcp://name,custom/terms#b", 0, "own", None), ("f", "zz:c", 0, "3", None), ("f", "custom:", 0, "4", None))
    expanded = lists(publish.expand_properties(said, builtin_prefixes(said)))
    assert expanded[("f", "arcp://name,custom/terms#a")] == ["1"]
    assert expanded[("f", "arcp://name,custom/terms#b")] == ["own"]
    assert len(expanded) == 6


def test_pages_follow_the_layout(props, rows):
    said = props(("f", "name", 0, "F", None), ("f", "custom:a", 0, None, "#p"), ("f", "arcp://name,custom/terms#a", 0, "full", None), ("#p", "name", 0, "Pat", None), ("#p", "custom:a", 0, None, "f"))
    layout = [{"name": "None", "inputs": ["what"]}, {"name": "All", "inputs": ["custom:a", "name"]}]
    pages = publish.entity_pages(said, layout, BUILTIN_PREFIXES, {"name": "http://schema.org/name"})
    assert rows(pages, "id", "group", "input_no", "text") == [("#p", "All", 0, "F"), ("#p", "All", 1, "Pat"), ("f", "All", 0, "full"), ("f", "All", 1, "F")]
    with pytest.raises(ValueError, match="property group"):
        publish.entity_pages(said, [], BUILTIN_PREFIXES, {})


SITE = {"types": {"A": {"template": "t.html"}, "B": {"template": "u.html"}}, "root": {"template": "t.html"}}


def test_page_templates(nodes, root, rows):
    assert publish.template_refs(SITE) == ["t.html", "u.html"]
    assert publish.template_refs({**SITE, "multipage": False}) == publish.template_refs(None) == []
    things = nodes(("1", "B"), ("1", "A"), ("2", "B"), ("3", "C"), ("./", "B"))
    plan = publish.page_plan(things, root("./"), SITE, ["t.html", "u.html"])
    assert rows(plan, "id", "template") == [("./", "t.html"), ("1", "t.html"), ("2", "u.html")]
    with pytest.raises(ValueError, match="u.html"):
        publish.page_plan(things, root("./"), SITE, ["t.html"])
    assert publish.page_plan(things, root("./"), {**SITE, "multipage": False}, []).count() == 0


def test_terms_of_any_length_equal_a_plain_search(table, rows):
    """Runs of one to three words are looked up whole, longer terms by their beginning."""
    draw = random.Random(5)
    said = [" ".join(draw.choice("ab c d Ä".split()) for _ in range(draw.randint(0, 30))) for _ in range(40)] + [None, "", "-"]
    names = [" ".join(draw.choice("ab c d Ä".split()) for _ in range(n)) for n in (1, 1, 2, 2, 3, 3, 4, 4, 5, 7) for _ in range(4)] + ["", "D-ab"]
    texts = table([("g", str(k), t) for k, t in enumerate(said)], "graph_id string, file_id string, text string")
    catalog = table([(f"c{k}", n) for k, n in enumerate(names)], "code string, name string")
    plain = lambda t: " " + " ".join(w for w in re.split(r"[^0-9a-zä]+", (t or "").lower()) if w) + " "
    expected = {("g", str(k), f"c{j}", n) for k, t in enumerate(said) for j, n in enumerate(names) if plain(n).strip() and plain(n) in plain(t)}
    for picked in (names, names[:8]):  # the second has no long terms
        some = catalog.filter(catalog.name.isin(picked))
        assert rows(terms.match_terms(texts, some)) == sorted(e for e in expected if e[3] in picked)
    assert rows(terms.match_terms(texts, catalog.limit(0))) == []
