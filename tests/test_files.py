import pytest
from pyspark.sql import functions as F

from cairn.operators import files as fs
from cairn.operators import stats
from cairn.plans.jobs import build_graph

PROFILE = {
    "types": ["Dataset", "RepositoryCollection"],
    "conforms_to": "https://example.org/profile",
    "licence": {"id": "https://example.org/by", "type": "ldac:DataReuseLicense", "name": "BY"},
}
TREE = ("Top/a.pdf", "Top/sub/b.pdf", "Top/sub/c.pdf")


def meta(files):
    return fs.file_metadata(fs.order_files(files))


def test_groups_come_from_folders_or_the_file_name(listing, rows):
    files = listing("D/x.pdf", "D/e/y.csv", ("field notes.txt", "notes at root.txt"))
    found = rows(meta(files), "id", "top_level_name", "group_id", "file_no")
    assert found == [
        ("D/e/y.csv", "D", "#D", 0),
        ("D/x.pdf", "D", "#D", 1),
        ("notes at root.txt", "field notes", "#field_notes", 2),
    ]


@pytest.mark.parametrize("block", [1024, 7, 1])
def test_duplicates_as_files(listing, rows, monkeypatch, block):
    """Every file names all others of its name, in whatever blocks they meet."""
    monkeypatch.setattr(fs, "LINK_BLOCK", block)
    paths = [f"d{k % 5}/Song ({k}).mp3" for k in range(30)] + ["A/list.csv", "B/list copy.csv", "é.txt", "ü.txt", "alone.txt"]
    files = meta(listing(*paths))
    numbers = {r["id"]: r["file_no"] for r in files.collect()}
    alike = [paths[:30], paths[30:32], paths[32:34]]
    expected = sorted((a, numbers[b], b) for names in alike for a in names for b in names if a != b)
    assert sorted(rows(fs.duplicate_links(fs.duplicate_groups(files)), "id", "pos", "ref")) == expected


def test_a_graph_with_duplicates_as_files_has_no_hubs(listing, root, rows):
    declared = {"custom:possibleDuplicate": {"id": "arcp://name,custom/terms#possibleDuplicate", "name": "possibleDuplicate"}}
    made = build_graph(listing("D/a.txt", "D/a copy.txt"), root("./"), PROFILE, file_properties=declared, duplicates_as_files=True)
    found = made.props.filter("prop = 'custom:possibleDuplicate'")
    assert rows(found, "id", "ref") == [("D/a copy.txt", "D/a.txt"), ("D/a.txt", "D/a copy.txt")]
    assert made.nodes.filter("id LIKE '%#duplicates%' OR type = 'Collection'").count() == 0


def test_duplicates_meet_in_a_hub(listing, rows):
    groups = fs.duplicate_groups(meta(listing("A/dict.pdf", "B/dict copy.pdf", "A/list.csv", "é.txt", "ü.txt")))
    assert rows(fs.possible_duplicates(groups), "id", "ref") == [
        ("#duplicates-", "é.txt"),  # names without a letter or digit all share the blank key
        ("#duplicates-", "ü.txt"),
        ("#duplicates-dict", "A/dict.pdf"),
        ("#duplicates-dict", "B/dict copy.pdf"),
        ("A/dict.pdf", "#duplicates-dict"),
        ("B/dict copy.pdf", "#duplicates-dict"),
        ("é.txt", "#duplicates-"),
        ("ü.txt", "#duplicates-"),
    ]
    assert rows(fs.duplicate_hub_nodes(groups), "id", "type") == [("#duplicates-", "Collection"), ("#duplicates-dict", "Collection")]


def test_blank_names_can_be_skipped(listing):
    files = meta(listing("é.txt", "ü.txt"))
    assert fs.duplicate_groups(files, skip_empty_key=True).count() == 0


@pytest.mark.parametrize("size", [2, 3, 120])
def test_groups_of_any_size_have_one_form(listing, size):
    """Each file's duplicates are all others of its name, in two links per file."""
    paths = [f"d{k}/one.txt" for k in range(size)] + ["d0/two.txt", "d1/two copy.txt", "solo.txt"]
    links = fs.possible_duplicates(fs.duplicate_groups(meta(listing(*paths)))).collect()
    assert len(links) == 2 * (size + 2)
    hub = {r["id"]: r["ref"] for r in links if not r["id"].startswith("#")}
    members = {h: {r["ref"] for r in links if r["id"] == h} for h in hub.values()}
    assert members[hub["d1/one.txt"]] == set(paths[:size])
    assert members[hub["d0/two.txt"]] == {"d0/two.txt", "d1/two copy.txt"} and "solo.txt" not in hub


def test_object_mode(listing, lists, rows):
    made = fs.folder_objects(meta(listing(*TREE)))
    assert rows(made["nodes"], "id", "type") == [("#Top", "RepositoryObject")]
    said = lists(made["props"])
    assert said[("#Top", "hasPart")] == [("@", p) for p in TREE]
    assert said[("#Top", "name")] == ["Top"]


def test_collection_mode(listing, lists, rows):
    made = fs.folder_collections(meta(listing(*TREE)))
    assert rows(made["nodes"], "id", "type") == [
        ("#Top", "RepositoryCollection"),
        ("#Top/Top_Files", "RepositoryObject"),
        ("#Top/sub", "RepositoryObject"),
    ]
    said = lists(made["props"])
    assert said[("#Top", "pcdm:hasMember")] == [("@", "#Top/sub"), ("@", "#Top/Top_Files")]
    assert said[("#Top/sub", "pcdm:memberOf")] == [("@", "#Top")]
    assert said[("#Top/Top_Files", "hasPart")] == [("@", "Top/a.pdf")]
    assert said[("#Top/sub", "hasPart")] == [("@", "Top/sub/b.pdf"), ("@", "Top/sub/c.pdf")]


def test_mixed_and_colliding_groups(listing, lists):
    """A root file beside a folder of its name; folders that sanitise alike."""
    made = fs.folder_collections(meta(listing("Top.txt", "Top/x y/1", "Top/x_y/2", "solo.md")))
    said = lists(made["props"])
    assert said[("#Top/Top_Files", "hasPart")] == [("@", "Top.txt")]
    assert said[("#Top/x_y", "hasPart")] == [("@", "Top/x y/1"), ("@", "Top/x_y/2")]
    assert said[("#Top/x_y", "name")] == ["x y"]
    assert said[("#solo", "hasPart")] == [("@", "solo.md")]


def build(listing, root, **options):
    files = listing("D/dict.pdf", "D/l/words.csv", ("field notes.txt", "root notes.txt"), "G/dict copy.pdf")
    return build_graph(files, root("arcp://name,test"), PROFILE, **options)


def test_whole_build(listing, root, rows, lists, props):
    name = props(("", "name", 0, "Test", None)).drop("id")
    declared = {
        f"custom:{p}": {"id": f"arcp://name,custom/terms#{p}", "name": p.title(), "description": "d"}
        for p in ("participant", "possibleDuplicate")
    }
    graph = build(listing, root, file_properties=declared, authored=name)
    objects = graph.nodes.filter("type = 'RepositoryObject'")
    assert rows(objects, "id") == [
        ("arcp://name,test/D",),
        ("arcp://name,test/G",),
        ("arcp://name,test/field_notes",),
    ]
    said = lists(graph.props)
    assert said[("arcp://name,test", "pcdm:hasMember")] == [
        ("@", "arcp://name,test/D"),
        ("@", "arcp://name,test/G"),
        ("@", "arcp://name,test/field_notes"),
    ]
    assert said[("arcp://name,test", "name")] == ["Test"]
    assert said[("D/l/words.csv", "isPartOf")] == [("@", "arcp://name,test/D")]
    hub = "#duplicates-dict"
    assert said[("D/dict.pdf", "custom:possibleDuplicate")] == said[("G/dict copy.pdf", "custom:possibleDuplicate")] == [("@", hub)]
    assert said[(hub, "custom:possibleDuplicate")] == [("@", "D/dict.pdf"), ("@", "G/dict copy.pdf")]
    assert ("D/l/words.csv", "custom:possibleDuplicate") not in said
    assert said[("D/dict.pdf", "custom:participant")] == [""]
    assert said[("arcp://name,custom/terms#participant", "name")] == ["Participant"]
    assert said[("ro-crate-metadata.json", "about")] == [("@", "arcp://name,test")]
    assert said[("ro-crate-metadata.json", "license")] == [("@", "https://example.org/by")]
    counts = {r["type"]: r["count"] for r in stats.type_counts(graph.nodes).collect()}
    assert counts["File"] == 4 and counts["RepositoryObject"] == 3 and counts["Dataset"] == 1


def test_described_elsewhere(listing, root, lists):
    graph = build(listing, root, structure_from_metadata=True)
    assert graph.nodes.filter("type = 'RepositoryObject'").count() == 0
    said = lists(graph.props)
    assert not [k for k in said if k[1] in ("isPartOf", "pcdm:hasMember", "hasPart")]
    assert ("D/dict.pdf", "custom:possibleDuplicate") not in said


def test_licences_are_inherited(listing, root, lists, props):
    licence = props(("", "license", 0, None, "https://example.org/l")).drop("id")
    said = lists(build(listing, root, authored=licence).props)
    assert said[("arcp://name,test/D", "license")] == [("@", "https://example.org/l")]


def test_local_and_blank_roots(nodes, props, root, rows):
    things, said = nodes(("#x", "RepositoryObject"), ("#p", "Person")), props(("#p", "knows", 0, None, "#x"))
    local = fs.rewrite_hash_ids(things, said, root("./"))
    assert rows(local["nodes"], "id") == [("#p",), ("./x",)]
    assert rows(local["props"], "ref") == [("./x",)]
    blank = fs.rewrite_hash_ids(things, said, root("  "))
    assert rows(blank["nodes"], "id") == [("#p",), ("#x",)]


def test_graphs_do_not_mix(table, rows):
    files = table(
        [(g, "a.txt", f"Top/{s}.txt") for g in ("g1", "g2") for s in "ab"],
        "graph_id string, file_name string, relative_path string",
    )
    made = fs.folder_objects(meta(files))
    assert rows(made["parents"], "graph_id", "file_no", "parent_id") == [
        ("g1", 0, "#Top"), ("g1", 1, "#Top"), ("g2", 0, "#Top"), ("g2", 1, "#Top"),
    ]
    groups = fs.duplicate_groups(meta(files))
    assert groups.agg(F.max("group_size")).first()[0] == 2
