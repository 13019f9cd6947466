import pytest

from cairn.model import Graph, builtin_prefixes
from cairn.operators import edits as ed
from cairn.operators import overlay
from cairn.plans.jobs import edit_graph, overlay_graph

MEMBER = "pcdm:hasMember"


@pytest.fixture
def log(table):
    """Changes (seq, op, id, prop, value, ref) of graph ``g``."""
    schema = "graph_id string, seq bigint, op string, id string, prop string, value string, ref string"
    return lambda *rows: table([("g", *r) for r in rows], schema)


def test_the_source_wins_on_what_it_states(props, root, lists):
    target = props(
        ("f.jpg", "encodingFormat", 0, "image/jpeg", None),
        ("f.jpg", "isPartOf", 0, None, "#folder"),
        ("f.jpg", "isPartOf", 1, None, "#other"),
        ("./", "name", 0, "target", None),
    )
    source = props(("f.jpg", "isPartOf", 0, None, "#magpie"), ("#magpie", "name", 0, "magpie", None), ("./", "name", 0, "source", None))
    assert lists(overlay.merge_graphs(target, source, root("./"))) == {
        ("f.jpg", "encodingFormat"): ["image/jpeg"],
        ("f.jpg", "isPartOf"): [("@", "#magpie")],
        ("#magpie", "name"): ["magpie"],
        ("./", "name"): ["target"],
    }
    counts = overlay.merge_counts(target, source, root("./")).first()
    assert (counts["added"], counts["enriched"]) == (1, 1)


def test_seeding_fills_gaps_only(props, root, lists):
    typed = props(("./", "name", 0, "By hand", None))
    source = props(
        ("./", "name", 0, "Birds", None),
        ("./", "description", 0, "A collection", None),
        ("./", "conformsTo", 0, None, "https://example.org/p"),
        ("./", MEMBER, 0, None, "#magpie"),
        ("#magpie", "name", 0, "magpie", None),
    )
    offered = overlay.root_properties(source, root("./"))
    assert lists(offered) == {("./", "name"): ["Birds"], ("./", "description"): ["A collection"]}
    assert lists(overlay.seed_root(typed, offered)) == {("./", "description"): ["A collection"]}


@pytest.mark.parametrize(("prop", "target", "moved"), [("memberOf", "arcp://b", 1), ("about", "arcp://b", 0), ("memberOf", "./", 0)])
def test_only_membership_of_the_local_root_moves(props, root, prop, target, moved):
    row = overlay.remap_root_refs(props(("#m", prop, 0, None, "./")), root(target)).first()
    assert row["remapped"] == moved
    assert row["ref"] == (target if moved else "./")


@pytest.mark.parametrize(
    ("named", "members", "missing"),
    [
        (["#magpie"], ["#magpie"], []),
        (["#magpie", "#ghost"], ["#magpie"], ["#ghost"]),
        (["#ghost"], ["#about", "#files"], ["#ghost"]),
        ([], ["#about", "#files"], []),
    ],
)
def test_membership_is_replaced_by_usable_members(props, nodes, root, lists, rows, named, members, missing):
    target = props(("arcp://b", MEMBER, 0, None, "#about"), ("arcp://b", MEMBER, 1, None, "#files"), ("#x", MEMBER, 0, None, "#y"))
    source = props(*[("./", MEMBER, i, None, m) for i, m in enumerate(named)], ("#magpie", "name", 0, "m", None))
    known = nodes(("#magpie", "RepositoryObject"), ("#about", "RepositoryObject"), ("#files", "RepositoryObject"))
    result = overlay.replace_membership(target, source, known, root("arcp://b"), root("./"))
    said = lists(result["props"])
    assert said[("arcp://b", MEMBER)] == [("@", m) for m in members]
    assert said[("#x", MEMBER)] == [("@", "#y")]
    assert rows(result["missing"], "ref") == [(m,) for m in missing]


def test_overlaying_a_graph(spark, props, nodes, root, lists, rows):
    prefixes = builtin_prefixes(root("./"))
    target = Graph(nodes(("arcp://b", "Dataset"), ("#about", "RepositoryObject")), props(("arcp://b", MEMBER, 0, None, "#about"), ("arcp://b", "name", 0, "Built", None)), root("arcp://b"), prefixes)
    source = Graph(
        nodes(("./", "Dataset"), ("#magpie", "RepositoryObject")),
        props(("./", MEMBER, 0, None, "#magpie"), ("#magpie", "memberOf", 0, None, "./"), ("./", "name", 0, "Birds", None), ("./", "description", 0, "Seen", None)),
        root("./"),
        prefixes,
    )
    merged = overlay_graph(target, source)
    assert rows(merged.nodes, "id") == [("#about",), ("#magpie",), ("arcp://b",)]
    assert lists(merged.props) == {
        ("arcp://b", "name"): ["Built"],
        ("arcp://b", "description"): ["Seen"],
        ("arcp://b", MEMBER): [("@", "#magpie")],
        ("#magpie", "memberOf"): [("@", "arcp://b")],
    }


def test_properties_follow_the_last_change(nodes, props, log, lists, rows):
    before = props(("f", "description", 0, "old", None), ("f", "who", 0, "A", None), ("f", "who", 1, "B", None), ("g", "name", 0, "n", None))
    changes = log(
        (1, "set", "f", "description", "first", None),
        (2, "set", "f", "description", "second", None),
        (3, "delete_property", "f", "who", None, None),
        (4, "set", "h", "creator", None, "#p"),
        (5, "set", "g", "name", None, None),
        (6, "set", "nobody", "name", "lost", None),
    )
    known = nodes(("f", "File"), ("g", "File"), ("h", "File"))
    assert rows(ed.edits_of_nothing(known, changes), "seq", "id") == [(6, "nobody")]
    assert lists(ed.edit_properties(known, before, changes)) == {
        ("f", "description"): ["second"],
        ("h", "creator"): [("@", "#p")],
    }


def test_one_change_may_set_several_values(nodes, props, table, lists):
    schema = "graph_id string, seq bigint, op string, id string, prop string, pos int, value string, ref string"
    changes = table([("g", 7, "set", "f", "who", i, v, None) for i, v in enumerate("XYZ")], schema)
    assert lists(ed.edit_properties(nodes(("f", "File")), props(("f", "who", 0, "A", None)), changes)) == {("f", "who"): ["X", "Y", "Z"]}


def test_additions(nodes, log, props, rows):
    known = nodes(("#a", "Person"))
    added = ed.add_entities(
        known,
        log((1, "add", "#a", None, "Place", None), (2, "add", "#b", None, "Place", None), (3, "set", "f", "x", None, "#c"), (4, "set", "f", "y", None, "#b")),
    )
    assert rows(added, "id", "type") == [("#b", "Place"), ("#c", "Thing")]
    assert rows(ed.placeholder_entities(known, props(("f", "x", 0, None, "#a"), ("f", "x", 1, None, "#z"))), "id", "type") == [("#z", "Thing")]


def test_renames_take_references_along(nodes, props, root, log, rows, lists):
    things = nodes(("#p", "Person"), ("#q", "Person"), ("f", "File"), ("./", "Dataset"))
    said = props(("#p", "name", 0, "P", None), ("f", "creator", 0, None, "#p"), ("f", "label", 0, "#p", None))
    changes = log(
        (1, "rename", "#p", None, "#q", None),  # taken
        (2, "rename", "#p", None, " #r ", None),
        (3, "rename", "#p", None, "#s", None),  # comes too late
        (4, "rename", "f", None, "f2", None),  # structural
        (5, "rename", "./", None, "arcp://x", None),
        (6, "rename", "#nobody", None, "#n", None),
        (7, "rename", "#q", None, "#r", None),  # taken by then
    )
    moved = ed.rename_ids(things, said, root("./"), changes)
    assert rows(moved["nodes"], "id") == [("#q",), ("#r",), ("./",), ("f",)]
    assert lists(moved["props"]) == {("#r", "name"): ["P"], ("f", "creator"): [("@", "#r")], ("f", "label"): ["#p"]}


def test_deletions_leave_no_reference(nodes, props, root, log, rows, lists):
    things = nodes(("#p", "Person"), ("f", "File"), ("./", "Dataset"))
    said = props(("#p", "name", 0, "P", None), ("f", "creator", 0, None, "#p"), ("f", "name", 0, "#p", None))
    left = ed.delete_entities(things, said, root("./"), log((1, "delete_entity", "#p", None, None, None), (2, "delete_entity", "./", None, None, None)))
    assert rows(left["nodes"], "id") == [("./",), ("f",)]
    assert lists(left["props"]) == {("f", "name"): ["#p"]}


def test_types_are_replaced(nodes, log, rows):
    changed = ed.retype(
        nodes(("#p", "Person"), ("#q", "Person")),
        log((1, "retype", "#p", None, "Place", None), (2, "retype", "#p", None, " Author, Person ,,Author", None), (3, "retype", "#q", None, " , ", None), (4, "retype", "#n", None, "X", None)),
    )
    assert rows(changed, "id", "pos", "type") == [("#p", 0, "Author"), ("#p", 1, "Person"), ("#q", 0, "Person")]


def test_a_whole_log(spark, nodes, props, root, log, rows, lists):
    graph = Graph(nodes(("#p", "Person"), ("./", "Dataset")), props(("#p", "name", 0, "P", None)), root("./"), builtin_prefixes(root("./")))
    edited = edit_graph(
        graph,
        log(
            (1, "set", "./", "author", None, "#new"),
            (2, "rename", "#new", None, "#author", None),
            (3, "retype", "#p", None, "Place", None),
            (4, "delete_entity", "#p", None, None, None),
        ),
    )
    assert rows(edited.nodes, "id", "type") == [("#author", "Thing"), ("./", "Dataset")]
    assert lists(edited.props) == {("./", "author"): [("@", "#author")]}
