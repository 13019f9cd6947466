"""What is costly is worked out once, however many parts and readers a table has."""

from functools import reduce

from cairn.model import Graph, builtin_prefixes
from cairn.operators import edits as ed
from cairn.operators import files as fs
from cairn.operators import quality as q
from cairn.operators import terms
from cairn.sinks.store import load_graphs, save_graphs


def optimised(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def parts(make, count):
    return reduce(lambda a, b: a.unionByName(b), [make(k) for k in range(count)])


LOG = "graph_id string, seq bigint, op string, id string, prop string, value string, ref string"


def test_types_are_looked_up_once_for_a_table_of_parts(nodes, table, rows):
    log = table([("g", 1, "retype", "#1", None, "Place, Thing", None)], LOG)
    whole, cut = (ed.retype(parts(lambda k: nodes((f"#{k}", "Person")), n), log) for n in (1, 4))
    assert optimised(cut).count("Join ") == optimised(whole).count("Join ")
    assert rows(cut, "id", "type") == [("#0", "Person"), ("#1", "Place"), ("#1", "Thing"), ("#2", "Person"), ("#3", "Person")]


def test_edits_are_looked_up_once_for_a_table_of_parts(nodes, props, root, table, rows):
    log = table([("g", 1, "set", "#1", "name", "new", None), ("g", 2, "delete_entity", "#2", None, None, None)], LOG)
    things = nodes(*[(f"#{k}", "Person") for k in range(4)])

    def made(n):
        said = parts(lambda k: props((f"#{k}", "name", 0, str(k), None), (f"#{k}", "knows", 0, None, "#2")), n)
        return ed.edit_properties(things, said, log), ed.delete_entities(things, said, root("./"), log)["props"]

    for cut, whole in zip(made(4), made(1), strict=True):
        assert optimised(cut).count("Join ") == optimised(whole).count("Join ")
    assert rows(made(4)[0].filter("prop = 'name'"), "id", "value") == [("#0", "0"), ("#1", "new"), ("#2", "2"), ("#3", "3")]
    assert rows(made(4)[1], "id", "prop") == [("#0", "name"), ("#1", "name"), ("#3", "name")]


RULES = "class string, prop string, range_type string, required int, multiple int, min_instances int"


def test_ranges_read_the_values_once(nodes, props, table, rows):
    rules = table([("Person", "born", "Date", 0, 1, 0), ("Place", "born", "Text", 0, 1, 0), ("Person", "home", "Place", 0, 1, 0)], RULES)
    things = nodes(("#a", "Person"), ("#p", "Place"))
    said = props(("#a", "born", 0, "x", None), ("#p", "born", 0, "x", None), ("#a", "home", 0, None, "#p"), ("#a", "home", 1, None, "#a"))
    found = q.check_ranges(things, said, rules)
    assert optimised(found).count("LogicalRDD [graph_id#") == 3  # values, types of entities and of targets
    assert rows(found, "id", "prop", "pos") == [("#a", "born", 0), ("#a", "home", 1)]


def test_values_with_nothing_to_tell_are_not_judged(nodes, props, table, rows):
    rules = table([("Person", "born", "Date", 0, 1, 0), ("Person", "home", "URL", 0, 1, 0)], RULES)
    said = props(("#a", "born", 0, "1990", None), ("#a", "born", 1, "soon", None), ("#a", "home", 0, "https://a", None), ("#a", "own", 0, "x", None))
    assert rows(q.judged(nodes(("#a", "Person")), said, rules), "prop", "unknown") == [("born", False), ("own", True)]


def test_files_are_placed_once(listing):
    made = fs.folder_collections(fs.file_metadata(fs.order_files(listing("Top/x/1", "Top/2", "Top.txt", "solo.md"))))
    assert "_piece" not in optimised(made["props"]) and "Join " not in optimised(made["nodes"])


def test_hits_are_found_once(nodes, table, rows):
    hits = table([("g", "a", "#L", "Lang"), ("g", "b", "#L", "Lang")], "graph_id string, file_id string, term_id string, name string")
    made = terms.link_terms(nodes(("a", "File")), hits)
    assert optimised(made["props"]).count("LogicalRDD") == 1  # the entities; hits are staged
    assert rows(made["props"].filter("prop = 'ldac:subjectLanguage'"), "id", "ref") == [("a", "#L")]


def test_stored_lines_are_parsed_once(spark, nodes, props, root, lists, tmp_path):
    said = props(("#a", "name", 0, "x", None), ("#a", "name", 1, "y", None))
    save_graphs(Graph(nodes(("#a", "Person")), said, None, builtin_prefixes(root("./"))), f"{tmp_path}/store")
    read = load_graphs(spark, f"{tmp_path}/store")
    assert "] text" not in optimised(read.props) and "] text" not in optimised(read.nodes)
    assert lists(read.props) == {("#a", "name"): ["x", "y"]}
