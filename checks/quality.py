"""Checks, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import quality as q
from cairn.sinks.jsonld import graph_to_json
from cairn.sinks.sheets import column_sizes, graph_to_sheet, other_values, sheet_columns
from cairn.model import Graph, builtin_prefixes
from cairn.plans.scale import scratch_folder
from cairn.sinks.jsonld import write_documents
from cairn.sinks.store import load_graphs, save_graphs
from cairn.sources import jsonld, tables
from cairn.sources.large_json import read_graph_files
from checks.overlay import graph_roots
from checks.registry import check, graph_rows

CARD = """pr AS (SELECT class, prop, max(required) AS required, max(multiple) AS multiple FROM rules GROUP BY ALL),
cnt AS (SELECT graph_id, id, prop, count(*) AS found FROM rich_props GROUP BY ALL),
ck AS (SELECT n.graph_id, n.id, pr.class, pr.prop, coalesce(found, 0) AS found, CASE WHEN required = 1 AND found IS NULL THEN 'missing' WHEN multiple = 0 AND found > 1 THEN 'several' END AS problem
  FROM graph_nodes n JOIN pr ON pr.class = n.type LEFT JOIN cnt ON cnt.graph_id = n.graph_id AND cnt.id = n.id AND cnt.prop = pr.prop)"""


@check("val_01", "graph_nodes rich_props rules", f"WITH {CARD} SELECT graph_id, id, class, prop, problem, found FROM ck WHERE problem IS NOT NULL")
def cardinality(v):
    return q.check_cardinality(v("graph_nodes"), v("rich_props"), v("rules"))


FEW = """due AS (SELECT class, max(min_instances) AS wanted FROM {1} GROUP BY class HAVING max(min_instances) > 0),
few AS (SELECT g.graph_id, class, count(DISTINCT n.id) AS found, CAST(any_value(wanted) AS BIGINT) AS wanted
  FROM (SELECT DISTINCT graph_id FROM {0}) g CROSS JOIN due LEFT JOIN {0} n ON n.graph_id = g.graph_id AND n.type = class GROUP BY g.graph_id, class HAVING count(DISTINCT n.id) < any_value(wanted))"""


@check(
    "val_01_instances",
    "graph_nodes file_nodes rules",
    f"WITH n0 AS (SELECT graph_id, id, type FROM graph_nodes UNION ALL SELECT graph_id, id, type FROM file_nodes), {FEW.format('n0', 'rules')} SELECT graph_id, class, found, wanted FROM few",
)
def instances(v):
    return q.check_instances(v("graph_nodes").unionByName(v("file_nodes")), v("rules"))


FITS = """CASE range_type WHEN 'Text' THEN true
  WHEN 'Date' THEN (regexp_matches(value, '^\\d{4}-\\d{2}-\\d{2}$') AND try_cast(value AS DATE) IS NOT NULL) OR regexp_matches(value, '^\\d{4}(-(0[1-9]|1[0-2]))?$')
  WHEN 'DateTime' THEN regexp_matches(value, '^\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}') AND try_cast(value AS TIMESTAMP) IS NOT NULL
  WHEN 'Integer' THEN regexp_matches(value, '^[+-]?\\d+$')
  WHEN 'Number' THEN regexp_matches(value, '^[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?$')
  WHEN 'Boolean' THEN value IN ('true', 'false')
  WHEN 'URL' THEN regexp_matches(value, '^[A-Za-z][A-Za-z0-9+.-]*:\\S+$') ELSE false END"""
RANGES = f"""nn AS (SELECT * FROM graph_nodes UNION ALL SELECT * FROM typed_nodes), pp AS (SELECT * FROM rich_props UNION ALL SELECT * FROM typed_props),
rr AS (SELECT * FROM rules UNION ALL SELECT * FROM typed_rules),
gr AS (SELECT p.*, rr.class, bool_or(CASE WHEN p.ref IS NULL THEN {FITS} ELSE (range_type = 'URL' AND regexp_matches(p.ref, '^[A-Za-z][A-Za-z0-9+.-]*:\\S+$')) OR coalesce(t.type = range_type, false) END) AS ok
  FROM pp p JOIN nn n ON n.graph_id = p.graph_id AND n.id = p.id JOIN rr ON rr.class = n.type AND rr.prop = p.prop LEFT JOIN nn t ON t.graph_id = p.graph_id AND t.id = p.ref GROUP BY ALL),
bad AS (SELECT graph_id, id, class, prop, pos, value, ref FROM gr WHERE NOT ok)"""
VIEWS = "graph_nodes rich_props rules typed_nodes typed_props typed_rules"


def everything(v):
    return (
        v("graph_nodes").unionByName(v("typed_nodes")),
        v("rich_props").unionByName(v("typed_props")),
        v("rules").unionByName(v("typed_rules")),
    )


@check("val_02", VIEWS, f"WITH {RANGES} SELECT * FROM bad")
def ranges(v):
    return q.check_ranges(*everything(v))


DANGLING = "SELECT p.graph_id, p.id, prop, ref FROM {1} p ANTI JOIN {0} n ON n.graph_id = p.graph_id AND n.id = p.ref WHERE ref IS NOT NULL AND prop NOT IN ('license', 'conformsTo', 'encodingFormat')"


@check("val_03", "graph_nodes rich_props", DANGLING.format("graph_nodes", "rich_props"))
def dangling(v):
    return q.dangling_refs(v("graph_nodes"), v("rich_props"))


@check(
    "val_04",
    "graph_nodes rich_props rules",
    "SELECT DISTINCT graph_id, id, prop FROM rich_props ANTI JOIN (SELECT prop FROM rules) r USING (prop) WHERE id NOT LIKE '%7'",
)
def unknown(v):
    # every entity that ends in 7 defines vocabulary
    nodes = v("graph_nodes")
    vocabulary = nodes.filter("id LIKE '%7'").withColumns({"type": F.lit("rdf:Property"), "pos": F.lit(1)})
    return q.unknown_properties(nodes.unionByName(vocabulary), v("rich_props"), v("rules"))


@check(
    "val_05",
    "rules",
    """SELECT 'k' || c_custkey AS graph_id, CASE c_custkey % 3 WHEN 0 THEN NULL WHEN 1 THEN 'Person' ELSE 'Place' END AS class,
  CASE WHEN c_custkey % 3 = 0 THEN 'root types [Dataset, ' || c_mktsegment || '] match no class of the rules [Language, Organization, Person, Place]' END AS error FROM customer""",
)
def root_classes(v):
    key = F.col("c_custkey")
    kinds = F.when(key % 3 == 0, F.array(F.lit("Dataset"), "c_mktsegment")).when(
        key % 3 == 1, F.array(F.lit("Dataset"), F.lit("Person"), F.lit("Place"))
    ).otherwise(F.array(F.lit("Place"), F.lit("Person")))
    types = v("customer").select(F.concat(F.lit("k"), key).alias("graph_id"), F.posexplode(kinds).alias("pos", "type"))
    return q.root_class(types, v("rules"))


REPORT = f"""{RANGES}, pr AS (SELECT class, prop, max(required) AS required, max(multiple) AS multiple FROM rr GROUP BY ALL),
cnt AS (SELECT graph_id, id, prop, count(*) AS found FROM pp GROUP BY ALL),
ck AS (SELECT n.graph_id, n.id, pr.prop, CASE WHEN required = 1 AND found IS NULL THEN 'missing' WHEN multiple = 0 AND found > 1 THEN 'several' END AS problem
  FROM nn n JOIN pr ON pr.class = n.type LEFT JOIN cnt ON cnt.graph_id = n.graph_id AND cnt.id = n.id AND cnt.prop = pr.prop), {FEW.format('nn', 'rr')},
rep AS (SELECT graph_id, 'error' AS severity, 'cardinality' AS "check", id, prop, problem AS detail FROM ck WHERE problem IS NOT NULL
  UNION ALL SELECT graph_id, 'error', 'range', id, prop, coalesce(value, ref) FROM bad
  UNION ALL SELECT graph_id, 'warning', 'dangling', id, prop, ref FROM ({DANGLING.format('nn', 'pp')}) d
  UNION ALL SELECT DISTINCT graph_id, 'warning', 'unknown', id, prop, NULL FROM pp ANTI JOIN rr USING (prop)
  UNION ALL SELECT graph_id, 'error', 'instances', NULL, NULL, class FROM few)"""


@check("val_06", VIEWS, f"WITH {REPORT} SELECT * FROM rep", once="graph_nodes rich_props")
def report(v):
    return q.quality_report(*everything(v))


@check(
    "val_06_summary",
    VIEWS,
    f"WITH {REPORT} SELECT graph_id, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, 0 AS passed FROM rep GROUP BY graph_id UNION ALL SELECT DISTINCT 'h' || graph_id, 0, 0, 1 FROM graph_nodes",
    once="graph_nodes rich_props",
)
def summary(v):
    roots = graph_roots(v("graph_nodes"))
    clean = roots.withColumn("graph_id", F.concat(F.lit("h"), "graph_id"))
    return q.quality_summary(q.quality_report(*everything(v)), roots.unionByName(clean))


#: a value opens its property if it is the first, and closes the list if it is the last of several
JSON = """vs AS (SELECT graph_id, id, prop AS key, pos, CASE WHEN ref IS NOT NULL THEN '{"@id":' || to_json(ref) || '}' ELSE to_json(value) END AS json FROM rich_props
  UNION ALL SELECT graph_id, id, '@type', pos, to_json(type) FROM graph_nodes),
nu AS (SELECT *, count(*) OVER (PARTITION BY graph_id, id, key) AS n, row_number() OVER (PARTITION BY graph_id, id, key ORDER BY pos) AS nth FROM vs),
en AS (SELECT graph_id, id FROM graph_nodes UNION SELECT graph_id, id FROM rich_props)"""


@check(
    "snk_01",
    "graph_nodes rich_props",
    f"""WITH {JSON}
SELECT graph_id, id, 0 AS rank, NULL::VARCHAR AS key, NULL::BIGINT AS pos, '{{"@id":' || to_json(id) AS text FROM en
UNION ALL SELECT graph_id, id, 1, key, pos, ',' || CASE WHEN nth = 1 THEN to_json(key) || ':' ELSE '' END || CASE WHEN nth = 1 AND n > 1 THEN '[' ELSE '' END
  || json || CASE WHEN nth = n AND n > 1 THEN ']' ELSE '' END FROM nu
UNION ALL SELECT graph_id, id, 2, NULL, NULL, '}}' FROM en""",
)
def json_fragments(v):
    return graph_to_json(v("graph_nodes"), v("rich_props"))


SHEET = ["@contentLocation", "@custom:order", "custom:segment", "email", "name"]


@check(
    "snk_02",
    "graph_nodes rich_props",
    """WITH p AS (SELECT graph_id, id FROM graph_nodes WHERE type = 'Person'),
c AS (SELECT graph_id, id, CASE WHEN ref IS NOT NULL THEN '@' || prop ELSE prop END AS col, list(coalesce(ref, value) ORDER BY pos) AS items FROM rich_props SEMI JOIN p USING (graph_id, id) GROUP BY ALL),
t AS (SELECT graph_id, id, col, CASE WHEN len(items) = 1 AND NOT starts_with(items[1], '[') AND items[1] <> '' THEN items[1] ELSE CAST(to_json(items) AS VARCHAR) END AS cell FROM c
  UNION ALL SELECT graph_id, id, '', '' FROM p)
SELECT graph_id, id, max(cell) FILTER (WHERE col = '@contentLocation') AS "@contentLocation", max(cell) FILTER (WHERE col = '@custom:order') AS "@custom:order",
  max(cell) FILTER (WHERE col = 'custom:segment') AS "custom:segment", max(cell) FILTER (WHERE col = 'email') AS email, max(cell) FILTER (WHERE col = 'name') AS name FROM t GROUP BY graph_id, id""",
)
def sheet(v):
    return graph_to_sheet(v("graph_nodes"), v("rich_props"), "Person", SHEET)


@check(
    "snk_02_columns",
    "graph_nodes rich_props",
    """SELECT type, CASE WHEN ref IS NOT NULL THEN '@' || prop ELSE prop END AS "column", count(*) AS "values"
FROM rich_props p JOIN graph_nodes n USING (graph_id, id) GROUP BY ALL""",
)
def columns_in_use(v):
    return sheet_columns(v("graph_nodes"), v("rich_props"))


@check(
    "snk_02_sizes",
    "graph_nodes rich_props",
    """WITH e AS (SELECT type, CASE WHEN ref IS NOT NULL THEN '@' || prop ELSE prop END AS "column", count(*) AS n, sum(length(coalesce(ref, value))) AS c
FROM rich_props p JOIN graph_nodes n USING (graph_id, id) GROUP BY type, "column", graph_id, id)
SELECT type, "column", count(*) AS entities, max(n) AS longest, CAST(max(coalesce(c, 0)) AS BIGINT) AS characters FROM e GROUP BY ALL""",
)
def sizes_of_columns(v):
    return column_sizes(v("graph_nodes"), v("rich_props"))


@check(
    "snk_02_others",
    "graph_nodes rich_props",
    """SELECT graph_id, id, CASE WHEN ref IS NOT NULL THEN '@' || prop ELSE prop END AS "column", p.pos, value, ref FROM rich_props p JOIN graph_nodes n USING (graph_id, id)
WHERE type = 'Person' AND prop NOT IN ('contentLocation', 'name')""",
)
def values_left_out(v):
    return other_values(v("graph_nodes"), v("rich_props"), "Person", ["@contentLocation", "name"])


@check(
    "src_02",
    "json_docs",
    """WITH d AS (SELECT * FROM json_docs WHERE c_custkey % 10 <> 9)
SELECT graph_id, 'ro-crate-metadata.json' AS id, '@type' AS prop, CAST(0 AS BIGINT) AS pos, 'CreativeWork' AS value, NULL::VARCHAR AS ref FROM d WHERE c_custkey % 3 <> 2
UNION ALL SELECT graph_id, 'ro-crate-metadata.json', 'about', 0, NULL, root FROM d WHERE c_custkey % 3 <> 2
UNION ALL SELECT graph_id, '#person', unnest(['@type', 'name', 'size']), 0, unnest(['Person', c_name, CAST(c_custkey AS VARCHAR)]), NULL FROM d
UNION ALL SELECT graph_id, root, unnest(['@type', '@type', 'name', 'name', 'open', 'tags', 'tags']), unnest([0, 1, 0, 1, 0, 0, 2]), unnest(['Dataset', 'RepositoryCollection', 'One', 'T&wo', 'true', 'a', 'b']), NULL FROM d
UNION ALL SELECT graph_id, root, 'tags', 1, NULL, '#person' FROM d UNION ALL SELECT graph_id, root, 'author', 0, NULL, '#person' FROM d""",
)
def parsed(v):
    return graph_rows(jsonld.read_graph(v("json_docs")))


@check(
    "src_02_rejected",
    "json_docs",
    "SELECT graph_id, CAST(NULL AS INTEGER) AS entity_no, 'no readable @graph' AS reason FROM json_docs WHERE c_custkey % 10 = 9",
)
def documents_rejected(v):
    return jsonld.read_graph(v("json_docs"))["rejected"]


@check("src_02_roots", "json_docs", "SELECT graph_id, root AS root_id FROM json_docs WHERE c_custkey % 10 <> 9")
def roots_found(v):
    return jsonld.read_graph(v("json_docs"))["roots"]


@check(
    "src_02_prefixes",
    "json_docs",
    "SELECT graph_id, 'x' || c_nationkey AS prefix, 'https://example.org/' || c_nationkey || '#' AS uri FROM json_docs WHERE c_custkey % 10 <> 9",
)
def prefixes_found(v):
    return jsonld.read_graph(v("json_docs"))["prefixes"]


@check(
    "src_03",
    "",
    "SELECT 'g' AS graph_id, CAST(doc_id AS VARCHAR) AS id, CAST(quality AS VARCHAR) AS quality FROM labels",
)
def sheet_read(v):
    raw = v("labels").select(
        F.concat(F.lit(" "), "doc_id").alias(" @id "),
        F.col("quality").alias("quality  "),
        F.col("toxic").alias("   "),
        F.col("toxic").alias("quality"),
    )
    return tables.clean_sheet(raw, F.lit("g"))


@check(
    "src_04",
    "graph_nodes rich_props",
    """SELECT graph_id, id, '@type' AS prop, CAST(0 AS BIGINT) AS pos, type AS value, NULL::VARCHAR AS ref FROM graph_nodes
UNION ALL SELECT graph_id, id, prop, row_number() OVER (PARTITION BY graph_id, id, prop ORDER BY pos) - 1, value, ref FROM rich_props""",
)
def round_trip(v):
    columns = {
        "Person": SHEET,
        "Organization": ["@contentLocation", "@license", "name"],
        "Place": ["@isPartOf", "name"],
        "RepositoryCollection": ["name"],
    }
    made = {k: graph_to_sheet(v("graph_nodes"), v("rich_props"), k, names) for k, names in columns.items()}
    return graph_rows(tables.sheets_to_graph(made))


ALL_ROWS = """SELECT graph_id, id, '@type' AS prop, CAST(0 AS BIGINT) AS pos, type AS value, NULL::VARCHAR AS ref FROM graph_nodes
UNION ALL SELECT graph_id, id, prop, row_number() OVER (PARTITION BY graph_id, id, prop ORDER BY pos) - 1, value, ref FROM rich_props"""


@check("src_02_files", "graph_nodes rich_props", ALL_ROWS)
def read_by_byte_range(v):
    """Graphs written as documents of several files each, and read in byte ranges."""
    nodes, props = v("graph_nodes"), v("rich_props")
    folder = scratch_folder(nodes.sparkSession)
    write_documents(nodes, props, builtin_prefixes(nodes), folder)
    name = F.regexp_extract("document", "/graph_id=([^/]*)$", 1)
    return graph_rows(read_graph_files(nodes.sparkSession, f"{folder}/graph_id=*", name, folders=True))


@check("snk_01_store", "graph_nodes rich_props", ALL_ROWS, once="graph_nodes rich_props")
def saved_and_loaded(v):
    """A save of all graphs, one of them with other values, and a save of that one over it."""
    nodes, props = v("graph_nodes"), v("rich_props")
    spark, folder = nodes.sparkSession, scratch_folder(nodes.sparkSession)
    one = nodes.agg(F.min("graph_id").alias("graph_id"))
    other = F.when(F.col("graph_id") == nodes.agg(F.min("graph_id")).first()[0], F.upper("value")).otherwise(F.col("value"))
    save_graphs(Graph(nodes, props.withColumn("value", other), None, builtin_prefixes(nodes)), folder)
    save_graphs(Graph(nodes, props, None, builtin_prefixes(nodes)), folder, only=one)
    read = load_graphs(spark, folder)
    return graph_rows({"nodes": read.nodes, "props": read.props})


@check(
    "src_05",
    "candidates",
    """WITH c AS (SELECT graph_id, name, last_modified, content NOT LIKE '{ not%' AS ok, last_modified * 10 - CASE name WHEN 'additional-ro-crate-metadata.xlsx' THEN 1 WHEN 'ro-crate-metadata.xlsx' THEN 2 ELSE 3 END AS ord
  FROM candidates WHERE name <> 'other.json'),
b AS (SELECT graph_id, arg_max(row(name, last_modified, ok), row(ord, ok)) AS w, arg_max(row(name, last_modified, ok), ord) FILTER (WHERE ok AND name = 'ro-crate-metadata.json') AS j FROM c GROUP BY graph_id),
x AS (SELECT graph_id, CASE WHEN w[3] THEN w ELSE j END AS p, NOT w[3] AS fell FROM b)
SELECT graph_id, p[1] AS name, p[2] AS last_modified, CAST(fell AS INTEGER) AS fell_back FROM x WHERE p IS NOT NULL""",
)
def newest(v):
    return jsonld.pick_newest_source(v("candidates"))


@check("src_06", "catalog", "SELECT name, code, 'src' || is_alternate AS source FROM catalog WHERE is_alternate = 0")
def records(v):
    catalog = v("catalog").select("name", "code", F.concat(F.lit("src"), "is_alternate").alias("source"))
    return tables.catalog_records(catalog, "src0")


@check(
    "src_07",
    "",
    """WITH i AS (SELECT p_brand AS class, CASE p_size % 9 WHEN 8 THEN 'hasPart' ELSE p_name || ' ' || p_partkey END AS name, p_size % 7 AS k, p_size % 2 AS required, p_partkey % 2 AS multiple, p_size % 5 = 0 AS listed FROM part),
t AS (SELECT *, CASE k WHEN 0 THEN ['Text'] WHEN 1 THEN ['Date'] WHEN 2 THEN ['URL', 'Text'] WHEN 3 THEN ['Person'] WHEN 4 THEN ['Text', 'Place', 'Organization'] WHEN 5 THEN ['Value'] ELSE ['Text', 'URL', 'Date'] END AS types FROM i WHERE name <> 'hasPart' AND k <> 5)
SELECT class, name AS prop, unnest(types) AS range_type, required, CAST(multiple AS INTEGER) AS multiple,
  CASE WHEN list_contains(types, 'Date') THEN 'date' WHEN list_contains(types, 'URL') THEN 'url' WHEN listed THEN 'select' WHEN k IN (3, 4) THEN 'entity-ref' ELSE 'text' END AS kind FROM t""",
)
def rule_rows(v):
    size, key = F.col("p_size"), F.col("p_partkey")
    kinds = [["Text"], ["Date"], ["URL", "Text"], ["Person"], ["Text", "Place", "Organization"], ["Value"], ["Text", "URL", "Date"]]
    types = F.get(F.array(*[F.array(*[F.lit(t) for t in k]) for k in kinds]), (size % 7).cast("int"))
    inputs = v("part").select(
        F.col("p_brand").alias("class"),
        F.when(size % 9 == 8, "hasPart").otherwise(F.concat_ws(" ", "p_name", "p_partkey")).alias("name"),
        types.alias("type"),
        (size % 2 == 1).alias("required"),
        (key % 2 == 1).alias("multiple"),
        F.when(size % 5 == 0, F.array("p_type")).alias("values"),
    )
    return tables.class_rules(inputs)
