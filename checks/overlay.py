"""Overlays and bulk edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import edits as ed
from cairn.operators import overlay
from checks.registry import check, graph_rows

COLS = "graph_id, id, prop, pos, value, ref"


def local_roots(frame):
    return frame.select("graph_id").distinct().withColumn("root_id", F.lit("./"))


def graph_roots(frame):
    return frame.select("graph_id").distinct().withColumn("root_id", F.lit("#region-0"))


@check(
    "mg_01",
    "rich_props overlay_props",
    f"""WITH s AS (SELECT * FROM overlay_props WHERE id <> './')
SELECT {COLS} FROM rich_props t ANTI JOIN s ON t.graph_id = s.graph_id AND t.id = s.id AND t.prop = s.prop UNION ALL SELECT {COLS} FROM s""",
)
def merged(v):
    source = v("overlay_props")
    return overlay.merge_graphs(v("rich_props"), source, local_roots(source))


@check(
    "mg_01_counts",
    "graph_nodes overlay_props",
    """WITH s AS (SELECT DISTINCT graph_id, id FROM overlay_props WHERE id <> './')
SELECT s.graph_id, count(*) FILTER (WHERE n.id IS NULL) AS added, count(*) FILTER (WHERE n.id IS NOT NULL) AS enriched
FROM s LEFT JOIN graph_nodes n ON n.graph_id = s.graph_id AND n.id = s.id GROUP BY s.graph_id""",
)
def merge_counted(v):
    source = v("overlay_props")
    return overlay.merge_counts(v("graph_nodes"), source, local_roots(source))


@check(
    "mg_02",
    "rich_props overlay_props",
    f"SELECT {COLS} FROM overlay_props s ANTI JOIN rich_props t ON t.graph_id = s.graph_id AND t.id = s.id AND t.prop = s.prop",
)
def seeded(v):
    return overlay.seed_root(v("rich_props"), v("overlay_props")).select(*COLS.split(", "))


@check(
    "mg_03",
    "member_props overlay_props",
    "SELECT graph_id, id, prop, pos, value, ref FROM overlay_props WHERE id = './' UNION ALL SELECT graph_id, './', 'author', pos, value, ref FROM member_props",
)
def root_said(v):
    members = v("member_props")
    authors = members.withColumn("prop", F.lit("author"))
    typed = members.withColumns({"prop": F.lit("conformsTo")})
    everything = v("overlay_props").unionByName(members).unionByName(authors).unionByName(typed)
    return overlay.root_properties(everything, local_roots(everything)).select(*COLS.split(", "))


@check(
    "mg_04",
    "overlay_props",
    """SELECT graph_id, id, prop, pos, value, CASE WHEN prop = 'memberOf' AND ref = './' THEN '#region-0' ELSE ref END AS ref,
  CASE WHEN prop = 'memberOf' AND ref = './' THEN 1 ELSE 0 END AS remapped FROM overlay_props
UNION ALL SELECT graph_id, id, 'about', pos, value, ref, 0 FROM overlay_props""",
)
def remapped(v):
    source = v("overlay_props")
    both = source.unionByName(source.withColumn("prop", F.lit("about")))
    return overlay.remap_root_refs(both, graph_roots(source))


USABLE = "u AS (SELECT s.* FROM claimed_props s SEMI JOIN member_nodes n ON n.graph_id = s.graph_id AND n.id = s.ref)"


@check(
    "mg_05",
    "member_props claimed_props member_nodes",
    f"""WITH {USABLE}
SELECT {COLS} FROM member_props t ANTI JOIN u ON t.graph_id = u.graph_id UNION ALL SELECT {COLS} FROM u""",
)
def membership(v):
    roots = local_roots(v("member_nodes"))
    return overlay.replace_membership(v("member_props"), v("claimed_props"), v("member_nodes"), roots, roots)["props"]


@check(
    "mg_05_missing",
    "claimed_props member_nodes",
    f"SELECT {COLS} FROM claimed_props s ANTI JOIN member_nodes n ON n.graph_id = s.graph_id AND n.id = s.ref",
)
def unusable_members(v):
    roots = local_roots(v("member_nodes"))
    return overlay.replace_membership(v("member_props"), v("claimed_props"), v("member_nodes"), roots, roots)["missing"]


LAST = """d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, id, prop ORDER BY seq DESC) AS rn FROM {0} WHERE op IN ('set', 'delete_property')) x WHERE rn = 1)"""
EDITED = f"""SELECT {COLS} FROM {{1}} t ANTI JOIN d ON t.graph_id = d.graph_id AND t.id = d.id AND t.prop = d.prop
UNION ALL SELECT graph_id, id, prop, CAST(0 AS BIGINT), value, ref FROM d WHERE op = 'set' AND EXISTS (SELECT 1 FROM {{0}} e WHERE e.graph_id = d.graph_id AND e.id = d.id)"""


@check("ed_01", "graph_nodes rich_props edits", f"WITH {LAST.format('edits')} {EDITED.format('graph_nodes', 'rich_props')}")
def properties_edited(v):
    return ed.edit_properties(v("graph_nodes"), v("rich_props"), v("edits"))


@check(
    "ed_01_rejected",
    "graph_nodes more_edits",
    "SELECT graph_id, seq, id, prop FROM more_edits e WHERE op IN ('set', 'delete_property') AND NOT EXISTS (SELECT 1 FROM graph_nodes n WHERE n.graph_id = e.graph_id AND n.id = e.id)",
)
def edits_rejected(v):
    return ed.edits_of_nothing(v("graph_nodes"), v("more_edits"))


@check(
    "ed_02",
    "graph_nodes edits more_edits",
    """WITH a AS (
  SELECT graph_id, id, 'Thing' AS type, NULL AS seq FROM (SELECT DISTINCT graph_id, ref AS id FROM more_edits WHERE op = 'set' AND ref IS NOT NULL) x
  UNION ALL SELECT graph_id, id, value, seq FROM more_edits WHERE op = 'add'
  UNION ALL SELECT DISTINCT graph_id, id, 'Thing', NULL FROM edits WHERE op = 'set')
SELECT graph_id, id, coalesce(arg_min(type, seq) FILTER (WHERE seq IS NOT NULL), 'Thing') AS type, 0 AS pos
FROM a ANTI JOIN graph_nodes n USING (graph_id, id) GROUP BY graph_id, id""",
)
def entities_added(v):
    # a link to every entity that the first log edits
    links = v("edits").filter("op = 'set'").withColumn("ref", F.col("id"))
    return ed.add_entities(v("graph_nodes"), v("more_edits").unionByName(links))


@check(
    "ed_02_placeholders",
    "graph_nodes rich_props",
    "SELECT DISTINCT p.graph_id, ref AS id, 'Thing' AS type, 0 AS pos FROM rich_props p ANTI JOIN graph_nodes n ON n.graph_id = p.graph_id AND n.id = p.ref WHERE ref IS NOT NULL",
)
def placeholders(v):
    return ed.placeholder_entities(v("graph_nodes"), v("rich_props"))


def renames(nodes: str, log: str) -> str:
    return f"""f AS (SELECT e.graph_id, seq, e.id AS old, trim(value) AS new FROM {log} e
  SEMI JOIN {nodes} k ON k.graph_id = e.graph_id AND k.id = e.id
  ANTI JOIN (SELECT graph_id, id FROM {nodes} WHERE type IN ('File', 'RepositoryObject', 'RepositoryCollection') OR id = '#region-0') st ON st.graph_id = e.graph_id AND st.id = e.id
  ANTI JOIN {nodes} t ON t.graph_id = e.graph_id AND t.id = e.value
  WHERE op = 'rename' AND value <> '' AND value <> e.id),
f1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, old ORDER BY seq) AS rn FROM f) x WHERE rn = 1),
rn AS (SELECT graph_id, old, new FROM (SELECT graph_id, old, new, row_number() OVER (PARTITION BY graph_id, new ORDER BY seq) AS rn FROM f1) x WHERE rn = 1)"""


def renamed(nodes: str, props: str) -> str:
    return f"""nn AS (SELECT n.graph_id, coalesce(new, id) AS id, type, pos FROM {nodes} n LEFT JOIN rn ON rn.graph_id = n.graph_id AND old = id),
pp AS (SELECT p.graph_id, coalesce(a.new, id) AS id, prop, pos, value, coalesce(b.new, ref) AS ref
  FROM {props} p LEFT JOIN rn a ON a.graph_id = p.graph_id AND a.old = id LEFT JOIN rn b ON b.graph_id = p.graph_id AND b.old = ref)"""


AS_ROWS = f"""SELECT graph_id, id, '@type' AS prop, CAST(pos AS BIGINT) AS pos, type AS value, NULL::VARCHAR AS ref FROM {{0}}
UNION ALL SELECT {COLS} FROM {{1}}"""

# links between customers, so that renames and deletions have references to follow
LINKED = """linked AS (SELECT graph_id, id, prop, pos, value, ref FROM rich_props
  UNION ALL SELECT 'g' || c_custkey % 3, '#nation-' || c_nationkey, 'knows', c_custkey, NULL, '#customer-' || c_custkey FROM customer)"""


def linked_props(v):
    knows = v("customer").select(
        F.concat(F.lit("g"), F.col("c_custkey") % 3).alias("graph_id"),
        F.concat(F.lit("#nation-"), "c_nationkey").alias("id"),
        F.lit("knows").alias("prop"),
        F.col("c_custkey").alias("pos"),
        F.lit(None).cast("string").alias("value"),
        F.concat(F.lit("#customer-"), "c_custkey").alias("ref"),
    )
    return v("rich_props").unionByName(knows)


@check(
    "ed_03",
    "graph_nodes rich_props more_edits",
    f"WITH {LINKED}, {renames('graph_nodes', 'more_edits')}, {renamed('graph_nodes', 'linked')} {AS_ROWS.format('nn', 'pp')}",
)
def ids_renamed(v):
    nodes = v("graph_nodes")
    return graph_rows(ed.rename_ids(nodes, linked_props(v), local_roots(nodes), v("more_edits")))


def deleted(nodes: str, props: str, log: str) -> str:
    return f"""gone AS (SELECT DISTINCT graph_id, id FROM {log} WHERE op = 'delete_entity' AND id <> '#region-0'),
dn AS (SELECT n.* FROM {nodes} n ANTI JOIN gone ON gone.graph_id = n.graph_id AND gone.id = n.id),
dp AS (SELECT p.* FROM {props} p ANTI JOIN gone ON gone.graph_id = p.graph_id AND gone.id = p.id ANTI JOIN gone g2 ON g2.graph_id = p.graph_id AND g2.id = p.ref)"""


@check(
    "ed_04",
    "graph_nodes rich_props edits more_edits",
    f"""WITH {LINKED}, logs AS (SELECT graph_id, op, id FROM edits UNION ALL SELECT graph_id, op, id FROM more_edits),
{deleted('graph_nodes', 'linked', 'logs')} {AS_ROWS.format('dn', 'dp')}""",
)
def entities_deleted(v):
    nodes = v("graph_nodes")
    log = v("edits").unionByName(v("more_edits"))
    return graph_rows(ed.delete_entities(nodes, linked_props(v), graph_roots(nodes), log))


def retyped(nodes: str, log: str) -> str:
    return f"""ty AS (SELECT e.graph_id, e.id, seq, [trim(x) FOR x IN string_split(value, ',') IF trim(x) <> ''] AS types
  FROM {log} e SEMI JOIN {nodes} n ON n.graph_id = e.graph_id AND n.id = e.id WHERE op = 'retype'),
ty1 AS (SELECT graph_id, id, arg_max(types, seq) AS types FROM ty WHERE len(types) > 0 GROUP BY graph_id, id),
ty2 AS (SELECT graph_id, id, unnest(types) AS type, unnest(range(len(types))) AS nth FROM ty1),
rt AS (SELECT n.graph_id, n.id, n.type, n.pos FROM {nodes} n ANTI JOIN ty1 ON ty1.graph_id = n.graph_id AND ty1.id = n.id
  UNION ALL SELECT graph_id, id, type, CAST(row_number() OVER (PARTITION BY graph_id, id ORDER BY min(nth)) - 1 AS INTEGER) FROM ty2 GROUP BY graph_id, id, type)"""


@check(
    "ed_05",
    "graph_nodes edits more_edits",
    f"""WITH logs AS (SELECT graph_id, seq, op, id, value FROM more_edits UNION ALL SELECT graph_id, seq, 'retype', id, value FROM edits WHERE op = 'set' AND value IS NOT NULL),
{retyped('graph_nodes', 'logs')} SELECT graph_id, id, type, pos FROM rt""",
    once="graph_nodes",
)
def types_edited(v):
    more = v("edits").filter("op = 'set'").withColumn("op", F.lit("retype"))
    return ed.retype(v("graph_nodes"), v("more_edits").unionByName(more))


@check(
    "ed_06",
    "graph_nodes rich_props more_edits",
    f"""WITH {LINKED}, {LAST.format('more_edits')}, {retyped('graph_nodes', 'more_edits')},
ad AS (SELECT graph_id, id, 'Thing' AS type, NULL AS seq FROM (SELECT DISTINCT graph_id, ref AS id FROM more_edits WHERE op = 'set' AND ref IS NOT NULL) x
  UNION ALL SELECT graph_id, id, value, seq FROM more_edits WHERE op = 'add'),
an AS (SELECT graph_id, id, type, pos FROM rt UNION ALL SELECT graph_id, id, coalesce(arg_min(type, seq) FILTER (WHERE seq IS NOT NULL), 'Thing'), 0
  FROM ad ANTI JOIN rt USING (graph_id, id) GROUP BY graph_id, id),
ep AS ({EDITED.format('an', 'linked')}),
{renames('an', 'more_edits')}, {renamed('an', 'ep')}, {deleted('nn', 'pp', 'more_edits')} {AS_ROWS.format('dn', 'dp')}""",
    once="graph_nodes",
)
def log_applied(v):
    nodes = v("graph_nodes")
    return graph_rows(ed.apply_edits(nodes, linked_props(v), graph_roots(nodes), v("more_edits")))
