"""Path and name functions, listings, and the structure built from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn import functions as fn
from cairn.model import fact, prop_rows
from cairn.operators import documents, stats
from cairn.operators import files as fs
from cairn.sources.listing import scan_files
from checks.registry import check, graph_rows

STEM = "regexp_replace({0}, '^(.+)\\.[^.]*$', '\\1')"
NORMAL = (
    "trim(regexp_replace(regexp_replace(regexp_replace(lower("
    + STEM
    + "), '\\b(copy|duplicate)\\b', '', 'g'), '\\([0-9]+\\)', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
)
SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"

KEPT = """kept AS (
  SELECT * FROM order_files WHERE len([x FOR x IN string_split(relative_path, '/')
    IF starts_with(x, '.') OR starts_with(x, '~$') OR x IN ('ro-crate-preview_html', 'ro-crate-metadata.json')]) = 0)"""


def meta_sql(table: str) -> str:
    return f"""m AS (
  SELECT *, CASE WHEN len(folders) > 0 THEN folders[1] ELSE {STEM.format("file_name")} END AS top,
    '#' || replace(top, ' ', '_') AS group_id
  FROM (SELECT graph_id, file_name, relative_path AS id,
      row_number() OVER (PARTITION BY graph_id ORDER BY relative_path) - 1 AS file_no,
      [x FOR x IN string_split(CASE WHEN contains(relative_path, '/') THEN regexp_replace(relative_path, '/[^/]*$', '') ELSE '' END, '/')
        IF x NOT IN ('', '.')] AS folders
    FROM {table}) f)"""


def described(table: str, id: str, name: str, profile: str) -> str:
    return f"""
SELECT graph_id, {id} AS id, 'conformsTo' AS prop, CAST(0 AS BIGINT) AS pos, NULL::VARCHAR AS value, 'https://w3id.org/ldac/profile#{profile}' AS ref FROM {table}
UNION ALL SELECT graph_id, {id}, 'name', 0, {name}, NULL FROM {table}
UNION ALL SELECT graph_id, {id}, 'description', 0, '', NULL FROM {table}
UNION ALL SELECT graph_id, {id}, 'datePublished', 0, '', NULL FROM {table}"""


ROOTS = "roots AS (SELECT DISTINCT graph_id, 'arcp://name,' || graph_id AS root_id FROM {0})"


def meta(files):
    return fs.file_metadata(fs.order_files(files))


def roots_of(files):
    return files.select("graph_id").distinct().withColumn(
        "root_id", F.concat(F.lit("arcp://name,"), "graph_id")
    )


@check(
    "fn_01",
    "order_files",
    f"""SELECT relative_path, regexp_replace(relative_path, '^.*/', '') AS base,
  CASE WHEN contains(relative_path, '/') THEN regexp_replace(relative_path, '/[^/]*$', '') ELSE '' END AS dir,
  {STEM.format("regexp_replace(relative_path, '^.*/', '')")} AS stem,
  array_to_string([x FOR x IN string_split(dir, '/') IF x NOT IN ('', '.')], '|') AS folders
FROM order_files""",
)
def paths(v):
    path = F.col("relative_path")
    return v("order_files").select(
        path,
        fn.basename(path).alias("base"),
        fn.dirname(path).alias("dir"),
        fn.strip_ext(path).alias("stem"),
        F.array_join(fn.folders(path), "|").alias("folders"),
    )


@check(
    "fn_02",
    "order_files",
    "SELECT relative_path, replace(relative_path, ' ', '_') AS url, replace(replace(relative_path, ' ', '_'), '/', '_') AS segment FROM order_files",
)
def sanitized(v):
    path = F.col("relative_path")
    return v("order_files").select(
        path, fn.sanitize_url(path).alias("url"), fn.sanitize_segment(path).alias("segment")
    )


@check("fn_03", "files", f"SELECT file_name, {NORMAL.format('file_name')} AS dup_key FROM files")
def normal_names(v):
    return v("files").select("file_name", fn.normalize_name(F.col("file_name")).alias("dup_key"))


@check(
    "fn_04",
    "",
    f"""SELECT doc_id, {SLUG.format("text")} AS slug,
  'arcp://name,' || CASE WHEN {SLUG.format("text")} = '' THEN 'crate' ELSE {SLUG.format("text")} END AS text_id,
  'arcp://name,' || {SLUG.format("lang || ' ' || source")} AS source_id
FROM documents""",
)
def slugs(v):
    prefixed = F.concat(F.lit(" ARCP://name,"), "lang", F.lit(" "), "source")
    return v("documents").select(
        "doc_id",
        fn.slugify(F.col("text")).alias("slug"),
        fn.arcp_id(F.col("text")).alias("text_id"),
        fn.arcp_id(prefixed).alias("source_id"),
    )


@check("src_01", "order_files", f"WITH {KEPT} SELECT graph_id, file_name, relative_path FROM kept")
def scanned(v):
    return scan_files(v("order_files"))


@check(
    "ord_01",
    "files",
    "SELECT graph_id, relative_path, row_number() OVER (PARTITION BY graph_id ORDER BY relative_path) - 1 AS file_no FROM files",
)
def ordered(v):
    return fs.order_files(v("files")).select("graph_id", "relative_path", "file_no")


@check(
    "gra_01",
    "order_files",
    f"WITH {KEPT}, {meta_sql('kept')} SELECT graph_id, id, file_name, array_to_string(folders, '|') AS folders, top AS top_level_name, group_id FROM m",
)
def described_files(v):
    return fs.file_metadata(scan_files(v("order_files"))).select(
        "graph_id", "id", "file_name", F.array_join("folders", "|").alias("folders"), "top_level_name", "group_id"
    )


def duplicates_sql(files: str) -> str:
    """Files of one normalised name, each tied to the hub of that name and back."""
    return f"""{meta_sql(files)}, k AS (SELECT graph_id, id, file_no, {NORMAL.format("file_name")} AS dup_key FROM m),
n AS (SELECT *, count(*) OVER (PARTITION BY graph_id, dup_key) AS alike FROM k),
l AS (SELECT graph_id, id, file_no, '#duplicates-' || replace(dup_key, ' ', '-') AS hub FROM n WHERE alike > 1)"""


LINKS = "SELECT graph_id, id, CAST(0 AS BIGINT) AS pos, hub AS ref FROM l UNION ALL SELECT graph_id, hub, file_no, id FROM l"


@check("gra_02", "files", f"WITH {duplicates_sql('files')} {LINKS}")
def duplicates(v):
    return fs.possible_duplicates(fs.duplicate_groups(meta(v("files"))))


@check("gra_02_large_groups", "line_files", f"WITH {duplicates_sql('line_files')} {LINKS}")
def many_duplicates(v):
    return fs.possible_duplicates(fs.duplicate_groups(meta(v("line_files"))))


@check(
    "gra_02_links",
    "files",
    f"WITH {duplicates_sql('files')} SELECT a.graph_id, a.id, b.file_no AS pos, b.id AS ref FROM k a JOIN k b ON a.graph_id = b.graph_id AND a.dup_key = b.dup_key AND a.id <> b.id",
)
def duplicate_files(v):
    return fs.duplicate_links(fs.duplicate_groups(meta(v("files"))))


GROUPS = "g AS (SELECT graph_id, group_id, arg_min(top, file_no) AS name, min(file_no) AS first_no, max(file_no) AS last_no FROM {0} GROUP BY ALL)"


@check(
    "gra_03",
    "order_files",
    f"""WITH {KEPT}, {meta_sql("kept")}, {GROUPS.format("m")}
SELECT graph_id, group_id AS id, '@type' AS prop, CAST(0 AS BIGINT) AS pos, 'RepositoryObject' AS value, NULL::VARCHAR AS ref FROM g
UNION ALL {described("g", "group_id", "name", "Object")}
UNION ALL SELECT graph_id, group_id, 'hasPart', file_no, NULL, id FROM m""",
)
def objects(v):
    return graph_rows(fs.folder_objects(meta(scan_files(v("order_files")))))


COLLECTIONS = f"""{GROUPS.format("m")},
coll AS (SELECT DISTINCT graph_id, group_id FROM m WHERE len(folders) > 0),
p AS (SELECT m.*, coll.group_id IS NOT NULL AS in_coll, len(folders) <= 1 AS direct,
    CASE WHEN coll.group_id IS NULL THEN m.group_id WHEN len(folders) <= 1 THEN m.group_id || '/' || substr(m.group_id, 2) || '_Files'
      ELSE m.group_id || '/' || translate(folders[2], ' /', '__') END AS parent
  FROM m LEFT JOIN coll ON coll.graph_id = m.graph_id AND coll.group_id = m.group_id),
kids AS (SELECT p.graph_id, p.group_id, parent,
    coalesce(arg_min(folders[2], file_no) FILTER (WHERE NOT direct), any_value(g.name) || '_Files') AS name,
    coalesce(min(file_no) FILTER (WHERE NOT direct), max(g.last_no) + 1) AS member_pos
  FROM p JOIN g ON g.graph_id = p.graph_id AND g.group_id = p.group_id WHERE in_coll GROUP BY p.graph_id, p.group_id, parent),
c AS (SELECT g.* FROM g SEMI JOIN coll ON coll.graph_id = g.graph_id AND coll.group_id = g.group_id),
s AS (SELECT g.* FROM g ANTI JOIN coll ON coll.graph_id = g.graph_id AND coll.group_id = g.group_id)"""


COLLECTION_ROWS = f"""SELECT graph_id, group_id AS id, '@type' AS prop, CAST(0 AS BIGINT) AS pos, 'RepositoryCollection' AS value, NULL::VARCHAR AS ref FROM c
UNION ALL SELECT graph_id, parent, '@type', 0, 'RepositoryObject', NULL FROM kids
UNION ALL SELECT graph_id, group_id, '@type', 0, 'RepositoryObject', NULL FROM s
UNION ALL {described("c", "group_id", "name", "Collection")}
UNION ALL {described("kids", "parent", "name", "Object")}
UNION ALL {described("s", "group_id", "name", "Object")}
UNION ALL SELECT graph_id, parent, 'pcdm:memberOf', 0, NULL, group_id FROM kids
UNION ALL SELECT graph_id, group_id, 'pcdm:hasMember', member_pos, NULL, parent FROM kids
UNION ALL SELECT graph_id, parent, 'hasPart', file_no, NULL, id FROM p"""


@check("gra_04", "order_files", f"""WITH {KEPT}, {meta_sql("kept")}, {COLLECTIONS} {COLLECTION_ROWS}""")
def collections(v):
    return graph_rows(fs.folder_collections(meta(scan_files(v("order_files")))))


@check("gra_04_lines", "line_files", f"""WITH {meta_sql("line_files")}, {COLLECTIONS} {COLLECTION_ROWS}""", once="line_files")
def large_collections(v):
    """Three top folders hold all files; each order is an object in one of them."""
    return graph_rows(fs.folder_collections(meta(v("line_files"))))


@check(
    "gra_05",
    "files",
    f"""WITH {duplicates_sql('files')}
SELECT graph_id, id, '@type' AS prop, CAST(0 AS BIGINT) AS pos, 'File' AS value, NULL::VARCHAR AS ref FROM m
UNION ALL SELECT graph_id, id, 'name', 0, file_name, NULL FROM m
UNION ALL SELECT graph_id, id, unnest(['description', 'datePublished', 'contentLocation', 'custom:participant']), 0, '', NULL FROM m
UNION ALL SELECT graph_id, id, 'isPartOf', 0, NULL, group_id FROM m
UNION ALL SELECT graph_id, id, 'custom:possibleDuplicate', pos, NULL, ref FROM ({LINKS}) x""",
)
def entities(v):
    listed = meta(v("files"))
    links = fs.possible_duplicates(fs.duplicate_groups(listed))
    parents = fs.folder_objects(listed)["parents"]
    return graph_rows(
        fs.file_entities(listed, parents, ["custom:participant", "custom:possibleDuplicate"], links)
    )


@check(
    "gra_06",
    "order_files",
    f"""WITH {KEPT}, {meta_sql("kept")}, {GROUPS.format("m")}, {ROOTS.format("order_files")}
SELECT graph_id, root_id AS id, 'pcdm:hasMember' AS prop, first_no AS pos, NULL::VARCHAR AS value, group_id AS ref FROM g JOIN roots USING (graph_id)""",
)
def members(v):
    made = fs.folder_collections(meta(scan_files(v("order_files"))))
    return fs.root_membership(made["top_level"], roots_of(v("order_files")))


@check(
    "gra_07",
    "files",
    f"""WITH {meta_sql("files")}, {GROUPS.format("m")}, {ROOTS.format("files")},
r AS (SELECT graph_id, group_id, root_id || '/' || substr(group_id, 2) AS nid, name FROM g JOIN roots USING (graph_id))
SELECT graph_id, nid AS id, '@type' AS prop, CAST(0 AS BIGINT) AS pos, 'RepositoryObject' AS value, NULL::VARCHAR AS ref FROM r
UNION ALL SELECT graph_id, id, '@type', 0, 'File', NULL FROM m
UNION ALL {described("r", "nid", "name", "Object")}
UNION ALL SELECT m.graph_id, r.nid, 'hasPart', file_no, NULL, id FROM m JOIN r ON r.graph_id = m.graph_id AND r.group_id = m.group_id
UNION ALL SELECT graph_id, id, 'name', 0, file_name, NULL FROM m
UNION ALL SELECT graph_id, id, unnest(['description', 'datePublished', 'contentLocation']), 0, '', NULL FROM m
UNION ALL SELECT m.graph_id, id, 'isPartOf', 0, NULL, r.nid FROM m JOIN r ON r.graph_id = m.graph_id AND r.group_id = m.group_id""",
)
def rewritten(v):
    listed = meta(v("files"))
    made = fs.folder_objects(listed)
    own = fs.file_entities(listed, made["parents"])
    return graph_rows(
        fs.rewrite_hash_ids(
            made["nodes"].unionByName(own["nodes"]),
            made["props"].unionByName(own["props"]),
            # a trailing slash changes nothing
            roots_of(v("files")).withColumn("root_id", F.concat("root_id", F.lit("/"))),
        )
    )


PROFILE = {
    "types": ["Dataset", "RepositoryCollection"],
    "conforms_to": "https://w3id.org/ldac/profile#Collection",
    "licence": {
        "id": "https://creativecommons.org/licenses/by/4.0/",
        "type": "ldac:DataReuseLicense",
        "name": "Attribution 4.0 International (CC BY 4.0)",
    },
}


@check(
    "gra_08",
    "",
    """WITH r AS (SELECT 'k' || c_custkey AS graph_id, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE 'arcp://name,customer-' || c_custkey END AS root_id, c_custkey, c_name, c_mktsegment FROM customer),
lic AS (SELECT 'https://creativecommons.org/licenses/by/4.0/' AS lid)
SELECT graph_id, root_id AS id, '@type' AS prop, unnest(CASE WHEN c_custkey % 4 = 0 THEN [CAST(0 AS BIGINT)] ELSE [CAST(0 AS BIGINT), 1] END) AS pos,
  unnest(CASE WHEN c_custkey % 4 = 0 THEN [c_mktsegment] ELSE ['Dataset', 'RepositoryCollection'] END) AS value, NULL::VARCHAR AS ref FROM r
UNION ALL SELECT graph_id, 'ro-crate-metadata.json', '@type', 0, 'CreativeWork', NULL FROM r
UNION ALL SELECT graph_id, lid, '@type', 0, 'ldac:DataReuseLicense', NULL FROM r, lic
UNION ALL SELECT graph_id, lid, 'name', 0, 'Attribution 4.0 International (CC BY 4.0)', NULL FROM r, lic
UNION ALL SELECT graph_id, 'ro-crate-metadata.json', 'license', 0, NULL, lid FROM r, lic
UNION ALL SELECT graph_id, 'ro-crate-metadata.json', 'about', 0, NULL, root_id FROM r WHERE root_id <> ''
UNION ALL SELECT graph_id, root_id, 'name', 0, c_name, NULL FROM r
UNION ALL SELECT graph_id, root_id, 'conformsTo', 0, NULL, CASE WHEN c_custkey % 4 = 1 THEN 'https://example.org/own' ELSE 'https://w3id.org/ldac/profile#Collection' END FROM r""",
)
def root_parts(v):
    own = v("customer").withColumn("graph_id", F.concat(F.lit("k"), "c_custkey"))
    key = F.col("c_custkey")
    roots = own.select(
        "graph_id",
        F.when(key % 9 == 0, "").otherwise(fn.arcp_id(F.concat(F.lit("Customer "), "c_custkey"))).alias("root_id"),
    )
    said = prop_rows(
        own,
        F.col("graph_id"),
        [
            fact("name", F.col("c_name")),
            fact("@type", F.when(key % 4 == 0, F.col("c_mktsegment"))),
            fact("conformsTo", ref=F.when(key % 4 == 1, "https://example.org/own")),
        ],
    ).drop("id")
    return graph_rows(fs.assemble_root(roots, PROFILE, said))


@check(
    "gra_09",
    "files",
    f"""WITH {meta_sql("files")}, {GROUPS.format("m")}, {ROOTS.format("files")}
SELECT graph_id, group_id AS id, 'license' AS prop, unnest([CAST(0 AS BIGINT), 1]) AS pos, NULL::VARCHAR AS value,
  unnest(['https://example.org/' || graph_id, 'https://example.org/all']) AS ref FROM g WHERE graph_id = 'c0'""",
)
def licences(v):
    made = fs.folder_objects(meta(v("files")))
    roots = roots_of(v("files"))
    stated = roots.filter("graph_id = 'c0'").select(
        "graph_id",
        F.col("root_id").alias("id"),
        F.lit("license").alias("prop"),
        F.posexplode(
            F.array(F.concat(F.lit("https://example.org/"), "graph_id"), F.lit("https://example.org/all"))
        ).alias("pos", "ref"),
    )
    stated = stated.withColumns({"value": F.lit(None).cast("string"), "pos": F.col("pos").cast("bigint")})
    return fs.inherit_license(made["nodes"], stated, roots)


@check(
    "agg_01",
    "files",
    f"""WITH {meta_sql("files")}, n AS (
  SELECT graph_id, 'File' AS type FROM m UNION ALL SELECT graph_id, 'RepositoryObject' FROM (SELECT DISTINCT graph_id, group_id FROM m)
  UNION ALL SELECT 'c' || doc_id % 2, CASE WHEN doc_id % 3 = 0 THEN ' ' WHEN doc_id % 3 = 1 THEN NULL ELSE lang END FROM documents)
SELECT graph_id, coalesce(nullif(trim(type), ''), '(none)') AS type, count(*) AS count FROM n GROUP BY 1, 2""",
)
def counted_types(v):
    listed = meta(v("files"))
    made = fs.folder_objects(listed)
    loose = v("documents").select(
        F.concat(F.lit("c"), F.col("doc_id") % 2).alias("graph_id"),
        F.when(F.col("doc_id") % 3 == 0, " ").when(F.col("doc_id") % 3 == 2, F.col("lang")).alias("type")
    )
    nodes = made["nodes"].unionByName(fs.file_entities(listed, made["parents"])["nodes"]).select("graph_id", "type")
    return stats.type_counts(nodes.unionByName(loose))


@check(
    "agg_02",
    "files",
    f"""WITH {meta_sql("files")}, f AS (SELECT graph_id, count(*) AS files FROM m GROUP BY 1),
g AS (SELECT graph_id, count(DISTINCT group_id) AS n FROM m GROUP BY 1)
SELECT graph_id, files, files + n AS entities FROM f JOIN g USING (graph_id)""",
)
def built_counts(v):
    listed = meta(v("files"))
    made = fs.folder_objects(listed)
    own = fs.file_entities(listed, made["parents"])
    return stats.build_stats(v("files"), made["nodes"].unionByName(own["nodes"]))


@check(
    "flt_03",
    "originals",
    "SELECT graph_id, topic, file_name FROM originals WHERE NOT regexp_matches(file_name, '(?i)notes?') AND file_name NOT LIKE '~$%' AND file_name NOT LIKE '.%'",
)
def content_documents(v):
    return documents.exclude_working_docs(v("originals"))


@check(
    "doc_05",
    "originals",
    """WITH d AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY topic, file_name) - 1 AS no, replace(topic, ' ', '_') AS seg,
    'ro-crate-preview_files/' || topic || '/' || file_name AS fid
  FROM (SELECT DISTINCT * FROM originals WHERE NOT regexp_matches(file_name, '(?i)notes?') AND file_name NOT LIKE '~$%' AND file_name NOT LIKE '.%') x),
t AS (SELECT graph_id, topic, seg, min(no) AS no FROM d GROUP BY ALL), w AS (SELECT DISTINCT graph_id FROM d)
SELECT graph_id, '#derivedContent' AS id, '@type' AS prop, CAST(0 AS BIGINT) AS pos, 'custom:DerivedContentCollection' AS value, NULL::VARCHAR AS ref FROM w
UNION ALL SELECT graph_id, '#sourceDocuments', '@type', 0, 'custom:SourceDocumentsCollection', NULL FROM w
UNION ALL SELECT graph_id, '#' || seg, '@type', 0, 'RepositoryCollection', NULL FROM t
UNION ALL SELECT graph_id, '#sourceDocuments-' || seg, '@type', 0, 'custom:SourceDocumentGroup', NULL FROM t
UNION ALL SELECT graph_id, fid, '@type', 0, 'File', NULL FROM d
UNION ALL SELECT graph_id, './', 'hasPart', unnest([CAST(0 AS BIGINT), 1]), NULL, unnest(['#derivedContent', '#sourceDocuments']) FROM w
UNION ALL SELECT graph_id, '#derivedContent', 'hasPart', no, NULL, '#' || seg FROM t
UNION ALL SELECT graph_id, '#sourceDocuments', 'hasPart', no, NULL, '#sourceDocuments-' || seg FROM t
UNION ALL SELECT graph_id, '#' || seg, 'name', 0, topic, NULL FROM t
UNION ALL SELECT graph_id, '#sourceDocuments-' || seg, 'name', 0, topic, NULL FROM t
UNION ALL SELECT graph_id, '#sourceDocuments-' || seg, 'hasPart', no, NULL, fid FROM d
UNION ALL SELECT graph_id, fid, 'name', 0, file_name, NULL FROM d
UNION ALL SELECT graph_id, fid, 'encodingFormat', 0, 'application/vnd.openxmlformats-officedocument.wordprocessingml.document', NULL FROM d""",
)
def document_collections(v):
    originals = v("originals")
    roots = originals.select("graph_id").distinct().withColumn("root_id", F.lit("./"))
    return graph_rows(documents.document_collections(originals, roots))
