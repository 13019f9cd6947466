"""Terms, sheets, places, links and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn import functions as fn
from cairn.model import BUILTIN_PREFIXES, builtin_prefixes
from cairn.operators import links, places, publish, sheets, terms
from cairn.operators import filters as flt
from checks.build import SLUG
from checks.overlay import COLS, graph_roots
from checks.registry import check, graph_rows

PREFIX = "CASE WHEN contains({0}, '://') THEN '' ELSE regexp_extract({0}, '^([A-Za-z][A-Za-z0-9._-]*):', 1) END"


@check(
    "fn_05",
    "targets",
    f"SELECT target, {PREFIX.format('target')} AS prefix, regexp_replace(target, '^[^:]*:', '') AS local FROM targets",
)
def curies(v):
    term = F.col("target")
    return v("targets").select(term, fn.curie_prefix(term).alias("prefix"), fn.curie_local(term).alias("local"))


# the path is walked part by part; the accumulator is the path so far
WALK = """list_reduce(list_prepend('', string_split(replace({0}, '\\', '/'), '/')),
  lambda acc, x: CASE WHEN x IN ('', '.') THEN acc WHEN x = '..' THEN regexp_replace(acc, '/?[^/]*$', '') WHEN acc = '' THEN x ELSE acc || '/' || x END)"""
ABSOLUTE = "(regexp_matches({0}, '(?i)^[a-z][a-z0-9+.-]*:') OR starts_with({0}, '//') OR starts_with({0}, '#'))"
BASE = "regexp_extract({0}, '^[^?#]*')"


@check(
    "fn_06",
    "link_forms",
    f"SELECT page_id, href, {WALK.format('href')} AS path FROM link_forms",
)
def normal_paths(v):
    return v("link_forms").select("page_id", "href", fn.normalize_relative_path(F.col("href")).alias("path"))


@check(
    "fn_07",
    "link_forms",
    f"SELECT page_id, href, CAST({ABSOLUTE.format('href')} AS INTEGER) AS absolute, {BASE.format('href')} AS base, substr(href, length({BASE.format('href')}) + 1) AS suffix FROM link_forms",
)
def url_parts(v):
    url = F.col("href")
    return v("link_forms").select(
        "page_id",
        url,
        fn.is_absolute_url(url).cast("int").alias("absolute"),
        fn.url_base(url).alias("base"),
        fn.url_suffix(url).alias("suffix"),
    )


VARIANTS = r"""spell AS (SELECT *, regexp_replace(regexp_replace(fixed, '(?i)^mt\.?\s+', 'Mount '), '(?i)^(.+?)\s+mountain$', 'Mount \1') AS mount
  FROM (SELECT graph_id, name, trim(name) AS given, regexp_replace(trim(name), '\blsland\b', 'Island') AS fixed FROM place_names) x),
listed AS (SELECT graph_id, name, [given, fixed, mount, regexp_replace(mount, '(?i)^mount\s+', 'Mt '), regexp_replace(mount, '(?i)^mount\s+(.+)$', '\1 Mountain')] AS forms FROM spell),
forms AS (SELECT graph_id, name, variant, row_number() OVER (PARTITION BY graph_id, name ORDER BY min(nth)) - 1 AS spelling
  FROM (SELECT graph_id, name, unnest(forms) AS variant, unnest(range(len(forms))) AS nth FROM listed) y GROUP BY graph_id, name, variant)"""


@check("fn_08", "place_names", f"WITH {VARIANTS} SELECT graph_id, name, CAST(spelling AS INTEGER) AS spelling, variant FROM forms")
def variants(v):
    return v("place_names").select(
        "graph_id", "name", F.posexplode(fn.place_variants(F.col("name"))).alias("spelling", "variant")
    )


@check(
    "fn_09",
    "",
    """SELECT c_custkey, 'POINT(' || regexp_replace(CAST(c_acctbal AS VARCHAR), '\\.0$', '') || ' ' || regexp_replace(CAST(c_nationkey - 12.5 AS VARCHAR), '\\.0$', '') || ')' AS wkt FROM customer""",
)
def points(v):
    return v("customer").select(
        "c_custkey", fn.wkt_point(F.col("c_nationkey") - F.lit(12.5), F.col("c_acctbal")).alias("wkt")
    )


NAMES = "nm AS (SELECT graph_id, id, arg_min(value, pos) AS name FROM rich_props WHERE prop = 'name' AND trim(value) <> '' GROUP BY ALL)"


@check(
    "fn_10",
    "graph_nodes rich_props",
    f"WITH {NAMES} SELECT n.graph_id, n.id, coalesce(name, n.id) AS display_name FROM graph_nodes n LEFT JOIN nm USING (graph_id, id)",
)
def shown_names(v):
    # a blank name before the real one does not count
    own = (F.col("prop") == "name") & F.col("id").startswith("#nation-")
    blank = v("rich_props").filter(own).withColumns({"value": F.lit(" "), "pos": F.col("pos") - 1})
    return links.display_names(v("graph_nodes"), v("rich_props").unionByName(blank))


PARTS = "[trim(x) FOR x IN regexp_split_to_array({0}, '[,/]') IF trim(x) <> '']"


@check(
    "fn_11",
    "sheet_rows",
    f"SELECT graph_id, id, unnest(range(len(parts))) AS nth, unnest(parts) AS part FROM (SELECT graph_id, id, {PARTS.format('author')} AS parts FROM sheet_rows) x",
)
def cell_values(v):
    return v("sheet_rows").select(
        "graph_id", "id", F.posexplode(fn.split_values(F.col("author"))).alias("nth", "part")
    ).withColumn("nth", F.col("nth").cast("bigint"))


@check(
    "fn_12",
    "sheet_rows",
    f"SELECT DISTINCT '#person-' || {SLUG.format('part')} AS minted, part FROM (SELECT unnest({PARTS.format('author')}) AS part FROM sheet_rows) x",
)
def minted_ids(v):
    return (
        v("sheet_rows")
        .select(F.explode(fn.split_values(F.col("author"))).alias("part"))
        .select(fn.mint_id("Person", F.col("part")).alias("minted"), "part")
        .distinct()
    )


GENERIC = "('north', 'people', 'unknown', 'south', 'east', 'west', 'language', 'other')"


@check(
    "flt_04",
    "catalog",
    f"SELECT name, code, is_alternate FROM catalog WHERE length(name) >= 4 AND lower(trim(name)) NOT IN {GENERIC} AND is_alternate = 0",
)
def terms_kept(v):
    return terms.usable_terms(v("catalog"))


TERM_HITS = """tw AS (SELECT code, name, regexp_extract_all(lower(name), '[\\p{L}\\p{N}]+') AS words FROM catalog WHERE length(name) >= 4 AND lower(trim(name)) NOT IN """ + GENERIC + """),
xw AS (SELECT graph_id, file_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS words FROM titles),
xp AS (SELECT graph_id, file_id, unnest(words) AS word, lead(word) OVER w AS next FROM (
  SELECT graph_id, file_id, unnest(words) AS word, unnest(range(len(words))) AS nth FROM xw) z WINDOW w AS (PARTITION BY graph_id, file_id ORDER BY nth)),
hits AS (SELECT DISTINCT graph_id, file_id, code, name FROM xp JOIN tw ON tw.words[1] = word WHERE len(tw.words) = 1 OR (len(tw.words) = 2 AND tw.words[2] = next))"""
TERM_HITS = TERM_HITS.replace("unnest(words) AS word, lead(word) OVER w AS next FROM", "word, lead(word) OVER w AS next FROM")


def hits_of(v):
    return terms.match_terms(v("titles"), terms.usable_terms(v("catalog"), include_alternates=True))


@check("jn_01", "titles catalog", f"WITH {TERM_HITS} SELECT graph_id, file_id, code, name FROM hits")
def matched(v):
    return hits_of(v)


@check(
    "jn_02",
    "titles catalog",
    f"""WITH {TERM_HITS}, known AS (SELECT DISTINCT graph_id, file_id FROM titles WHERE file_id NOT LIKE '%7'),
t AS (SELECT graph_id, '#' || code AS tid, min(name) AS name FROM hits GROUP BY ALL)
SELECT graph_id, tid AS id, '@type' AS prop, CAST(0 AS BIGINT) AS pos, 'Language' AS value, NULL::VARCHAR AS ref FROM t
UNION ALL SELECT graph_id, tid, 'name', 0, name, NULL FROM t
UNION ALL SELECT DISTINCT graph_id, 'arcp://name,custom/terms#' || p, '@type', 0, 'rdf:Property', NULL FROM t, (SELECT unnest(['austlangCode', 'iso639-3', 'glottologCode']) AS p) q
UNION ALL SELECT DISTINCT graph_id, 'arcp://name,custom/terms#' || p, 'name', 0, p, NULL FROM t, (SELECT unnest(['austlangCode', 'iso639-3', 'glottologCode']) AS p) q
UNION ALL SELECT h.graph_id, file_id, 'ldac:subjectLanguage', row_number() OVER (PARTITION BY h.graph_id, file_id ORDER BY '#' || code) - 1, NULL, '#' || code
  FROM (SELECT DISTINCT graph_id, file_id, code FROM hits) h SEMI JOIN known USING (graph_id, file_id)""",
)
def linked_terms(v):
    found = hits_of(v).select("graph_id", "file_id", F.concat(F.lit("#"), "code").alias("term_id"), "name")
    known = v("titles").filter("file_id NOT LIKE '%7'").select("graph_id", F.col("file_id").alias("id"))
    return graph_rows(terms.link_terms(known, found))


@check(
    "jn_02_count",
    "titles catalog",
    f"WITH {TERM_HITS} SELECT graph_id, count(DISTINCT code) AS terms FROM hits GROUP BY graph_id",
)
def linked_count(v):
    found = hits_of(v).select("graph_id", "file_id", F.col("code").alias("term_id"), "name")
    known = v("titles").select("graph_id", F.col("file_id").alias("id"))
    return terms.link_terms(known, found)["count"]


MAPPING = [
    {"source": "quality", "target": "custom:quality"},
    {"source": "toxic", "target": "custom:toxic"},
    {"source": "author", "target": "author", "type": "Person"},
    {"source": "location", "target": "contentLocation", "type": "Place"},
]
MATCHED = "s AS (SELECT r.* FROM sheet_rows r SEMI JOIN file_nodes n ON n.graph_id = r.graph_id AND n.id = r.id)"
LITERALS = "SELECT graph_id, id, 'custom:quality' AS prop, CAST(0 AS BIGINT) AS pos, quality AS value, NULL::VARCHAR AS ref FROM s UNION ALL SELECT graph_id, id, 'custom:toxic', 0, toxic, NULL FROM s WHERE toxic <> ''"
TYPED = f"""c AS (SELECT graph_id, id, 'author' AS prop, 'Person' AS type, {PARTS.format('author')} AS parts FROM s
  UNION ALL SELECT graph_id, id, 'contentLocation', 'Place', {PARTS.format('location')} FROM s),
val AS (SELECT graph_id, id, prop, type, unnest(parts) AS text, unnest(range(len(parts))) AS nth FROM c),
mint AS (SELECT *, '#' || lower(type) || '-' || {SLUG.format('text')} AS mid FROM val),
fresh AS (SELECT graph_id, mid, type, min(text) AS name FROM mint GROUP BY ALL),
link AS (SELECT graph_id, id, prop, min(nth) AS pos, NULL::VARCHAR AS value, mid AS ref FROM mint GROUP BY graph_id, id, prop, mid)"""


@check("jn_03", "file_nodes sheet_rows", f"WITH {MATCHED} {LITERALS}")
def literals(v):
    return sheets.sheet_literals(v("file_nodes"), v("sheet_rows"), MAPPING)


@check(
    "jn_03_merged",
    "file_nodes sheet_rows",
    f"""WITH {MATCHED}, w AS ({LITERALS}),
t AS (SELECT graph_id, id, 'custom:toxic' AS prop, CAST(0 AS BIGINT) AS pos, 'unset' AS value, NULL::VARCHAR AS ref FROM file_nodes)
SELECT t.* FROM t ANTI JOIN w ON w.graph_id = t.graph_id AND w.id = t.id AND w.prop = t.prop UNION ALL SELECT * FROM w""",
)
def merged_literals(v):
    nodes = v("file_nodes")
    before = nodes.select(
        "graph_id", "id", F.lit("custom:toxic").alias("prop"), F.lit(0).cast("bigint").alias("pos"),
        F.lit("unset").alias("value"), F.lit(None).cast("string").alias("ref"),
    )
    return sheets.merge_sheet(nodes, before, v("sheet_rows"), MAPPING[:2])["props"]


@check(
    "jn_04",
    "file_nodes sheet_rows",
    f"""WITH {MATCHED}, {TYPED}
SELECT graph_id, mid AS id, '@type' AS prop, CAST(0 AS BIGINT) AS pos, type AS value, NULL::VARCHAR AS ref FROM fresh
UNION ALL SELECT graph_id, mid, 'name', 0, name, NULL FROM fresh UNION ALL SELECT {COLS} FROM link""",
)
def typed_links(v):
    made = sheets.sheet_links(v("file_nodes"), v("sheet_rows"), MAPPING)
    return graph_rows({"nodes": made["nodes"], "props": made["props"].unionByName(made["links"])})


@check(
    "jn_05",
    "files sheet_rows",
    """WITH f AS (SELECT DISTINCT graph_id, relative_path AS id FROM files), r AS (SELECT DISTINCT graph_id, id FROM sheet_rows),
u AS (SELECT graph_id, 'file' AS side, id FROM f ANTI JOIN r USING (graph_id, id) UNION ALL SELECT graph_id, 'row', id FROM r ANTI JOIN f USING (graph_id, id))
SELECT * FROM (SELECT graph_id, side, count(*) OVER (PARTITION BY graph_id, side) AS total,
  CAST(row_number() OVER (PARTITION BY graph_id, side ORDER BY id) AS INTEGER) AS sample_no, id FROM u) x WHERE sample_no <= 5""",
)
def without_partner(v):
    files = v("files").select("graph_id", F.col("relative_path").alias("id"))
    return sheets.unmatched(files, v("sheet_rows"), 5)


GAZETTEER = f"""{VARIANTS},
cand AS (SELECT f.graph_id, f.name, f.spelling, CASE WHEN lower(g.name) <> lower(f.variant) THEN 2 WHEN priority = 0 THEN 0 WHEN priority = 1 THEN 1 ELSE 3 END AS step,
    g.region <> 'R1' AS off_region, g.name AS matched_name, provider, g.region AS match_region, latitude, longitude
  FROM forms f JOIN gazetteer g ON lower(g.name) = lower(f.variant) OR (priority = 1 AND starts_with(lower(g.name), lower(f.variant)))),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, name ORDER BY step, spelling, off_region, matched_name, provider, match_region, latitude, longitude) AS rn FROM cand) x WHERE rn = 1)"""


@check(
    "jn_06",
    "place_names gazetteer",
    f"WITH {GAZETTEER} SELECT graph_id, name, step, matched_name, provider, match_region, latitude, longitude FROM best",
)
def found_places(v):
    return places.lookup_places(v("place_names"), v("gazetteer"), "R1")


@check(
    "jn_07",
    "place_names gazetteer",
    f"""WITH {GAZETTEER}, p AS (SELECT graph_id, name, '#place-' || {SLUG.format('name')} AS id, '#location-' || {SLUG.format('name')} AS gid, latitude, longitude FROM best),
sh AS (SELECT graph_id, gid, min(row(latitude, longitude)) AS nth FROM p GROUP BY ALL),
tx AS (SELECT graph_id, gid, regexp_replace(CAST(nth[1] AS VARCHAR), '\\.0$', '') AS lat, regexp_replace(CAST(nth[2] AS VARCHAR), '\\.0$', '') AS lon FROM sh)
SELECT graph_id, gid AS id, '@type' AS prop, CAST(0 AS BIGINT) AS pos, 'Geometry' AS value, NULL::VARCHAR AS ref FROM sh
UNION ALL SELECT graph_id, id, 'geo', 0, NULL, gid FROM p
UNION ALL SELECT graph_id, gid, '.latitude', 0, lat, NULL FROM tx UNION ALL SELECT graph_id, gid, '.longitude', 0, lon, NULL FROM tx
UNION ALL SELECT graph_id, gid, 'asWKT', 0, 'POINT(' || lon || ' ' || lat || ')', NULL FROM tx""",
)
def geometries(v):
    named = v("place_names").withColumn("id", fn.mint_id("Place", F.col("name")))
    return graph_rows(places.attach_geometry(named, places.lookup_places(v("place_names"), v("gazetteer"), "R1")))


@check(
    "agg_03",
    "file_nodes sheet_rows gazetteer place_names",
    f"""WITH {MATCHED}, {TYPED}, wr AS ({LITERALS} UNION ALL SELECT {COLS} FROM link), {GAZETTEER}
SELECT graph_id, CAST(sum(a) AS BIGINT) AS merged, CAST(sum(b) AS BIGINT) AS generated, CAST(sum(c) AS BIGINT) AS enriched_places FROM (
  SELECT graph_id, 1 AS a, 0 AS b, 0 AS c FROM wr UNION ALL SELECT graph_id, 0, 1, 0 FROM fresh UNION ALL SELECT graph_id, 0, 0, 1 FROM best) x GROUP BY graph_id""",
)
def merge_counts(v):
    made = sheets.sheet_links(v("file_nodes"), v("sheet_rows"), MAPPING)
    written = sheets.sheet_literals(v("file_nodes"), v("sheet_rows"), MAPPING).unionByName(made["links"])
    named = v("place_names").withColumn("id", fn.mint_id("Place", F.col("name")))
    found = places.lookup_places(v("place_names"), v("gazetteer"), "R1")
    return sheets.merge_stats(written, made["nodes"], places.attach_geometry(named, found)["enriched"])


# references of documents to media beside them, in other spellings
MEDIA = """media AS (SELECT graph_id, file_name, regexp_replace(relative_path, '[^/]*$', '') || 'media/' || file_name AS id, doc_id FROM files),
refs AS (SELECT graph_id, doc_id AS ref_id, regexp_replace(relative_path, '/?[^/]*$', '') AS folder,
  CASE WHEN doc_id % 5 = 0 THEN 'nowhere.png' WHEN doc_id % 4 = 3 THEN ' ' || file_name || '  ' WHEN doc_id % 2 = 0 THEN upper(file_name) ELSE lower(regexp_replace(file_name, '\\.[^.]*$', '')) || CASE WHEN doc_id % 3 = 0 THEN '.jpg' ELSE '' END END AS name
  FROM files)"""


@check(
    "jn_08",
    "files",
    f"""WITH {MEDIA}, ix AS (SELECT graph_id, id, regexp_replace(id, '/[^/]*$', '') AS place, lower(file_name) AS whole FROM media),
k AS (SELECT graph_id, place, whole AS key, 0 AS ex, id FROM ix UNION ALL SELECT graph_id, place, regexp_replace(whole, '^(.+)\\.[^.]*$', '\\1'), 1, id FROM ix),
a AS (SELECT *, CASE WHEN folder = '' THEN 'media' ELSE folder || '/media' END AS place, lower(trim(name)) AS whole, regexp_replace(lower(trim(name)), '^(.+)\\.[^.]*$', '\\1') AS bare FROM refs),
hit AS (SELECT a.graph_id, ref_id, id, row_number() OVER (PARTITION BY a.graph_id, ref_id ORDER BY CASE WHEN key = whole THEN 0 ELSE 1 END, ex, id) AS rn
  FROM a JOIN k ON k.graph_id = a.graph_id AND k.place = a.place AND (k.key = a.whole OR k.key = a.bare))
SELECT r.graph_id, r.ref_id, folder, name, h.id AS file_id FROM refs r LEFT JOIN hit h ON h.graph_id = r.graph_id AND h.ref_id = r.ref_id AND rn = 1""",
)
def media(v):
    files = v("files")
    path, name, key = F.col("relative_path"), F.col("file_name"), F.col("doc_id")
    folder = fn.dirname(path)
    beside = files.select(
        "graph_id",
        F.concat_ws("/", F.nullif(folder, F.lit("")), F.lit("media"), "file_name").alias("id"),
    )
    padded = F.concat(F.lit(" "), name, F.lit("  "))
    said = F.when(key % 5 == 0, "nowhere.png").when(key % 4 == 3, padded).when(key % 2 == 0, F.upper(name)).otherwise(
        F.concat(F.lower(fn.strip_ext(name)), F.when(key % 3 == 0, ".jpg").otherwise(""))
    )
    refs = files.select("graph_id", key.alias("ref_id"), folder.alias("folder"), said.alias("name"))
    return links.resolve_media(refs, beside)


RESOLVED = f"""n AS (SELECT graph_id, page_id, href, {ABSOLUTE.format('href')} AS ab, {WALK.format(BASE.format('href'))} AS key, substr(href, length({BASE.format('href')}) + 1) AS suffix FROM {{0}}),
a AS (SELECT graph_id, path, min(target) AS target FROM assets GROUP BY graph_id, path)"""


@check(
    "jn_09",
    "link_forms assets",
    f"""WITH {RESOLVED.format('link_forms')}
SELECT n.graph_id, page_id, href, CASE WHEN ab THEN 'absolute' WHEN key = '' THEN 'empty' WHEN lower(key) LIKE '%.html' THEN 'page' WHEN target IS NOT NULL THEN 'mapped' ELSE 'unknown' END AS kind,
  CASE WHEN NOT ab AND key <> '' AND lower(key) NOT LIKE '%.html' AND target IS NOT NULL THEN target || suffix ELSE href END AS resolved
FROM n LEFT JOIN a ON a.graph_id = n.graph_id AND a.path = n.key""",
)
def resolved_links(v):
    return links.resolve_links(v("link_forms"), v("assets"))


CSS_PAT = "url\\(''([^'')]+)''\\)"


@check(
    "jn_10",
    "assets",
    f"""WITH t AS (SELECT page_id, regexp_replace(html, 'href="([^"]*)"', 'url(''\\1'')', 'g') AS css FROM pages),
b AS (SELECT page_id, string_split_regex(css, '{CSS_PAT}') AS between, list_concat(regexp_extract_all(css, '{CSS_PAT}', 1), ['']) AS raws FROM t),
x AS (SELECT page_id, unnest(between) AS piece, unnest(raws) AS href, unnest(range(len(between))) AS nth, len(between) - 1 AS last FROM b),
{RESOLVED.format("(SELECT DISTINCT concat('g', CAST(page_id % 3 AS VARCHAR)) AS graph_id, page_id, href FROM x)")}
SELECT n.graph_id, x.page_id AS css_id, string_agg(piece || CASE WHEN nth = last THEN '' WHEN target IS NOT NULL AND NOT ab THEN 'url(''' || target || suffix || ''')' ELSE 'url(''' || x.href || ''')' END, '' ORDER BY nth) AS css
FROM x LEFT JOIN n ON n.page_id = x.page_id AND n.href = x.href LEFT JOIN a ON a.graph_id = n.graph_id AND a.path = n.key GROUP BY n.graph_id, x.page_id""",
)
def style_sheets(v):
    css = v("pages").select(
        F.concat(F.lit("g"), F.col("page_id") % 3).alias("graph_id"),
        F.col("page_id").alias("css_id"),
        F.regexp_replace("html", 'href="([^"]*)"', "url( '$1' )").alias("css"),
    )
    return links.rewrite_css_urls(css, v("assets")).withColumn(
        "css", F.regexp_replace("css", r"url\( '([^']*)' \)", "url('$1')")
    )


@check(
    "jn_11",
    "targets declared",
    f"""WITH used AS (SELECT DISTINCT graph_id, {PREFIX.format('target')} AS prefix FROM targets)
SELECT graph_id, prefix, uri FROM used LEFT JOIN (SELECT graph_id, prefix, arg_max(uri, pos) AS uri FROM declared WHERE regexp_matches(uri, '^https?:') GROUP BY ALL) d USING (graph_id, prefix)
WHERE prefix <> '' AND prefix NOT IN ('ldac', 'pcdm', 'custom', 'AUSTLANG')""",
)
def prefixes_used(v):
    return sheets.discover_prefixes(v("targets"), v("declared"))


@check(
    "jn_12",
    "rich_props files sheet_rows",
    """WITH w AS (SELECT DISTINCT graph_id, prop FROM rich_props WHERE prop LIKE 'custom:%' UNION SELECT DISTINCT graph_id, 'custom:q' || quality FROM sheet_rows),
d AS (SELECT graph_id, 'arcp://name,custom/terms#' || substr(prop, 8) AS id, substr(prop, 8) AS name, NULL::VARCHAR AS description FROM w WHERE prop <> 'custom:segment'
  UNION ALL SELECT DISTINCT graph_id, 'arcp://name,custom/terms#segment', 'Segment', 'Market segment' FROM rich_props)
SELECT graph_id, id, '@type' AS prop, CAST(0 AS BIGINT) AS pos, 'rdf:Property' AS value, NULL::VARCHAR AS ref FROM d
UNION ALL SELECT graph_id, id, 'name', 0, name, NULL FROM d UNION ALL SELECT graph_id, id, 'description', 0, description, NULL FROM d WHERE description IS NOT NULL""",
)
def definitions(v):
    sheet = v("sheet_rows").withColumn("prop", F.concat(F.lit("custom:q"), "quality"))
    written = v("rich_props").select("graph_id", "prop").unionByName(sheet.select("graph_id", "prop"))
    declared = v("graph_nodes").filter("id = '#region-0'").select(
        "graph_id",
        F.lit("arcp://name,custom/terms#segment").alias("id"),
        F.lit("Segment").alias("name"),
        F.lit("Market segment").alias("description"),
    )
    return graph_rows(sheets.property_definitions(v("graph_nodes"), written, declared))


@check(
    "jn_13",
    "rich_props",
    f"""WITH {NAMES}, p AS (SELECT *, coalesce(ref, value) AS t FROM rich_props)
SELECT p.graph_id, p.id, prop, pos, coalesce(trim(nm.name), trim(t)) AS text FROM p LEFT JOIN nm ON nm.graph_id = p.graph_id AND nm.id = t WHERE trim(t) <> ''""",
)
def value_texts(v):
    return links.resolve_names(v("rich_props"))


@check(
    "flt_01",
    "graph_nodes rich_props",
    f"""WITH {NAMES} SELECT n.graph_id, n.id, coalesce(name, n.id) AS display_name FROM graph_nodes n LEFT JOIN nm USING (graph_id, id)
WHERE type = 'Person' AND contains(lower(coalesce(name, n.id) || ' ' || n.id), 'er-1')""",
)
def entities_found(v):
    return flt.find_entities(v("graph_nodes"), v("rich_props"), "Person", " ER-1")


@check(
    "flt_02",
    "graph_nodes file_nodes",
    """SELECT graph_id, id, CAST(max(CASE WHEN type IN ('File', 'RepositoryObject', 'RepositoryCollection') OR id = '#nation-3' OR id = 'ro-crate-metadata.json' THEN 1 ELSE 0 END) AS INTEGER) AS structural
FROM (SELECT graph_id, id, type FROM graph_nodes UNION ALL SELECT graph_id, id, type FROM file_nodes) x GROUP BY ALL""",
)
def structural(v):
    nodes = v("graph_nodes").unionByName(v("file_nodes"))
    return flt.is_structural(nodes, graph_roots(v("graph_nodes")).withColumn("root_id", F.lit("#nation-3")))


@check("flt_05", "graph_nodes file_nodes", "SELECT DISTINCT graph_id, type FROM (SELECT graph_id, type FROM graph_nodes UNION ALL SELECT graph_id, type FROM file_nodes) x")
def types_used(v):
    return flt.distinct_types(v("graph_nodes").unionByName(v("file_nodes")))


@check(
    "pv_01",
    "rich_props graph_nodes",
    f"""WITH p AS (SELECT {COLS} FROM rich_props UNION ALL SELECT graph_id, id, 'arcp://name,custom/terms#segment', pos, 'own', ref FROM rich_props WHERE prop = 'custom:segment' AND id LIKE '%5'),
c AS (SELECT graph_id, id, 'arcp://name,custom/terms#' || substr(prop, 8) AS prop, pos, value, ref FROM p WHERE prop LIKE 'custom:%')
SELECT {COLS} FROM p UNION ALL SELECT {COLS} FROM c ANTI JOIN p ON p.graph_id = c.graph_id AND p.id = c.id AND p.prop = c.prop""",
)
def expanded(v):
    own = v("rich_props").filter("prop = 'custom:segment' AND id LIKE '%5'").withColumns(
        {"prop": F.lit("arcp://name,custom/terms#segment"), "value": F.lit("own")}
    )
    props = v("rich_props").unionByName(own)
    return publish.expand_properties(props, builtin_prefixes(v("graph_nodes")))


LAYOUT = [
    {"name": "About", "inputs": ["name", "http://schema.org/email", "invented"]},
    {"name": "Nothing", "inputs": ["unheardof", "zz:what"]},
    {"name": "More", "inputs": ["custom:segment", "custom:order", "contentLocation"]},
]


@check(
    "pv_02",
    "rich_props",
    f"""WITH {NAMES}, lay(group_no, "group", input_no, prop, prop_uri) AS (VALUES (0, 'About', 0, 'name', 'http://schema.org/name'), (0, 'About', 1, 'email', 'http://schema.org/email'),
  (2, 'More', 0, 'custom:segment', 'arcp://name,custom/terms#segment'), (2, 'More', 1, 'custom:order', 'arcp://name,custom/terms#order'), (2, 'More', 2, 'contentLocation', 'http://schema.org/contentLocation')),
p AS (SELECT *, coalesce(ref, value) AS t FROM rich_props)
SELECT p.graph_id, p.id, group_no, "group", input_no, prop_uri, pos, coalesce(trim(nm.name), trim(t)) AS text FROM p JOIN lay USING (prop) LEFT JOIN nm ON nm.graph_id = p.graph_id AND nm.id = t WHERE trim(t) <> ''""",
)
def pages(v):
    known = {t: f"http://schema.org/{t}" for t in ("name", "email", "contentLocation")}
    return publish.entity_pages(v("rich_props"), LAYOUT, BUILTIN_PREFIXES, known)


SITE = {
    "root": {"template": "templates/root.html"},
    "types": {"Person": {"template": "templates/person.html"}, "Place": {"template": "templates/place.html"}, "RepositoryCollection": {"template": "templates/place.html"}},
}


@check(
    "pv_03",
    "graph_nodes",
    """SELECT graph_id, id, CASE WHEN id = '#region-0' THEN 'templates/root.html' WHEN type = 'Person' THEN 'templates/person.html' ELSE 'templates/place.html' END AS template
FROM graph_nodes WHERE type IN ('Person', 'Place', 'RepositoryCollection')""",
)
def page_templates(v):
    nodes = v("graph_nodes")
    twice = nodes.filter("type = 'Person'").withColumns({"type": F.lit("Place"), "pos": F.lit(1)})
    return publish.page_plan(nodes.unionByName(twice), graph_roots(nodes), SITE, publish.template_refs(SITE))
