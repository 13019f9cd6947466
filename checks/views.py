"""Input views over the given tables, in Spark SQL and in DuckDB SQL.

A view is one text for both engines, or one text each where dialects differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()

_SPLIT = {
    "spark": "SELECT {keep}, CAST(pe.pos AS BIGINT) AS {pos}, pe.col AS {line} FROM {table} LATERAL VIEW posexplode(split({text}, '\\n')) pe AS pos, col",
    "duckdb": "SELECT {keep}, CAST(generate_subscripts(string_split({text}, chr(10)), 1) - 1 AS BIGINT) AS {pos}, unnest(string_split({text}, chr(10))) AS {line} FROM {table}",
}


def _split(engine, **parts):
    return _SPLIT[engine].format(**parts)


def _per_engine(template, **inner):
    return {e: template.format(lines=_split(e, **inner)) for e in _SPLIT}


_WORDS = {
    "spark": "explode(regexp_extract_all(lower({0}), '[a-z]+', 0))",
    "duckdb": "unnest(regexp_extract_all(lower({0}), '[a-z]+', 0))",
}
# every two words that stand side by side
_PAIRS = {
    "spark": "explode(transform(sequence(1, greatest(size(regexp_extract_all(lower(text), '[a-z]+', 0)) - 1, 1)), "
    "i -> concat_ws(' ', slice(regexp_extract_all(lower(text), '[a-z]+', 0), i, 2))))",
    "duckdb": "unnest([array_to_string(w[i:i + 1], ' ') FOR i IN range(1, greatest(len(w) - 1, 1) + 1)])",
}
_PAIRED = {"spark": "benchmark", "duckdb": "(SELECT item_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM benchmark) b"}
_TITLE = {
    "spark": "regexp_extract(html, '<title>([^<]*)</title>', 1)",
    "duckdb": "regexp_extract(html, '<title>([^<]*)</title>', 1)",
}

VIEWS: dict[str, str | dict[str, str]] = {
    # a listing with near-duplicate names and three depths, in two collections
    "files": """
SELECT id AS doc_id, concat('c', CAST(CAST(floor(id / 2) AS BIGINT) % 2 AS STRING)) AS graph_id, file_name,
  CASE WHEN id % 10 = 0 THEN file_name
       WHEN id % 10 < 5 THEN concat(lang, '/', file_name)
       ELSE concat(lang, '/', source, '/', file_name) END AS relative_path
FROM (
  SELECT doc_id AS id, lang, source,
    concat('Item ', CAST(CAST(floor(doc_id / 2) AS BIGINT) AS STRING),
      CASE WHEN doc_id % 2 = 1 THEN ' copy' WHEN doc_id % 8 = 0 THEN ' (2)' ELSE '' END,
      CASE WHEN doc_id % 3 = 0 THEN '.pdf' WHEN doc_id % 3 = 1 THEN '.csv' ELSE '.txt' END) AS file_name
  FROM documents) d""",
    # the large listing: one file per line item, three top folders
    "line_files": """
SELECT 'c0' AS graph_id, concat('line_', CAST(rn AS STRING), '.txt') AS file_name,
  concat(l_returnflag, '/order_', CAST(l_orderkey AS STRING), '/line_', CAST(rn AS STRING), '.txt') AS relative_path
FROM (
  SELECT l_returnflag, l_orderkey,
    row_number() OVER (PARTITION BY l_returnflag, l_orderkey
      ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS rn
  FROM lineitem) t""",
    # an untidy listing with an entry per order: hidden and generated names, lock
    # files, root files beside a folder of their name, names that sanitise alike
    "order_files": """
SELECT concat('c', CAST(o_custkey % 3 AS STRING)) AS graph_id,
  CASE WHEN o_orderkey % 7 = 4 THEN concat('Report ', CAST(o_orderkey AS STRING), '.txt') ELSE regexp_replace(relative_path, '^.*/', '') END AS file_name,
  relative_path
FROM (
  SELECT o_orderkey, o_custkey,
    CASE o_orderkey % 7
      WHEN 0 THEN concat(o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN ' ' ELSE '_' END, CAST(o_orderkey % 5 AS STRING), '/', CAST(o_orderkey AS STRING), '.pdf')
      WHEN 1 THEN concat('.hidden/', CAST(o_orderkey AS STRING))
      WHEN 2 THEN CASE WHEN o_orderkey % 2 = 0 THEN concat(o_orderstatus, '/ro-crate-preview_html/', CAST(o_orderkey AS STRING)) ELSE concat(o_orderstatus, '/~$', CAST(o_orderkey AS STRING), '.docx') END
      WHEN 3 THEN concat(o_orderstatus, ' ', CAST(o_orderkey % 5 AS STRING), '.', CAST(o_orderkey AS STRING))
      WHEN 4 THEN concat('report ', CAST(o_orderkey AS STRING), '.txt')
      ELSE concat(o_orderstatus, '/', o_orderpriority, '/order ', CAST(o_orderkey AS STRING), '.pdf') END AS relative_path
  FROM orders) t""",
    "sheet_rows": """
SELECT f.graph_id,
  CASE WHEN l.doc_id % 9 = 0 THEN concat('missing/', CAST(l.doc_id AS STRING)) ELSE f.relative_path END AS id,
  CAST(l.quality AS STRING) AS quality,
  CASE WHEN l.toxic = 1 THEN 'yes' ELSE '' END AS toxic,
  concat('Person ', CAST(l.doc_id % 5 AS STRING), ', Person ', CAST(l.doc_id % 7 AS STRING), '/Person ', CAST(l.doc_id % 3 AS STRING)) AS author,
  concat('Mt N', CAST(l.doc_id % 30 AS STRING)) AS location
FROM labels l JOIN files f ON f.doc_id = l.doc_id""",
    "file_nodes": "SELECT graph_id, relative_path AS id, 'File' AS type, 0 AS pos FROM files",
    # entities and what is said of them; the same ids stand in several graphs:
    # shared ones in all three, every fourth other one in two, with other values
    "entity_rows": """
SELECT concat('#region-', CAST(r_regionkey AS STRING)) AS id, 'RepositoryCollection' AS type, r_regionkey AS k, 1 AS shared FROM region
UNION ALL SELECT concat('#nation-', CAST(n_nationkey AS STRING)), 'Place', n_nationkey, 1 FROM nation
UNION ALL SELECT concat('#supplier-', CAST(s_suppkey AS STRING)), 'Organization', s_suppkey, 0 FROM supplier
UNION ALL SELECT concat('#customer-', CAST(c_custkey AS STRING)), 'Person', c_custkey, 0 FROM customer""",
    "entity_facts": """
SELECT concat('#region-', CAST(r_regionkey AS STRING)) AS id, 'name' AS prop, 0 AS pos, r_name AS value, CAST(NULL AS STRING) AS ref, r_regionkey AS k, 1 AS shared FROM region
UNION ALL SELECT concat('#nation-', CAST(n_nationkey AS STRING)), 'name', 0, n_name, CAST(NULL AS STRING), n_nationkey, 1 FROM nation
UNION ALL SELECT concat('#nation-', CAST(n_nationkey AS STRING)), 'isPartOf', 0, CAST(NULL AS STRING), concat('#region-', CAST(n_regionkey AS STRING)), n_nationkey, 1 FROM nation
UNION ALL SELECT concat('#supplier-', CAST(s_suppkey AS STRING)), 'name', 0, s_name, CAST(NULL AS STRING), s_suppkey, 0 FROM supplier
UNION ALL SELECT concat('#supplier-', CAST(s_suppkey AS STRING)), 'contentLocation', 0, CAST(NULL AS STRING),
  concat('#nation-', CAST(CASE WHEN s_suppkey % 17 = 0 THEN s_nationkey + 25 ELSE s_nationkey END AS STRING)), s_suppkey, 0 FROM supplier
UNION ALL SELECT concat('#supplier-', CAST(s_suppkey AS STRING)), 'license', 0, CAST(NULL AS STRING), 'https://example.org/licence', s_suppkey, 0 FROM supplier
UNION ALL SELECT concat('#customer-', CAST(c_custkey AS STRING)), 'name', 0, c_name, CAST(NULL AS STRING), c_custkey, 0 FROM customer
UNION ALL SELECT concat('#customer-', CAST(c_custkey AS STRING)), 'custom:segment', 0, c_mktsegment, CAST(NULL AS STRING), c_custkey, 0 FROM customer
UNION ALL SELECT concat('#customer-', CAST(c_custkey AS STRING)), 'contentLocation', 0, CAST(NULL AS STRING), concat('#nation-', CAST(c_nationkey AS STRING)), c_custkey, 0 FROM customer""",
    "graph_nodes": """
SELECT concat('g', CAST((k + nth) % 3 AS STRING)) AS graph_id, id, type, 0 AS pos FROM (
SELECT 0 AS nth, id, type, k FROM entity_rows UNION ALL SELECT 1, id, type, k FROM entity_rows WHERE shared = 1 OR k % 4 = 0
UNION ALL SELECT 2, id, type, k FROM entity_rows WHERE shared = 1 ) t""",
    "graph_props": """
SELECT concat('g', CAST((k + nth) % 3 AS STRING)) AS graph_id, id, prop, CAST(pos AS BIGINT) AS pos,
  CASE WHEN nth > 0 AND value IS NOT NULL THEN concat(value, ' ', CAST(nth AS STRING)) ELSE value END AS value, ref FROM (
SELECT 0 AS nth, id, prop, pos, value, ref, k FROM entity_facts UNION ALL SELECT 1, id, prop, pos, value, ref, k FROM entity_facts WHERE shared = 1 OR k % 4 = 0
UNION ALL SELECT 2, id, prop, pos, value, ref, k FROM entity_facts WHERE shared = 1 ) t""",
    # the graph with several, blank and untidy values
    "rich_props": """
SELECT graph_id, id, prop, pos, value, ref FROM graph_props
UNION ALL SELECT concat('g', CAST(o_custkey % 3 AS STRING)), concat('#customer-', CAST(o_custkey AS STRING)), 'custom:order', o_orderkey, CAST(NULL AS STRING), concat('#order-', CAST(o_orderkey AS STRING)) FROM orders
UNION ALL SELECT concat('g', CAST(c_custkey % 3 AS STRING)), concat('#customer-', CAST(c_custkey AS STRING)), 'name', CAST(1 AS BIGINT), concat('Also ', c_name), CAST(NULL AS STRING) FROM customer WHERE c_custkey % 6 = 0
UNION ALL SELECT concat('g', CAST(c_custkey % 3 AS STRING)), concat('#customer-', CAST(c_custkey AS STRING)), 'email', CAST(0 AS BIGINT), CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'a "quoted", mail' END, CAST(NULL AS STRING) FROM customer WHERE c_custkey % 5 = 0""",
    "overlay_props": """
SELECT concat('g', CAST(k % 3 AS STRING)) AS graph_id, id, prop, CAST(pos AS BIGINT) AS pos, value, ref FROM (
SELECT c_custkey AS k, concat('#customer-', CAST(c_custkey AS STRING)) AS id, 'name' AS prop, 0 AS pos, concat('Authored ', c_name) AS value, CAST(NULL AS STRING) AS ref
FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT c_custkey, concat('#customer-', CAST(c_custkey AS STRING)), 'memberOf', 0, CAST(NULL AS STRING), './' FROM customer WHERE c_custkey % 4 = 1
UNION ALL SELECT c_custkey, concat('#extra-', CAST(c_custkey AS STRING)), 'name', 0, c_name, CAST(NULL AS STRING) FROM customer WHERE c_custkey % 50 = 0
UNION ALL SELECT r_regionkey, './', 'name', 0, r_name, CAST(NULL AS STRING) FROM region WHERE r_regionkey < 3) t""",
    # a collection per nation, whose members are its customers
    "member_props": """
SELECT concat('n', CAST(c_nationkey AS STRING)) AS graph_id, './' AS id, 'pcdm:hasMember' AS prop, c_custkey AS pos,
  CAST(NULL AS STRING) AS value, concat('#customer-', CAST(c_custkey AS STRING)) AS ref FROM customer""",
    "member_nodes": """
SELECT concat('n', CAST(c_nationkey AS STRING)) AS graph_id, concat('#customer-', CAST(c_custkey AS STRING)) AS id, 'Person' AS type, 0 AS pos FROM customer""",
    "claimed_props": """
SELECT concat('n', CAST(c_nationkey AS STRING)) AS graph_id, './' AS id, 'pcdm:hasMember' AS prop, c_custkey AS pos, CAST(NULL AS STRING) AS value,
  concat('#customer-', CAST(CASE WHEN c_nationkey % 5 = 0 OR c_custkey % 7 = 0 THEN -c_custkey ELSE c_custkey END AS STRING)) AS ref
FROM customer WHERE c_custkey % 2 = 0 AND c_nationkey % 4 <> 3""",
    "nation_roots": "SELECT concat('n', CAST(n_nationkey AS STRING)) AS graph_id, './' AS root_id FROM nation",
    "place_names": """
SELECT DISTINCT concat('g', CAST(c_custkey % 2 AS STRING)) AS graph_id,
  CASE c_custkey % 5 WHEN 0 THEN concat('Mt N', k) WHEN 1 THEN concat('N', k, ' Mountain') WHEN 2 THEN concat('Mount N', k)
    WHEN 3 THEN concat('Mt.  n', k) ELSE concat(' N', k, ' lsland') END AS name
FROM (SELECT c_custkey, CAST(c_custkey % 45 AS STRING) AS k FROM customer) t""",
    "gazetteer": """
SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'manual' WHEN n_nationkey % 3 = 1 THEN 'primary' ELSE 'secondary' END AS provider,
  n_nationkey % 3 AS priority,
  concat('Mount N', CAST(n_nationkey AS STRING)) AS name,
  concat('R', CAST(n_regionkey AS STRING)) AS region,
  CAST(-40.5 AS DOUBLE) + n_nationkey AS latitude, CAST(110.0 AS DOUBLE) + n_nationkey AS longitude
FROM nation
UNION ALL
SELECT 'primary', 1, concat('Mount N', CAST(n_nationkey AS STRING), ' Lookout'), 'R0', CAST(-10.0 AS DOUBLE) - n_nationkey, CAST(140.25 AS DOUBLE) + n_nationkey FROM nation""",
    "catalog": {
        e: f"""
SELECT word AS name, concat('L', CAST(min(item_id) AS STRING), '-', word) AS code, max(item_id) % 3 AS is_alternate
FROM (SELECT item_id, {_WORDS[e].format("text")} AS word FROM benchmark) t
WHERE length(word) >= 3 GROUP BY word
UNION ALL
SELECT pair, concat('P', CAST(min(item_id) AS STRING), '-', replace(pair, ' ', '-')), 0 FROM (SELECT item_id, {_PAIRS[e]} AS pair FROM {_PAIRED[e]}) t
GROUP BY pair"""
        for e in _SPLIT
    },
    # page titles and whole benchmark passages, to be searched for terms
    "titles": {
        e: f"""
SELECT concat('g', CAST(page_id % 3 AS STRING)) AS graph_id, CAST(page_id AS STRING) AS file_id, {_TITLE[e]} AS text FROM pages
UNION ALL SELECT concat('g', CAST(doc_id % 3 AS STRING)), concat('d', CAST(doc_id AS STRING)), text FROM documents"""
        for e in _SPLIT
    },
    "transcript_lines": _per_engine(
        """
SELECT concat('g', CAST(conv_id % 2 AS STRING)) AS graph_id, conv_id AS doc_id, turn, line_no,
  CASE WHEN line_no = 0 THEN concat(CASE role WHEN 'user' THEN 'A' WHEN 'assistant' THEN 'B' ELSE 'C' END, ': ', line) ELSE line END AS line,
  CASE WHEN line_no = 0 AND turn = 0 THEN 'PRE' WHEN line_no = 0 AND turn = 1 THEN 'MAIN' WHEN line_no = 0 AND turn = 4 THEN 'POST' END AS marker
FROM ({lines}) t""",
        keep="conv_id, turn, role",
        pos="line_no",
        line="line",
        table="conversations",
        text="text",
    ),
    "declared_speakers": """
SELECT DISTINCT concat('g', CAST(conv_id % 2 AS STRING)) AS graph_id, conv_id AS doc_id,
  CASE role WHEN 'user' THEN 'A' ELSE 'B' END AS code,
  concat(role, ' ', CAST(conv_id AS STRING)) AS label,
  CASE WHEN conv_id % 3 = 0 THEN concat('(Group ', CAST(conv_id % 5 AS STRING), ')') END AS affiliation,
  CASE WHEN conv_id % 5 <> 0 THEN concat('#', role, '-', CAST(conv_id AS STRING)) END AS speaker_id
FROM conversations WHERE role IN ('user', 'assistant') AND conv_id % 4 <> 0""",
    # whole texts with a speaker list, built from documents
    "transcripts": {
        e: f"""
SELECT 'g' AS graph_id, concat('talks/t', CAST(doc_id AS STRING), '.docx') AS doc_id,
  concat('Transcript: ', source, {nl}, 'Speakers:', {nl}, 'A: Speaker ', lang, ' (', source, ', ', lang, ') #spk', CAST(doc_id % 50 AS STRING), {nl},
    'B: Other ', lang, {nl}, 'PRELIMINARIES', {nl}, 'A: hello', {nl}, 'MAIN', {nl}, 'B:', text, {nl}, 'X: bye', {nl}, 'END OF TRANSCRIPT') AS text
FROM documents"""
        for e, nl in (("spark", "'\\n'"), ("duckdb", "chr(10)"))
    },
    # styled documents; every tenth has no headings, some lines name images
    "blocks": _per_engine(
        """
SELECT 'g' AS graph_id, doc_id, pos,
  CASE WHEN doc_id % 10 = 9 AND (pos = 0 OR pos % 7 IN (0, 3)) THEN 'p'
    WHEN pos = 0 THEN 'h1' WHEN pos % 7 = 0 AND doc_id % 4 = 1 THEN 'p' WHEN pos % 7 = 0 THEN 'h2' WHEN pos % 7 = 3 THEN 'h3' WHEN pos % 14 = 4 THEN 'table'
    WHEN pos % 7 = 1 THEN 'image' WHEN pos % 7 = 2 THEN 'caption' WHEN pos % 7 = 5 AND doc_id % 3 = 2 THEN 'caption' ELSE 'p' END AS kind,
  CASE WHEN pos % 7 = 0 AND doc_id % 4 = 1 THEN concat('photo_', CAST(pos AS STRING), '.JPG ', text)
    WHEN pos % 7 = 2 AND doc_id % 3 = 0 THEN concat('Photo: ', text) WHEN pos % 7 = 2 AND doc_id % 3 = 1 THEN concat('caption:', text) ELSE text END AS text
FROM ({lines}) t""",
        keep="doc_id",
        pos="pos",
        line="text",
        table="documents",
        text="text",
    ),
    # originals by topic; every fifth is a working document
    "originals": """
SELECT concat('c', CAST(doc_id % 2 AS STRING)) AS graph_id, concat(lang, ' ', source) AS topic,
  CASE WHEN doc_id % 5 = 0 THEN concat('Field Notes ', CAST(doc_id AS STRING), '.docx')
       WHEN doc_id % 11 = 0 THEN concat('~$doc ', CAST(doc_id AS STRING), '.docx')
       WHEN doc_id % 13 = 0 THEN concat('.doc ', CAST(doc_id AS STRING), '.docx')
       ELSE concat('Doc ', CAST(doc_id AS STRING), '.docx') END AS file_name
FROM documents""",
    "edits": """
SELECT concat('g', CAST(user_id % 3 AS STRING)) AS graph_id, event_id AS seq,
  CASE event_id % 5 WHEN 0 THEN 'set' WHEN 1 THEN 'set' WHEN 2 THEN 'delete_property' WHEN 3 THEN 'rename' ELSE 'delete_entity' END AS op,
  concat('#customer-', CAST(user_id AS STRING)) AS id,
  CASE WHEN event_id % 5 = 3 OR event_id % 5 = 4 THEN CAST(NULL AS STRING) WHEN event_id % 2 = 0 THEN 'name' ELSE 'custom:segment' END AS prop,
  CASE event_id % 5 WHEN 3 THEN concat('#renamed-', CAST(user_id AS STRING)) WHEN 2 THEN CAST(NULL AS STRING) WHEN 4 THEN CAST(NULL AS STRING) ELSE event_type END AS value,
  CAST(NULL AS STRING) AS ref
FROM events""",
    # a second log: links, renames that clash, types, additions
    "more_edits": """
SELECT concat('g', CAST(o_custkey % 3 AS STRING)) AS graph_id, o_orderkey AS seq,
  CASE o_orderkey % 6 WHEN 0 THEN 'set' WHEN 1 THEN 'rename' WHEN 2 THEN 'retype' WHEN 3 THEN 'add' WHEN 4 THEN 'delete_property' ELSE 'delete_entity' END AS op,
  CASE WHEN o_orderkey % 6 = 3 THEN concat('#order-', CAST(o_orderkey % 997 AS STRING))
       WHEN o_orderkey % 31 = 5 THEN concat('#region-', CAST(o_orderkey % 5 AS STRING))
       WHEN o_orderkey % 31 = 6 THEN concat('#nation-', CAST(o_orderkey % 25 AS STRING))
       ELSE concat('#customer-', CAST(o_custkey AS STRING)) END AS id,
  CASE WHEN o_orderkey % 6 = 0 THEN 'custom:order' WHEN o_orderkey % 6 = 4 THEN 'contentLocation' END AS prop,
  CASE o_orderkey % 6 WHEN 1 THEN CASE WHEN o_orderkey % 4 = 0 THEN concat('#supplier-', CAST(o_orderkey % 50 AS STRING)) ELSE concat('#new-', CAST(o_orderkey % 400 AS STRING)) END
    WHEN 2 THEN CASE WHEN o_orderkey % 9 = 0 THEN ' , ' ELSE concat('Person, ', o_orderstatus, ' , Person') END
    WHEN 3 THEN 'CreativeWork' END AS value,
  CASE WHEN o_orderkey % 6 = 0 THEN concat('#order-', CAST(o_orderkey % 1499 AS STRING)) END AS ref
FROM orders""",
    "page_links": {
        "spark": "SELECT concat('g', CAST(page_id % 3 AS STRING)) AS graph_id, page_id, url, href FROM pages LATERAL VIEW explode(regexp_extract_all(html, '(?:href|src)=\"([^\"]*)\"', 1)) x AS href",
        "duckdb": "SELECT concat('g', CAST(page_id % 3 AS STRING)) AS graph_id, page_id, url, unnest(regexp_extract_all(html, '(?:href|src)=\"([^\"]*)\"', 1)) AS href FROM pages",
    },
    # the same links in the forms a page may write them
    "link_forms": """
SELECT graph_id, page_id, CASE page_id % 6 WHEN 0 THEN href WHEN 1 THEN concat('..', href, '?v=2#top') WHEN 2 THEN concat('https://example.org', href)
  WHEN 3 THEN concat('./a/../', substring(href, 2), '#x') WHEN 4 THEN concat(href, '.HTML') ELSE concat('#', href) END AS href
FROM page_links""",
    # two graphs with the same paths and other targets; the third has none
    "assets": "SELECT 'g0' AS graph_id, name AS path, concat('asset:', code) AS target FROM catalog UNION ALL SELECT 'g1', name, concat('other:', code) FROM catalog",
    "rules": """
SELECT * FROM (VALUES
  ('Person', 'name', 'Text', 1, 0, 1), ('Person', 'contentLocation', 'Place', 1, 0, 1), ('Person', 'email', 'Text', 1, 0, 1),
  ('Place', 'name', 'Text', 1, 0, 26), ('Place', 'isPartOf', 'RepositoryCollection', 1, 0, 0),
  ('Organization', 'name', 'Text', 1, 0, 0), ('Organization', 'license', 'URL', 1, 0, 0),
  ('Organization', 'contentLocation', 'Place', 0, 0, 0), ('Language', 'name', 'Text', 1, 1, 1)
) AS t(class, prop, range_type, required, multiple, min_instances)""",
    # entities with literals of every scalar range type, well and ill formed
    "typed_nodes": "SELECT concat('g', CAST(o_orderkey % 3 AS STRING)) AS graph_id, concat('#order-', CAST(o_orderkey AS STRING)) AS id, 'CreativeWork' AS type, 0 AS pos FROM orders",
    "typed_props": """
SELECT concat('g', CAST(o_orderkey % 3 AS STRING)) AS graph_id, concat('#order-', CAST(o_orderkey AS STRING)) AS id, prop, CAST(0 AS BIGINT) AS pos, value, CAST(NULL AS STRING) AS ref FROM (
SELECT o_orderkey, 'datePublished' AS prop, CASE o_orderkey % 7 WHEN 0 THEN '1996-01-02' WHEN 1 THEN '1996' WHEN 2 THEN '1996-13' WHEN 3 THEN 'yesterday' WHEN 4 THEN '1996-02-30' WHEN 5 THEN '' ELSE '1996-07' END AS value FROM orders
UNION ALL SELECT o_orderkey, 'size', CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey AS STRING) WHEN 1 THEN '1.5' ELSE concat('+', CAST(o_custkey AS STRING), ' ') END FROM orders
UNION ALL SELECT o_orderkey, 'ratio', CASE o_orderkey % 4 WHEN 0 THEN '1e5' WHEN 1 THEN '.5' WHEN 2 THEN o_orderstatus ELSE '-3.' END FROM orders
UNION ALL SELECT o_orderkey, 'open', CASE o_orderkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'yes' ELSE 'false' END FROM orders
UNION ALL SELECT o_orderkey, 'home', CASE o_orderkey % 3 WHEN 0 THEN 'https://example.org/a' WHEN 1 THEN 'not a url' ELSE 'arcp://name,x' END FROM orders
UNION ALL SELECT o_orderkey, 'made', CASE o_orderkey % 3 WHEN 0 THEN '1996-01-02T10:30:00' WHEN 1 THEN '1996-01-02' ELSE '1996-01-02 25:00' END FROM orders) t""",
    "typed_rules": """
SELECT * FROM (VALUES
  ('CreativeWork', 'datePublished', 'Date', 1, 0, 0), ('CreativeWork', 'size', 'Integer', 0, 0, 0), ('CreativeWork', 'ratio', 'Number', 0, 0, 0),
  ('CreativeWork', 'open', 'Boolean', 0, 0, 0), ('CreativeWork', 'home', 'URL', 0, 0, 0), ('CreativeWork', 'made', 'DateTime', 0, 0, 0), ('CreativeWork', 'made', 'Person', 0, 0, 0)
) AS t(class, prop, range_type, required, multiple, min_instances)""",
    # a JSON-LD document per customer; roots are named in three ways, some do not parse
    "json_docs": """
SELECT concat('k', CAST(c_custkey AS STRING)) AS graph_id, root, c_custkey, c_name, c_nationkey,
  CASE WHEN c_custkey % 10 = 9 THEN concat('{ not json ', c_name) ELSE concat(
    '{"@context": ["https://w3id.org/ro/crate/1.2/context", {"x', CAST(c_nationkey AS STRING), '": "https://example.org/', CAST(c_nationkey AS STRING), '#", "bad key": "https://z", "n": 5}], "@graph": [',
    CASE WHEN c_custkey % 3 = 2 THEN '' ELSE concat('{"@id": "ro-crate-metadata.json", "@type": "CreativeWork", "about": {"@id": "', root, '"}}, ') END,
    '{"@id": "#person", "@type": "Person", "name": "', c_name, '", "size": ', CAST(c_custkey AS STRING), '}, ',
    '{"@id": "', root, '", "@type": ["Dataset", "RepositoryCollection"], "name": ["One", "T&wo"], "open": true, "tags": ["a", {"@id": "#person"}, "b"], "none": null, "author": {"@id": "#person", "name": "nested"}}]}') END AS text
FROM (SELECT *, CASE c_custkey % 3 WHEN 0 THEN './' WHEN 1 THEN concat('arcp://name,k', CAST(c_custkey AS STRING)) ELSE '#set' END AS root FROM customer) c""",
    # prefixed targets and the context rows a sheet declares
    "targets": "SELECT DISTINCT concat('g', CAST(p_partkey % 3 AS STRING)) AS graph_id, concat(CASE WHEN p_size % 7 = 0 THEN 'custom' WHEN p_size % 7 = 1 THEN 'http' ELSE concat('x', CAST(p_size % 7 AS STRING)) END, CASE WHEN p_size % 7 = 1 THEN '://' ELSE ':' END, p_brand) AS target FROM part",
    # graphs declare one prefix differently, and twice: the last one holds
    "declared": """
SELECT concat('g', CAST(n_nationkey % 2 AS STRING)) AS graph_id, n_nationkey AS pos, concat('x', CAST(n_regionkey AS STRING)) AS prefix,
  CASE WHEN n_regionkey = 3 THEN 'not a uri' ELSE concat('https://example.org/', n_name, '#') END AS uri FROM nation""",
    # metadata files found in collections; some do not parse
    "candidates": """
SELECT concat(lang, '/', source, '/', CAST(CAST(floor(doc_id / 30) AS BIGINT) AS STRING)) AS graph_id,
  CASE doc_id % 4 WHEN 0 THEN 'additional-ro-crate-metadata.xlsx' WHEN 1 THEN 'ro-crate-metadata.xlsx' WHEN 2 THEN 'ro-crate-metadata.json' ELSE 'other.json' END AS name,
  CAST(floor(doc_id / 7) AS BIGINT) AS last_modified,
  CASE WHEN doc_id % 3 = 0 THEN '{ not json' ELSE concat('{"@graph": [{"@id": "./", "n": ', CAST(doc_id AS STRING), '}]}') END AS content
FROM documents""",
}

_DEPENDS = {
    name: [
        other
        for other in VIEWS
        if other != name
        and any(
            f" {other}{end}" in (text if isinstance(text, str) else text["duckdb"]) + " "
            for end in (" ", "\n", ")")
        )
    ]
    for name, text in VIEWS.items()
}


def _in_order(names, seen=None):
    seen = [] if seen is None else seen
    for name in names:
        if name not in seen:
            _in_order(_DEPENDS[name], seen)
            if name not in seen:
                seen.append(name)
    return seen


def _with(engine: str, names) -> str:
    parts = [
        f"{n} AS ({VIEWS[n] if isinstance(VIEWS[n], str) else VIEWS[n][engine]})" for n in _in_order(names)
    ]
    return "WITH " + ",\n".join(parts)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table, as a DataFrame over the tables in ``sf_dir``."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ctes = _with("spark", [name])
    for table in TABLES:
        if table in ctes:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(f"{ctes} SELECT * FROM {name}")


def oracle(views: str, body: str) -> str:
    """DuckDB SQL for a check: the named views, then the body."""
    body = body.strip()
    if not views:
        return body
    ctes = _with("duckdb", views.split())
    if body.upper().startswith("WITH "):
        return f"{ctes},\n{body[5:]}"
    return f"{ctes}\n{body}"
