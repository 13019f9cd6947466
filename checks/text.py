"""Transcripts, documents and lines of text."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn import functions as fn
from cairn.operators import documents as docs
from cairn.operators import stats
from cairn.operators import transcripts as ts
from cairn.plans.scale import SEGMENT_ROWS
from cairn.sinks import text as out
from checks.registry import check, graph_rows

WHITE = "[\\t-\\r\\x{FEFF}\\p{Z}]"


def trim(text: str) -> str:
    return f"regexp_replace({text}, '^{WHITE}+|{WHITE}+$', '', 'g')"


def code_of(line: str) -> str:
    return f"nullif(regexp_extract({line}, '^\\s*([A-Z][A-Z0-9_]*):', 1), '')"


def spoken(line: str) -> str:
    return trim(f"regexp_replace({line}, '^\\s*[A-Z][A-Z0-9_]*:', '')")


def turns_sql(table: str) -> str:
    """Turns of lines (graph_id, doc_id, ord, line, marker) as table ``tn``.

    A line with no code joins the turn above; a ``Label:`` line opens a
    heading only where no section has begun.
    """
    return f"""tg AS (SELECT *, {code_of('line')} AS code0 FROM {table}),
th AS (SELECT *, last_value(marker IGNORE NULLS) OVER w AS section,
    last_value(CASE WHEN {trim('line')} = 'Speakers:' THEN 'speakers' WHEN marker IS NOT NULL THEN 'turns' END IGNORE NULLS) OVER w AS block
  FROM tg WINDOW w AS (PARTITION BY graph_id, doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING)),
ts AS (SELECT *, coalesce(last_value(CASE WHEN code0 IS NOT NULL OR marker IS NOT NULL OR (section IS NULL AND regexp_matches(line, '^\\s*[A-Z][A-Za-z ]*:')) THEN ord END IGNORE NULLS) OVER w, ord) AS start
  FROM th WINDOW w AS (PARTITION BY graph_id, doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING)),
tp AS (SELECT *, CASE WHEN ord = start AND code0 IS NOT NULL THEN {spoken('line')} ELSE {trim('line')} END AS piece FROM ts),
tn AS (SELECT graph_id, doc_id, start, max(CASE WHEN ord = start THEN code0 END) AS code, max(section) AS section, arg_min(coalesce(block, ''), ord) AS block,
    coalesce(string_agg(piece, ' ' ORDER BY ord) FILTER (WHERE piece <> ''), '') AS text FROM tp GROUP BY ALL)"""


#: turns are what is said with a code, anywhere but in the speaker list
SAID = "code IS NOT NULL AND block <> 'speakers'"
CONV = "ln AS (SELECT *, turn * 1000000 + line_no AS ord FROM transcript_lines)"


def conversation(v):
    """Lines of conversations, placed by turn and line, cut every so many turns."""
    lines = v("transcript_lines").withColumn("pos", F.struct("turn", "line_no"))
    return lines, "pos", F.floor(F.col("turn") / SEGMENT_ROWS).cast("bigint"), F.col("marker")


def conversation_rows(v):
    return ts.speaker_rows(ts.turns(ts.tag_lines(*conversation(v)), "pos"), v("declared_speakers"))


NORMAL = f"""raw AS (SELECT graph_id, doc_id, string_split(text, chr(10))[2:] AS ls FROM transcripts),
ul AS (SELECT graph_id, doc_id, unnest(range(len(ls))) AS ord, unnest(ls) AS line FROM raw),
ln AS (SELECT graph_id, doc_id, ord, regexp_replace(line, '^\\s*([A-Z][A-Z0-9_]*):\\s*', '\\1:' || chr(9)) AS line,
    CASE {trim('line')} WHEN 'PRELIMINARIES' THEN 'PRE' WHEN 'MAIN' THEN 'MAIN' WHEN 'POSTLIMINARIES' THEN 'POST' END AS marker
  FROM ul WHERE {trim('line')} <> 'END OF TRANSCRIPT')"""


@check("txt_01", "transcripts", f"WITH {NORMAL} SELECT graph_id, doc_id, CAST(ord AS INTEGER) AS line_no, line FROM ln")
def normalized(v):
    return ts.normalize_transcript(v("transcripts"), header_rows=1)


@check(
    "txt_02",
    "transcript_lines",
    f"WITH {CONV}, {turns_sql('ln')} SELECT graph_id, doc_id, start // 1000000 AS turn, start % 1000000 AS line_no, code, section, text FROM tn WHERE text <> '' OR code IS NOT NULL",
)
def continued(v):
    merged = ts.merge_continuations(*conversation(v))
    return merged.select("graph_id", "doc_id", "at.turn", "at.line_no", "code", "section", "text")


@check(
    "txt_03",
    "transcript_lines",
    f"WITH {CONV}, {turns_sql('ln')} SELECT graph_id, doc_id, turn, line_no, line, marker, section FROM ts",
)
def sections(v):
    return ts.assign_sections(*conversation(v)).drop("pos")


@check(
    "txt_04",
    "transcripts",
    """WITH p AS (SELECT 'g' AS graph_id, '#spk' || doc_id % 50 AS id,
    arg_min('Speaker ' || lang, 'talks/t' || doc_id || '.docx') AS name, arg_min('(' || source || ', ' || lang || ')', 'talks/t' || doc_id || '.docx') AS affiliation FROM documents GROUP BY 1, 2)
SELECT graph_id, id, '@type' AS prop, CAST(0 AS BIGINT) AS pos, 'Person' AS value, NULL::VARCHAR AS ref FROM p
UNION ALL SELECT graph_id, id, 'name', 0, name, NULL FROM p UNION ALL SELECT graph_id, id, 'affiliation', 0, affiliation, NULL FROM p
UNION ALL SELECT graph_id, id, 'identifier', 0, id, NULL FROM p""",
)
def people(v):
    tagged = ts.tag_lines(ts.normalize_transcript(v("transcripts"), header_rows=1))
    return graph_rows(ts.speaker_entities(ts.speakers(tagged)))


@check(
    "txt_05",
    "transcripts",
    f"""WITH {NORMAL}, {turns_sql('ln')}
SELECT graph_id, doc_id, CAST(start AS INTEGER) AS "at", code,
  CASE WHEN code = 'A' THEN '#spk' || (CAST(regexp_extract(doc_id, 't([0-9]+)', 1) AS BIGINT) % 50) ELSE code END AS speaker_id, text, section,
  './c2c-output/' || regexp_extract(doc_id, '/(.*)\\.docx', 1) || '.csv' AS csv_id, './c2c-output/' || regexp_extract(doc_id, '/(.*)\\.docx', 1) AS object_id
FROM tn WHERE {SAID}""",
)
def rows(v):
    return ts.transcript_rows(v("transcripts"), header_rows=1)["rows"]


@check(
    "txt_06",
    "transcripts",
    f"""WITH {NORMAL}, {turns_sql('ln')},
r AS (SELECT graph_id, start, code, './c2c-output/' || regexp_extract(doc_id, '/(.*)\\.docx', 1) AS object_id,
    CASE WHEN code = 'A' THEN '#spk' || (CAST(regexp_extract(doc_id, 't([0-9]+)', 1) AS BIGINT) % 50) END AS speaker FROM tn WHERE {SAID}),
o AS (SELECT DISTINCT graph_id, object_id, object_id || '.csv' AS csv_id, replace(object_id, './c2c-output/', '') AS name FROM r)
SELECT graph_id, csv_id AS id, '@type' AS prop, CAST(0 AS BIGINT) AS pos, 'File' AS value, NULL::VARCHAR AS ref FROM o
UNION ALL SELECT graph_id, object_id, '@type', 0, 'RepositoryObject', NULL FROM o
UNION ALL SELECT graph_id, csv_id, 'name', 0, name || '.csv', NULL FROM o UNION ALL SELECT graph_id, csv_id, 'encodingFormat', 0, 'text/csv', NULL FROM o
UNION ALL SELECT graph_id, csv_id, 'isPartOf', 0, NULL, object_id FROM o UNION ALL SELECT graph_id, object_id, 'name', 0, name, NULL FROM o
UNION ALL SELECT graph_id, object_id, 'hasPart', 0, NULL, csv_id FROM o
UNION ALL SELECT graph_id, object_id, 'ldac:speaker', min(start), NULL, speaker FROM r WHERE speaker IS NOT NULL GROUP BY graph_id, object_id, speaker""",
)
def transcripts_made(v):
    return graph_rows(ts.transcript_entities(ts.transcript_rows(v("transcripts"), header_rows=1)["rows"]))


SPOKEN_ROWS = f"{CONV}, {turns_sql('ln')}, sr AS (SELECT tn.*, coalesce(speaker_id, tn.code) AS speaker, affiliation FROM tn LEFT JOIN declared_speakers d ON d.graph_id = tn.graph_id AND d.doc_id = tn.doc_id AND d.code = tn.code WHERE tn.code IS NOT NULL AND block <> 'speakers')"


@check(
    "agg_05",
    "transcript_lines declared_speakers",
    f"""WITH {CONV}, {turns_sql('ln')}, us AS (SELECT DISTINCT graph_id, doc_id, code FROM tn WHERE {SAID}),
mi AS (SELECT * FROM us ANTI JOIN declared_speakers d USING (graph_id, doc_id, code))
SELECT * FROM mi UNION ALL SELECT graph_id, doc_id, 'none' FROM (SELECT DISTINCT graph_id, doc_id FROM us) x ANTI JOIN mi USING (graph_id, doc_id)""",
)
def unresolved(v):
    return ts.unresolved_speakers(conversation_rows(v), v("declared_speakers"))


QUOTED = "CASE WHEN regexp_matches({0}, '[\",\\r\\n]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"


@check(
    "snk_03",
    "transcript_lines declared_speakers",
    f"""WITH {SPOKEN_ROWS}
SELECT graph_id, doc_id, start // 1000000 AS turn, start % 1000000 AS line_no,
  {QUOTED.format('speaker')} || ',' || {QUOTED.format('text')} || ',' || coalesce(section, '') AS line FROM sr
UNION ALL SELECT DISTINCT graph_id, doc_id, NULL, NULL, 'speakerID,text,section' FROM sr""",
)
def csv_lines(v):
    lines = out.transcript_csv(conversation_rows(v))
    return lines.select("graph_id", "doc_id", "at.turn", "at.line_no", "line")


@check(
    "snk_04",
    "transcript_lines declared_speakers",
    f"""WITH {SPOKEN_ROWS},
wh AS (SELECT DISTINCT graph_id, doc_id, code, coalesce(regexp_replace(affiliation, '^\\(|\\)$', '', 'g'), '') AS affil FROM sr),
hd AS (SELECT graph_id, doc_id, ['@UTF8', '@Begin', '@Languages: eng', '@Participants: ' || string_agg(code || ' Participant', ', ' ORDER BY code)] AS ls FROM wh GROUP BY graph_id, doc_id)
SELECT graph_id, doc_id, CAST(unnest(range(len(ls))) AS INTEGER) AS section, NULL::VARCHAR AS code, NULL AS turn, NULL AS line_no, unnest(ls) AS line FROM hd
UNION ALL SELECT graph_id, doc_id, 4, code, NULL, NULL, '@ID: eng|demo|' || code || '|||||Participant||' || affil || '|' FROM wh
UNION ALL SELECT graph_id, doc_id, 5, NULL, start // 1000000, start % 1000000, '*' || code || ': ' || text FROM sr""",
)
def chat(v):
    lines = out.chat_lines(conversation_rows(v), v("declared_speakers"), "eng", "demo")
    return lines.select("graph_id", "doc_id", "section", "code", "at.turn", "at.line_no", "line")


@check(
    "fn_15",
    "transcripts",
    f"""WITH ul AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM transcripts),
r AS (SELECT *, {spoken('line')} AS rest FROM ul), n AS (SELECT *, {trim("regexp_replace(rest, '\\s*#\\S+\\s*$', '')")} AS named FROM r)
SELECT doc_id, line, {code_of('line')} AS code, {trim("regexp_replace(named, '\\s*\\([^()]*\\)$', '')")} AS label,
  nullif(regexp_extract(named, '(\\([^()]*\\))$', 1), '') AS affiliation, nullif(regexp_extract(rest, '(#\\S+)\\s*$', 1), '') AS speaker_id FROM n""",
)
def speaker_lines(v):
    lines = v("transcripts").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", "line", F.inline(F.array(fn.parse_speaker_line(F.col("line")))))


@check(
    "agg_04",
    "",
    "SELECT lang AS graph_id, c AS character, count(*) AS count FROM (SELECT lang, unnest(regexp_extract_all(text, '(?s).')) AS c FROM documents) x GROUP BY lang, c",
)
def characters(v):
    return stats.character_inventory(v("documents").withColumnRenamed("lang", "graph_id"))


OPENS = "kind IN ('h2', 'h3')"
W = "PARTITION BY graph_id, doc_id ORDER BY pos"


@check(
    "doc_01",
    "blocks",
    f"""SELECT graph_id, doc_id, pos, kind, text, CAST(sum(CASE WHEN {OPENS} THEN 1 ELSE 0 END) OVER w AS BIGINT) AS chapter, last_value(CASE WHEN {OPENS} THEN pos END IGNORE NULLS) OVER w AS heading_pos
FROM blocks b SEMI JOIN (SELECT doc_id FROM blocks WHERE kind IN ('h1', 'h2', 'h3')) h USING (doc_id) WINDOW w AS ({W} ROWS UNBOUNDED PRECEDING)""",
)
def chapters(v):
    return docs.segment_chapters(v("blocks"))


@check(
    "doc_01_without",
    "blocks",
    "SELECT DISTINCT graph_id, doc_id FROM blocks ANTI JOIN (SELECT doc_id FROM blocks WHERE kind IN ('h1', 'h2', 'h3')) h USING (doc_id)",
)
def without_chapters(v):
    return docs.documents_without_headings(v("blocks"))


@check(
    "doc_02",
    "blocks",
    f"""SELECT graph_id, doc_id, pos, kind, text, CASE WHEN kind = 'h3' AND nx = 'table' THEN h2 END AS parent_pos
FROM (SELECT *, lead(kind) OVER ({W}) AS nx, last_value(CASE WHEN kind = 'h2' THEN pos END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS h2 FROM blocks) b WHERE {OPENS}""",
)
def nested(v):
    return docs.nest_sections(v("blocks"))


@check(
    "doc_03",
    "blocks",
    f"""SELECT graph_id, doc_id, pos, 0 AS row_no, {trim("string_split(text, chr(9))[1]")} AS cell
FROM (SELECT *, lag(kind) OVER ({W}) AS above FROM blocks) b WHERE kind = 'table' AND above IN ('h2', 'h3')""",
)
def table_rows(v):
    return docs.structured_rows(v("blocks"))


HALF = "CASE WHEN regexp_matches(text, '(?i)^\\s*caption:') THEN 'caption' WHEN regexp_matches(text, '(?i)^\\s*photo:') THEN 'credit' END"
CAPTION = trim("regexp_replace(text, '(?i)^\\s*(caption|photo):', '')")
NAMED = "(?i)^\\s*(.+?\\.(?:jpg|jpeg|png|gif|tif|tiff|webp|bmp|mov|mp4))\\b\\s*(.*?)\\s*$"


@check(
    "doc_04",
    "blocks",
    f"""WITH b AS (SELECT *, lead(kind) OVER ({W}) AS nk, lead(pos) OVER ({W}) AS np,
    last_value(CASE WHEN kind <> 'caption' THEN kind END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS ak, last_value(CASE WHEN kind <> 'caption' THEN pos END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS ap,
    last_value(CASE WHEN kind = 'image' THEN 'caption' WHEN kind = 'caption' THEN {HALF} END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS half FROM blocks),
l AS (SELECT graph_id, doc_id, ap AS image_pos, half, pos, {CAPTION} AS text FROM b WHERE kind = 'caption' AND ak = 'image'
  UNION ALL SELECT graph_id, doc_id, np, 'caption', pos, regexp_extract(text, '{NAMED}', 2) FROM b
    WHERE kind = 'p' AND nk = 'image' AND regexp_matches(text, '{NAMED}') AND NOT regexp_matches(text, '(?i)^\\s*sound file:'))
SELECT graph_id, doc_id, image_pos, half, string_agg(text, ' ' ORDER BY pos) AS text FROM l WHERE text <> '' GROUP BY ALL""",
)
def captions(v):
    return docs.attach_captions(v("blocks"))


@check(
    "doc_06",
    "blocks originals",
    f"""WITH o AS (SELECT 'g' AS graph_id, doc_id, lang || ' ' || source AS topic, 'Doc ' || doc_id || '.docx' AS file_name FROM documents WHERE doc_id % 5 <> 0),
k AS (SELECT *, '#' || replace(topic, ' ', '_') AS topic_id, '#' || replace(topic, ' ', '_') || '/Doc_' || doc_id AS entity, 'ro-crate-preview_files/' || topic || '/' || file_name AS file_id FROM o),
t AS (SELECT doc_id, arg_min(text, pos) AS title FROM blocks WHERE kind = 'h1' GROUP BY doc_id),
b AS (SELECT *, lead(kind) OVER ({W}) AS nk, lead(pos) OVER ({W}) AS np, last_value(CASE WHEN kind = 'h2' THEN pos END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS h2,
    last_value(CASE WHEN {OPENS} THEN pos END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS hp,
    last_value(CASE WHEN kind <> 'caption' THEN kind END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS ak, last_value(CASE WHEN kind <> 'caption' THEN pos END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS ap,
    last_value(CASE WHEN kind = 'image' THEN 'caption' WHEN kind = 'caption' THEN {HALF} END IGNORE NULLS) OVER ({W} ROWS UNBOUNDED PRECEDING) AS half FROM blocks),
l AS (SELECT doc_id, ap AS image_pos, half, pos, {CAPTION} AS text FROM b WHERE kind = 'caption' AND ak = 'image'
  UNION ALL SELECT doc_id, np, 'caption', pos, regexp_extract(text, '{NAMED}', 2) FROM b
    WHERE kind = 'p' AND nk = 'image' AND regexp_matches(text, '{NAMED}') AND NOT regexp_matches(text, '(?i)^\\s*sound file:')),
c AS (SELECT k.*, pos, text, entity || '/chapter-' || pos AS id, CASE WHEN kind = 'h3' AND nk = 'table' AND h2 IS NOT NULL THEN entity || '/chapter-' || h2 ELSE entity END AS above FROM b JOIN k USING (doc_id) WHERE {OPENS}),
m AS (SELECT k.*, pos, text, entity || '/media-' || pos AS id, CASE WHEN hp IS NOT NULL THEN entity || '/chapter-' || hp ELSE entity END AS above FROM b JOIN k USING (doc_id) WHERE kind = 'image')
SELECT 'g' AS graph_id, entity AS id, '@type' AS prop, CAST(0 AS BIGINT) AS pos, 'RepositoryObject' AS value, NULL::VARCHAR AS ref FROM k
UNION ALL SELECT 'g', id, '@type', 0, 'RepositoryObject', NULL FROM c UNION ALL SELECT 'g', id, '@type', 0, 'CreativeWork', NULL FROM m
UNION ALL SELECT 'g', entity, 'name', 0, coalesce(title, 'Doc ' || k.doc_id), NULL FROM k LEFT JOIN t USING (doc_id)
UNION ALL SELECT 'g', entity, 'pcdm:memberOf', 0, NULL, topic_id FROM k UNION ALL SELECT 'g', entity, 'isBasedOn', 0, NULL, file_id FROM k
UNION ALL SELECT 'g', topic_id, 'pcdm:hasMember', doc_id, NULL, entity FROM k
UNION ALL SELECT 'g', id, 'name', 0, text, NULL FROM c UNION ALL SELECT 'g', id, 'isPartOf', 0, NULL, above FROM c UNION ALL SELECT 'g', above, 'hasPart', pos, NULL, id FROM c
UNION ALL SELECT 'g', id, 'name', 0, text, NULL FROM m UNION ALL SELECT 'g', id, 'isPartOf', 0, NULL, above FROM m UNION ALL SELECT 'g', above, 'hasPart', pos, NULL, id FROM m
UNION ALL SELECT 'g', m.id, half, 0, string_agg(l.text, ' ' ORDER BY l.pos), NULL FROM l JOIN m ON m.doc_id = l.doc_id AND m.pos = l.image_pos WHERE l.text <> '' GROUP BY m.id, half""",
)
def document_parts(v):
    named = F.concat(F.lit("Doc "), "doc_id", F.lit(".docx"))
    originals = v("documents").select(
        F.lit("g").alias("graph_id"),
        "doc_id",
        F.concat_ws(" ", "lang", "source").alias("topic"),
        F.when(F.col("doc_id") % 5 == 0, "Field Notes.docx").otherwise(named).alias("file_name"),
    )
    return graph_rows(docs.document_entities(originals, v("blocks")))


@check("fn_13", "blocks", f"SELECT doc_id, pos, {HALF} AS half, {CAPTION} AS said FROM blocks")
def caption_parts(v):
    text = F.col("text")
    return v("blocks").select("doc_id", "pos", fn.caption_half(text).alias("half"), fn.caption_text(text).alias("said"))


SOUND = "(?i)^\\s*sound file:\\s*(.*?)\\s*$"


@check(
    "fn_14",
    "blocks",
    f"""WITH l AS (SELECT doc_id, pos, CASE WHEN doc_id % 6 = 0 THEN 'Sound file:  ' || text ELSE text END AS text FROM blocks)
SELECT doc_id, pos, CASE WHEN regexp_matches(text, '{SOUND}') THEN 'sound' WHEN regexp_matches(text, '{NAMED}') THEN 'image' END AS kind,
  CASE WHEN regexp_matches(text, '{SOUND}') THEN regexp_extract(text, '{SOUND}', 1) WHEN regexp_matches(text, '{NAMED}') THEN regexp_extract(text, '{NAMED}', 1) END AS name,
  CASE WHEN NOT regexp_matches(text, '{SOUND}') AND regexp_matches(text, '{NAMED}') THEN nullif(regexp_extract(text, '{NAMED}', 2), '') END AS caption FROM l""",
)
def media_lines(v):
    heard = F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit("Sound file:  "), "text")).otherwise(F.col("text"))
    return v("blocks").select("doc_id", "pos", F.inline(F.array(fn.media_ref(heard))))
