"""Transcripts to speaker rows.

Lines are (graph_id, doc_id, <position>, line). The position may be any
column that orders a transcript; with it goes a ``segment`` expression that
grows with the position and bounds how many lines one task sees together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn import functions as fn
from cairn.model import fact, node_rows, prop_rows
from cairn.plans.scale import scan, segment_of

DOC = ["graph_id", "doc_id"]

# Last line of a transcript, heading of the speaker list, and
# the folder that holds what is made from transcripts.
END_MARKER = "END OF TRANSCRIPT"
SPEAKER_HEADING = "Speakers:"
OUTPUT_FOLDER = "./c2c-output/"
CSV_FORMAT = "text/csv"


def _kept_lines(header_rows: int, footer_rows: int) -> Column:
    raw = F.split(F.col("text"), "\r?\n", -1)
    return F.slice(raw, header_rows + 1, F.greatest(F.size(raw) - header_rows - footer_rows, F.lit(0)))


def normalize_transcript(texts: DataFrame, header_rows: int = 0, footer_rows: int = 0) -> DataFrame:
    """Lines of each text, a tab after every speaker code, without the end marker.

    A text is one cell, so its lines are cut and trimmed inside the row.
    """
    return (
        texts.select(*DOC, F.posexplode(_kept_lines(header_rows, footer_rows)).alias("line_no", "line"))
        .filter(fn.trim_all(F.col("line")) != END_MARKER)
        .withColumn("line", _with_tab(F.col("line")))
    )


def normalize_lines(lines: DataFrame, header_rows: int = 0, footer_rows: int = 0) -> DataFrame:
    """``normalize_transcript`` for transcripts that come as rows: (graph_id, doc_id, line_no, line).

    ``line_no`` counts from 0 without gaps, as ``sources.lines.read_lines``
    gives it; the result counts behind the header.
    """
    ends = lines.groupBy(*DOC).agg((F.max("line_no") + 1 - footer_rows).alias("_end"))
    kept = lines.join(ends, DOC).filter((F.col("line_no") >= header_rows) & (F.col("line_no") < F.col("_end")))
    return (
        kept.filter(fn.trim_all(F.col("line")) != END_MARKER)
        .withColumns({"line": _with_tab(F.col("line")), "line_no": F.col("line_no") - header_rows})
        .select(*DOC, "line_no", "line")
    )


def _with_tab(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s*([A-Z][A-Z0-9_]*):\s*", "$1:\t")


def tag_lines(
    lines: DataFrame, pos: str = "line_no", segment: Column | None = None, marker: Column | None = None
) -> DataFrame:
    """Give each line its section, its block and the line its turn starts on.

    One pass carries all three. A turn starts at a speaker code or a section
    heading; other lines continue the turn above. Ahead of the first section
    a ``Label:`` line is a heading as well, inside of one it is spoken text.
    """
    line = F.col("line")
    marker = fn.section_marker(line) if marker is None else marker
    segment = segment_of(F.col(pos)) if segment is None else segment
    label = line.rlike(r"^\s*[A-Z][A-Za-z ]*:")
    starts = fn.speaker_code(line).isNotNull() | fn.section_marker(line).isNotNull() | marker.isNotNull()
    here = F.struct(F.col(pos).alias("at"), fn.speaker_code(line).alias("code"))
    tagged = scan(
        lines,
        DOC,
        pos,
        segment,
        last={
            "section": marker,
            "block": F.when(fn.trim_all(line) == SPEAKER_HEADING, F.lit("speakers")).when(
                marker.isNotNull(), F.lit("turns")
            ),
            "_inside": F.when(starts, here),
            "_ahead": F.when(starts | label, here),
        },
    )
    start = F.when(F.col("section").isNull(), F.col("_ahead")).otherwise(F.col("_inside"))
    return tagged.withColumn("start", start).drop("_inside", "_ahead", "_seg")


def assign_sections(
    lines: DataFrame, pos: str = "line_no", segment: Column | None = None, marker: Column | None = None
) -> DataFrame:
    """Section label of each line, carried forward from the headings."""
    return tag_lines(lines, pos, segment, marker).select(*lines.columns, "section")


def turns(tagged: DataFrame, pos: str = "line_no") -> DataFrame:
    """Join the lines of each turn with blanks: (doc, at, code, section, block, text).

    A turn is part of one transcript cell and so no longer than that.
    """
    line = F.col("line")
    is_start = F.col("start.at") == F.col(pos)
    piece = F.when(is_start & F.col("start.code").isNotNull(), fn.spoken_text(line)).otherwise(
        fn.trim_all(line)
    )
    spoken = tagged.withColumns({"_piece": piece, "_at": F.coalesce("start.at", F.col(pos))})
    pieces = F.array_sort(F.collect_list(F.when(F.col("_piece") != "", F.struct(F.col(pos).alias("p"), "_piece"))))
    return (
        spoken.groupBy(*DOC, F.col("_at").alias("at"))
        .agg(
            F.max("start.code").alias("code"),
            F.max("section").alias("section"),
            F.min_by("block", pos).alias("block"),
            pieces.alias("pieces"),
        )
        .select(*DOC, "at", "code", "section", "block", F.array_join("pieces._piece", " ").alias("text"))
    )


def merge_continuations(
    lines: DataFrame, pos: str = "line_no", segment: Column | None = None, marker: Column | None = None
) -> DataFrame:
    merged = turns(tag_lines(lines, pos, segment, marker), pos)
    return merged.filter("text <> '' OR code IS NOT NULL").drop("block")


def speakers(tagged: DataFrame, pos: str = "line_no") -> DataFrame:
    """The speaker list of each transcript, first declaration of a code only."""
    return _first_declared(tagged.filter(F.col("block") == "speakers"), pos)


def listed_speakers(texts: DataFrame, header_rows: int = 0, footer_rows: int = 0) -> DataFrame:
    """The speaker lists of whole texts, found inside each text's row.

    A list runs from its heading to the next section heading.
    """
    trimmed = texts.select(
        *DOC, F.transform(_kept_lines(header_rows, footer_rows), fn.trim_all).alias("lines")
    )
    after = trimmed.filter(F.array_contains("lines", SPEAKER_HEADING)).select(
        *DOC, F.slice("lines", F.array_position("lines", SPEAKER_HEADING).cast("int") + 1, F.size("lines")).alias("lines")
    )
    ends = [F.array_position("lines", heading) for heading in fn.SECTIONS]
    end = F.least(*[F.nullif(e, F.lit(0)) for e in ends]).cast("int")
    block = F.coalesce(F.slice("lines", 1, end - 1), "lines")
    return _first_declared(after.select(*DOC, F.posexplode(block).alias("line_no", "line")), "line_no")


def _first_declared(lines: DataFrame, pos: str) -> DataFrame:
    parsed = lines.filter(fn.speaker_code(F.col("line")).isNotNull()).select(
        *DOC, pos, F.inline(F.array(fn.parse_speaker_line(F.col("line"))))
    )
    first = F.min_by(F.struct("label", "affiliation", "speaker_id"), pos).alias("who")
    return parsed.groupBy(*DOC, "code").agg(first).select(*DOC, "code", "who.*")


def speaker_entities(declared: DataFrame) -> dict[str, DataFrame]:
    """A Person per declared speaker id, with affiliation and identifier."""
    people = (
        declared.filter("speaker_id IS NOT NULL")
        .groupBy("graph_id", "speaker_id")
        .agg(F.min_by(F.struct("label", "affiliation"), F.struct("doc_id", "code")).alias("who"))
        .select("graph_id", "speaker_id", "who.*")
    )
    sid = F.col("speaker_id")
    return {
        "nodes": node_rows(people, sid, "Person"),
        "props": prop_rows(
            people,
            sid,
            [
                fact("name", F.col("label")),
                fact("affiliation", F.col("affiliation")),
                fact("identifier", sid),
            ],
        ),
    }


def speaker_rows(merged: DataFrame, declared: DataFrame) -> DataFrame:
    """Turns with their speaker ids; a code nobody declared stands for itself.

    The speaker list and what stands before it are no turns; turns outside
    any section have a null section. ``doc_id`` is the transcript's path, from
    which the ids of its table and object follow.
    """
    stem = fn.strip_ext(F.col("doc_id").cast("string"))
    return (
        merged.filter("code IS NOT NULL AND (block IS NULL OR block <> 'speakers')")
        .join(declared.select(*DOC, "code", "speaker_id"), [*DOC, "code"], "left")
        .select(
            *DOC,
            "at",
            "code",
            F.coalesce("speaker_id", "code").alias("speaker_id"),
            "text",
            "section",
            F.concat(F.lit(OUTPUT_FOLDER), stem, F.lit(".csv")).alias("csv_id"),
            F.concat(F.lit(OUTPUT_FOLDER), stem).alias("object_id"),
        )
    )


def transcript_rows(texts: DataFrame, header_rows: int = 0, footer_rows: int = 0) -> dict[str, DataFrame]:
    """From whole texts to ``rows`` and the ``speakers`` they declare."""
    tagged = tag_lines(normalize_transcript(texts, header_rows, footer_rows))
    declared = listed_speakers(texts, header_rows, footer_rows)
    return {"rows": speaker_rows(turns(tagged), declared), "speakers": declared}


def transcript_rows_of_lines(lines: DataFrame, header_rows: int = 0, footer_rows: int = 0) -> dict[str, DataFrame]:
    """``transcript_rows`` for transcripts that come as rows of lines, however many those are.

    A turn is still one value; a transcript is not.
    """
    tagged = tag_lines(normalize_lines(lines, header_rows, footer_rows))
    declared = speakers(tagged)
    return {"rows": speaker_rows(turns(tagged), declared), "speakers": declared}


def used_codes(rows: DataFrame) -> DataFrame:
    """Distinct codes of each transcript, made distinct before they are shuffled."""
    return rows.select(*DOC, "code").distinct()


def unresolved_speakers(rows: DataFrame, declared: DataFrame) -> DataFrame:
    """Codes used but not declared, one row each; ``none`` for a transcript without any."""
    missing = (
        used_codes(rows)
        .join(declared.select(*DOC, "code").distinct(), [*DOC, "code"], "left_anti")
    )
    clean = used_codes(rows).select(*DOC).distinct().join(missing.select(*DOC).distinct(), DOC, "left_anti")
    return missing.unionByName(clean.withColumn("code", F.lit("none")))


def transcript_entities(rows: DataFrame) -> dict[str, DataFrame]:
    """The table and the object of each transcript that has turns, as entities.

    An object has its table as part and names the speakers who have an id, in
    order of their first turn.
    """
    made = rows.select("graph_id", "csv_id", "object_id").distinct()
    spoken = (
        rows.filter(F.col("speaker_id").startswith("#"))
        .groupBy("graph_id", "object_id", "speaker_id")
        .agg(F.min("at").alias("first"))
    )
    table, whole = F.col("csv_id"), F.col("object_id")
    return {
        "nodes": node_rows(made, table, "File").unionByName(node_rows(made, whole, "RepositoryObject")),
        "props": prop_rows(
            made,
            table,
            [fact("name", fn.basename(table)), fact("encodingFormat", CSV_FORMAT), fact("isPartOf", ref=whole)],
        )
        .unionByName(prop_rows(made, whole, [fact("name", fn.basename(whole)), fact("hasPart", ref=table)]))
        .unionByName(
            prop_rows(spoken, whole, [fact("ldac:speaker", ref=F.col("speaker_id"), pos=F.col("first"))])
        ),
    }
