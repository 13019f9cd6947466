"""Transcripts as CSV lines and as CHAT text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn import functions as fn
from cairn.operators.transcripts import DOC, used_codes

CSV_HEADER = "speakerID,text,section"


def transcript_csv(rows: DataFrame) -> DataFrame:
    """The lines of each transcript's table: (doc, at, line).

    ``at`` is null for the header line, which sorts first.
    """
    fields = [fn.csv_field(F.col(c)) for c in ("speaker_id", "text", "section")]
    fields[2] = F.coalesce(fields[2], F.lit(""))  # a turn outside any section
    body = rows.select(*DOC, "at", F.concat_ws(",", *fields).alias("line"))
    header = used_codes(rows).select(*DOC).distinct().withColumn("line", F.lit(CSV_HEADER))
    return body.unionByName(header, allowMissingColumns=True)


def _write(lines: DataFrame, order: list, path: str, mode: str) -> None:
    placed = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.select(*DOC, F.col("line").alias("value")).write.mode(mode).partitionBy(*DOC).text(path)


def write_transcript_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of CSV files per transcript; a long one is cut, in order."""
    _write(transcript_csv(rows), [*DOC, F.asc_nulls_first("at")], path, mode)


def chat_lines(rows: DataFrame, declared: DataFrame, language: str, corpus: str) -> DataFrame:
    """CHAT lines of each transcript: (graph_id, doc_id, section, code, at, line).

    In order of these columns they are the text: opening lines, participants,
    an ``@ID`` line per speaker, and a line per turn.
    """
    codes = used_codes(rows)
    used = codes.join(declared.select(*DOC, "code", "affiliation"), [*DOC, "code"], "left")
    inside = F.regexp_replace(F.coalesce("affiliation", F.lit("")), r"^\(|\)\z", "")
    # the codes of one transcript, a few
    who = F.array_join(F.transform(F.array_sort(F.collect_list("code")), lambda c: F.concat(c, F.lit(" Participant"))), ", ")
    opening = F.array(F.lit("@UTF8"), F.lit("@Begin"), F.lit(f"@Languages: {language}"), F.concat(F.lit("@Participants: "), "who"))
    head = codes.groupBy(*DOC).agg(who.alias("who")).select(*DOC, F.posexplode(opening).alias("section", "line"))
    ids = used.select(
        *DOC,
        F.lit(4).alias("section"),
        "code",
        F.concat(F.lit(f"@ID: {language}|{corpus}|"), "code", F.lit("|||||Participant||"), inside, F.lit("|")).alias("line"),
    )
    said = F.concat(F.lit("*"), "code", F.lit(": "), "text")
    turns = rows.select(*DOC, F.lit(5).alias("section"), "at", said.alias("line"))
    return head.unionByName(ids, allowMissingColumns=True).unionByName(turns, allowMissingColumns=True)


def write_chat(rows: DataFrame, declared: DataFrame, language: str, corpus: str, path: str, mode: str = "overwrite") -> None:
    """A folder of CHAT text per transcript; a long one is cut, in order."""
    order = [*DOC, "section", F.asc_nulls_first("at"), F.asc_nulls_first("code")]
    _write(chat_lines(rows, declared, language, corpus), order, path, mode)
