"""Lines of transcripts and documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.paths import trim_all

__all__ = [
    "SECTIONS",
    "caption_half",
    "caption_text",
    "csv_field",
    "media_ref",
    "parse_speaker_line",
    "section_marker",
    "speaker_code",
    "spoken_text",
]

# File endings a document line may name as media.
_MEDIA = "jpg|jpeg|png|gif|tif|tiff|webp|bmp|mov|mp4"

# Section headings of a transcript and the label of each.
SECTIONS = {"PRELIMINARIES": "PRE", "MAIN": "MAIN", "POSTLIMINARIES": "POST"}

_CODE = r"^\s*([A-Z][A-Z0-9_]*):"


def speaker_code(line: Column) -> Column:
    """Upper-case code before the colon, or null for a line without one."""
    return F.nullif(F.regexp_extract(line, _CODE, 1), F.lit(""))


def spoken_text(line: Column) -> Column:
    return trim_all(F.regexp_replace(line, _CODE, ""))


def section_marker(line: Column) -> Column:
    heading = trim_all(line)
    chain = F.lit(None).cast("string")
    for name, label in SECTIONS.items():
        chain = F.when(heading == name, F.lit(label)).otherwise(chain)
    return chain


def parse_speaker_line(line: Column) -> Column:
    """``CODE: Name (Affiliation) #id`` as a struct; absent parts are null."""
    rest = spoken_text(line)
    named = trim_all(F.regexp_replace(rest, r"\s*#\S+\s*\z", ""))

    def part(text, pattern):
        return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))

    return F.struct(
        speaker_code(line).alias("code"),
        trim_all(F.regexp_replace(named, r"\s*\([^()]*\)\z", "")).alias("label"),
        part(named, r"(\([^()]*\))\z").alias("affiliation"),
        part(rest, r"(#\S+)\s*\z").alias("speaker_id"),
    )


def caption_half(line: Column) -> Column:
    """``caption`` or ``credit`` where the line names its half, else null."""
    return (
        F.when(line.rlike(r"(?i)^\s*caption:"), F.lit("caption"))
        .when(line.rlike(r"(?i)^\s*photo:"), F.lit("credit"))
    )


def caption_text(line: Column) -> Column:
    return trim_all(F.regexp_replace(line, r"(?i)^\s*(caption|photo):", ""))


def media_ref(line: Column) -> Column:
    """What a line refers to: kind, file name and any inline caption."""
    sound = r"(?i)^\s*sound file:\s*(.*?)\s*\z"
    named = rf"(?i)^\s*(.+?\.(?:{_MEDIA}))(?![A-Za-z0-9_])\s*(.*?)\s*\z"
    is_sound = line.rlike(sound)
    is_image = ~is_sound & line.rlike(named)
    return F.struct(
        F.when(is_sound, F.lit("sound")).when(is_image, F.lit("image")).alias("kind"),
        F.when(is_sound, F.regexp_extract(line, sound, 1))
        .when(is_image, F.regexp_extract(line, named, 1))
        .alias("name"),
        F.when(is_image, F.nullif(F.regexp_extract(line, named, 2), F.lit(""))).alias("caption"),
    )


def csv_field(text: Column) -> Column:
    """Quoted only where a comma, quote or line break asks for it."""
    plain = F.coalesce(text, F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(plain, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(plain.rlike('[",\r\n]'), quoted).otherwise(plain)
