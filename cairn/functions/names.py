"""Names, slugs, ids and cell values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.paths import strip_ext, trim_all

__all__ = [
    "arcp_id",
    "curie_local",
    "curie_prefix",
    "mint_id",
    "normalize_name",
    "number_text",
    "slugify",
    "split_values",
    "words",
]


def normalize_name(file_name: Column) -> Column:
    """Key under which near-copies of a file name fall together.

    Word borders are ASCII on purpose: ``écopy`` loses its ``copy``.
    """
    plain = F.lower(strip_ext(file_name))
    plain = F.regexp_replace(plain, r"(?<![A-Za-z0-9_])(copy|duplicate)(?![A-Za-z0-9_])", "")
    plain = F.regexp_replace(plain, r"\([0-9]+\)", "")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def slugify(text: Column) -> Column:
    lowered = F.lower(trim_all(F.coalesce(text, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(lowered, "[^a-z0-9]+", "-"), r"^-+|-+\z", "")


def arcp_id(text: Column) -> Column:
    """``arcp://name,<slug>``; a typed prefix is tolerated, blank means ``crate``."""
    bare = F.regexp_replace(trim_all(F.coalesce(text, F.lit(""))), r"(?i)^arcp://name,", "")
    return F.concat(F.lit("arcp://name,"), F.coalesce(F.nullif(slugify(bare), F.lit("")), F.lit("crate")))


def curie_prefix(term: Column) -> Column:
    """Prefix of a compact name, or empty for a URL or an ill-formed prefix."""
    bare = trim_all(F.coalesce(term, F.lit("")))
    prefix = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9._-]*):", 1)
    return F.when(bare.contains("://"), F.lit("")).otherwise(prefix)


def curie_local(term: Column) -> Column:
    return F.regexp_extract(term, r"(?s)^[^:]*:(.*)\z", 1)


def split_values(cell: Column, separators: str = "[,/]") -> Column:
    """Trimmed, non-blank parts of a cell."""
    parts = F.transform(F.split(cell, separators, -1), trim_all)
    return F.filter(parts, lambda p: p != "")


def mint_id(type: Column | str, value: Column) -> Column:
    kind = F.lit(type) if isinstance(type, str) else type
    return F.concat(F.lit("#"), slugify(kind), F.lit("-"), slugify(value))


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def number_text(number: Column) -> Column:
    """Shortest decimal text of a double, without an exponent or ``.0``.

    The digits are those of the shortest text that names the double; where
    that has an exponent, the point is moved by as many places.
    """
    text = number.cast("string")
    sign = F.when(text.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(F.regexp_extract(text, r"^-?([\d.]+)", 1), r"\.", "")
    point = F.length(F.regexp_extract(text, r"^-?(\d+)", 1)) + F.regexp_extract(text, r"E(-?\d+)$", 1).cast("int")
    size = F.length(digits)
    moved = (
        F.when(point <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .when(point >= size, F.concat(digits, F.repeat(F.lit("0"), point - size)))
        .otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, size)))
    )
    plain = F.when(text.contains("E"), F.concat(sign, moved)).otherwise(text)
    return F.when(plain.contains("."), F.regexp_replace(plain, r"\.?0*\z", "")).otherwise(plain)
