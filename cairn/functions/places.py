"""Place names and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions.names import number_text
from cairn.functions.paths import trim_all

__all__ = ["place_variants", "wkt_point"]


def place_variants(name: Column) -> Column:
    """Spellings to try, best first; the given name leads.

    ``Mt X`` and ``Mount X`` stand for each other, ``X Mountain`` and
    ``Mount X`` too, and a misread ``lsland`` becomes ``Island``.
    """
    given = trim_all(name)
    fixed = F.regexp_replace(given, r"\blsland\b", "Island")
    mount = F.regexp_replace(fixed, r"(?i)^mt\.?\s+", "Mount ")
    mount = F.regexp_replace(mount, r"(?i)^(.+?)\s+mountain\z", "Mount $1")
    short = F.regexp_replace(mount, r"(?i)^mount\s+", "Mt ")
    long = F.regexp_replace(mount, r"(?i)^mount\s+(.+)\z", "$1 Mountain")
    return F.array_distinct(F.array(given, fixed, mount, short, long))


def wkt_point(latitude: Column, longitude: Column) -> Column:
    return F.concat(
        F.lit("POINT("), number_text(longitude), F.lit(" "), number_text(latitude), F.lit(")")
    )
