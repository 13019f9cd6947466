"""Paths and links. Relative paths use ``/``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "basename",
    "dirname",
    "encode_uri",
    "folders",
    "is_absolute_url",
    "normalize_relative_path",
    "sanitize_segment",
    "sanitize_url",
    "strip_ext",
    "trim_all",
    "url_base",
    "url_suffix",
]

# White space of every kind, trimmed alike.
_BLANK = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# Characters a whole-URI encoder leaves alone though a form
# encoder escapes them, with the escape.
_URI_PLAIN = {
    "+": "%20",
    "%2F": "/",
    "%3B": ";",
    "%2C": ",",
    "%3F": "?",
    "%3A": ":",
    "%40": "@",
    "%26": "&",
    "%3D": "=",
    "%2B": "+",
    "%24": "$",
    "%21": "!",
    "%7E": "~",
    "%27": "'",
    "%28": "(",
    "%29": ")",
    "%23": "#",
}


def trim_all(text: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.trim(text, F.lit(_BLANK))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.substring(path, F.lit(1), F.length(path) - F.length(basename(path)) - 1)


def strip_ext(path: Column) -> Column:
    """Base name up to its last dot; a leading dot starts no extension."""
    return F.regexp_replace(basename(path), r"(?s)^(.+)\.[^.]*\z", "$1")


def folders(path: Column) -> Column:
    return F.filter(F.split(dirname(path), "/"), lambda part: ~part.isin("", "."))


def sanitize_url(path: Column) -> Column:
    return F.translate(path, " ", "_")


def sanitize_segment(path: Column) -> Column:
    return F.translate(path, " /", "__")


def is_absolute_url(url: Column) -> Column:
    return url.rlike(r"(?i)^[a-z][a-z0-9+.-]*:") | url.startswith("//") | url.startswith("#")


def url_base(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*", 0)


def url_suffix(url: Column) -> Column:
    return F.substring(url, F.length(url_base(url)) + 1, F.length(url))


def _percent_decoded(text: Column) -> Column:
    """Decoded text, or the text itself where its escapes are malformed."""
    decoded = F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    broken = decoded.contains("�") & ~text.rlike("(?i)%EF%BF%BD|�")
    return F.when(broken, text).otherwise(F.coalesce(decoded, text))


def normalize_relative_path(path: Column) -> Column:
    """Path from the collection's root; ``..`` never climbs above it."""
    text = _percent_decoded(trim_all(F.coalesce(path, F.lit(""))))
    text = F.translate(text, "\\", "/")
    walked = F.aggregate(
        F.split(text, "/"),
        F.array().cast("array<string>"),
        lambda done, part: F.when(part.isin("", "."), done)
        .when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.concat(done, F.array(part))),
    )
    return F.array_join(walked, "/")


def encode_uri(path: Column) -> Column:
    """Percent-encode a path as a whole, leaving its separators."""
    text = F.url_encode(path)
    for escape, plain in _URI_PLAIN.items():
        text = F.replace(text, F.lit(escape), F.lit(plain))
    return text
