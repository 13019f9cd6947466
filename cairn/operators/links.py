"""Resolving references to files: media in documents, links in pages, css urls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn import functions as fn
from cairn.model import entity_ids
from cairn.operators.overlay import KEY
from cairn.plans.scale import scattered

_CSS_URL = r"""(?i)url\(\s*(['"]?)([^'")]+)\1\s*\)"""


def resolve_media(refs: DataFrame, files: DataFrame) -> DataFrame:
    """File ids for names that documents mention; unresolved ones stay, with null.

    ``refs`` is (graph_id, ref_id, folder, name). Only the ``media`` folder
    beside the document counts. The whole name decides before the stem, upper
    and lower case alike; of several files the first id is taken.
    """
    media = files.select(
        "graph_id", fn.dirname(F.col("id")).alias("place"), "id", F.lower(fn.basename(F.col("id"))).alias("full")
    ).filter(F.col("place").rlike(r"(^|/)media\z"))
    keys = F.array(
        F.struct(F.lit(0).alias("exactness"), F.col("full").alias("key")),
        F.struct(F.lit(1).alias("exactness"), fn.strip_ext(F.col("full")).alias("key")),
    )
    index = (
        media.select("graph_id", "place", "id", F.inline(keys))
        .groupBy("graph_id", "place", "key")
        .agg(F.min(F.struct("exactness", "id")).alias("file"))
    )
    wanted = F.lower(fn.trim_all(F.col("name")))
    asked = refs.select(
        "graph_id",
        "ref_id",
        F.concat_ws("/", F.nullif(F.col("folder"), F.lit("")), F.lit("media")).alias("place"),
        F.posexplode(F.array_distinct(F.array(wanted, fn.strip_ext(wanted)))).alias("attempt", "key"),
    )
    found = (
        asked.join(index, ["graph_id", "place", "key"])
        .groupBy("graph_id", "ref_id")
        .agg(F.min(F.struct("attempt", "file")).alias("best"))
        .select("graph_id", "ref_id", F.col("best.file.id").alias("file_id"))
    )
    return refs.join(found, ["graph_id", "ref_id"], "left")


def asset_index(assets: DataFrame) -> DataFrame:
    """The target behind each key of a graph: a path as it reads or, failing that, its decoded form."""
    path = F.col("path")
    decoded = fn.normalize_relative_path(path)
    keys = F.array(
        F.struct(path.alias("key"), F.lit(0).alias("rank")),
        F.struct(F.when(fn.encode_uri(decoded) == path, decoded).alias("key"), F.lit(1).alias("rank")),
    )
    return (
        assets.select("graph_id", "target", F.inline(keys))
        .filter("key IS NOT NULL")
        .groupBy("graph_id", "key")
        .agg(F.min(F.struct("rank", "target")).alias("hit"))
        .select("graph_id", "key", F.col("hit.target").alias("target"))
    )


def _mapped(refs: DataFrame, raw: str, assets: DataFrame) -> DataFrame:
    """Add ``key`` and ``mapped`` for a raw reference; null where it is not ours."""
    own = F.col(raw).isNotNull() & (F.col(raw) != "") & ~fn.is_absolute_url(F.col(raw))
    path = F.nullif(fn.normalize_relative_path(fn.url_base(F.col(raw))), F.lit(""))
    keyed = refs.withColumn("key", F.when(own, path))
    return (
        keyed.withColumn("_key", scattered(F.col("key"), F.col("key").isNotNull(), *refs.columns))
        .join(asset_index(assets).withColumnRenamed("key", "_key"), ["graph_id", "_key"], "left")
        .select(*refs.columns, "key", F.concat("target", fn.url_suffix(F.col(raw))).alias("mapped"))
    )


def resolve_links(links: DataFrame, assets: DataFrame) -> DataFrame:
    """Classify each ``href`` and map the relative ones to known assets.

    ``kind`` is ``empty``, ``absolute``, ``page`` (left to navigation),
    ``mapped`` or ``unknown``; ``resolved`` is what the reference becomes.
    """
    raw = F.col("href")
    looked_up = _mapped(links, "href", assets)
    kind = (
        F.when(raw.isNotNull() & fn.is_absolute_url(raw), "absolute")
        .when(F.col("key").isNull(), "empty")
        .when(F.lower("key").endswith(".html"), "page")
        .when(F.col("mapped").isNotNull(), "mapped")
        .otherwise("unknown")
    )
    resolved = F.when(kind == "mapped", F.col("mapped")).otherwise(raw)
    return looked_up.select(*links.columns, kind.alias("kind"), resolved.alias("resolved"))


def rewrite_css_urls(css: DataFrame, assets: DataFrame) -> DataFrame:
    """``css`` (graph_id, css_id, css) with every mappable ``url(...)`` swapped.

    The text is cut at its urls; each distinct url of a style sheet is looked
    up once, and the pieces are put together again in order.
    """
    text = F.col("css")
    pattern = F.lit(_CSS_URL)

    def every(group: int) -> Column:
        return F.regexp_extract_all(text, pattern, F.lit(group))

    cut = css.select(
        "graph_id",
        "css_id",
        "css",
        F.split(text, _CSS_URL, -1).alias("between"),
        F.arrays_zip(
            every(0).alias("whole"), every(1).alias("quote"), F.transform(every(2), fn.trim_all).alias("raw")
        ).alias("urls"),
    )
    urls = cut.select("graph_id", "css_id", F.explode(F.array_distinct("urls.raw")).alias("raw"))
    targets = (
        _mapped(urls, "raw", assets)
        .filter("mapped IS NOT NULL")
        .groupBy("graph_id", "css_id")
        # at most the distinct urls of one text cell
        .agg(F.map_from_entries(F.collect_list(F.struct("raw", "mapped"))).alias("targets"))
    )

    def swapped(url: Column) -> Column:
        target = F.try_element_at(F.col("targets"), url["raw"])
        put = F.concat(F.lit("url("), url["quote"], target, url["quote"], F.lit(")"))
        return F.coalesce(put, url["whole"])

    pieces = F.flatten(
        F.zip_with(
            "between",
            F.transform("urls", swapped),
            lambda piece, url: F.array(piece, F.coalesce(url, F.lit(""))),
        )
    )
    return cut.join(targets, ["graph_id", "css_id"], "left").select(
        "graph_id", "css_id", F.array_join(pieces, "").alias("css")
    )


def entity_names(props: DataFrame) -> DataFrame:
    """First non-blank literal name of each entity that has one."""
    named = props.filter((F.col("prop") == "name") & (fn.trim_all(F.col("value")) != ""))
    return named.groupBy("graph_id", "id").agg(F.min_by("value", F.struct("pos", "value")).alias("name"))


def display_names(nodes: DataFrame, props: DataFrame) -> DataFrame:
    """Name to show for each entity: its first non-blank name, else its id."""
    return entity_ids(nodes).join(entity_names(props), ["graph_id", "id"], "left").select(
        "graph_id", "id", F.coalesce("name", "id").alias("display_name")
    )


def with_text(props: DataFrame, named: DataFrame) -> DataFrame:
    """Add each value as ``text``, references by the name ``named`` has for them, else by id."""
    names = entity_names(named).select(
        "graph_id", F.col("id").alias("target"), fn.trim_all(F.col("name")).alias("linked")
    )
    return (
        props.withColumn("target", F.coalesce("ref", "value"))
        .filter(fn.trim_all(F.col("target")) != "")
        .join(names, ["graph_id", "target"], "left")
        .select(*props.columns, F.coalesce("linked", fn.trim_all(F.col("target"))).alias("text"))
    )


def resolve_names(props: DataFrame) -> DataFrame:
    """Every value as text, references by the linked entity's name, else its id.

    One row per value, in order of ``pos``: a list of any length stays a set
    of rows. Literals that read as an entity's id are resolved the same way.
    """
    return with_text(props, props).select(*KEY, "pos", "text")
