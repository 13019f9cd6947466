"""Matching catalogue terms in names and linking what was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn import functions as fn
from cairn.model import entity_ids, fact, node_rows, prop_rows, union_all
from cairn.plans.scale import staged

# Generic words that identify nothing. The first three are fixed values.
GENERIC_TERMS = ["north", "people", "unknown", "south", "east", "west", "language", "other"]
SHORTEST_TERM = 4
RUN = 3  # words of a term that are looked up at once

LINK_PROP = "ldac:subjectLanguage"

# Properties a linked term may carry, with their definitions.
TERM_PROPERTIES = ["austlangCode", "iso639-3", "glottologCode"]
CUSTOM_TERMS = "arcp://name,custom/terms#"


def usable_terms(catalog: DataFrame, include_alternates: bool = False) -> DataFrame:
    """Terms worth matching: long enough, not generic, alternates on request."""
    kept = catalog.filter(
        (F.length("name") >= SHORTEST_TERM) & ~F.lower(fn.trim_all(F.col("name"))).isin(GENERIC_TERMS)
    )
    return kept if include_alternates else kept.filter("is_alternate = 0")


def match_terms(texts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Whole-word, case-insensitive hits: rows (graph_id, file_id, code, name).

    ``texts`` is (graph_id, file_id, text). The distinct runs of up to
    ``RUN`` words of a text meet the terms' beginnings of as many words by
    equality; only runs as long as some term's are made. That settles all terms
    but those with more words: the ones whose beginning a text has are
    gathered, no more than the catalogue holds, and the text is joined once to
    look for the rest of each. Terms may be of any length.
    """
    words = fn.words(F.col("name"))
    terms = (
        catalog.select("code", "name", words.alias("words"))
        .filter("size(words) > 0")
        .select("code", "name", F.least(F.size("words"), F.lit(RUN)).alias("n"), F.array_join(F.slice("words", 1, RUN), " ").alias("run"), F.array_join("words", " ").alias("term"))
        .distinct()
    )
    key = ["graph_id", "file_id"]
    sizes = [r["n"] for r in terms.select("n").distinct().collect()]  # RUN rows at most
    runs = F.flatten(F.array(*[F.array_distinct(_runs(F.col("words"), n)) for n in sizes])) if sizes else F.array().cast("array<string>")
    spoken = texts.select(*key, fn.words(F.col("text")).alias("words")).select(*key, F.explode(runs).alias("run"))
    begun = spoken.join(terms.drop("n"), "run")
    whole = begun.filter("run = term").select(*key, "code", "name")
    if RUN not in sizes:
        return whole.distinct()
    longer = begun.filter("run <> term").groupBy(*key).agg(F.collect_set(F.struct("code", "name", "term")).alias("terms"))
    line = F.concat(F.lit(" "), F.array_join(fn.words(F.col("text")), " "), F.lit(" ")).alias("line")
    here = F.filter("terms", lambda t: F.col("line").contains(F.concat(F.lit(" "), t["term"], F.lit(" "))))
    rest = texts.select(*key, line).join(longer, key).select(*key, F.inline(here)).select(*key, "code", "name")
    return whole.union(rest).distinct()


def _runs(words: Column, n: int) -> Column:
    """All runs of ``n`` words; none if there are fewer."""
    if n == 1:
        return words
    ends = F.sequence(F.lit(n), F.size(words))
    return F.when(F.size(words) >= n, F.transform(ends, lambda end: F.array_join(F.slice(words, end - n + 1, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def link_terms(
    nodes: DataFrame, hits: DataFrame, geometry: DataFrame | None = None
) -> dict[str, DataFrame]:
    """Term entities, links from the files that exist, and the distinct term count.

    ``hits`` is (graph_id, file_id, term_id, name), ``geometry`` (term_id,
    geo_id, wkt). Property definitions come only to graphs with a term. The
    hits are read by each part of the result, so they are staged.
    """
    hits = staged(hits)
    terms = hits.groupBy("graph_id", "term_id").agg(F.min("name").alias("name"))
    found = hits.select("graph_id", F.col("file_id").alias("id"), "term_id").distinct()
    linked = found.join(entity_ids(nodes), ["graph_id", "id"], "left_semi")
    # a file's terms are distinct catalogue entries, so the window stays small
    per_file = Window.partitionBy("graph_id", "id").orderBy("term_id")
    links = linked.withColumn("pos", F.row_number().over(per_file) - 1)
    links = prop_rows(links, F.col("id"), [fact(LINK_PROP, ref=F.col("term_id"), pos=F.col("pos"))])
    term = F.col("term_id")
    definitions = terms.select("graph_id").distinct().select(
        "graph_id", F.explode(F.array(*[F.lit(p) for p in TERM_PROPERTIES])).alias("local")
    )
    def_id = F.concat(F.lit(CUSTOM_TERMS), "local")
    node_parts = [node_rows(terms, term, "Language"), node_rows(definitions, def_id, "rdf:Property")]
    prop_parts = [
        prop_rows(terms, term, [fact("name", F.col("name"))]),
        prop_rows(definitions, def_id, [fact("name", F.col("local"))]),
        links,
    ]
    if geometry is not None:
        placed = terms.join(geometry, "term_id")
        node_parts.append(node_rows(placed, F.col("geo_id"), "Geometry"))
        prop_parts += [
            prop_rows(placed, term, [fact("geo", ref=F.col("geo_id"))]),
            prop_rows(placed, F.col("geo_id"), [fact("asWKT", F.col("wkt"))]),
        ]
    return {
        "nodes": union_all(node_parts),
        "props": union_all(prop_parts),
        "count": terms.groupBy("graph_id").agg(F.count("*").alias("terms")),
    }
