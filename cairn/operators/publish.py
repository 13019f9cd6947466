"""Tables behind published pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn import functions as fn
from cairn.model import PROP_COLS, literal_table
from cairn.operators.links import with_text
from cairn.operators.overlay import KEY
from cairn.operators.sheets import context_rows


def expand_properties(props: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Add a full-URI copy of each compact property, unless the entity has one."""
    return props.unionByName(expanded_copies(props, prefixes))


def expanded_copies(props: DataFrame, prefixes: DataFrame) -> DataFrame:
    known = context_rows(prefixes).withColumnRenamed("uri", "base")
    compact = (
        props.filter(~F.col("prop").startswith("@"))
        .withColumn("prefix", fn.curie_prefix(F.col("prop")))
        .withColumn("local", fn.curie_local(F.col("prop")))
        .filter("prefix <> '' AND local <> ''")
    )
    copies = (
        compact.join(known, ["graph_id", "prefix"])
        .withColumn("prop", F.concat("base", "local"))
        .select(*PROP_COLS)
    )
    present = props.filter(F.col("prop").rlike("(?i)^(https?:|urn:|arcp:)")).select(*KEY).distinct()
    return copies.join(present, KEY, "left_anti").select(*PROP_COLS)


def resolve_layout(
    layout: Sequence[dict], prefixes: Mapping[str, str], terms: Mapping[str, str]
) -> list[tuple]:
    """Rows (group_no, group, input_no, prop_uri) of a page layout.

    ``layout`` is a list of ``{"name", "inputs"}``. Names are full URIs,
    compact names or plain ``terms``. Names that do not resolve, and groups
    left empty, drop out; an empty layout is an error.
    """
    if not layout:
        raise ValueError("a page layout needs at least one property group")

    def uri(name):
        if "://" in name:
            return name
        prefix, colon, local = name.partition(":")
        return prefixes[prefix] + local if colon and prefix in prefixes else terms.get(name)

    return [
        (g, group["name"], i, uri(name))
        for g, group in enumerate(layout)
        for i, name in enumerate(group["inputs"])
        if uri(name)
    ]


def entity_pages(
    props: DataFrame, layout: Sequence[dict], prefixes: Mapping[str, str], terms: Mapping[str, str]
) -> DataFrame:
    """What each entity's page shows, one row per value.

    Rows (graph_id, id, group_no, group, input_no, prop_uri, pos, text); order
    by group_no, input_no, pos. References read as names. A property counts in
    full, compact or plain form; where an entity has several, the full one.
    """
    rows = resolve_layout(layout, prefixes, terms)
    uris = sorted({row[3] for row in rows})
    short = [(f"{p}:{u[len(base):]}", u) for u in uris for p, base in prefixes.items() if u.startswith(base)]
    short += [(term, u) for term, u in terms.items() if u in uris]
    spark = props.sparkSession
    inputs = literal_table(spark, rows, group_no="int", group="string", input_no="int", prop_uri="string")
    forms = literal_table(spark, short, prop="string", prop_uri="string")
    full = props.filter(F.col("prop").isin(uris)).withColumn("prop_uri", F.col("prop"))
    brief = props.filter(F.col("prop").isin([form for form, _ in short])).join(forms, "prop")
    brief = brief.join(full.select(*KEY).distinct().withColumnRenamed("prop", "prop_uri"), ["graph_id", "id", "prop_uri"], "left_anti")
    return (
        with_text(full.unionByName(brief), props)
        .join(inputs, "prop_uri")
        .select("graph_id", "id", "group_no", "group", "input_no", "prop_uri", "pos", "text")
    )


def template_refs(config: dict | None) -> list[str]:
    """Templates a site configuration names, each once; none for a single page."""
    if not config or config.get("multipage") is False:
        return []
    named = [config.get("root", {}).get("template")]
    named += [kind.get("template") for kind in config.get("types", {}).values()]
    return list(dict.fromkeys(t for t in named if t))


def page_plan(
    nodes: DataFrame, roots: DataFrame, config: dict, available: Sequence[str]
) -> DataFrame:
    """Entities that get a page, and its template: (graph_id, id, template).

    The root has its own template; of an entity's types the one listed first
    in the configuration decides. A template that is not available is an error.
    """
    missing = [t for t in template_refs(config) if t not in set(available)]
    if missing:
        raise ValueError(f"could not resolve page templates: {', '.join(missing)}")
    kinds = [
        (i, kind, entry["template"])
        for i, (kind, entry) in enumerate(config.get("types", {}).items())
        if entry.get("template")
    ]
    if not template_refs(config):
        kinds = []
    listed = literal_table(
        nodes.sparkSession, kinds, rank="int", type="string", template="string"
    )
    own = roots.select("graph_id", F.col("root_id").alias("id"))
    typed = (
        nodes.join(listed, "type")
        .groupBy("graph_id", "id")
        .agg(F.min_by("template", "rank").alias("template"))
        .join(own, ["graph_id", "id"], "left_anti")
        .select("graph_id", "id", "template")
    )
    root_template = config.get("root", {}).get("template")
    if not root_template or not template_refs(config):
        return typed
    present = own.join(nodes.select("graph_id", "id").distinct(), ["graph_id", "id"], "left_semi")
    return typed.unionByName(present.withColumn("template", F.lit(root_template)))
