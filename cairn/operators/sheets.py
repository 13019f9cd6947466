"""Merging metadata sheets into a graph by entity id.

A mapping is a list of ``{"source", "target", "type"?}``: column, property
and, for a typed column, the type of the entities its values become.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn import functions as fn
from cairn.model import BUILTIN_PREFIXES, entity_ids, fact, literal_table, node_rows, prop_rows, union_all
from cairn.operators.overlay import KEY, replace_values
from cairn.operators.terms import CUSTOM_TERMS


def _column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`").cast("string")


def sheet_cells(sheet: DataFrame, mapping: Sequence[dict], typed: bool) -> DataFrame:
    """Non-blank mapped cells, long: graph_id, id, prop, type, cell.

    Where rows or columns write one property twice, the later row wins
    (``row_no``, if the sheet has it), then the later mapping.
    """
    rules = [(i, m) for i, m in enumerate(mapping) if bool(m.get("type")) == typed]
    if not rules:
        none = dict.fromkeys(["graph_id", "id", "prop", "type", "cell"], "string")
        return literal_table(sheet.sparkSession, [], **none)
    row_no = F.col("row_no") if "row_no" in sheet.columns else F.lit(0)
    cells = F.array(
        *[
            F.struct(
                F.lit(m["target"]).alias("prop"),
                F.lit(m.get("type")).cast("string").alias("type"),
                F.struct(row_no.cast("bigint").alias("row"), F.lit(i).alias("rule")).alias("order"),
                fn.trim_all(_column(m["source"])).alias("cell"),
            )
            for i, m in rules
        ]
    )
    long = sheet.select("graph_id", "id", F.inline(cells)).filter("cell <> ''")
    return (
        long.groupBy(*KEY)
        .agg(F.max(F.struct("order", "type", "cell")).alias("won"))
        .select(*KEY, "won.type", "won.cell")
    )


def sheet_literals(nodes: DataFrame, sheet: DataFrame, mapping: Sequence[dict]) -> DataFrame:
    """Literal values of the sheet for entities that exist."""
    cells = sheet_cells(sheet, mapping, typed=False)
    known = cells.join(entity_ids(nodes), ["graph_id", "id"], "left_semi")
    return prop_rows(known, F.col("id"), [fact(F.col("prop"), F.col("cell"))])


def sheet_links(nodes: DataFrame, sheet: DataFrame, mapping: Sequence[dict]) -> dict[str, DataFrame]:
    """Typed cells: an entity per distinct value, and ordered references to them.

    Entities that already exist are reused as they are.
    """
    cells = sheet_cells(sheet, mapping, typed=True)
    known = cells.join(entity_ids(nodes), ["graph_id", "id"], "left_semi")
    values = known.select(
        *KEY, "type", F.posexplode(fn.split_values(F.col("cell"))).alias("at", "text")
    ).withColumn("minted", fn.mint_id(F.col("type"), F.col("text")))
    # one reference per entity, where the cell names it first; within one cell
    refs = values.groupBy(*KEY, F.col("minted").alias("ref")).agg(F.min("at").alias("pos"))
    refs = prop_rows(refs, F.col("id"), [fact(F.col("prop"), ref=F.col("ref"), pos=F.col("pos"))])
    fresh = (
        values.groupBy("graph_id", F.col("minted").alias("id"), "type")
        .agg(F.min("text").alias("name"))
        .join(entity_ids(nodes), ["graph_id", "id"], "left_anti")
    )
    return {
        "nodes": node_rows(fresh, F.col("id"), F.col("type")),
        "props": prop_rows(fresh, F.col("id"), [fact("name", F.col("name"))]),
        "links": refs,
    }


def merge_sheet(
    nodes: DataFrame, props: DataFrame, sheet: DataFrame, mapping: Sequence[dict]
) -> dict[str, DataFrame]:
    """The graph with a sheet merged in: literals, minted entities and links."""
    literals = sheet_literals(nodes, sheet, mapping)
    linked = sheet_links(nodes, sheet, mapping)
    written = literals.unionByName(linked["links"])
    return {
        "nodes": nodes.unionByName(linked["nodes"]),
        "props": replace_values(props, written).unionByName(linked["props"]),
        "written": written,
        "minted": linked["nodes"],
    }


def unmatched(files: DataFrame, sheet: DataFrame, sample: int) -> DataFrame:
    """Files with no row and rows with no file: counts with a sample of ids.

    The sample is the first ``sample`` ids of each side; Spark limits it
    before the shuffle.
    """
    has_file = files.select("graph_id", "id").distinct()
    has_row = sheet.select("graph_id", "id").distinct()
    sides = (
        has_file.join(has_row, ["graph_id", "id"], "left_anti")
        .withColumn("side", F.lit("file"))
        .unionByName(has_row.join(has_file, ["graph_id", "id"], "left_anti").withColumn("side", F.lit("row")))
    )
    totals = sides.groupBy("graph_id", "side").agg(F.count("*").alias("total"))
    first = Window.partitionBy("graph_id", "side").orderBy("id")
    picked = sides.withColumn("sample_no", F.row_number().over(first)).filter(
        F.col("sample_no") <= sample
    )
    return picked.join(totals, ["graph_id", "side"]).select("graph_id", "side", "total", "sample_no", "id")


def context_rows(cells: DataFrame) -> DataFrame:
    """Prefixes of each graph (graph_id, prefix, uri) with a well-formed prefix and URI.

    The last declaration holds: the one with the greatest ``pos``, if ``cells``
    has that column, then the greatest URI.
    """
    place = F.col("pos") if "pos" in cells.columns else F.lit(0)
    prefix, uri = fn.trim_all(F.col("prefix")), fn.trim_all(F.col("uri"))
    return (
        cells.select("graph_id", prefix.alias("prefix"), uri.alias("uri"), place.alias("pos"))
        .filter(F.col("prefix").rlike(r"^[A-Za-z][A-Za-z0-9._-]*\z") & F.col("uri").rlike("(?i)^(https?:|urn:|arcp:)"))
        .groupBy("graph_id", "prefix")
        .agg(F.max(F.struct("pos", "uri"))["uri"].alias("uri"))
    )


def discover_prefixes(targets: DataFrame, declared: DataFrame) -> DataFrame:
    """Prefixes that a graph's targets use beyond the built-in ones; ``uri`` is null if undeclared."""
    used = (
        targets.select("graph_id", fn.curie_prefix(F.col("target")).alias("prefix"))
        .filter((F.col("prefix") != "") & ~F.col("prefix").isin(list(BUILTIN_PREFIXES)))
        .distinct()
    )
    return used.join(context_rows(declared), ["graph_id", "prefix"], "left").select("graph_id", "prefix", "uri")


def property_definitions(
    nodes: DataFrame, props: DataFrame, declared: DataFrame | None = None
) -> dict[str, DataFrame]:
    """An ``rdf:Property`` entity per declared file property and written ``custom:`` one.

    ``declared`` is (graph_id, id, name, description). Properties that are
    described already get nothing.
    """
    written = (
        props.filter(F.col("prop").startswith("custom:"))
        .select("graph_id", "prop")
        .distinct()
        .select(
            "graph_id",
            F.concat(F.lit(CUSTOM_TERMS), fn.curie_local(F.col("prop"))).alias("id"),
            fn.curie_local(F.col("prop")).alias("name"),
            F.lit(None).cast("string").alias("description"),
        )
    )
    if declared is not None:
        told = declared.select("graph_id", "id", "name", "description")
        written = told.unionByName(
            written.join(told.select("graph_id", "id"), ["graph_id", "id"], "left_anti")
        )
    fresh = written.join(entity_ids(nodes), ["graph_id", "id"], "left_anti")
    return {
        "nodes": node_rows(fresh, F.col("id"), "rdf:Property"),
        "props": prop_rows(
            fresh, F.col("id"), [fact("name", F.col("name")), fact("description", F.col("description"))]
        ),
    }


def merge_stats(written: DataFrame, minted: DataFrame, enriched_places: DataFrame) -> DataFrame:
    """Per graph: values merged, entities generated, places given coordinates."""

    def flagged(df, merged, generated, placed):
        return df.select(
            "graph_id",
            F.lit(merged).alias("merged"),
            F.lit(generated).alias("generated"),
            F.lit(placed).alias("enriched_places"),
        )

    events = union_all(
        [flagged(written, 1, 0, 0), flagged(minted, 0, 1, 0), flagged(enriched_places, 0, 0, 1)]
    )
    return events.groupBy("graph_id").agg(
        *[F.sum(c).alias(c) for c in ("merged", "generated", "enriched_places")]
    )
