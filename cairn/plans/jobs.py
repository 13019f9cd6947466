"""Whole jobs: build a graph from files, edit one, check one."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.model import DUPLICATE_PROP, NODE_COLS, PROP_COLS, Graph, builtin_prefixes, entity_ids, union_all
from cairn.operators import edits as ed
from cairn.operators import files as fs
from cairn.operators import documents, overlay, places, quality, sheets, terms, transcripts
from cairn.operators.links import entity_names


def build_graph(
    files: DataFrame,
    roots: DataFrame,
    profile: Mapping,
    *,
    authored: DataFrame | None = None,
    collections: bool = False,
    structure_from_metadata: bool = False,
    file_properties: Mapping[str, Mapping] | None = None,
    duplicates_as_files: bool = False,
) -> Graph:
    """Graphs of all listings in ``files`` (graph_id, file_name, relative_path).

    With ``structure_from_metadata`` the folders make no objects and files no
    parents: a sheet describes them. ``file_properties`` maps the properties
    every file gets to their definitions. Name-alikes share a hub, or, with
    ``duplicates_as_files``, each names all others. Structural ids end up under
    each root.
    """
    meta = fs.file_metadata(fs.order_files(files))
    head = fs.assemble_root(roots, profile, authored)
    nodes, props = [head["nodes"]], [head["props"]]
    parents = None
    if not structure_from_metadata:
        made = (fs.folder_collections if collections else fs.folder_objects)(meta)
        parents = made["parents"]
        nodes.append(made["nodes"])
        props += [
            made["props"],
            fs.root_membership(made["top_level"], roots),
            fs.inherit_license(made["nodes"], head["props"], roots),
        ]
    declared = dict(file_properties or {})
    if declared:
        defined = fs.declared_definitions(roots, list(declared.values()))
        nodes.append(defined["nodes"])
        props.append(defined["props"])
    links = None
    if DUPLICATE_PROP in declared:
        groups = fs.duplicate_groups(meta)
        links = fs.duplicate_links(groups) if duplicates_as_files else fs.possible_duplicates(groups)
        if not duplicates_as_files:
            nodes.append(fs.duplicate_hub_nodes(groups))
    entities = fs.file_entities(meta, parents, list(declared), links)
    nodes.append(entities["nodes"])
    props.append(entities["props"])
    moved = fs.rewrite_hash_ids(union_all(nodes), union_all(props), roots)
    return Graph(moved["nodes"], moved["props"], roots, builtin_prefixes(roots))


def overlay_graph(target: Graph, source: Graph) -> Graph:
    """Lay an authored graph over a built one, then take its membership.

    What the source says of its own root fills what the target's root lacks.
    """
    said = overlay.remap_root_refs(source.props, target.roots).drop("remapped")
    nodes = overlay.merge_nodes(target.nodes, source.nodes, source.roots)
    props = overlay.merge_graphs(target.props, said, source.roots)
    of_root = (
        overlay.root_properties(said, source.roots)
        .drop("id")
        .join(target.roots.withColumnRenamed("root_id", "id"), "graph_id")
        .select(*PROP_COLS)
    )
    props = props.unionByName(overlay.seed_root(props, of_root).select(*PROP_COLS))
    members = overlay.replace_membership(props, source.props, nodes, target.roots, source.roots)
    return target.with_(nodes=nodes, props=members["props"])


def merge_metadata(
    graph: Graph,
    sheet: DataFrame,
    mapping: Sequence[dict],
    *,
    gazetteer: DataFrame | None = None,
    region: str | None = None,
    declared: DataFrame | None = None,
) -> Graph:
    """Merge a metadata sheet and describe the custom properties it brought.

    Entities that the sheet's ``Place`` columns made get a geometry where the
    ``gazetteer`` knows their name. ``declared`` (graph_id, prefix, uri) are
    the sheet's context rows: prefixes that the mapping uses join the graph's.
    """
    merged = sheets.merge_sheet(graph.nodes, graph.props, sheet, mapping)
    defined = sheets.property_definitions(merged["nodes"], merged["written"])
    made = graph.with_(nodes=merged["nodes"], props=merged["props"]).plus(defined["nodes"], defined["props"])
    if gazetteer is not None:
        placed = merged["minted"].filter("type = 'Place'").select("graph_id", "id")
        names = entity_names(merged["props"]).join(placed, ["graph_id", "id"], "left_semi")
        found = places.lookup_places(names.select("graph_id", "name").distinct(), gazetteer, region)
        geometry = places.attach_geometry(names, found)
        made = made.plus(geometry["nodes"], geometry["props"])
    if declared is not None:
        targets = F.array(*[F.lit(m["target"]) for m in mapping])
        used = graph.roots.select("graph_id", F.explode(targets).alias("target"))
        known = graph.prefixes.select("graph_id", "prefix")
        fresh = sheets.discover_prefixes(used, declared).filter("uri IS NOT NULL")
        made = made.with_(prefixes=graph.prefixes.unionByName(fresh.join(known, ["graph_id", "prefix"], "left_anti")))
    return made


def add_terms(
    graph: Graph,
    texts: DataFrame,
    catalog: DataFrame,
    include_alternates: bool = False,
    geometry: DataFrame | None = None,
) -> Graph:
    """Find catalogue terms in the names of files and link what was found.

    ``texts`` is (graph_id, file_id, text); a term's ``code`` becomes its id,
    under which ``geometry`` (term_id, geo_id, wkt) knows it. Terms that the
    graph has stay as they are; the links of a file replace those it had.
    """
    hits = terms.match_terms(texts, terms.usable_terms(catalog, include_alternates))
    made = terms.link_terms(graph.nodes, hits.withColumnRenamed("code", "term_id"), geometry)
    known = entity_ids(graph.nodes)
    links = made["props"].filter(F.col("prop") == terms.LINK_PROP)
    said = made["props"].filter(F.col("prop") != terms.LINK_PROP)
    # of a term the graph has, only a geometry it lacks is new
    fresh = said.join(known, ["graph_id", "id"], "left_anti").unionByName(
        overlay.seed_root(graph.props, said.filter("prop = 'geo'").join(known, ["graph_id", "id"], "left_semi")).select(*PROP_COLS)
    )
    nodes = made["nodes"].join(known, ["graph_id", "id"], "left_anti").select(*NODE_COLS)
    return graph.with_(props=overlay.replace_values(graph.props, links.select(*PROP_COLS))).plus(nodes, fresh.select(*PROP_COLS))


def add_speakers(graph: Graph, texts: DataFrame, header_rows: int = 0, footer_rows: int = 0) -> Graph:
    """Person entities for the speakers that transcripts list, unless they are there."""
    people = transcripts.speaker_entities(transcripts.listed_speakers(texts, header_rows, footer_rows))
    known = entity_ids(graph.nodes)
    return graph.plus(
        *[people[t].join(known, ["graph_id", "id"], "left_anti").select(*people[t].columns) for t in ("nodes", "props")]
    )


def add_transcripts(graph: Graph, texts: DataFrame, header_rows: int = 0, footer_rows: int = 0) -> Graph:
    """Speakers, tables and objects of transcripts (graph_id, doc_id, text), unless they are there."""
    made = transcripts.transcript_rows(texts, header_rows, footer_rows)
    entities = transcripts.transcript_entities(made["rows"])
    known = entity_ids(graph.nodes)
    fresh = {t: entities[t].join(known, ["graph_id", "id"], "left_anti").select(*entities[t].columns) for t in ("nodes", "props")}
    return add_speakers(graph.plus(fresh["nodes"], fresh["props"]), texts, header_rows, footer_rows)


def add_documents(graph: Graph, originals: DataFrame, blocks: DataFrame) -> Graph:
    """Collections, documents, chapters and media of styled documents.

    ``originals`` is (graph_id, doc_id, topic, file_name).
    """
    listed = documents.document_collections(originals, graph.roots)
    inside = documents.document_entities(originals, blocks)
    return graph.plus(listed["nodes"], listed["props"]).plus(inside["nodes"], inside["props"])


def edit_graph(graph: Graph, edits: DataFrame) -> Graph:
    return graph.with_(**ed.apply_edits(graph.nodes, graph.props, graph.roots, edits))


def check_graph(graph: Graph, rules: DataFrame) -> DataFrame:
    """Errors and warnings per graph; ``quality.quality_report`` has the findings."""
    report = quality.quality_report(graph.nodes, graph.props, rules)
    return quality.quality_summary(report, graph.roots)
