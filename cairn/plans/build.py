"""One build from start to end, and edits of what a build has stored.

The stages run in a fixed order, each if its input is given: structure from
files, an existing graph laid over it, terms, transcripts and documents, the
metadata sheet, checks, then the outputs: the graph, transcript tables, CHAT
text and sheets. Checks report and never hold up an output.

The finished graph is computed once and staged. What is counted of it is
observed while its tables are written, without a job of its own.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cairn.model import Graph, entity_ids
from cairn.operators import quality, stats, transcripts
from cairn.plans import jobs
from cairn.plans.scale import staged
from cairn.sinks.sheets import write_sheets
from cairn.sinks.store import load_graphs, save_graphs
from cairn.sinks.text import write_chat, write_transcript_csv


@dataclass
class Inputs:
    """What a build may be given; a stage without its input is left out."""

    files: DataFrame  # graph_id, file_name, relative_path
    roots: DataFrame
    profile: Mapping
    structure: Mapping = field(default_factory=dict)  # further arguments of build_graph
    crate: Graph | None = None
    catalog: DataFrame | None = None
    texts: DataFrame | None = None  # graph_id, doc_id, text: transcripts
    originals: DataFrame | None = None  # graph_id, doc_id, topic, file_name: documents
    blocks: DataFrame | None = None
    sheet: DataFrame | None = None
    mapping: Sequence[dict] = ()
    gazetteer: DataFrame | None = None
    rules: DataFrame | None = None


@dataclass
class Built:
    graph: Graph
    counts: dict[str, int]  # files, types, values, references: rows over all graphs
    per_graph: DataFrame  # graph_id, files, entities
    types: DataFrame  # graph_id, type, count
    report: DataFrame | None = None
    summary: DataFrame | None = None


def observed(table: DataFrame, **counts) -> tuple[DataFrame, Observation]:
    """The table, staged, and its counts, which are taken while it is written."""
    seen = Observation()
    return staged(table.observe(seen, *[c.alias(n) for n, c in counts.items()])), seen


def fixed(graph: Graph) -> Graph:
    """Staged, so that the next stage plans and reads tables instead of all that came before."""
    return graph.with_(nodes=staged(graph.nodes), props=staged(graph.props), prefixes=staged(graph.prefixes))


def assemble(given: Inputs) -> Graph:
    """The graph of all stages, in their order."""
    graph = jobs.build_graph(given.files, given.roots, given.profile, **given.structure)
    if given.crate is not None:
        graph = jobs.overlay_graph(fixed(graph), given.crate)
    if given.catalog is not None:
        names = given.files.select("graph_id", F.col("relative_path").alias("file_id"), F.col("file_name").alias("text"))
        graph = jobs.add_terms(fixed(graph), names, given.catalog)
    if given.texts is not None:
        graph = jobs.add_transcripts(fixed(graph), given.texts)
    if given.originals is not None:
        graph = jobs.add_documents(graph, given.originals, given.blocks)
    if given.sheet is not None:
        graph = jobs.merge_metadata(fixed(graph), given.sheet, given.mapping, gazetteer=given.gazetteer)
    return graph


def build(given: Inputs, path: str, sheets: Mapping[str, Sequence[str]] | None = None, language: str = "und", corpus: str = "corpus") -> Built:
    """Run all stages and write below ``path``: graph, report, transcripts, chat, sheets."""
    graph = assemble(given)
    files, of_files = observed(given.files, files=F.count(F.lit(1)))
    nodes, of_nodes = observed(graph.nodes, types=F.count(F.lit(1)))
    props, of_props = observed(graph.props, values=F.count("value"), references=F.count("ref"))
    graph = graph.with_(nodes=nodes, props=props)
    built = Built(graph, of_files.get | of_nodes.get | of_props.get, stats.build_stats(files, nodes), stats.type_counts(nodes))
    if given.rules is not None:
        built.report = staged(quality.quality_report(nodes, props, given.rules))
        built.summary = quality.quality_summary(built.report, graph.roots)
        built.report.write.mode("overwrite").partitionBy("graph_id").csv(f"{path}/report", header=True, escape='"')
    save_graphs(graph, f"{path}/graph")
    if given.texts is not None:
        made = transcripts.transcript_rows(given.texts)
        rows = staged(made["rows"])
        write_transcript_csv(rows, f"{path}/transcripts")
        write_chat(rows, made["speakers"], language, corpus, f"{path}/chat")
    if sheets:
        write_sheets(nodes, props, sheets, f"{path}/sheets")
    return built


def edit_stored(spark: SparkSession, path: str, edits: DataFrame) -> int:
    """Apply a change log to stored graphs: only the graphs that it names are read and written; the new version."""
    touched = staged(edits.select("graph_id").distinct())
    graph = load_graphs(spark, path, only=touched)
    known = touched.join(entity_ids(graph.nodes).select("graph_id").distinct(), "graph_id", "left_semi")
    edited = jobs.edit_graph(graph, edits)
    return save_graphs(edited.with_(nodes=staged(edited.nodes), props=staged(edited.props)), path, only=staged(known))
