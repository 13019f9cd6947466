"""What the plans of whole jobs must not contain."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cairn.model import Graph, builtin_prefixes
from cairn.operators import overlay, quality
from cairn.plans import jobs
from cairn.sinks.jsonld import graph_to_json
from checks import registry

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "MapInPandas", "SinglePartition"]


@pytest.fixture
def graph(spark):
    """A graph whose every column varies, so that nothing folds to a constant."""
    ids = spark.range(400)
    graph_id, id = F.concat(F.lit("g"), F.col("id") % 3).alias("graph_id"), F.concat(F.lit("#e"), "id").alias("id")
    nodes = ids.select(graph_id, id, F.concat(F.lit("T"), F.col("id") % 4).alias("type"), F.lit(0).alias("pos"))
    props = ids.select(
        graph_id,
        id,
        F.concat(F.lit("p"), F.col("id") % 5).alias("prop"),
        F.col("id").alias("pos"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("v"), "id")).alias("value"),
        F.when(F.col("id") % 2 == 1, F.concat(F.lit("#e"), (F.col("id") * 7) % 500)).alias("ref"),
    )
    roots = ids.select(graph_id, F.concat(F.lit("#e"), F.col("id") % 3).alias("root_id")).distinct()
    return Graph(nodes, props, roots, builtin_prefixes(roots))


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("job", ["overlay", "edit", "check", "json"])
def test_jobs_use_equi_joins_only(spark, graph, job):
    ids = spark.range(300)
    if job == "overlay":
        source = graph.with_(props=graph.props.withColumn("value", F.concat("value", F.lit("!"))))
        made = [jobs.overlay_graph(graph, source).props, overlay.merge_counts(graph.nodes, graph.props, graph.roots)]
    elif job == "edit":
        log = ids.select(
            F.concat(F.lit("g"), F.col("id") % 3).alias("graph_id"),
            F.col("id").alias("seq"),
            F.element_at(F.array(*[F.lit(o) for o in ("set", "rename", "retype", "add", "delete_entity")]), (F.col("id") % 5 + 1).cast("int")).alias("op"),
            F.concat(F.lit("#e"), "id").alias("id"),
            F.concat(F.lit("p"), F.col("id") % 5).alias("prop"),
            F.concat(F.lit("#n"), "id").alias("value"),
            F.lit(None).cast("string").alias("ref"),
        )
        edited = jobs.edit_graph(graph, log)
        made = [edited.nodes, edited.props]
    elif job == "check":
        rules = spark.createDataFrame([("T1", "p1", "Text", 1, 0, 1), ("T2", "p2", "T3", 0, 0, 0)], "class string, prop string, range_type string, required int, multiple int, min_instances int")
        made = [quality.quality_report(graph.nodes, graph.props, rules)]
    else:
        made = [graph_to_json(graph.nodes, graph.props)]
    for frame in made:
        # a scalar subquery holds what the hand-written rule table says of minima
        text = plan(frame).split("Subquery subquery")[0]
        assert not [word for word in FORBIDDEN if word in text]


def test_every_query_has_its_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES) <= set(entry.queries())


def test_json_gathers_no_lists(graph):
    text = plan(graph_to_json(graph.nodes, graph.props))
    assert "collect_list" not in text and "Window" not in text
