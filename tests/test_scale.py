import random

import pytest
from pyspark.sql import functions as F

from cairn.operators import files as fs
from cairn.plans import scale
from cairn.plans.scale import number_rows, scan


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_numbers_agree_with_a_plain_sort(spark, rows, partitions):
    """One group holds two thirds of the rows; the partition count must not matter."""
    rng = random.Random(4)
    data = [("hot" if rng.random() < 0.67 else f"g{rng.randrange(9)}", f"{rng.random():.9f}") for _ in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        frame = spark.createDataFrame(data, "g string, k string").repartition(5)
        found = rows(number_rows(frame, ["g"], ["k"], "no"), "g", "k", "no")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    expected = []
    for group in {g for g, _ in data}:
        expected += [(group, k, i) for i, k in enumerate(sorted(k for g, k in data if g == group))]
    assert sorted(found) == sorted(expected)


@pytest.mark.parametrize("segment", [1, 3, 1000])
def test_scan_agrees_with_a_walk(spark, rows, segment):
    """Values cross segment borders, whatever the segments' size and gaps in positions."""
    rng = random.Random(segment)
    data = []
    for group in ("a", "b"):
        places = sorted(rng.sample(range(200), 60))
        data += [(group, p, rng.choice([None, None, "x", "y", "z"]), rng.randrange(3)) for p in places]
    frame = spark.createDataFrame(data, "g string, p bigint, v string, n int").repartition(3)
    scanned = scan(
        frame,
        ["g"],
        "p",
        F.floor(F.col("p") / segment).cast("bigint"),
        last={"seen": F.col("v")},
        total={"sum": F.col("n")},
        lead={"after": F.col("v")},
        lag={"above": F.col("v")},
    )
    found = {(r["g"], r["p"]): (r["seen"], r["sum"], r["after"], r["above"]) for r in scanned.collect()}
    for group in ("a", "b"):
        walk = [d for d in data if d[0] == group]
        seen, total = None, 0
        for i, (_, p, v, n) in enumerate(walk):
            seen, total = v or seen, total + n
            after = walk[i + 1][2] if i + 1 < len(walk) else None
            above = walk[i - 1][2] if i else None
            assert found[(group, p)] == (seen, total, after, above)


def test_blank_keys_are_spread(spark):
    frame = spark.range(5000).select(F.col("id"), F.lit(None).cast("string").alias("k"))
    keys = frame.select(scale.scattered(F.col("k"), F.col("k").isNotNull(), "id").alias("key"))
    assert keys.distinct().count() > 1000
    assert keys.filter("NOT startswith(key, '\0')").count() == 0


def test_staged_tables_go_where_the_session_says(spark):
    kept = scale.staged(spark.range(10).withColumn("at", F.monotonically_increasing_id()))
    assert kept.count() == 10 and kept.columns == ["id", "at"]
    folder = scale.staging_folder(spark)
    assert folder == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert all(path.startswith(f"{folder}/cairn-") for path in kept.inputFiles())


@pytest.fixture
def small_partitions(spark):
    """Limits low enough for a few thousand rows to count as skewed."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def test_a_hot_reference_is_split(spark, small_partitions):
    """A third of all references name one folder; its join runs in several tasks."""
    refs = spark.range(0, 60000, 1, 8).select(
        F.lit("g").alias("graph_id"),
        F.concat(F.lit("f"), "id").alias("id"),
        F.lit("isPartOf").alias("prop"),
        F.lit(0).cast("bigint").alias("pos"),
        F.lit(None).cast("string").alias("value"),
        F.when(F.col("id") % 3 == 0, "#hot").otherwise(F.concat(F.lit("#t"), F.col("id") % 500)).alias("ref"),
    )
    nodes = refs.select("graph_id", F.col("ref").alias("id")).distinct().withColumns(
        {"type": F.lit("RepositoryObject"), "pos": F.lit(0)}
    )
    roots = spark.createDataFrame([("g", "arcp://name,x")], "graph_id string, root_id string")
    moved = fs.rewrite_hash_ids(nodes, refs, roots)["props"]
    assert "skew=true" in final_plan(moved)
    assert moved.filter("ref = 'arcp://name,x/hot'").count() == 20000
    assert moved.filter("startswith(ref, '#')").count() == 0


def test_a_hot_name_is_split_and_stays_linear(spark, small_partitions):
    """A third of all files share a name: links stay linear and none is lost."""
    count = 30000
    files = spark.range(0, count, 1, 8).select(
        F.lit("g").alias("graph_id"),
        F.concat(F.lit("f"), "id").alias("id"),
        F.col("id").alias("file_no"),
        F.when(F.col("id") % 3 == 0, "same.txt").otherwise(F.concat(F.lit("n"), F.floor(F.col("id") / 6), F.lit(".txt"))).alias("file_name"),
    )
    groups = fs.duplicate_groups(files)
    assert "skew=true" in final_plan(groups)
    links = fs.possible_duplicates(groups).cache()
    hub = "#duplicates-same"
    assert links.filter(F.col("ref") == hub).count() == count // 3
    assert links.filter(F.col("id") == hub).count() == count // 3
    assert links.count() == 2 * count
