"""Ordered work over groups of any size.

A plain window puts a whole group into one task. Groups here (a folder, a
collection, a transcript) may hold a large share of all rows, so ordered work
is cut into bounded pieces and the few facts that cross a border are carried
over separately.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEGMENT_ROWS = 1 << 16  # positions per segment of an ordered group


def staging_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, which ``spark.checkpoint.dir`` names.

    Where that is unset, a folder in the warehouse serves on a single machine.
    On a cluster the warehouse may be local to each machine, so it is refused.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/staging"
    return folder.rstrip("/")


def scratch_folder(spark: SparkSession) -> str:
    """A new folder in the shared one, not made yet; it goes when the application ends."""
    folder = f"{staging_folder(spark)}/cairn-{uuid.uuid4().hex}"
    _goes_at_exit(spark, folder)
    return folder


def staged(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read back.

    Cuts lineage like a checkpoint, but as Parquet: readers prune columns and
    know the size. What is not a function of the row (row ids, sampled range
    borders) is fixed here, so a lost executor cannot change it. The folder
    goes when the application ends.
    """
    spark = df.sparkSession
    folder = scratch_folder(spark)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def staged_by(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """Like ``staged``, but bucketed: joins and groups on ``keys`` need no shuffle of this table.

    The table stands in the catalogue only while it is read back; the plan of
    the result keeps its buckets.
    """
    spark = df.sparkSession
    name = f"cairn_{uuid.uuid4().hex}"
    folder = f"{staging_folder(spark)}/{name}"
    df.write.format("parquet").bucketBy(buckets, *keys).option("path", folder).saveAsTable(name)
    _goes_at_exit(spark, folder)
    table = spark.table(name)
    table.schema  # resolved before the name goes; the files of a table with a path stay
    spark.sql(f"DROP TABLE {name}")
    return table


def _goes_at_exit(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def number_rows(
    df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "row_no"
) -> DataFrame:
    """Number rows 0, 1, 2 … within each group, without a task per group.

    Rows are range-partitioned over (group, order), which also cuts a group
    that holds most of the data. The numbered rows are staged, so a lost
    executor cannot move a row over the sampled borders. A piece's first number
    is the size of the group's earlier pieces: at most one row per partition
    and group.
    """
    keys = [*group, *order]
    placed = staged(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_piece", F.shiftright("_at", 33))
    )
    earlier = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (
        placed.groupBy(*group, "_piece")
        .agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))
        .withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
        .drop("_size")
    )
    return (
        placed.join(pieces, [*group, "_piece"])
        .withColumn(name, F.col("_at") - F.col("_first") + F.col("_before"))
        .drop("_at", "_piece", "_first", "_before")
    )


def scattered(key: Column, wanted: Column, *row: str) -> Column:
    """``key`` where wanted, else one of many keys that match nothing.

    Rows that have nothing to look up would else meet in one task of a join.
    """
    blank = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*row), F.lit(4096)))
    return F.when(wanted, key).otherwise(blank)


def lacking(df: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose keys ``known`` has not.

    An outer join with a mark. The optimiser moves an anti join below unions, so
    a table made of many parts would meet ``known`` once per part, and one task
    would sort ``known`` as many times.
    """
    mark = known.select(*keys).distinct().withColumn("_known", F.lit(True))
    return df.join(mark, list(keys), "left").filter("_known IS NULL").select(*df.columns)


def segment_of(pos: Column) -> Column:
    return F.floor(pos / SEGMENT_ROWS).cast("bigint")


def scan(
    df: DataFrame,
    group: Sequence[str],
    pos: str,
    segment: Column | None = None,
    *,
    last: Mapping[str, Column] | None = None,
    total: Mapping[str, Column] | None = None,
    lead: Mapping[str, Column] | None = None,
    lag: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Carry values along ordered groups of any length.

    ``last``   newest non-null value at or before the row
    ``total``  running sum up to and including the row
    ``lead`` / ``lag``  value on the next / previous row

    Windows run per (group, segment); ``segment`` must grow with ``pos`` and
    defaults to runs of ``SEGMENT_ROWS`` positions. One summary row per
    segment, pre-aggregated before its shuffle, carries values over borders.
    The segment stays in the result as ``_seg``.
    """
    last, total, lead, lag = (dict(x or {}) for x in (last, total, lead, lag))
    rows = df.withColumn("_seg", segment_of(F.col(pos)) if segment is None else segment)
    inputs = {f"_in_{k}": v for d in (last, total, lead, lag) for k, v in d.items()}
    rows = rows.withColumns(inputs)

    at = F.col(pos)
    summaries = (
        [
            F.max_by(f"_in_{k}", F.when(F.col(f"_in_{k}").isNotNull(), at)).alias(f"_edge_{k}")
            for k in last
        ]
        + [F.sum(f"_in_{k}").alias(f"_edge_{k}") for k in total]
        + [F.min_by(F.struct(f"_in_{k}"), at).alias(f"_edge_{k}") for k in lead]
        + [F.max_by(F.struct(f"_in_{k}"), at).alias(f"_edge_{k}") for k in lag]
    )
    across = Window.partitionBy(*group).orderBy("_seg")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy(*group, "_seg")
        .agg(*summaries)
        .select(
            *group,
            "_seg",
            *[F.last(f"_edge_{k}", ignorenulls=True).over(before).alias(f"_from_{k}") for k in last],
            *[F.sum(f"_edge_{k}").over(before).alias(f"_from_{k}") for k in total],
            *[F.lead(f"_edge_{k}").over(across)[f"_in_{k}"].alias(f"_from_{k}") for k in lead],
            *[F.lag(f"_edge_{k}").over(across)[f"_in_{k}"].alias(f"_from_{k}") for k in lag],
        )
    )

    here = Window.partitionBy(*group, "_seg").orderBy(pos)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns(
        {f"_here_{k}": F.last(f"_in_{k}", ignorenulls=True).over(upto) for k in last}
        | {f"_here_{k}": F.sum(f"_in_{k}").over(upto) for k in total}
        | {f"_here_{k}": F.lead(F.struct(f"_in_{k}")).over(here) for k in lead}
        | {f"_here_{k}": F.lag(F.struct(f"_in_{k}")).over(here) for k in lag}
    )

    def neighbour(k):
        inside = F.col(f"_here_{k}")
        return F.when(inside.isNotNull(), inside[f"_in_{k}"]).otherwise(F.col(f"_from_{k}"))

    joined = local.join(carried, [*group, "_seg"], "left")
    return joined.select(
        *df.columns,
        "_seg",
        *[F.coalesce(f"_here_{k}", f"_from_{k}").alias(k) for k in last],
        *[(F.col(f"_here_{k}") + F.coalesce(f"_from_{k}", F.lit(0))).alias(k) for k in total],
        *[neighbour(k).alias(k) for k in [*lead, *lag]],
    )
