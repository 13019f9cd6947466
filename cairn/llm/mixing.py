"""Mixing sources to target weights by systematic sampling.

Each document of a source is expected ``target / source size`` times. The
prefix sum of these expectations along the source, shifted by one random
offset per source, crosses an integer once per copy that is emitted.

Documents lie along their source by size class, then by a hash, so that each
stretch of the line holds documents of like size and the words taken come near
the target. The place of a document is the number of documents in earlier
classes and buckets, plus its rank in its own: all functions of the row, so a
lost executor changes nothing and no task holds a source.

Null texts have size 0. The null source is a source of its own, ordered last.
A null id takes part like any other. Rows that repeat are separate documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.rows import row_hash
from cairn.plans.scale import staged

WEIGHTS = (5, 2, 1)  # by the order of sources, again and again
SHARE = 1.5  # of all words
MOST = 2  # times a source and a document may be taken
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def size_class(size: Column) -> Column:
    """The size's length in bits and the four bits after the first: 16 classes per doubling."""
    bits = F.length(F.bin(size))
    next_bits = F.expr("shiftright(_size, length(bin(_size)) - 5) % 16")
    return (bits * 16 + F.when(bits > 4, next_bits).otherwise(size)).cast("int")


def targets(
    sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: float = MOST
) -> DataFrame:
    """(_source, source_size) with ``target``: weights fill up to ``most`` times the size.

    Sources fill in the order of cap / weight. The level at which the water
    stands is the first one that the source at hand can take whole, and of
    those that later ones could take it is the highest; what lies below it is
    full. One row per source, sorted as a whole.
    """
    n = F.row_number().over(Window.orderBy(F.col("_source").isNull(), "_source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (n % len(weights) + 1).cast("int"))
    cap = F.lit(float(most)) * F.col("source_size")
    line = Window.orderBy(F.col("_cap") / F.col("_weight"), F.col("_source").isNull(), "_source")
    whole = Window.partitionBy()
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    after = line.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    filled = (
        sources.withColumns({"_weight": weight, "_cap": cap})
        .withColumn("_level", left / F.sum("_weight").over(after))
        .withColumn("_holds", F.col("_cap") >= F.col("_level") * F.col("_weight"))
        .withColumn("_level", F.max(F.when(F.col("_holds"), F.col("_level"))).over(whole))
    )
    return filled.withColumn("target", F.least("_cap", F.col("_weight") * F.col("_level"))).drop(
        "_weight", "_cap", "_holds", "_level"
    )


def copies(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    payload: Sequence[str] = (),
    seed: int = 0,
    **mix,
) -> DataFrame:
    """doc_id, size, source_size, target and ``copies``: how often the mix takes the document.

    ``payload`` names columns that come along, in a struct ``doc``.
    """
    # rows without an id are told apart by their text, so that they spread as well
    unnamed = F.concat(F.lit("text:"), F.xxhash64(F.coalesce(text, F.lit(""))).cast("string"))
    salt = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), unnamed)))
    facts = [
        F.col(id).alias("doc_id"),
        F.col(source).alias("_source"),
        n_words(F.col(text)).alias("_size"),
        salt.alias("_salt"),
    ]
    whole = [F.struct(*[F.col(f"`{c}`") for c in payload]).alias("doc")] if payload else []

    def placed(rows: DataFrame) -> DataFrame:
        bucket = F.conv(F.substring("_salt", 1, 2), 16, 10).cast("int")  # 256 of them
        return rows.withColumns({"_class": size_class(F.col("_size")), "_bucket": bucket})

    # one text for source, class and bucket, so that nulls meet by equality
    own = F.concat(F.when(F.col("_source").isNull(), "n").otherwise("s"), F.coalesce("_source", F.lit("")))
    place = F.concat_ws(":", "_class", "_bucket", own)

    small = staged(placed(docs.select(*facts)))
    rows = placed(docs.select(*facts, *whole)) if payload else small

    buckets = small.groupBy("_source", "_class", "_bucket").agg(F.count("*").alias("_n"), F.sum("_size").alias("_words"))
    buckets = staged(buckets)
    earlier = (Window.unboundedPreceding, -1)
    in_class = Window.partitionBy("_source", "_class").orderBy("_bucket").rowsBetween(*earlier)
    in_source = Window.partitionBy("_source").orderBy("_class").rowsBetween(*earlier)
    classes = buckets.groupBy("_source", "_class").agg(F.sum("_n").alias("_n"))
    classes = classes.withColumn("_class_start", F.coalesce(F.sum("_n").over(in_source), F.lit(0))).drop("_n")
    mixed = targets(buckets.groupBy("_source").agg(F.sum("_words").alias("source_size")), **mix)
    name = F.concat(F.coalesce("_source", F.lit("")), F.when(F.col("_source").isNull(), ":null").otherwise(""))
    mixed = mixed.withColumns(
        {
            "_start": F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 12), 16, 10).cast("bigint").cast("double")
            / F.lit(float(1 << 48)),
            "_rate": F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0),
        }
    )

    def same(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
        b = b.withColumnsRenamed({k: f"{k}_b" for k in keys})
        met = a.join(b, [F.col(k).eqNullSafe(F.col(f"{k}_b")) for k in keys])
        return met.drop(*[f"{k}_b" for k in keys])

    starts = buckets.withColumn("_bucket_start", F.coalesce(F.sum("_n").over(in_class), F.lit(0))).drop("_n", "_words")
    starts = same(same(starts, classes, "_source", "_class"), mixed, "_source").withColumn("_place", place)
    starts = staged(starts.drop("_source", "_class", "_bucket"))
    # the rank and the join use one shuffle; starts grow with the sources, so they are not broadcast
    here = Window.partitionBy("_place").orderBy("_size", "_salt", "doc_id", *(["_tie"] if payload else []))
    if payload:
        rows = rows.withColumn("_tie", row_hash(rows, "doc"))
    rows = rows.withColumn("_place", place).withColumn("_rank", F.row_number().over(here))
    rows = rows.join(starts.hint("merge"), "_place")
    k = (F.col("_class_start") + F.col("_bucket_start") + F.col("_rank")).cast("double")

    def crossed(at: Column) -> Column:
        return F.floor(F.col("_rate") * at + F.col("_start"))

    most = mix.get("most", MOST)
    taken = F.least(crossed(k) - crossed(k - F.lit(1.0)), F.lit(most)).cast("bigint")
    return rows.select(
        "doc_id",
        F.col("_size").alias("size"),
        "source_size",
        "target",
        taken.alias("copies"),
        *(["doc"] if payload else []),
    )


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its columns."""
    taken = copies(docs, id, text, source, payload=docs.columns, **options)
    emitted = F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))
    return taken.filter("copies > 0").withColumn("_copy", emitted).select("doc.*")
