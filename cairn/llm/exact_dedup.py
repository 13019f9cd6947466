"""Exact deduplication of texts with a split for heavy hitters.

Misra-Gries summaries name the digests that may be frequent. Their winners are
found by an exact pass, and there are at most ``HEAVY`` of them, so they are
broadcast and settle their groups where the rows lie. Every other digest holds
a bounded share of the rows and goes through an ordinary shuffle.

Rows with null text count as empty. Of equal texts the longest original stays,
then the smallest id; a null id comes last; of fully repeated rows one stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.rows import row_hash
from cairn.plans.scale import staged

HEAVY = 1024  # counters of a summary, and most digests that are broadcast
BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, "")


def facts(id: str, text: str) -> list[Column]:
    """doc_id, digest and n_chars: SHA-256 of the text without white space."""
    return [
        F.col(id).alias("doc_id"),
        F.unhex(F.sha2(normalised(F.col(text)), 256)).alias("digest"),
        F.char_length(F.coalesce(text, F.lit(""))).cast("bigint").alias("n_chars"),
    ]


def rank(tie: str) -> Column:
    """The smallest of a group stays."""
    return F.struct(
        (-F.col("n_chars")).alias("shortness"), F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(tie).alias("tie")
    ).alias("rank")


def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Misra-Gries: counters that fall short by at most rows / (HEAVY + 1)."""
    counters = pd.Series(dtype="int64")
    for batch in batches:
        counters = counters.add(batch["digest"].value_counts(), fill_value=0)
        if len(counters) > HEAVY:
            counters = counters - counters.nlargest(HEAVY + 1).iloc[-1]
            counters = counters[counters > 0]
    yield pd.DataFrame({"digest": list(counters.index), "n": counters.astype("int64").to_numpy()})


def heavy_winners(rows: DataFrame) -> DataFrame:
    """(digest, winner, group_size) of every frequent digest, HEAVY rows at most.

    Whatever makes up over 2 / (HEAVY + 1) of all rows is among them: a merged
    counter and the counter that bounds the merge each fall short by one part.
    """
    candidates = (
        rows.select("digest")
        .mapInPandas(summarise, "digest binary, n bigint")
        .groupBy("digest")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "digest")
        .limit(HEAVY)
        .select("digest")
    )
    return (
        rows.join(F.broadcast(candidates), "digest")
        .groupBy("digest")
        .agg(F.min("rank").alias("winner"), F.count("*").alias("group_size"))
    )


def exact_groups(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row with its group: doc_id, keep_id, group_size, kept, text_sha256.

    ``kept`` is true in exactly one row of a group, also where ids repeat.
    """
    rows = staged(docs.select(*facts(id, text), F.monotonically_increasing_id().alias("row")))
    rows = rows.select("doc_id", "digest", rank("row"))
    split = rows.join(F.broadcast(heavy_winners(rows)), "digest", "left")
    heavy = split.filter(F.col("winner").isNotNull())
    group = Window.partitionBy("digest")
    rest = split.filter(F.col("winner").isNull()).withColumns(
        {"winner": F.min("rank").over(group), "group_size": F.count("*").over(group)}
    )
    return heavy.unionByName(rest).select(
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rank.tie") == F.col("winner.tie")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.

    Of a frequent digest only what equals its winner gets past the map side;
    the rest is shuffled once by digest. Rows with one id and text are told
    apart by the hash of their columns; if that is equal too, any one stays.
    """
    small = staged(docs.select(*facts(id, text), F.lit(0).alias("none")))
    winners = heavy_winners(small.select("digest", rank("none")))
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row_hash(docs).alias("tie"), *facts(id, text)
    ).select("doc", "digest", rank("tie"))
    split = whole.join(F.broadcast(winners), "digest", "left")
    ahead = F.col("rank").dropFields("tie").eqNullSafe(F.col("winner").dropFields("tie"))
    heavy = split.filter(F.col("winner").isNotNull() & ahead)
    first = Window.partitionBy("digest").orderBy("rank")
    rest = split.filter(F.col("winner").isNull()).withColumn("at", F.row_number().over(first)).filter("at = 1")
    kept = heavy.groupBy("digest").agg(F.min_by("doc", "rank").alias("doc")).select("doc.*")
    return kept.unionByName(rest.select("doc.*"))
