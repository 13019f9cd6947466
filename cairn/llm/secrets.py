"""Secret scans with corpus-wide ownership of what they find.

Candidates are found per text; the hashes of their values are then counted
over the corpus by distinct repositories and owners. A value that many owners
hold is a copied example; one that a single owner holds, and that looks drawn
at random, is reported as ``live``.

Spans are code points, end exclusive. Offsets come from the text between the
matches: ``split`` gives the gaps and ``regexp_extract_all`` the matches, so
nothing leaves the built-in functions. A null text counts as empty, a null
owner or repository as one of its own. Rows that repeat are kept apart by a row
number that is fixed when candidates are staged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.plans.scale import staged

ASSIGN = (
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]"""
    r"""|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
KINDS = ("assign", "access", "hex", "live")  # the order of spans with one start
#: kind, pattern, group that holds the value, least length of the value
BASE = (
    ("assign", ASSIGN, 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),  # a shorter run has no longer run inside
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: further shapes of tokens: only ``live`` spans come of them
SHAPES = (
    ("shaped", r"(gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|sk-|AIza|npm_|hf_)[A-Za-z0-9_-]{20,}", 0, 20),
    ("shaped", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
)
OWNERS = 1  # most owners of a live value
REPOSITORIES = 2  # most repositories of a live value
DISTINCT = 8  # least different characters of a live value


def hits(text: Column) -> Column:
    """Array of (kind, at, gap, match) of all matches of all patterns.

    ``at`` counts the matches of one pattern, ``gap`` the code points between a
    match and the one before it.
    """

    def paired(number: int, kind: str, pattern: str) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), lambda gap: F.char_length(gap))
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        both = F.zip_with(
            found,
            gaps,
            lambda match, gap: F.struct(
                F.lit(number).alias("pattern"), F.lit(kind).alias("kind"), gap.alias("gap"), match.alias("match")
            ),
        )
        return F.filter(both, lambda hit: hit["match"].isNotNull())

    shapes = [(number, kind, pattern) for number, (kind, pattern, _, _) in enumerate(BASE + SHAPES)]
    lists = [F.when(F.regexp_like(text, F.lit(shape[-1])), paired(*shape)) for shape in shapes]
    return F.flatten(F.array_compact(F.array(*lists)))


def candidates(scanned: DataFrame) -> DataFrame:
    """One row per match that is long enough: row, kind, begin, end, value_begin, value."""
    rows = scanned.select("row", "owner", "repository", F.posexplode("hits").alias("at", "hit")).select(
        "row", "owner", "repository", "at", "hit.*"
    )
    line = Window.partitionBy("row", "pattern").orderBy("at")
    length = F.char_length("match")
    value = F.col("match")
    enough = F.lit(False)
    for number, (_, pattern, group, least) in enumerate(BASE + SHAPES):
        here = F.col("pattern") == number
        if group:
            value = F.when(here, F.regexp_extract("match", pattern, group)).otherwise(value)
        enough |= here & (F.char_length("value") >= least)
    end = F.sum(F.col("gap") + length).over(line).cast("bigint")
    return (
        rows.withColumns({"end": end, "value": value})
        .withColumns({"begin": F.col("end") - length, "value_begin": F.col("end") - F.char_length("value")})
        .filter(enough)
        .select("row", "owner", "repository", "kind", "begin", "end", "value_begin", "value")
    )


def ownership(found: DataFrame) -> DataFrame:
    """(hash) with the distinct owners and repositories that hold the value.

    Holders are made distinct before they are counted, so a value that a third
    of all texts quote arrives once per task and repository.
    """
    holders = found.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    return holders.groupBy("hash").agg(
        F.count_distinct(F.struct("owner")).alias("owners"),
        F.count("*").alias("repositories"),
        F.sum("n").alias("places"),
    )


def looks_drawn(kind: Column, value: Column) -> Column:
    """Letters and digits, many of them different; bare hex only where it has the length of a key."""
    mixed = value.rlike("[A-Za-z]") & value.rlike("[0-9]")
    varied = F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT
    return mixed & varied & ((kind != "hex") | (F.char_length(value) >= 32))


def scan_secrets(
    docs: DataFrame, id: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "lang"
) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): row and doc_id of every text, and the spans found.

    Spans have row, kind, begin, end, value, owners, repositories, places and
    ``status``: ``live``, ``copied`` (several owners) or ``plain``. A live
    value stands a second time with kind ``live`` and its own place. A
    repository is known by its owner and its name.
    """
    scanned = staged(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id).alias("doc_id"),
            F.col(owner).alias("owner"),
            F.col(repository).alias("repository"),
            F.coalesce(text, F.lit("")).alias("text"),
        ).select("row", "doc_id", "owner", "repository", hits(F.col("text")).alias("hits"))
    )
    found = staged(candidates(scanned).withColumn("hash", F.unhex(F.sha2("value", 256))))
    held = staged(ownership(found))
    status = (
        F.when((F.col("owners") <= OWNERS) & (F.col("repositories") <= REPOSITORIES) & looks_drawn(F.col("kind"), F.col("value")), "live")
        .when(F.col("owners") > OWNERS, "copied")
        .otherwise("plain")
    )
    known = found.join(held, "hash").withColumn("status", status)
    columns = ["row", "kind", "begin", "end", "value", "owners", "repositories", "places", "status"]
    base = known.filter(F.col("kind").isin([k for k, *_ in BASE])).select(*columns)
    live = known.filter("status = 'live'").withColumns({"kind": F.lit("live"), "begin": F.col("value_begin")})
    return scanned.select("row", "doc_id"), base.unionByName(live.select(*columns).dropDuplicates(["row", "begin", "end"]))


def digest(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """One line per text: counts per kind, the hash of its base spans, all spans."""

    def joined(list_: Column) -> Column:
        return F.concat_ws(",", F.transform(list_, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])))

    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    per_row = spans.groupBy("row").agg(
        *[F.count_if(F.col("kind") == kind).alias(f"n_{kind}") for kind in KINDS],
        F.count_if(F.col("status") == "copied").alias("n_copied"),
        F.array_sort(F.collect_list(F.struct("begin", order.alias("order"), "end", "kind"))).alias("all"),
    )
    base = F.filter("all", lambda s: s["kind"] != "live")
    nothing = F.array().cast("array<struct<begin:bigint,order:bigint,end:bigint,kind:string>>")
    joined_rows = rows.join(per_row, "row", "left").withColumn("all", F.coalesce("all", nothing))
    return joined_rows.select(
        "doc_id",
        *[F.coalesce(F.col(f"n_{kind}"), F.lit(0)).cast("bigint").alias(f"n_{kind}") for kind in (*KINDS, "copied")],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("all")).alias("spans"),
    )
