"""The registered queries of this package over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import embeddings, exact_dedup, html_text, lexical, licenses, mixing, negatives, pieces, pii, repeats, secrets, simhash, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

BATCH_ROWS = 512  # texts per Arrow batch; a worker holds one batch
BATCH_BYTES = 1 << 24  # and bytes, where texts are long
PIECES = "/opt/tokenizers/piece_bpe_32k.model"  # the driver's copy is sent to the executors


def bounded(spark: SparkSession) -> None:
    """Let Arrow batches hold few texts, and fewer where they are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def query(name: str, tables: str, sql: str | None = None):
    """Register a function of whole tables."""

    def register(build):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            bounded(spark)
            return build(*[spark.read.parquet(f"{sf_dir}/{table}.parquet") for table in tables.split()])

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return build

    return register


@query(
    "op9_exact_dedup",
    "documents",
    r"""
    WITH d AS (
      SELECT doc_id, length(coalesce(text, '')) AS n,
             sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
      FROM documents),
    g AS (
      SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
             first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id
      FROM d)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
)
def op9_exact_dedup(documents):
    return exact_dedup.exact_groups(documents)


@query(
    "op10_mixing",
    "documents",
    r"""
    WITH d AS (
      SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
             md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
      FROM documents),
    c AS (
      SELECT *, length(bin(size)) * 16 + CASE WHEN length(bin(size)) > 4
               THEN (size >> (length(bin(size)) - 5)) % 16 ELSE size END AS class,
             CAST('0x' || substr(h, 1, 2) AS BIGINT) AS bucket
      FROM d),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM d GROUP BY source),
    w AS (
      SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3
               WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
      FROM s),
    o AS (
      SELECT *, row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source IS NULL, encode(source)) AS place,
             sum(source_size) OVER () * 1.5::DOUBLE AS budget
      FROM w),
    f AS (
      SELECT *, budget - coalesce(sum(2 * source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS rest,
             sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS weights
      FROM o),
    l AS (SELECT max(rest / weights) FILTER (WHERE 2 * source_size >= rest / weights * weight) AS level FROM f),
    t AS (
      SELECT source, source_size, n, least(2.0::DOUBLE * source_size, weight * level) AS target,
             CAST('0x' || substr(md5('0:' || coalesce(source, '') || CASE WHEN source IS NULL THEN ':null' ELSE '' END), 1, 12) AS BIGINT)::DOUBLE
               / 281474976710656.0::DOUBLE AS start
      FROM f, l),
    r AS (
      SELECT c.*, t.source_size, t.target, t.start, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
             (row_number() OVER (PARTITION BY c.source ORDER BY class, bucket, size, h, doc_id))::DOUBLE AS k
      FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
           CAST(least(floor(rate * k + start) - floor(rate * (k - 1) + start), 2) AS BIGINT) * size AS taken
    FROM r
    """,
)
def op10_mixing(documents):
    mixed = mixing.copies(documents)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op1_simhash", "documents")
def op1_simhash(documents):
    return simhash.near_groups(documents)


def _secret_sql() -> str:
    """Spans from the gaps between matches; values counted by owner over the corpus."""
    patterns = [(kind, pattern.replace("'", "''"), group, least) for kind, pattern, group, least in secrets.BASE + secrets.SHAPES]
    found = " UNION ALL ".join(
        f"""SELECT doc_id, source, lang, {n} AS pattern, '{kind}' AS kind, {group} AS grp, {least} AS least, text,
               regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS g,
               {f"regexp_extract_all(text, '{pattern}', {group})" if group else f"regexp_extract_all(text, '{pattern}')"} AS v
            FROM d WHERE regexp_matches(text, '{pattern}')"""
        for n, (kind, pattern, group, least) in enumerate(patterns)
    )
    return f"""
    WITH d AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents),
    f AS ({found}),
    e AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM f),
    p AS (
      SELECT doc_id, source, lang, kind, least, v[i] AS value,
             CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))) AS BIGINT) AS "end",
             length(m[i]) AS n
      FROM e),
    c AS (SELECT *, "end" - n AS begin, "end" - length(value) AS value_begin FROM p WHERE length(value) >= least),
    o AS (SELECT value, count(DISTINCT coalesce(source, chr(1))) AS owners,
                 count(DISTINCT coalesce(source, chr(1)) || chr(2) || coalesce(lang, chr(1))) AS repositories FROM c GROUP BY value),
    k AS (
      SELECT c.*, owners > {secrets.OWNERS} AS copied,
             owners <= {secrets.OWNERS} AND repositories <= {secrets.REPOSITORIES}
             AND regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]')
             AND len(list_distinct(string_split(value, ''))) >= {secrets.DISTINCT} AND (kind <> 'hex' OR length(value) >= 32) AS live
      FROM c JOIN o USING (value)),
    s AS (
      SELECT doc_id, kind, begin, "end", copied, CASE kind WHEN 'assign' THEN 1 WHEN 'access' THEN 2 ELSE 3 END AS o
      FROM k WHERE kind <> 'shaped'
      UNION ALL
      SELECT DISTINCT doc_id, 'live', value_begin, "end", false, 4 FROM k WHERE live),
    r AS (
      SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
             count(*) FILTER (WHERE kind = 'hex') AS n_hex, count(*) FILTER (WHERE kind = 'live') AS n_live,
             count(*) FILTER (WHERE copied) AS n_copied,
             string_agg(kind || ':' || begin || ':' || "end", ',' ORDER BY begin, o, "end") FILTER (WHERE o < 4) AS base,
             string_agg(kind || ':' || begin || ':' || "end", ',' ORDER BY begin, o, "end") AS spans
      FROM s GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied,
           sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN r USING (doc_id)
    """


@query("op6_secrets", "documents", _secret_sql())
def op6_secrets(documents):
    return secrets.digest(*secrets.scan_secrets(documents))


@query(
    "op8_embeddings",
    "embeddings",
    """
    WITH RECURSIVE v AS (
      SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
      WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    l AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
      ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
    r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    c AS (SELECT a, min(least(a, b)) AS low FROM r GROUP BY a),
    n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(low, vec_id) AS component_id, coalesce(low, vec_id) = vec_id AS kept
    FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
    """,
)
def op8_embeddings(vectors):
    return embeddings.near_vectors(vectors)


@query("op2_toxicity", "documents labels")
def op2_toxicity(documents, labels):
    return toxicity.severity(documents, toxicity.fit(documents, labels))


@query("op4_licenses", "documents")
def op4_licenses(documents):
    return licenses.scan_licenses(documents)


@query("op5_pii", "documents")
def op5_pii(documents):
    return pii.scan_personal_data(documents)


@query("op3_html_text", "pages")
def op3_html_text(pages):
    return html_text.extract(pages)


@query("op7_pieces", "documents")
def op7_pieces(documents):
    return pieces.encoded(documents, PIECES)


@query(
    "op11_hard_negatives",
    "embeddings",
    """
    WITH v AS (
      SELECT vec_id, min({'l': CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END::BIGINT,
                          'e': list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)))}) AS r
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      GROUP BY vec_id),
    s AS (
      SELECT a.vec_id AS a, b.vec_id AS b, a.r.l = b.r.l AS same, CAST(list_inner_product(a.r.e, b.r.e) AS BIGINT) AS s
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
    p AS (SELECT a, b, s, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS k FROM s WHERE same),
    n AS (
      SELECT p.a, p.b, p.s AS ps, s.b AS n, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS k
      FROM p JOIN s ON p.a = s.a AND p.k <= 5 AND NOT s.same AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s)
    SELECT a AS anchor_id, b AS positive_id, CAST(k AS INT) AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score
    FROM n WHERE k <= 3
    """,
)
def op11_hard_negatives(vectors):
    relabel = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors, F.col("vec_id") % 50 == 0, relabel=relabel)


@query(
    "op12_lexical_search",
    "documents benchmark",
    r"""
    WITH t AS (
      SELECT *, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM (SELECT doc_id, text, row_number() OVER () AS r FROM documents)),
    q AS (
      SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM benchmark),
    p AS (SELECT r, doc_id, term, count(*) AS tf FROM t GROUP BY r, doc_id, term),
    n AS (SELECT r, sum(tf)::BIGINT AS n FROM p GROUP BY r),
    s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM n),
    m AS (SELECT r, 10 + (90 * n * docs) // total AS m, docs FROM n, s),
    w AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    i AS (
      SELECT item_id, r, doc_id,
             CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * m)) AS impact
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (r)),
    c AS (SELECT item_id, doc_id, r, sum(impact)::BIGINT AS score FROM i WHERE doc_id IS NOT NULL GROUP BY item_id, doc_id, r HAVING sum(impact) > 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS k FROM c)
    SELECT item_id, CAST(k AS INT) AS rank, doc_id, score FROM k WHERE k <= 10
    """,
)
def op12_lexical_search(documents, benchmark):
    return lexical.search(documents, benchmark)


@query(
    "op13_substring_dedup",
    "documents",
    r"""
    WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id, text) AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    p AS (SELECT r, w, unnest(range(1, len(w) - 18)) AS i FROM d),
    g AS (SELECT r, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY r, i) AS k FROM p),
    x AS (SELECT DISTINCT r, unnest(range(i, i + 20)) AS i FROM g WHERE k > 1),
    c AS (SELECT r, list(i) AS gone FROM x GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
           sha256(array_to_string(CASE WHEN gone IS NULL THEN w
             ELSE list_transform(list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(gone, j)), lambda j: w[j]) END, ' ')) AS kept_sha256
    FROM d LEFT JOIN c USING (r)
    """,
)
def op13_substring_dedup(documents):
    kept = repeats.without_repeats(documents)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
