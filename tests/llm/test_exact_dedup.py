"""Exact deduplication against plain Python, with few and with many heavy hitters."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from cairn.llm import exact_dedup

SCHEMA = "doc_id bigint, text string, kept string, digest int"


def plain(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        sha = hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()
        groups[sha].append((-len(t or ""), i is None, i))
    key = lambda r: (r[0], r[1], 0 if r[2] is None else r[2])
    return {sha: (len(g), min(g, key=key)[2]) for sha, g in groups.items()}


def rows():
    rng = np.random.default_rng(3)
    texts = [f"text {k}  é {k}" for k in range(80)]
    out = [(i, texts[int(rng.zipf(1.4)) % 80].replace(" ", " " * int(rng.integers(1, 3))), "x", 1) for i in range(900)]
    return out + [(900, None, "x", 1), (901, "", "x", 1), (902, " \n", "x", 1), (None, "null id", "x", 1), (903, "null id", "x", 1), (7, "same", "x", 1), (7, "same", "x", 1), (904, "l " * 40_000, "x", 1)]


@pytest.mark.parametrize("heavy", [2, 1024])
def test_groups(spark, monkeypatch, heavy):
    monkeypatch.setattr(exact_dedup, "HEAVY", heavy)
    given = rows()
    found = exact_dedup.exact_groups(spark.createDataFrame(given, SCHEMA).repartition(4)).collect()
    want = plain(given)
    assert len(found) == len(given)
    assert all((r.group_size, r.keep_id) == want[r.text_sha256] for r in found)
    assert sum(r.kept for r in found) == len(want)
    assert all(r.keep_id == r.doc_id for r in found if r.kept)


@pytest.mark.parametrize("heavy", [2, 1024])
def test_drop_copies_keeps_one_row_of_each_text(spark, monkeypatch, heavy):
    monkeypatch.setattr(exact_dedup, "HEAVY", heavy)
    given = rows()
    kept = exact_dedup.drop_copies(spark.createDataFrame(given, SCHEMA).repartition(4))
    assert kept.columns == ["doc_id", "text", "kept", "digest"]
    found = kept.collect()
    assert sorted(map(str, (r.doc_id for r in found))) == sorted(map(str, (i for _, i in plain(given).values())))


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_groups(empty).collect() == [] and exact_dedup.drop_copies(empty).collect() == []


def test_summary_never_loses_a_frequent_digest(monkeypatch):
    monkeypatch.setattr(exact_dedup, "HEAVY", 5)
    rng = np.random.default_rng(0)
    digests = [str(d).encode() for d in rng.zipf(1.5, 4000)]
    batches = [pd.DataFrame({"digest": digests[k : k + 137]}) for k in range(0, 4000, 137)]
    (summary,) = exact_dedup.summarise(iter(batches))
    counts = pd.Series(digests).value_counts()
    held = dict(zip(summary["digest"], summary["n"], strict=True))
    assert len(held) <= 5
    for digest, n in counts.items():
        assert n - 4000 / 6 <= held.get(digest, 0) <= n


def test_columns_that_spark_does_not_hash(spark):
    given = spark.createDataFrame([(1, "a b", {"k": 1}, [{"x": "y"}]), (1, "ab", {"k": 2}, None), (2, "c", None, [None])], "doc_id bigint, text string, more map<string,int>, lists array<map<string,string>>")
    kept = exact_dedup.drop_copies(given)
    assert kept.schema == given.schema
    assert sorted((r.doc_id, r.text, r.more) for r in kept.collect()) == [(1, "a b", {"k": 1}), (2, "c", None)]
