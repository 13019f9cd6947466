"""Mixing against filling by hand, and what the sampling promises."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from cairn.llm import mixing

SCHEMA = "doc_id bigint, text string, source string, size string, copies int, doc string"


def by_hand(sizes):
    """Shares by weight, what is above twice the size shared again, until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        unit = left / sum(weight[s] for s in free)
        full = {s for s in free if unit * weight[s] > 2 * sizes[s]}
        for s in full or free:
            target[s] = 2.0 * sizes[s] if full else unit * weight[s]
        left -= sum(target[s] for s in full)
        free = free - full if full else set()
    return target


def made(seed, n_sources):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(600):
        source = None if i % 37 == 0 else f"s{int(rng.integers(n_sources) * rng.random())}é"
        text = [None, "", "x"][i % 3] if i % 50 == 0 else " ".join(["w\x0bz"] * int(rng.geometric(0.02)))
        rows.append((i, text, source, "a", i, "b"))
    return rows


@pytest.mark.parametrize(("seed", "n_sources"), [(1, 1), (2, 3), (3, 12)])
def test_targets_and_copies(spark, seed, n_sources):
    rows = made(seed, n_sources)
    given = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = {r.doc_id: r for r in mixing.copies(given).collect()}
    assert len(found) == len(rows)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    sizes, taken = Counter(), defaultdict(int)
    for i, _, source, *_ in rows:
        sizes[source] += size[i]
        taken[source] += found[i].copies * size[i]
    target = by_hand(sizes)
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for i, _, source, *_ in rows:
        r = found[i]
        assert (r.size, r.source_size) == (size[i], sizes[source]) and 0 <= r.copies <= 2
        assert r.target == pytest.approx(target[source])
    largest = max(size.values())
    assert all(abs(taken[s] - target[s]) <= 2 * largest for s in sizes)


def test_mix_repeats_whole_rows_and_agrees_with_itself(spark):
    rows = made(4, 4)
    given = spark.createDataFrame(rows, SCHEMA)
    copies = {r.doc_id: r.copies for r in mixing.copies(given.repartition(7)).collect()}
    first = sorted(map(str, mixing.mix(given).collect()))
    assert first == sorted(map(str, mixing.mix(given.repartition(3)).collect()))
    assert Counter(r.doc_id for r in mixing.mix(given).collect()) == Counter({i: c for i, c in copies.items() if c})
    assert mixing.mix(given).columns == given.columns


def test_repeated_rows_and_null_ids(spark):
    rows = [(None, "a b c", "s", "", 0, "")] * 40 + [(5, "a b", "s", "", 0, "")] * 40
    found = mixing.copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == 80
    assert sum(r.copies for r in found) == 120  # one source: its target is 1.5 times its size


def test_empty_table_and_empty_texts(spark):
    assert mixing.copies(spark.createDataFrame([], SCHEMA)).collect() == []
    found = mixing.copies(spark.createDataFrame([(1, None, None, "", 0, ""), (2, " ", "s", "", 0, "")], SCHEMA)).collect()
    assert [(r.size, r.target, r.copies) for r in found] == [(0, 0.0, 0)] * 2


def test_columns_that_spark_does_not_hash(spark):
    rows = [(i % 3, "a b", "s", {"k": i}, {"in": {"k": i}}) for i in range(40)]
    given = spark.createDataFrame(rows, "doc_id bigint, text string, source string, more map<string,int>, `deep.er` map<string,map<string,int>>")
    found = mixing.mix(given)
    assert found.schema == given.schema
    assert Counter(r.more["k"] for r in found.collect()).total() == 60
