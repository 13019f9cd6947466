from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.llm import negatives

SCHEMA = "vec_id bigint, embedding array<float>, label int, anchor_id string"


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 70), st.integers(0, 70), st.integers(1, 70), st.integers(0, 2**32 - 1))
def test_strassen_equals_the_plain_product(m, k, n, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-(2**62), 2**62, (m, k)), rng.integers(-(2**62), 2**62, (k, n))
    with np.errstate(over="ignore"):
        assert (negatives.strassen(a, b) == a @ b).all()  # modulo 2**64 where it overflows


def test_heaps_merge_in_any_cut():
    rng = np.random.default_rng(1)
    scores, ids = rng.integers(-4, 4, (6, 40)), np.sort(rng.choice(1000, 40, replace=False))
    whole = negatives.Heaps(6, 5)
    whole.push(slice(0, 6), scores.copy(), ids)
    cut = negatives.Heaps(6, 5)
    for lo, hi in ((25, 40), (0, 3), (3, 25)):
        cut.push(slice(0, 6), scores[:, lo:hi].copy(), ids[lo:hi])
    assert (whole.score == cut.score).all() and (whole.id == cut.id).all()


def plain(rows, every=3):
    """The same by plain loops over Python integers."""
    kept = {}
    for vec_id, vector, label, _ in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        parts = [math.floor(256 * float(np.float32(x))) for x in vector]
        kept[vec_id] = min(kept.get(vec_id, (label, parts)), (label, parts))
    out = []
    for a, (label, parts) in kept.items():
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(parts, other, strict=False)), b, l) for b, (l, other) in kept.items() if b != a)
        for p, b, _ in [x for x in scored if x[2] == label][: negatives.POSITIVES]:
            window = [x for x in scored if x[2] != label and 50 * -p <= 100 * -x[0] <= 95 * -p]
            out += [(a, b, k + 1, n, -p, -s) for k, (s, n, _) in enumerate(window[: negatives.NEGATIVES])]
    return sorted(out)


def made(seed, n=120, size=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        vector = [float(x) for x in rng.integers(-3, 6, size if i % 11 else 3) / 4]
        rows.append((i, vector, int(rng.integers(0, 3)) if i % 5 else 0, "other"))
    return rows + [
        (None, [1.0], 1, "x"),
        (500, None, 1, "x"),
        (501, [1.0, None], 1, "x"),
        (502, [float("nan")], 1, "x"),
        (503, [float("inf")], 1, "x"),
        (504, [1.0], None, "x"),
        (505, [], 1, None),
        rows[3],
        rows[3],
        (4, [0.25] * size, 2, "a second row of an id"),
    ]


@pytest.mark.parametrize("stripe", [1 << 20, 1])
def test_equals_plain_loops(spark, rows, monkeypatch, stripe):
    monkeypatch.setattr(negatives, "STRIPE", stripe)  # 64 rows a stripe at the least
    monkeypatch.setattr(negatives, "LEAST", 16)
    monkeypatch.setattr(negatives, "TILE", (7, 13))
    given_rows = made(2)
    found = negatives.hard_negatives(spark.createDataFrame(given_rows, SCHEMA), F.col("vec_id") % 3 == 0)
    expected = plain(given_rows)
    assert expected and sorted(rows(found)) == expected
    assert [f.dataType.simpleString() for f in found.schema] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]


def test_no_rows_and_no_anchors(spark, rows):
    empty = spark.createDataFrame([], SCHEMA)
    assert rows(negatives.hard_negatives(empty, F.col("vec_id") % 3 == 0)) == []
    assert rows(negatives.hard_negatives(spark.createDataFrame([(1, [1.0], 0, "x")], SCHEMA), F.col("vec_id") % 3 == 0)) == []


def test_repeated_rows_of_one_id_count_once(spark, rows):
    copies = [(0, [1.0, 1.0], 0, "x")] * 50 + [(1, [1.0, 1.0], 0, "x")] * 50 + [(2, [0.75, 0.75], 1, "x")] * 50
    assert rows(negatives.hard_negatives(spark.createDataFrame(copies, SCHEMA), F.col("vec_id") == 0)) == [(0, 1, 1, 2, 131072, 98304)]
