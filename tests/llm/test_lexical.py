from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from cairn.llm import lexical

DOCS = "doc_id bigint, text string, item_id string, score double"
ITEMS = "item_id bigint, text string, doc_id string"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, top=lexical.TOP):
    """Every document against every item, in Python integers."""
    counts = [(d[0], Counter(terms(d[1]))) for d in docs]
    n_docs, total = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for i in items:
        wanted.setdefault(i[0], set()).update(terms(i[1]))
    out = []
    for item, asked in wanted.items():
        scored = []
        for doc_id, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // max(total, 1)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c
            )
            if score and doc_id is not None:
                scored.append((-score, doc_id))
        out += [(item, k + 1, d, -s) for k, (s, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def made(seed):
    rng = np.random.default_rng(seed)
    words = [*"abcdefgh", "Ünïcode", "naïve", "İstanbul", "x1", "42", "日本", "ÀB"]
    text = lambda n: "".join(str(rng.choice(words)) + str(rng.choice([" ", ", ", "\n", "_", "\x7f", "'"])) for _ in range(n))
    docs = [(int(i), text(int(rng.integers(1, 40))), "x", 0.5) for i in rng.permutation(150)]
    docs += [(i, "a B c naïve", "x", 0.5) for i in range(200, 240)]  # a group of copies, which tie
    docs += [(300, None, None, None), (301, "", "", None), (302, " ,.; ", "x", None), (None, "a b c", "x", None), (200, "a b", "x", 1.0)]
    docs += [(303, "日本 " * 3000 + "naïve", "x", None)]
    items = [(i, text(6), "x") for i in range(12)] + [(20, None, "x"), (21, "?!", "x"), (22, "nowhere", "x"), (0, "naïve 42", "x"), (None, "a", "x")]
    return docs, items


@pytest.mark.parametrize("block,postings,wave", [(1 << 18, 1 << 20, 16), (9, 60, 1)])
def test_equals_scoring_everything(spark, rows, monkeypatch, block, postings, wave):
    monkeypatch.setattr(lexical, "BLOCK", block)
    docs, items = made(3)
    found = rows(lexical.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)))
    assert sorted(found, key=str) == plain(docs, items)
    index_in_small_parts(docs, postings, wave, monkeypatch)


def index_in_small_parts(docs, postings, wave, monkeypatch):
    """An index over any share of the documents, with tens carried on, gives the same ten."""
    monkeypatch.setattr(lexical, "WAVE", wave)
    rng = np.random.default_rng(postings)
    weight = np.array([0, 700, 700, 1, 4000])
    counts = [np.sort(rng.choice(5, rng.integers(1, 5), replace=False)) for _ in range(300)]
    tfs = [rng.integers(1, 4, len(c)) for c in counts]
    m, ids = rng.integers(10, 14, 300), rng.permutation(300)
    wanted = np.array([0, 1, 3, 4])
    held = (np.zeros(0, dtype="int64"), np.zeros(0, dtype="int64"))
    step = max(1, postings // 4) if postings < 100 else 300
    for lo in range(0, 300, step):
        part = slice(lo, lo + step)
        sizes = np.array([len(c) for c in counts[part]])
        index = lexical.Index(ids[part], m[part], sizes, np.concatenate(counts[part]), np.concatenate(tfs[part]), weight)
        held = index.best(wanted, held, 10)
    score = [
        sum(int(weight[t]) * (10**9 * int(f) // (1000 * int(f) + 8 * int(k))) for t, f in zip(c, fs, strict=True) if t in wanted)
        for c, fs, k in zip(counts, tfs, m, strict=True)
    ]
    expected = sorted((-s, int(i)) for s, i in zip(score, ids, strict=True) if s)[:10]
    assert [(-int(s), int(i)) for s, i in zip(*held, strict=True)] == expected


def test_strata_below_the_tenth_score_are_not_visited(monkeypatch):
    weight = np.array([1000])
    n = 400
    m = np.arange(10, 10 + n)  # a stratum per document, the shorter the better
    index = lexical.Index(np.arange(n), m, np.ones(n, dtype="int64"), np.zeros(n, dtype="int64"), np.ones(n, dtype="int64"), weight)
    visits = []
    scores = lexical.Index.scores
    monkeypatch.setattr(lexical.Index, "scores", lambda self, group, visit: visits.append(len(visit)) or scores(self, group, visit))
    held = index.best(np.array([0]), (np.zeros(0, dtype="int64"),) * 2, 10)
    assert held[1].tolist() == list(range(10)) and sum(visits) == lexical.WAVE


def test_empty_tables(spark, rows):
    none, docs = spark.createDataFrame([], ITEMS), spark.createDataFrame([(1, "a", "x", 0.1)], DOCS)
    items = spark.createDataFrame([(1, "a", "x")], ITEMS)
    assert rows(lexical.search(docs, none)) == []
    assert rows(lexical.search(spark.createDataFrame([], DOCS), items)) == []
    assert rows(lexical.search(spark.createDataFrame([(1, None, "x", 0.1)], DOCS), items)) == []
