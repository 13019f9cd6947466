from __future__ import annotations

import re

import numpy as np
import pytest

from cairn.llm import repeats

SCHEMA = "doc_id bigint, text string, n_words string, chunk int"


def plain(docs):
    """First places of all windows in a dictionary; documents in the order of their ids."""
    seen, out = set(), []
    for doc_id, text, *_ in sorted(docs, key=lambda d: (d[0] is None, d[0] or 0)):
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        gone = set()
        for i in range(len(words) - repeats.WINDOW + 1):
            window = tuple(words[i : i + repeats.WINDOW])
            if window in seen:
                gone.update(range(i, i + repeats.WINDOW))
            seen.add(window)
        spans, start = [], None
        for i in range(len(words) + 1):
            if i in gone and start is None:
                start = i
            elif i not in gone and start is not None:
                spans.append((start, i))
                start = None
        out.append((doc_id, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone), spans))
    return sorted(out, key=str)


def made(seed):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["ünï", "a b", "x\x1fy", "日本"]
    text = lambda n: [str(rng.choice(vocabulary)) for _ in range(n)]
    shared, header = text(57), text(23)
    docs = []
    for i in range(60):
        words = text(int(rng.integers(0, 90)))
        if i % 3 == 0:  # at any alignment, whole or in part
            cut = sorted(rng.integers(0, 58, 2))
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = shared[cut[0] : cut[1]]
        if i % 4 == 0:
            words = header + words
        docs.append((int(i * 7 % 61), str(rng.choice([" ", "\n", " \t\r\n"])).join(words), "x", i))
    whole = " ".join(text(120))
    docs += [(100 + i, whole, None, i) for i in range(25)]  # copies
    docs += [(200, whole + " " + " ".join(shared) + " " + " ".join(shared), "x", 1)]  # twice in one document
    docs += [(300, " ".join(["la"] * 500), "x", 1), (301, " ".join(["la", "li"] * 40), "x", 1), (302, " ".join(["la"] * 19), "x", 1)]
    docs += [(400, None, "x", 1), (401, "", "x", 1), (402, " \n", "x", 1), (None, " ".join(shared), "x", 1)]
    docs += [(500, " ".join(shared[:20]), "x", 1), (501, " ".join(shared[37:]), "x", 1), (502, " ".join(shared[:19]), "x", 1)]
    return docs


@pytest.mark.parametrize("chunk,parts,seed", [(1 << 18, 1, 1), (100, 3, 2), (1, 4, 3), (1000, 2, 4)])
def test_equals_a_dictionary_of_all_windows(spark, rows, monkeypatch, chunk, parts, seed):
    docs = made(seed)
    order = np.random.default_rng(seed).permutation(len(docs))
    frame = spark.createDataFrame([docs[k] for k in order], SCHEMA).repartition(parts)
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    chunked = lambda batches, pack=repeats.packed: setattr(repeats, "CHUNK", chunk) or pack(batches)  # noqa: E731  in the worker too
    monkeypatch.setattr(repeats, "packed", chunked)
    found = repeats.without_repeats(frame)
    mine = sorted(((*r[:4], [(s["begin"], s["end"]) for s in r[4]]) for r in found.collect()), key=str)
    assert mine == plain(docs)


def test_nothing_at_all(spark, rows):
    assert rows(repeats.without_repeats(spark.createDataFrame([], SCHEMA))) == []
    found = repeats.without_repeats(spark.createDataFrame([(1, None, "x", 1)], SCHEMA))
    assert rows(found, "doc_id", "n_words", "n_removed", "kept") == [(1, 0, 0, "")]


def test_repeated_ids_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(30))
    found = repeats.without_repeats(spark.createDataFrame([(1, text, "x", 1)] * 40, SCHEMA)).collect()
    assert sorted(r["n_removed"] for r in found) == [0] + [30] * 39


def test_words_do_not_travel_again(spark):
    """The passes over the chunks start from the table's buckets; only the probes are shuffled."""
    docs = spark.createDataFrame([(1, "a b c " * 20, "x", 1)], SCHEMA)
    plan = repeats.without_repeats(docs)._jdf.queryExecution().executedPlan().toString()
    chunks = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(chunks) == 1 and "line" not in chunks[0]
