"""SimHash fingerprints and groups against plain Python."""

import re

import numpy as np
import pytest
import xxhash

from cairn.llm import simhash
from cairn.llm.components import components, spanning_forest

SCHEMA = "doc_id bigint, text string, fingerprint int, f0 string"


def plain_fingerprint(text, n=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    runs = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_classes(prints, budget=3):
    """{id: smallest id reachable}, ids may repeat."""
    of = {i: i for i, _ in prints if i is not None}

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for n, (i, p) in enumerate(prints):
        for j, q in prints[:n]:
            if i is not None and j is not None and bin(p ^ q).count("1") <= budget:
                a, b = sorted((root(i), root(j)))
                of[b] = a
    return {i: root(i) for i in of}


def texts():
    rng = np.random.default_rng(5)
    words = ["alpha", "Beta", "gamma", "délta", "eps", "zeta", "ETA", "theta", "iota", "kappa"]
    base = [" ".join(rng.choice(words, int(rng.integers(1, 200)))) for _ in range(60)]
    near = [t + " more" for t in base[:30]] + [t.upper() for t in base[:10]]
    odd = [None, "", " \t\n", "one", "one two", "a\x0bb\x1fc d", "x " * 50_000, base[0], base[0]]
    return [(i, t) for i, t in enumerate(base + near + odd)] + [(3, base[3]), (3, base[4])]


def test_fingerprints_and_groups(spark):
    rows = texts()
    given = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(3)
    found = simhash.near_groups(given).collect()
    assert len(found) == len(rows)
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    assert sorted((r.doc_id, r.fingerprint) for r in found) == sorted((i, f"{p:016x}") for i, p in prints)
    classes = plain_classes(prints)
    assert {r.doc_id: r.component_id for r in found} == classes
    assert len(set(classes.values())) < len(classes)


def test_null_ids_take_part_but_lead_no_group(spark):
    given = spark.createDataFrame([(None, "a b c", 1, ""), (7, "a b c", 1, ""), (None, "only here", 1, "")], SCHEMA)
    found = sorted(((r.doc_id, r.component_id) for r in simhash.near_groups(given).collect()), key=str)
    assert found == sorted([(None, 7), (7, 7), (None, None)], key=str)


def test_a_null_id_joins_others_by_a_near_fingerprint(spark, monkeypatch):
    far, hidden = 0b1111, 0b11
    prints = [(7, 0), (None, hidden), (9, far), (None, -1), (12, 1 << 40 | 1 << 50 | 1 << 60 | 1 << 30)]
    given = spark.createDataFrame([(i, 0, f) for i, f in prints], "doc_id bigint, mark bigint, f0 bigint")
    monkeypatch.setattr(simhash, "fingerprints", lambda *rest: given)
    found = {r.fingerprint: (r.doc_id, r.component_id) for r in simhash.near_groups(given).collect()}
    assert [found[f"{p % (1 << 64):016x}"] for _, p in prints] == [(7, 7), (None, 7), (9, 7), (None, None), (12, 12)]


def test_empty_table(spark):
    assert simhash.near_groups(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("spread", [2, 6, 64])
def test_trie_finds_every_close_pair(spark, spread):
    rng = np.random.default_rng(spread)
    centres = rng.integers(0, 1 << 63, 40, dtype="uint64")
    made = {int(c) for c in centres}
    for c in centres:
        for _ in range(30):
            flips = rng.choice(64, int(rng.integers(0, min(spread, 8) + 1)), replace=False)
            made.add(int(c) ^ sum(1 << int(f) for f in flips))
    prints = list(enumerate(sorted(made)))
    signed = [(i, p - (1 << 64) if p >> 63 else p) for i, p in prints]
    links = simhash.near_links(spark.createDataFrame(signed, "rep bigint, f0 bigint")).collect()
    value = dict(prints)
    assert all(bin(value[r.a] ^ value[r.b]).count("1") <= 3 for r in links)
    found = {r.id: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = plain_classes(prints)
    assert {i: found.get(i, i) for i, _ in prints} == want


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 220)]
    star = [(500, i) for i in range(1000, 3000)] + [(2999, 7)]
    links = spark.createDataFrame(chain + star + [(9, 9)], "a bigint, b bigint").repartition(7)
    found = {r.id: r.component for r in components(links).collect()}
    assert {found[i] for i in range(100, 221)} == {100}
    assert {found[i] for i in [500, *range(1000, 3000)]} == {7} and 9 not in found


def test_forest_takes_the_lightest_edges():
    a, b, w = np.array([0, 1, 0, 3]), np.array([1, 2, 2, 4]), np.array([1, 5, 2, 0])
    assert sorted(spanning_forest(5, a, b, w).tolist()) == [0, 2, 3]
