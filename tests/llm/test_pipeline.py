"""Near-unique documents against all pairs, and the pipeline end to end."""

import os
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece

import corpus_pipeline
from cairn.llm import simhash
from cairn.llm.queries import PIECES

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row int, mark string, doc string"


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def alike(a, b):
    return not a and not b or len(a & b) >= 0.8 * len(a | b)


def plain_groups(rows):
    """Smallest id per group of texts that chains of similar pairs connect."""
    sets = [shingles(t) for _, t in rows]
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s or {None}:
            holders[x].append(k)
    of = list(range(len(rows)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, s in enumerate(sets):
        shared = Counter(j for x in (s or {None}) for j in holders[x] if j < i)
        for j in shared:
            if alike(s, sets[j]):
                of[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    return sorted(min(g) for g in groups.values())


def edited(rng, words, share):
    out = list(words)
    for k in rng.choice(len(out), max(1, int(share * len(out))), replace=False):
        out[int(k)] = f"new{int(rng.integers(1_000_000))}"
    return out


def near_copies(seed=0):
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(60):
        words = [f"w{int(x)}" for x in rng.integers(0, 3000, int(rng.integers(40, 400)))]
        texts.append(words)
        for _ in range(int(rng.integers(0, 6))):
            texts.append(edited(rng, words, float(rng.choice([0.005, 0.01, 0.015]))))
        if rng.random() < 0.3:
            texts.append(edited(rng, words, 0.2))
            cut = len(words) // 12
            texts.append(words[cut:] + ["tail"] * 3)
    whole = [" ".join(t) for t in texts]
    whole += [None, "", " \n", "one two", "One  two", "a b c d e", "x " * 60_000, "x " * 60_001]
    order = rng.permutation(len(whole))
    return [(int(i), whole[i]) for i in order]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, "m", "d") for i, t in rows], SCHEMA).repartition(4)


@pytest.mark.parametrize("seed", [0, 1])
def test_one_document_of_each_group_stays(spark, seed):
    rows = near_copies(seed)
    kept = simhash.near_unique(frame(spark, rows))
    assert kept.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(r.doc_id for r in kept.collect()) == plain_groups(rows)


def test_repeated_rows_and_ids(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "something else altogether here now"), (2, "A b c d e f g"), (None, "a b c d e f g")]
    found = sorted((r.doc_id, r.text) for r in simhash.near_unique(frame(spark, rows)).collect())
    assert found == [(1, "a b c d e f g"), (1, "something else altogether here now")]
    assert simhash.near_unique(frame(spark, rows).limit(0)).collect() == []


SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = sorted(r.doc_id for r in simhash.near_unique(docs).collect())
    want = plain_groups(rows)
    assert len(set(kept) ^ set(want)) <= 0.002 * len(rows)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_pipeline(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "pieces"]
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    found = corpus_pipeline.run(spark, SF_DIR).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert all(r.exact and r.n_tokens == len(r.ids) for r in found)
    assert all(library.decode(r.ids) == text[r.doc_id] for r in found[:300])
    taken = Counter(r.doc_id for r in found)
    assert max(taken.values()) <= 2
    kept = [(i, text[i]) for i in taken]
    assert plain_groups(kept) == sorted(taken)
    toxic = {i for i, t in labels.items() if t}
    assert len(toxic & set(taken)) <= 0.03 * len(toxic)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(50)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF_DIR).count() == 0, name
        if name != "pieces":
            assert stage(spark, docs, SF_DIR).columns == docs.columns


def crowd(seed=3, size=600, planted=40, total=240, template=200):
    """Texts of one template with words of their own (0.7 to 0.79 alike), and pairs that share some of these (0.8 and more)."""
    rng = np.random.default_rng(seed)
    base = [f"t{k}" for k in range(template)]
    texts = [base + [f"o{n}x{k}" for k in range(total - template - 8)] for n in range(size)]
    for n in range(planted):
        own = texts[n][template:]
        texts.append(base + own[: len(own) // 2] + [f"p{n}x{k}" for k in range(len(own) // 2)])
    order = rng.permutation(len(texts))
    return [(int(i), " ".join(texts[i])) for i in order]


def test_a_crowd_of_one_template_keeps_one_of_each_pair(spark):
    rows = crowd()
    sets = dict((i, shingles(t)) for i, t in rows)
    assert 0.7 <= len(sets[0] & sets[1]) / len(sets[0] | sets[1]) < 0.8 and not any(alike(sets[0], sets[i]) for i in range(1, 600))
    assert all(alike(sets[i], sets[600 + i]) for i in range(40))
    kept = sorted(r.doc_id for r in simhash.near_unique(frame(spark, rows)).collect())
    assert kept == list(range(600))


def test_shared_tokens_are_counted_alike_by_list_and_by_product(monkeypatch):
    rng = np.random.default_rng(0)
    cells = rng.random((60, 300)) < rng.random(300) * 0.6
    row, token = np.nonzero(cells)
    left, right = np.arange(25), np.arange(20, 60)
    want = cells[left].astype(int) @ cells[right].T.astype(int)
    for dense in (0, 40, 10_000):
        monkeypatch.setattr(simhash, "DENSE", dense)
        assert (simhash.common_counts(row, token * 7, left, right) == want).all()


def test_texts_that_one_shingle_rules(spark):
    """Whatever else these texts hold, over half of their runs of three words is one run."""
    rng = np.random.default_rng(8)
    rows = []
    for n in range(12):
        words = [f"r{n}x{k}" for k in range(60)]
        for copy in (words, edited(rng, words, 0.01)):
            rows.append((len(rows), " ".join(copy + ["0"] * 200)))
    assert sorted(r.doc_id for r in simhash.near_unique(frame(spark, rows)).collect()) == plain_groups(rows) == list(range(0, 24, 2))


def test_a_line_that_stands_many_times_counts_once(spark):
    rows = []
    for n in range(8):
        words = [f"l{n}x{k}" for k in range(400)]
        line = [f"line{n}x{k}" for k in range(8)]
        rows += [(2 * n, " ".join(words + line)), (2 * n + 1, " ".join(words + line * 50))]
    assert sorted(r.doc_id for r in simhash.near_unique(frame(spark, rows)).collect()) == plain_groups(rows) == list(range(0, 16, 2))
