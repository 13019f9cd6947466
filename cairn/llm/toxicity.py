"""Severity of toxic text by cumulative-link ordinal regression.

Grades are ordered: 0 clean, 1 toxic, 2 toxic in many words. One weight per
feature is shared by all thresholds: P(grade >= k) = sigmoid(w.x - b_k) with
b_1 < b_2. The expected severity is the sum of these over k.

Features are the words and beginnings of words that a text holds, each once,
out of at most ``FEATURES`` that set toxic texts apart. The regression is fitted on at most
``SAMPLE`` labelled texts, those with the smallest hash of their id; counting
their words runs in Spark, and only the chosen words of the sample reach the
driver. Scoring covers every row.

A null or empty text has no words and takes the severity of no evidence.
Labels that are null count as missing; of several labels of one id the highest
holds, and of several texts of one id the smallest is fitted on; labels without a
text are left out. Without toxic or without clean
labels every severity is 0. Rows that repeat are scored each for itself.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.licenses import words_of
from cairn.plans.scale import staged

SAMPLE = 8_000  # most labelled texts to fit on
FEATURES = 2_048  # most words with a weight
LEAST_TEXTS = 5  # of the sample that must hold a word
GRADES = 3
STEPS = 400
RIDGE = 1.0  # strength of the penalty on weights
REJECT = 0.25  # P(grade >= 1) from which a text counts as toxic
STEMS = (4, 5, 6)  # bytes of the word beginnings that are features as well


def features_of(words: Iterable[bytes]) -> set[bytes]:
    """Distinct words and, with ^ ahead, their beginnings."""
    found = set(words)
    found.update([b"^" + word[:n] for word in list(found) for n in STEMS if len(word) > n])
    return found


def text_words(text: str | None) -> set[bytes]:
    return set(words_of((text or "").lower().encode()))


class Model:
    """Weights of features, and a threshold for each grade from 1; none if nothing was learnt."""

    def __init__(self, weights: dict[bytes, float], thresholds: tuple[float, ...]):
        self.weights, self.thresholds = weights, thresholds
        # a word can only matter if a feature begins like it
        self.heads = frozenset(feature.removeprefix(b"^")[: STEMS[0]] for feature in weights)

    def at_least(self, text: str | None) -> np.ndarray:
        """P(grade >= k) for k = 1, 2 ..."""
        if not self.thresholds:
            return np.zeros(GRADES - 1)
        held = features_of(word for word in text_words(text) if word[: STEMS[0]] in self.heads)
        logit = sum(self.weights[feature] for feature in sorted(self.weights.keys() & held))
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds) - logit, -50, 50)))


def sample_words(docs: DataFrame, labels: DataFrame, id: str, text: str, toxic: str) -> DataFrame:
    """(doc_id, toxic, words): the sample with the features of each text."""
    known = labels.select(F.col(id).alias("doc_id"), F.col(toxic).alias("toxic")).dropna()
    sample = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([sorted(features_of(text_words(t.as_py()))) for t in batch.column("text")], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), found], ["doc_id", "toxic", "words"])

    texts = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return staged(
        texts.select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic", "text").mapInArrow(
            split, "doc_id bigint, toxic int, words array<binary>"
        )
    )


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and clean texts of a task hold each feature."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in batches:
        for toxic, words in zip(batch.column("toxic").to_pylist(), batch.column("words").to_pylist(), strict=True):
            seen[toxic > 0].update(words)
    words = list(seen[0].keys() | seen[1].keys())
    columns = [pa.array(words, "binary"), *(pa.array([seen[k][w] for w in words], "int64") for k in (1, 0))]
    yield pa.RecordBatch.from_arrays(columns, ["word", "bad", "good"])


def chosen_words(sample: DataFrame, n_toxic: int, n_clean: int) -> list[tuple[bytes, float]]:
    """The features that tell most about toxicity, with their log-odds."""
    counts = sample.select("toxic", "words").mapInArrow(counted, "word binary, bad bigint, good bigint")
    counts = counts.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = F.log((F.col("bad") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("good") + 0.5) / (n_clean + 1.0))
    told = F.abs(F.col("bad") / n_toxic - F.col("good") / n_clean) * F.abs(odds)
    top = counts.filter(F.col("bad") + F.col("good") >= LEAST_TEXTS).withColumns({"odds": odds, "told": told})
    return [(bytes(r["word"]), r["odds"]) for r in top.orderBy(F.desc("told"), "word").limit(FEATURES).collect()]


def grades(toxic: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Toxic texts with more features that mark toxic texts than their median are of grade 2."""
    line = np.median(marked[toxic]) if toxic.any() else 0.0
    return np.where(toxic, 1 + (marked > line), 0)


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, grade: np.ndarray, n_features: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest penalised likelihood, by gradient steps with momentum.

    ``rows`` and ``columns`` list the features that are set. A grade that does
    not occur leaves its threshold far away.
    """
    n, k = len(grade), GRADES - 1
    weights, bounds = np.zeros(n_features), np.linspace(1.0, 2.0, k)
    first, second = np.zeros(n_features + k), np.zeros(n_features + k)
    for step in range(1, STEPS + 1):
        logit = np.bincount(rows, weights[columns], minlength=n)
        above = 1 / (1 + np.exp(np.clip(bounds[None, :] - logit[:, None], -30, 30)))
        edge = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
        slope = edge * (1 - edge)
        at = np.arange(n)
        likely = np.maximum(edge[at, grade] - edge[at, grade + 1], 1e-9)
        up, down = slope[at, grade] / likely, slope[at, grade + 1] / likely
        d_logit = up - down
        d_bounds = np.bincount(grade + 1, down, minlength=GRADES + 1)[1 : k + 1] - np.bincount(grade, up, minlength=GRADES + 1)[1 : k + 1]
        d_weights = np.bincount(columns, d_logit[rows], minlength=n_features) - RIDGE * weights
        slope_all = np.concatenate([d_weights, d_bounds]) / n
        first = 0.9 * first + 0.1 * slope_all
        second = 0.99 * second + 0.01 * slope_all**2
        move = 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        weights, bounds = weights + move[:n_features], np.sort(bounds + move[n_features:])
    return weights, bounds


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    sample = sample_words(docs, labels, id, text, toxic)
    n_toxic = sample.filter("toxic > 0").count()
    n_clean = sample.filter("toxic <= 0").count()
    if not n_toxic or not n_clean:
        return Model({}, ())
    chosen = chosen_words(sample, n_toxic, n_clean)
    number = {w: i for i, (w, _) in enumerate(chosen)}

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [sorted(number[w] for w in words if w in number) for words in batch.column("words").to_pylist()]
            columns = [batch.column("doc_id"), batch.column("toxic"), pa.array(held, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "toxic", "words"])

    held = sample.mapInArrow(numbered, "doc_id bigint, toxic int, words array<int>").orderBy("doc_id").collect()
    rows = np.array([i for i, r in enumerate(held) for _ in r["words"]], dtype="int64")
    columns = np.array([w for r in held for w in r["words"]], dtype="int64")
    marks = np.array([odds > 2 for _, odds in chosen] or [False])
    marked = np.bincount(rows, marks[columns], minlength=len(held)) if len(rows) else np.zeros(len(held))
    grade = grades(np.array([r["toxic"] > 0 for r in held]), marked)
    weights, bounds = fit_ordinal(rows, columns, grade, max(1, len(chosen)))
    return Model({w: float(weights[i]) for w, i in number.items()}, tuple(map(float, bounds)))


def severity(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, severity, grade and toxic of every text."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = [model.at_least(t.as_py()) for t in batch.column(1)]
            columns = [
                pa.array([round(float(a.sum()), 6) for a in above], "float64"),
                pa.array([int((a >= 0.5).sum()) for a in above], "int32"),
                pa.array([bool(a[0] >= REJECT) for a in above], "bool"),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "severity", "grade", "toxic"])

    picked = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(scored, "doc_id bigint, severity double, grade int, toxic boolean")


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents that do not count as toxic, with all their columns."""

    @F.pandas_udf("boolean")
    def toxic(texts):
        return texts.map(lambda t: bool(model.at_least(t)[0] >= REJECT))

    return docs.filter(~toxic(F.coalesce(text, F.lit(""))))
