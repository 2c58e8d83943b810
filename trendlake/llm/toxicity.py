"""Toxicity by non-negative positive-unlabelled learning.

The positives are documents confirmed toxic; every other document of the training folds is
unlabelled, whatever its label says. A linear model over word and word-beginning rates is
trained in numpy on the class-prior-corrected risk
``prior * R+(P) + max(0, R-(U) - prior * R-(P))``. Screening counts cover every document of
the bounded training sample; scoring covers every word of every text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendlake.llm.common import byte_values, column, frugal
from trendlake.llm.decontaminate import words_of
from trendlake.storage import materialize

#: Documents that the model is fitted on: confirmed toxic ones and unlabelled ones, at most.
POSITIVES, UNLABELLED = 2_500, 7_500
#: Features kept after screening, and documents of the sample that must hold one. Its share must be
#: higher among the positives by FEW_Z standard errors for FEW positives, and by Z_STEP more for each
#: tenfold of these up to MOST_Z, as few positives cannot reach what many must show.
FEATURES, LEAST_DOCS = 200, 4
FEW, FEW_Z, Z_STEP, MOST_Z = 30, 4.0, 1.0, 5.0
THRESHOLD = 0.7
BEGINNINGS = (4, 5, 6, 7)
ROUNDS, RATE, DECAY = 400, 0.05, 1e-3
WORDS_KEPT = 400_000


def held_out(key: Column) -> Column:
    """Rows that give no label to training: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def features_of(word: bytes) -> list[bytes]:
    """The word itself and its beginnings (marked by a blank, which no word holds)."""
    return [word, *(word[:k] + b" " for k in BEGINNINGS if len(word) > k)]


def _screen_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for positive, text in zip(batch.column(0).to_pylist(), byte_values(batch.column(1)), strict=True):
            seen[positive].update({f for w in set(words_of(text)) for f in features_of(w)})
        names = list(seen[True] | seen[False])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.binary()), *(pa.array([seen[p][f] for f in names], pa.int64()) for p in (True, False))],
            ["feature", "positive", "unlabelled"],
        )


def _rate_batches(handle):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = handle.value
        for batch in batches:
            at, values = [], []
            for text in byte_values(batch.column(1)):
                words = words_of(text)
                counts = Counter(numbers[f] for w in words for f in features_of(w) if f in numbers)
                at.append(list(counts))
                values.append([c / len(words) for c in counts.values()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64()))],
                ["positive", "at", "rates"],
            )

    return run


class Model:
    """Weights of features and a bias; scores are probabilities."""

    def __init__(self, weights: dict[bytes, float], bias: float) -> None:
        self.weights, self.bias = weights, bias
        self.words: dict[bytes, float] = {}

    def score(self, text: bytes | None) -> float:
        words = words_of(text)
        if not words:
            return 1 / (1 + math.exp(-self.bias))
        found = list(map(self.words.get, words))
        if None in found:
            if len(self.words) > WORDS_KEPT:
                self.words.clear()
            get = self.weights.get
            for w in set(words):
                if w not in self.words:
                    self.words[w] = sum(map(get, features_of(w), repeat(0.0)))
            found = map(self.words.__getitem__, words)
        z = self.bias + sum(found) / len(words)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def risks(z: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, float, np.ndarray, np.ndarray]:
    """``prior * R+(P)`` and ``R-(U) - prior * R-(P)`` of scores ``z`` with logistic loss, and their gradients by z."""
    p, u = positive, ~positive
    n_p, n_u = max(1, p.sum()), max(1, u.sum())
    sigmoid = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    as_positive, as_negative = np.logaddexp(0, -z), np.logaddexp(0, z)
    of_positive = prior * as_positive[p].sum() / n_p
    of_negative = as_negative[u].sum() / n_u - prior * as_negative[p].sum() / n_p
    pull_positive = np.where(p, prior * (sigmoid - 1) / n_p, 0.0)
    pull_negative = np.where(p, -prior * sigmoid / n_p, sigmoid / n_u)
    return float(of_positive), float(of_negative), pull_positive, pull_negative


def fit(positive: np.ndarray, at: list[np.ndarray], rates: list[np.ndarray], n_features: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the non-negative risk with logistic loss.

    Where the negative part of the risk falls below zero, a step follows its gradient alone, turned
    round, so the model is not driven to fit the unlabelled rows as if all were negative.
    """
    sizes = np.array([len(a) for a in at])
    row = np.repeat(np.arange(len(at)), sizes)
    column = np.concatenate([*at, np.zeros(0, np.int32)]).astype(np.int64)
    value = np.concatenate([*rates, np.zeros(0)])
    scale = np.ones(n_features)
    spread = np.sqrt(np.bincount(column, value**2, n_features) / max(1, len(at)))
    scale[spread > 0] = 1 / spread[spread > 0]
    value = value * scale[column] * 0.1
    weights, bias = np.zeros(n_features), math.log(prior / (1 - prior))
    m = np.zeros(n_features + 1)
    v = np.zeros(n_features + 1)
    for step in range(1, ROUNDS + 1):
        z = np.bincount(row, value * weights[column], len(at)) + bias
        _, negative_risk, pull_positive, pull_negative = risks(z, positive, prior)
        pull = -pull_negative if negative_risk < 0 else pull_positive + pull_negative
        gradient = np.append(np.bincount(column, value * pull[row], n_features) + DECAY * weights / n_features, pull.sum())
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        weights -= move[:-1]
        bias -= move[-1]
    return weights * scale * 0.1, float(bias)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model from the folds that are not held out; without confirmed toxic rows it scores 0.

    The sample is the ids with the lowest hashes, one text of each, so it is the same in every run and has at most
    ``POSITIVES`` and ``UNLABELLED`` texts. Of several labels of one id the highest counts, of several texts the greatest;
    rows with a null id train nothing; copies of one text are one example.
    """
    spark = docs.sparkSession
    known = labels.select(column(key).alias("id"), column(label).cast("int").alias("y")).where(~held_out(F.col("id")) & F.col("id").isNotNull())
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    share = known.agg(F.avg((F.col("y") == 1).cast("double"))).first()[0]
    hashed = (F.xxhash64("id"), F.col("id"))
    ids_p = [r[0] for r in known.where("y = 1").select("id").orderBy(*hashed).limit(POSITIVES).collect()]
    if not ids_p or not share:
        return Model({}, -30.0)
    prior = min(0.95, max(0.001, float(share)))
    pool = docs.select(column(key).alias("id")).where(~held_out(F.col("id")) & F.col("id").isNotNull())
    ids_u = [r[0] for r in pool.distinct().orderBy(*hashed).limit(UNLABELLED).collect()]

    def chosen(ids: list[int], positive: bool) -> DataFrame:
        rows = docs.where(column(key).isin(ids) & column(text).isNotNull()).groupBy(column(key)).agg(F.max(column(text).cast("string")).alias("text"))
        return rows.select(F.lit(positive).alias("positive"), "text")

    # copies of one text are one example
    sample = chosen(ids_p, True).unionByName(chosen(ids_u, False)).dropDuplicates(["positive", "text"])
    sample = materialize(sample, "examples")
    sizes = dict(sample.groupBy("positive").count().collect())
    counted = sample.mapInArrow(frugal(_screen_batches), "feature binary, positive long, unlabelled long")
    counted = counted.groupBy("feature").agg(F.sum("positive").alias("p"), F.sum("unlabelled").alias("u")).where(F.col("p") + F.col("u") >= LEAST_DOCS)
    n_p, n_u = sizes.get(True, 0), max(1, sizes.get(False, 0))
    least_z = min(MOST_Z, max(FEW_Z, FEW_Z + Z_STEP * math.log10(max(n_p, 1) / FEW)))
    both = (F.col("p") + F.col("u")) / F.lit(n_p + n_u)
    error = F.sqrt(both * (F.lit(1.0) - both) * F.lit(1 / n_p + 1 / n_u) + F.lit(1e-12))
    ranked = counted.withColumn("z", (F.col("p") / n_p - F.col("u") / n_u) / error).where(F.col("z") >= least_z)
    ranked = ranked.orderBy(F.col("z").desc(), "feature").limit(FEATURES)
    names = [bytes(r[0]) for r in ranked.select("feature").collect()]
    numbers = {f: k for k, f in enumerate(names)}
    rows = sample.mapInArrow(frugal(_rate_batches(spark.sparkContext.broadcast(numbers))), "positive boolean, at array<int>, rates array<double>").collect()
    weights, bias = fit(
        np.array([r[0] for r in rows], bool), [np.array(r[1], np.int64) for r in rows], [np.array(r[2], np.float64) for r in rows], len(names), prior
    )
    return Model({f: float(w) for f, w in zip(names, weights, strict=True)}, bias)


def _score_batches(handle):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = handle.value
        for batch in batches:
            scores = [model.score(t) for t in byte_values(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    return run


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``; only the text is scored.

    A null or empty text has the score of the bias alone; texts of any length are scored whole; equal
    texts have equal scores, repeated rows too; other columns are not read; a null id is not held out;
    an empty table gives no rows.
    """
    handle = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(column(key).cast("long").alias("doc_id"), held_out(column(key)).alias("held_out"), column(text).cast("string").alias("text"))
    scored = chosen.mapInArrow(frugal(_score_batches(handle)), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
