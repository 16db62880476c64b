"""Quality by Bradley-Terry ranking of documents.

A document's raw score is a weighted sum of features of its text. The weights make good documents win against bad ones:
logistic loss on feature differences over preference pairs (a row labelled 1 is preferred to a row labelled 0). The
threshold is the quantile of the raw scores of the labelled rows below which a share of them lies that equals the share
of label 0; a logistic curve through that point turns raw scores into 0 to 1.

The weights are learned from at most ``LABELLED`` documents of each label, those with the smallest hash of the id (a
documented bound; the model has some fifty weights). The threshold is the exact quantile over all labelled documents
that aren't held out. Scoring covers every row and every whole text.

Defined results: a null text is the empty text; without labels of both kinds every score is 0.5; rows with null id or
label aren't learned from, and a null id counts as held out; several labels of one id count as the largest, as do the
scores of several texts of one id; repeated rows each get the same result; other columns are never looked at.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from trajspark.llm.common import annotate, free_name
from trajspark.llm.language import held_out
from trajspark.session import materialize

LABELLED = 20_000   # documents of each label to learn the weights from, at most
PAIRS = 200_000     # preference pairs drawn from them
THRESHOLD = 0.3     # of the 0 to 1 score
RIDGE = 1e-3

MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_UPPER = np.arange(65, 91)
_LOWER = np.arange(97, 123)
_DIGITS = np.arange(48, 58)
_WHITE = np.array([9, 10, 11, 12, 13, 32])
_MARKS = np.frombuffer(MARKS, np.uint8)
FEATURES = 15 + len(MARKS)


def features(text: bytes | None) -> np.ndarray:
    """Shares of kinds of characters, and the length, variety and repetition of words and lines."""
    data = text or b""
    size = max(1, len(data))
    bytes_of = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    tokens = data.split()
    n = max(1, len(tokens))
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens)) if tokens else np.zeros(1, np.int64)
    lines = [x for x in data.split(b"\n") if x]
    pairs = set(zip(tokens, tokens[1:]))
    marked = sum(1 for t in tokens if t[-1] in MARKS)
    upper, lower = bytes_of[_UPPER].sum(), bytes_of[_LOWER].sum()
    own = [
        np.log1p(size), np.log1p(len(tokens)), lengths.mean(), lengths.std(), np.log1p(lengths.max()),
        upper / max(1, upper + lower), lower / size, bytes_of[_DIGITS].sum() / size, bytes_of[_WHITE].sum() / size,
        bytes_of[128:].sum() / size, marked / n, len(pairs) / n,
        sum(map(operator.eq, tokens, tokens[1:])) / n, 1 - len(set(lines)) / max(1, len(lines)),
        np.log1p(len(tokens) / max(1, len(lines))),
    ]
    return np.concatenate((own, np.sqrt(bytes_of[_MARKS] / n)))


@dataclass(frozen=True)
class Ranking:
    """Weights on standardised features, and the raw score that becomes ``THRESHOLD``."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float | None

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.cut is None:
            return np.full(len(rows), 0.5)
        raw = self.raw(rows) - self.cut + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(raw, -500, 500)))

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return np.clip((rows - self.mean) / self.spread, -10, 10) @ self.weights


def fit_pairs(rows: np.ndarray, good: np.ndarray, pairs: int = PAIRS, seed: int = 42) -> Ranking:
    """Newton steps on the Bradley-Terry loss over pairs of a good and a bad row."""
    width = FEATURES if rows.size == 0 else rows.shape[1]
    if good.all() or not good.any():
        return Ranking(np.zeros(width), np.ones(width), np.zeros(width), None)
    mean, spread = rows.mean(axis=0), rows.std(axis=0)
    spread[spread < 1e-9] = 1.0
    scaled = np.clip((rows - mean) / spread, -10, 10)
    rng = np.random.default_rng(seed)
    winners, losers = np.flatnonzero(good), np.flatnonzero(~good)
    count = min(pairs, 20 * len(rows))
    apart = scaled[rng.choice(winners, count)] - scaled[rng.choice(losers, count)]
    weights = np.zeros(width)
    for _ in range(25):
        lost = 1 / (1 + np.exp(np.clip(apart @ weights, -500, 500)))
        slope = RIDGE * weights - apart.T @ lost / count
        curve = (apart * (lost * (1 - lost))[:, None]).T @ apart / count + RIDGE * np.eye(width)
        step = np.linalg.solve(curve, slope)
        weights = weights - step
        if np.abs(step).max() < 1e-8:
            break
    model = Ranking(mean, spread, weights, 0.0)
    raw = np.sort(model.raw(rows))
    share = int((~good).sum())
    return Ranking(mean, spread, weights, float((raw[share - 1] + raw[share]) / 2))


def learn(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Ranking:
    """Fit the ranking on labelled rows that aren't held out: weights on a sample of each label, the cut on all."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(folds=5, fold=0))
    known = materialize(
        usable.groupBy("doc_id").agg(F.max("quality").alias("quality")).join(docs.select("doc_id"), "doc_id", "left_semi"),
        "quality-labels",
    )
    order = [F.xxhash64(F.col("doc_id").cast("long")), F.col("doc_id")]
    chosen = known.where("quality = 0").orderBy(*order).limit(labelled).unionByName(
        known.where("quality = 1").orderBy(*order).limit(labelled)
    )
    # At most twice ``labelled`` ids, so this side may be broadcast whatever the size of the corpus.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    added = StructType([StructField("_features", ArrayType(DoubleType()))])
    found = annotate(texts, "text", added, lambda batch: [pa.array([features(t).tolist() for t in batch], pa.list_(pa.float64()))])
    rows = found.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("_features").alias("f")).orderBy("doc_id").collect()
    model = fit_pairs(np.array([r["f"] for r in rows], float), np.array([r["quality"] == 1 for r in rows], bool))
    return model if model.cut is None else replace(model, cut=_cut(docs, known, model))


def _cut(docs: DataFrame, known: DataFrame, model: Ranking) -> float:
    """The middle between the two raw scores of labelled documents that the share of label 0 lies between."""

    def each(texts: Iterable[bytes | None]) -> list[pa.Array]:
        rows = [features(t) for t in texts]
        return [pa.array(model.raw(np.array(rows)) if rows else [], pa.float64())]

    # Texts are scored where they are read; only ids and scores are shuffled.
    scored = annotate(docs.select("doc_id", "text"), "text", StructType([StructField("_raw", DoubleType())]), each)
    raw = materialize(
        scored.select("doc_id", "_raw").join(known, "doc_id").groupBy("doc_id").agg(F.max("_raw").alias("raw")), "quality-raw"
    )
    share = known.where("quality = 0").count()
    return (nth_smallest(raw, share - 1) + nth_smallest(raw, share)) / 2


def nth_smallest(values: DataFrame, n: int, bins: int = 4096, few: int = LABELLED) -> float:
    """The value of column raw with n smaller or equal ones before it, exactly and without sorting them all.

    Values are counted in bins, then those of the bin that holds the n-th, until few are left or all are equal.
    """
    low, high, count = values.agg(F.min("raw"), F.max("raw"), F.count("raw")).first()
    while low < high and count > few:
        at = F.least(F.floor((F.col("raw") - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
        binned = values.withColumn("bin", at)
        for r in sorted(binned.groupBy("bin").agg(
            F.min("raw").alias("low"), F.max("raw").alias("high"), F.count("raw").alias("count")
        ).collect()):
            if n < r["count"]:
                break
            n -= r["count"]
        values, low, high, count = binned.where(F.col("bin") == r["bin"]).drop("bin"), r["low"], r["high"], r["count"]
    return low if low == high else sorted(r["raw"] for r in values.select("raw").collect())[n]


def score(docs: DataFrame, model: Ranking, name: str = "score") -> DataFrame:
    """``docs`` with a score of 0 to 1 for each row."""

    def each(texts: Iterable[bytes | None]) -> list[pa.Array]:
        rows = [features(t) for t in texts]
        return [pa.array(model.score(np.array(rows)) if rows else [], pa.float64())]

    return annotate(docs, "text", StructType([StructField(name, DoubleType())]), each)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` that score ``THRESHOLD`` or more; columns as they are."""
    name = free_name(docs, "quality_score")
    return score(docs, learn(docs, labels), name).where(F.col(name) >= THRESHOLD).drop(name)
