"""Language identification by rank-order profiles of character n-grams.

The profile of a language lists its most frequent 1- to 3-grams by rank. A document is ranked the same way, and goes to
the language whose profile is nearest by out-of-place distance: the sum, over the n-grams of the document, of
how far each is from its place in the profile (``size`` for one that isn't there).

An n-gram of up to three code points is packed into one integer (21 bits each). Counts are taken over words with a
space on either side, from all training texts; ties of rank go to the smaller integer, ties of distance to the smaller
language name.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is every text when there is
nothing to learn from; rows with null text, null language or null id are not learned from; a null id
counts as held out; repeated rows each get the same result; other columns are never looked at.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from trajspark.llm.common import annotate, free_name

SIZE = 300        # n-grams in a profile
UNKNOWN = "und"
MIN_SCORE = 0.05  # the pipeline lets documents go that are less like any language
LETTERS = re.compile(r"[^\W\d_]+")
SHIFT, SPACE = 21, 32
SALTS = 64
COUNTED = 2048    # rows whose words are counted together, at least

Profiles = Mapping[str, np.ndarray]


def held_out(doc_id: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(True))


def words(text: bytes | None) -> Counter[str]:
    return Counter(LETTERS.findall((text or b"").decode("utf-8", "replace").lower()))


def ngrams(counts: Mapping[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The packed 1- to 3-grams of the words, each word between spaces, and how often each occurs (sorted by n-gram)."""
    points = np.frombuffer((" " + " ".join(counts) + " ").encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    # Position of each word's leading space and letters carry the count of that word.
    runs = np.fromiter(map(len, counts), np.int64, len(counts)) + 1
    weights = np.repeat(np.fromiter(counts.values(), np.int64, len(counts)), runs)
    one = points[:-1] != SPACE
    three = points[1:-1] != SPACE
    two = points[:-1] << SHIFT | points[1:]
    codes = np.concatenate((points[:-1][one], two, (two[:-1] << SHIFT | points[2:])[three]))
    each = np.concatenate((weights[one], weights, weights[:-1][three]))
    order = np.argsort(codes, kind="stable")
    codes, each = codes[order], each[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.add.reduceat(each, first)


def ranked(counts: Mapping[str, int], size: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first."""
    codes, each = ngrams(counts)
    return codes[np.argsort(-each, kind="stable")[:size]]


def learn(docs: DataFrame, size: int = SIZE) -> dict[str, np.ndarray]:
    """Profiles from all rows of ``docs`` that have a language and aren't held out: ``size`` n-grams per language.

    Tasks count words per ``COUNTED`` rows, then the n-grams of the distinct words; Spark adds the counts up. Only the profiles
    themselves reach the driver.
    """
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("binary").alias("text")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[str, Counter[str]] = defaultdict(Counter)
        counted = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                met[lang].update(words(text))
            counted += batch.num_rows
            if counted >= COUNTED:
                yield from given(met)
                met.clear()
                counted = 0
        yield from given(met)

    def given(met: dict[str, Counter[str]]) -> Iterator[pa.RecordBatch]:
        for lang, counts in met.items():
            if counts:
                codes, each = ngrams(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(each)], names=["lang", "code", "n"]
                )

    totals = rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # The best of each part first, so that no task sorts all n-grams of a language.
    best = [F.desc("n"), F.asc("code")]
    salted = totals.withColumn("salt", F.pmod(F.xxhash64("code"), F.lit(SALTS)))
    for keys in (["lang", "salt"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*best))
        salted = salted.withColumn("rank", rank).where(F.col("rank") <= size)
    profiles: dict[str, list[int]] = defaultdict(list)
    for row in salted.select("lang", "code", "rank").orderBy("lang", "rank").toLocalIterator():
        profiles[row["lang"]].append(row["code"])
    return {lang: np.array(codes, np.int64) for lang, codes in profiles.items()}


class Places:
    """The ranks of all profiles in one table: a row per n-gram, a column per language."""

    def __init__(self, profiles: Profiles, size: int) -> None:
        self.langs, self.size = sorted(profiles), size
        self.codes = np.unique(np.concatenate([profiles[x] for x in self.langs] or [np.zeros(0, np.int64)]))
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)  # the last row: in no profile
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, profiles[lang]), k] = np.arange(len(profiles[lang]))

    def nearest(self, text: bytes | None) -> tuple[str, float]:
        counts = words(text)
        if not counts or not self.langs:
            return UNKNOWN, 0.0
        grams = ranked(counts, self.size)
        at = np.searchsorted(self.codes, grams)
        at[self.codes[np.minimum(at, len(self.codes) - 1)] != grams] = len(self.codes)
        places = self.ranks[at]
        apart = np.where(places < 0, self.size, np.abs(places - np.arange(len(grams))[:, None])).sum(axis=0)
        best = int(apart.argmin())
        return self.langs[best], 1 - float(apart[best]) / (self.size * len(grams))


def identify(docs: DataFrame, profiles: Profiles, size: int = SIZE, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the predicted language and a score of 0 to 1 (1: all n-grams at their place in the profile)."""
    places = Places(profiles, size)

    def each(texts: Iterable[bytes | None]) -> list[pa.Array]:
        found = [places.nearest(t) for t in texts]
        return [pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())]

    return annotate(docs, "text", StructType([StructField(names[0], StringType()), StructField(names[1], DoubleType())]), each)


def keep_known(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without texts in no language: ``und``, or less like any profile than ``min_score``."""
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    found = identify(docs, learn(docs), names=(lang, score))
    return found.where((F.col(lang) != UNKNOWN) & (F.col(score) >= min_score)).drop(lang, score)
