from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import SMALL, odd_texts
from trajspark.llm import language, quality
from trajspark.llm.queries import QUERIES


def plain_grams(text):
    counts = Counter()
    for word in language.LETTERS.findall(text.lower()):
        padded = f" {word} "
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                gram = padded[i : i + n]
                if gram != " ":
                    counts[gram] += 1
    return counts


def unpack(code):
    points = []
    while code:
        points.append(chr(code & (1 << language.SHIFT) - 1))
        code >>= language.SHIFT
    return "".join(reversed(points))


def test_ngrams_equal_plain_form():
    for text in ["the cat, The hat a", "Ünï çødé 漢字", "x", "a1b2"]:
        codes, each = language.ngrams(language.words(text.encode()))
        assert {unpack(int(c)): int(n) for c, n in zip(codes, each)} == dict(plain_grams(text))


def test_profiles_and_distances_equal_plain_form(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("h", language.held_out()).collect()
    totals = {}
    for r in rows:
        if not r.h:
            totals.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    pack = lambda g: sum(ord(x) << language.SHIFT * k for k, x in enumerate(reversed(g)))
    top = lambda c: sorted(c, key=lambda g: (-c[g], pack(g)))[: language.SIZE]
    profiles = {lang: {g: k for k, g in enumerate(top(c))} for lang, c in totals.items()}
    found = {r.doc_id: r for r in QUERIES["op8_language"](spark, SMALL).collect()}
    assert len(found) == len(rows)
    for r in rows[:150]:
        grams = top(plain_grams(r.text))
        apart = {
            lang: sum(abs(p[g] - k) if g in p else language.SIZE for k, g in enumerate(grams)) for lang, p in profiles.items()
        }
        best = min(sorted(apart), key=apart.get)
        assert found[r.doc_id].lang_pred == best
        assert abs(found[r.doc_id].score - (1 - apart[best] / language.SIZE / len(grams))) < 1e-12


def test_held_out_languages_are_found(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    held = [r for r in QUERIES["op8_language"](spark, SMALL).collect() if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) > 0.97


def test_language_of_odd_rows(docs, spark):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(None, "a b"), (6, "a b")]
    odd = docs(rows).withColumns({c: F.lit(7) for c in ("language", "_llm_text", "quality_score")})
    profiles = language.learn(spark.read.parquet(f"{SMALL}/documents.parquet"))
    found = language.identify(odd, profiles).collect()
    assert len(found) == len(rows)
    assert {r.lang_pred for r in found if r.doc_id in (0, 1, 2, 12, 13)} == {"und"}
    assert all(r.lang_pred in profiles for r in found if r.doc_id in (3, 6, 9))
    assert {r.lang_pred for r in language.identify(odd, {}).collect()} == {"und"}
    assert language.learn(docs([])) == {} and language.learn(docs([(0, None, None), (None, "a", None)])) == {}
    clash = odd.withColumns({c: F.lit(1) for c in ("lang_pred", "lang_score")})
    left = language.keep_known(clash)
    assert left.columns == clash.columns and all(r.text for r in left.collect())


def test_pairs_are_learned_and_thresholded_by_quantile():
    rng = np.random.default_rng(0)
    good = rng.random(500) < 0.8
    rows = np.where(good[:, None], 1.0, -1.0) * np.array([1.0, 0.0, 0.5]) + rng.normal(0, 0.4, (500, 3))
    model = quality.fit_pairs(rows, good)
    score = model.score(rows)
    assert (score >= quality.THRESHOLD).sum() == good.sum()
    assert ((score >= quality.THRESHOLD) == good).mean() > 0.95
    assert (quality.fit_pairs(rows, np.ones(500, bool)).score(rows) == 0.5).all()
    assert (quality.fit_pairs(np.zeros((0, 3)), np.zeros(0, bool)).score(rows) == 0.5).all()


def test_held_out_quality(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    found = QUERIES["op9_quality"](spark, SMALL).collect()
    held = [r for r in found if r.held_out and r.doc_id in labels]
    assert len(found) == 1000 and all(0 <= r.score <= 1 for r in found)
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) > 0.97


def test_quality_of_odd_rows(docs, spark):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(None, "a b"), (6, "a b"), (6, "a b")]
    odd = docs(rows).withColumns({c: F.lit(7) for c in ("quality", "_features", "quality_score")})
    schema = "doc_id long, quality int, toxic int"
    few = [(i, i % 2, 0) for i in range(18)] + [(None, 1, 0), (4, None, 0), (3, 0, None), (3, 1, 0), (7, 5, 0)]
    for labels in (spark.createDataFrame(few, schema), spark.createDataFrame([], schema)):
        model = quality.learn(odd, labels)
        found = quality.score(odd, model).collect()
        assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
        left = quality.keep_good(odd, labels)
        assert left.columns == odd.columns and left.count() <= len(rows)
    assert quality.score(docs([]), model).collect() == []
