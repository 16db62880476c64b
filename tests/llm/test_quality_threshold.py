import random

import numpy as np
import pytest

from tests.llm.conftest import SMALL
from trajspark.llm import quality
from trajspark.llm.language import held_out


def labelled_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = labels.where(~held_out(folds=5, fold=0)).join(docs, "doc_id").select("doc_id", "quality", "text").collect()
    return docs, labels, rows


def test_threshold_is_the_quantile_of_all_labelled_rows(spark):
    docs, labels, rows = labelled_rows(spark)
    model = quality.learn(docs, labels, labelled=20)
    raw = np.sort(model.raw(np.array([quality.features(r.text.encode()) for r in rows])))
    share = sum(r.quality == 0 for r in rows)
    assert len(rows) > 100 and model.cut == pytest.approx((raw[share - 1] + raw[share]) / 2, abs=1e-9)


def test_rare_label_and_labels_without_a_document(spark):
    docs, labels, rows = labelled_rows(spark)
    bad = min(r.doc_id for r in rows if r.quality == 0)
    good = [r.doc_id for r in rows if r.quality == 1]
    absent = [10**9 + i for i in range(5000)]
    few = spark.createDataFrame([(bad, 0)] + [(i, 1) for i in good + absent], "doc_id long, quality int")
    model = quality.learn(docs, few, labelled=10)
    assert model.cut is not None and np.abs(model.weights).max() > 0


def test_nth_smallest_in_several_rounds(spark):
    rng = random.Random(1)
    values = [rng.gauss(0, 1) ** 9 for _ in range(300)] + [0.25] * 100
    frame = spark.createDataFrame([(v,) for v in values], "raw double")
    for n in (0, 57, 150, 200, 399):
        assert quality.nth_smallest(frame, n, bins=8, few=5) == sorted(values)[n]
