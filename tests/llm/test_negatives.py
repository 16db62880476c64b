import random

import numpy as np
import pytest
from pyspark.errors import PySparkException

from tests.conftest import rows
from trajspark.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, extra string"


def brute(data):
    usable = {}
    for i, v, label, *_ in data:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(np.float32(x)) for x in v):
            continue
        whole = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        if i % 7 == 0:
            label = (label + 1) % 10
        found = (len(v), label, whole)
        usable[i] = min(usable.get(i, found), found)
    result = []
    for a, (dim, label, v) in usable.items():
        if a % 100:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(v, w)), b, label == other)
            for b, (d, other, w) in usable.items() if d == dim and b != a
        )
        for score, p in [(-s, b) for s, b, same in scored if same][:5]:
            fits = [(-s, b) for s, b, same in scored if not same and 30 * score <= -100 * s <= 90 * score]
            result += [(a, p, r, b, score, s) for r, (s, b) in enumerate(fits[:10], 1)]
    return sorted(result, key=repr)


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (16, 16, 16), (33, 64, 70), (65, 17, 130), (40, 0, 40)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(sum(shape))
    m, k, n = shape
    a, b = rng.integers(-10**8, 10**8, (m, k)), rng.integers(-10**8, 10**8, (k, n))
    for leaf in (1, 4, 16):
        assert (negatives.strassen(a, b, leaf) == a @ b).all()


def test_heaps_keep_the_best_and_prefer_smaller_ids():
    rng = random.Random(2)
    heaps, offered = negatives.Heaps(3, 4), [[] for _ in range(3)]
    for start in range(0, 400, 80):
        scores = np.array([[rng.randint(0, 5) for _ in range(80)] for _ in range(3)])
        may = np.array([[rng.random() < 0.8 for _ in range(80)] for _ in range(3)])
        heaps.offer(0, scores, may, np.arange(start, start + 80))
        for r in range(3):
            offered[r] += [(-int(scores[r, c]), start + c) for c in range(80) if may[r, c]]
    for r in range(3):
        mine = heaps.row == r
        assert list(zip((-heaps.score[mine]).tolist(), heaps.id[mine].tolist())) == sorted(offered[r])[:4]


def sample(seed, n=700, dim=6):
    rng = random.Random(seed)
    hot = [rng.gauss(0.3, 0.2) for _ in range(dim)]
    data = []
    for i in range(n):
        kind = rng.random()
        v = hot if kind < 0.33 else [rng.gauss(0.1, 0.3) for _ in range(dim)]  # a third share one vector
        data.append((i * 5, [round(x, 2) for x in v], 3 if kind < 0.4 else rng.randrange(10), "x"))
    return data


def test_equals_brute_force_with_odd_rows(spark, monkeypatch):
    data = sample(1) + [
        (None, [1.0] * 6, 1, ""), (100, [0.1] * 6, 2, ""), (100, [0.1] * 6, 2, ""), (200, None, 1, ""), (300, [0.1] * 6, None, ""),
        (401, [float("nan")] + [0.1] * 5, 3, ""), (402, [float("inf")] * 6, 3, ""), (403, [None] + [0.1] * 5, 3, ""),
        (600, [], 3, ""), (601, [], 3, ""), (602, [], 4, ""), (700, [1.0, 2.0], 1, ""), (701, [1.0, 2.0], 1, ""),
        (-700, [1.0, 0.5], 1, ""), (702, [0.5, 0.5], 2, ""), (10_000, [0.0] * 6, 1, ""), (10_100, [-0.5] * 6, 1, ""),
    ]
    random.Random(3).shuffle(data)
    frame = spark.createDataFrame(data, SCHEMA)
    expected = brute(data)
    assert len(expected) > 500
    assert rows(negatives.mine(frame)) == expected
    for name, value in (("ANCHOR_BLOCK", 30), ("CANDIDATE_BLOCK", 300), ("ROWS", 3), ("COLUMNS", 17), ("TASKS", 5)):
        monkeypatch.setattr(negatives, name, value)
    assert rows(negatives.mine(frame)) == expected


def test_empty_tables_and_large_components(spark):
    assert negatives.mine(spark.createDataFrame([], SCHEMA)).collect() == []
    assert negatives.mine(spark.createDataFrame([(1, [0.5], 1, "")], SCHEMA)).collect() == []
    big = [(100, [2.0**20, 0.0], 1, ""), (101, [2.0**20, 0.0], 1, ""), (102, [2.0**19, 1.0], 2, "")]
    assert rows(negatives.mine(spark.createDataFrame(big, SCHEMA))) == brute(big)
    with pytest.raises(PySparkException, match="too large"):
        negatives.mine(spark.createDataFrame([(100, [1e30], 1, "")], SCHEMA)).collect()
