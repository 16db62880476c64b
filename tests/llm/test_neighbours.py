import math
import random

import numpy as np

from tests.llm.conftest import SMALL
from trajspark.llm import neighbours as nn

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, dim string"


def product(v, w):
    """Added up in order, without the corrections that sum() makes."""
    total = 0.0
    for a, b in zip(v, w):
        total += a * b
    return total


def brute(rows, k):
    known = {}
    for i, v in rows:
        usable = v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        if i is not None and usable:
            v = [float(np.float32(x)) for x in v]
            known[i] = min(v, known.get(i, v))
    out = {}
    for q, v in known.items():
        if q % 20 == 0:
            scored = [(-product(v, w), c) for c, w in known.items() if c != q and len(w) == len(v)]
            out[q] = [(r, c, -s) for r, (s, c) in enumerate(sorted(scored)[:k], 1)]
    return {q: x for q, x in out.items() if x}


def found(spark, rows, k):
    frame = spark.createDataFrame([(i, v, 0, 0, "") for i, v in rows], SCHEMA)
    out = {}
    for r in nn.search(frame.where("vec_id % 20 = 0"), frame, k).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(x) for q, x in out.items()}


def test_odd_vectors_match_brute_force(spark):
    rng = random.Random(4)
    vector = lambda n=8: [rng.gauss(0, 1) for _ in range(n)]
    same = vector()
    rows = [(i, vector()) for i in range(60)] + [(60 + i, same) for i in range(40)] + [(i, vector(3)) for i in range(100, 130)]
    rows += [(200, None), (201, [0.0] * 8), (202, [None] * 8), (203, [float("nan")] * 8), (204, [float("inf")] * 8), (205, []),
             (220, [0.0] * 8), (None, vector()), (5, vector()), (20, vector()), (20, vector()), (240, [1.0] * 5), (300, [1e30] * 8)]
    assert found(spark, rows, 7) == brute(rows, 7)
    assert found(spark, rows[:3], 20) == brute(rows[:3], 20)
    assert found(spark, [], 5) == {}


def test_small_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 16)))]
    monkeypatch.setattr(nn, "QUERY_BLOCK", 100)
    monkeypatch.setattr(nn, "CANDIDATE_BLOCK", 1000)
    monkeypatch.setattr(nn, "PAIRS", 500)
    assert found(spark, rows, 10) == brute(rows, 10)


def test_bound_prunes_and_recall_is_near_one(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    vectors = np.array([r.embedding for r in rows], float)
    codes, factor, error = nn.encode(vectors)
    turn = nn.rotation(vectors.shape[1])
    signs = np.unpackbits(codes, axis=1, count=len(turn)) * 2.0 - 1
    estimate = (vectors @ turn.T) @ signs.T * factor
    exact = vectors @ vectors.T
    length = np.linalg.norm(vectors, axis=1)
    off = np.abs(estimate - exact) > error[None, :] * length[:, None]
    assert off.mean() < 0.005
    bar = np.sort(exact, axis=1)[:, -21]
    assert ((estimate + error * length[:, None]) >= bar[:, None]).mean() < 0.5
