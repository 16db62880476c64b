import random

import pytest
from pyspark.sql import functions as F

from trajspark.operators import sketches as sk
from trajspark.operators.bounds import fit_bounds
from trajspark.session import scratch_path


def frames_of(spark, n=20_000):
    rng = random.Random(1)
    rows = [(0 if rng.random() < 0.4 else rng.randint(1, 30), [rng.gauss(0, 1), rng.expovariate(1), float(rng.randint(0, 3))]) for _ in range(n)]
    rows += [(5, [None, float("nan"), 1.0]), (6, None)]
    return spark.createDataFrame(rows, "episode_index long, action array<double>").repartition(5)


def as_dict(bounds):
    return {(r["dim"], end): r[end] for r in bounds.collect() for end in ("lower", "upper")}


def test_new_parts_change_the_bounds_without_old_frames(spark):
    frames, path = frames_of(spark), scratch_path(spark, "sketches")
    old, new = frames.where("episode_index < 20"), frames.where("episode_index >= 20")
    sk.store_sketches(sk.sketch_parts(old, "episode_index"), path)
    sk.store_sketches(sk.sketch_parts(new, "episode_index"), path)
    stored = sk.read_sketches(spark, path)
    exact = as_dict(fit_bounds(frames))
    assert as_dict(sk.refined_bounds(stored, frames)) == pytest.approx(exact)
    values = frames.select(F.posexplode("action").alias("dim", "v")).where("v IS NOT NULL AND NOT isnan(v)")
    for (dim, name), end in as_dict(sk.sketched_bounds(stored)).items():
        q = 0.01 if name == "lower" else 0.99
        below, upto = values.where(F.col("dim") == dim).agg(
            F.avg((F.col("v") < end).cast("double")), F.avg((F.col("v") <= end).cast("double"))).first()
        assert below - sk.rank_error() <= q <= upto + sk.rank_error()
    before = stored.agg(F.count("*"), F.sum("n")).first()
    sk.store_sketches(sk.sketch_parts(new, "episode_index"), path)  # once more
    assert sk.read_sketches(spark, path).agg(F.count("*"), F.sum("n")).first() == before


def test_order_of_merging_does_not_matter_beyond_the_error(spark):
    parts = sk.sketch_parts(frames_of(spark, 6000), "episode_index").collect()
    found = []
    for seed in range(3):
        random.Random(seed).shuffle(parts)
        found.append(as_dict(sk.sketched_bounds(spark.createDataFrame(parts, sk.SKETCHES).repartition(seed + 1))))
    for other in found[1:]:
        assert other == pytest.approx(found[0], abs=0.15)


def test_a_bracket_that_misses_is_noticed(spark):
    frames = frames_of(spark, 2000)
    wrong = sk.sketch_parts(frames.withColumn("action", F.transform("action", lambda x: x + 50)), "episode_index")
    assert as_dict(sk.refined_bounds(wrong, frames)) == pytest.approx(as_dict(fit_bounds(frames)))


def test_empty(spark):
    none = spark.createDataFrame([], "episode_index long, action array<double>")
    assert sk.sketched_bounds(sk.sketch_parts(none, "episode_index")).collect() == []
    assert sk.refined_bounds(sk.sketch_parts(none, "episode_index"), none).collect() == []
