import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trajspark.operators import bounds as bd
from trajspark.sources.frames import load_bounds, save_bounds


def make_bounds(spark, pairs):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pairs)], "dim int, lower double, upper double")


def make_frames(spark, vectors):
    return spark.createDataFrame([(v,) for v in vectors], "action array<double>")


def normalize(spark, vectors, pairs):
    out = bd.normalize_actions(make_frames(spark, vectors), make_bounds(spark, pairs))
    return [r["action"] for r in out.collect()]


def test_constant_dimension_becomes_minus_one(spark):
    assert normalize(spark, [[5.0]], [(5, 5)]) == [[-1.0]]


def test_values_outside_are_clamped_first(spark):
    low, high = normalize(spark, [[-100.0], [100.0]], [(-1, 3)])
    assert low == [-1.0] and high[0] == pytest.approx(1.0, abs=1e-8)


def test_null_and_nan_survive(spark):
    (got,) = normalize(spark, [[None, float("nan"), 0.5]], [(0, 1)] * 3)
    assert got[0] is None and math.isnan(got[1]) and got[2] == pytest.approx(0.0, abs=1e-7)


def test_null_vector_stays_null(spark):
    assert normalize(spark, [None, [1.0]], [(0, 1)])[0] is None


def test_wrong_length_fails(spark):
    with pytest.raises(Exception, match="differ in length"):
        normalize(spark, [[1.0, 2.0]], [(0, 1)])


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(-1e3, 1e3), st.floats(-1e3, 1e3), st.floats(-2e3, 2e3)), min_size=1, max_size=4))
def test_round_trip_is_the_clamped_value(spark, triples):
    pairs = [(min(a, b), max(a, b)) for a, b, _ in triples]
    vector = [x for _, _, x in triples]
    bounds = make_bounds(spark, pairs)
    normal = bd.normalize_actions(make_frames(spark, [vector]), bounds)
    (n,) = [r["action"] for r in normal.collect()]
    (back,) = [r["action"] for r in bd.unnormalize_actions(normal, bounds).collect()]
    for x, (lo, hi), y, z in zip(vector, pairs, n, back):
        assert -1.0 <= y <= 1.0
        assert z == pytest.approx(min(max(x, lo), hi), abs=1e-9)


def test_long_vectors_take_the_lambda_form_with_the_same_result(spark, monkeypatch):
    vectors, pairs = [[0.5, None, 7.0], [float("-inf"), 2.0, -1.0]], [(0, 1), (1, 3), (-2, 2)]
    unrolled = normalize(spark, vectors, pairs)
    monkeypatch.setattr(bd, "UNROLLED_DIMS", 2)
    assert normalize(spark, vectors, pairs) == unrolled
    with pytest.raises(Exception, match="differ in length"):
        normalize(spark, [[1.0]], pairs)


@pytest.mark.parametrize("bad", [[(0, 1.0, 0.0)], [(1, 0.0, 1.0)], [(0, 0.0, 1.0), (0, 0.0, 1.0)], [(0, None, 1.0)], [(0, float("nan"), 1.0)]])
def test_unfit_bounds_are_refused(spark, bad):
    with pytest.raises(ValueError):
        bd.normalize_actions(make_frames(spark, [[1.0]]), spark.createDataFrame(bad, "dim int, lower double, upper double"))


def test_check_bounds(spark):
    good, bad = make_bounds(spark, [(0, 1), (2, 2)]), make_bounds(spark, [(0, 1), (3, 2)])
    assert bd.check_bounds(good) is good
    with pytest.raises(ValueError):
        bd.check_bounds(bad)
    for broken in ([(0, float("nan"))], [(float("nan"), 0)]):
        with pytest.raises(ValueError):
            bd.check_bounds(make_bounds(spark, broken))
    assert bd.assert_bounds(good).count() == 2
    with pytest.raises(Exception, match="bad bounds in dimension 1"):
        bd.assert_bounds(bad).collect()


@pytest.mark.parametrize("n", [1, 2, 3, 100, 1001])
@pytest.mark.parametrize("partitions", [3, None])
def test_exact_quantiles(spark, n, partitions):
    rng = np.random.default_rng(n)
    data = np.stack([rng.normal(size=n), np.round(rng.exponential(size=n), 1), np.full(n, 3.0)], axis=1)
    data[: n // 3, 1] = 0.5  # a third of the rows share one value
    fitted = bd.fit_bounds(make_frames(spark, data.tolist()), 0.05, 0.9, accuracy=50, partitions=partitions)
    for r in fitted.collect():
        column = data[:, r["dim"]]
        assert r["lower"] == pytest.approx(np.quantile(column, 0.05), abs=1e-12)
        assert r["upper"] == pytest.approx(np.quantile(column, 0.9), abs=1e-12)


def test_a_bracket_that_misses_is_noticed_and_repaired(spark, monkeypatch):
    """The sketch is made to answer far off; the second try must give the exact result."""
    real = F.percentile_approx
    monkeypatch.setattr(bd.F, "percentile_approx", lambda *a: F.transform(real(*a), lambda v: v + 1e6))
    data = [[float(i)] for i in range(101)]
    (r,) = bd.fit_bounds(make_frames(spark, data), 0.1, 0.9).collect()
    assert (r["lower"], r["upper"]) == (pytest.approx(10.0), pytest.approx(90.0))


def test_fit_skips_null_and_nan_and_may_use_some_episodes(spark):
    df = spark.createDataFrame(
        [(1, [1.0, None]), (1, [float("nan"), 4.0]), (1, [3.0, 8.0]), (2, [1000.0, 1000.0])],
        "episode_index long, action array<double>",
    )
    only = spark.createDataFrame([(1,)], "episode_index long")
    fitted = {r["dim"]: (r["lower"], r["upper"]) for r in bd.fit_bounds(df, 0.0, 1.0, episodes=only).collect()}
    assert fitted == {0: (1.0, 3.0), 1: (4.0, 8.0)}
    assert bd.fit_bounds(df, 0.0, 1.0, exact=False).where("dim = 0").first()["upper"] == 1000.0


def test_sketch_stays_within_its_rank_error(spark):
    data = np.random.default_rng(0).lognormal(size=5000)
    (r,) = bd.fit_bounds(make_frames(spark, [[float(x)] for x in data]), 0.1, 0.9, exact=False, accuracy=100).collect()
    assert abs((data <= r["lower"]).mean() - 0.1) <= 0.011 and abs((data <= r["upper"]).mean() - 0.9) <= 0.011


def test_bounds_from_stats(spark):
    stats = spark.createDataFrame([([0.0, 1.0], [2.0, 3.0])], "q01 array<double>, q99 array<double>")
    assert [tuple(r) for r in bd.bounds_from_stats(stats).orderBy("dim").collect()] == [(0, 0.0, 2.0), (1, 1.0, 3.0)]


def test_save_and_load(spark, tmp_path):
    bounds = make_bounds(spark, [(0, 1), (2, 3)])
    save_bounds(bounds, str(tmp_path / "b"))
    assert sorted(map(tuple, load_bounds(spark, str(tmp_path / "b")).collect())) == [(0, 0.0, 1.0), (1, 2.0, 3.0)]
    make_bounds(spark, [(1, 0)]).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        load_bounds(spark, str(tmp_path / "bad"))
