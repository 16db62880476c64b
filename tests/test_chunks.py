import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trajspark.operators import chunks as ch
from trajspark.operators.bounds import normalize_actions


def make_frames(spark, sizes, dim=1):
    rows = [(e, i, [float(100 * e + i + d) for d in range(dim)]) for e, n in sizes.items() for i in range(n)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "episode_index long, frame_index long, action array<double>").repartition(3)


def brute(sizes, k):
    return {(e, i): [[float(100 * e + min(i + s, n - 1))] for s in range(k)] for e, n in sizes.items() for i in range(n)}


@pytest.mark.parametrize("block_rows", [8, 11, 16, 1 << 16])
@pytest.mark.parametrize("k", [1, 3, 8])
def test_chunks_by_brute_force(spark, k, block_rows):
    sizes = {0: 3, 1: 70, 2: 1, 3: 16, 4: 17, 5: 8}
    got = ch.action_chunk(make_frames(spark, sizes), k, block_rows=block_rows)
    assert {(r["episode_index"], r["frame_index"]): r["action_chunk"] for r in got.collect()} == brute(sizes, k)


def test_short_episode_repeats_its_last_action(spark):
    got = ch.action_chunk(make_frames(spark, {0: 3}), 8).orderBy("frame_index").collect()
    flat = [[v[0] for v in r["action_chunk"]] for r in got]
    assert flat == [[0, 1, 2, 2, 2, 2, 2, 2], [1, 2, 2, 2, 2, 2, 2, 2], [2] * 8]


def test_normalising_inside_equals_normalising_before(spark):
    frames = make_frames(spark, {0: 9, 1: 4}, dim=2)
    bounds = spark.createDataFrame([(0, 1.0, 100.0), (1, 0.0, 50.0)], "dim int, lower double, upper double")
    inside = ch.action_chunk(frames, 4, bounds)
    before = ch.action_chunk(normalize_actions(frames, bounds), 4)
    key = ["episode_index", "frame_index", "action_chunk"]
    assert sorted(map(tuple, inside.select(key).collect())) == sorted(map(tuple, before.select(key).collect()))
    assert inside.select("action").exceptAll(frames.select("action")).isEmpty()  # the raw action is kept


def test_null_action_keeps_its_step(spark):
    df = spark.createDataFrame([(0, 0, [1.0]), (0, 1, None), (0, 2, [3.0])], "episode_index long, frame_index long, action array<double>")
    first = ch.action_chunk(df, 4).where("frame_index = 0").first()["action_chunk"]
    assert first == [[1.0], None, [3.0], [3.0]]


@pytest.mark.parametrize("indexes", [[0, 1, 3, 4], [0, 1, 1, 2], [3, 4, 5], [1], [5, 6]])
def test_gap_duplicate_or_late_start_fails(spark, indexes):
    df = spark.createDataFrame([(0, i, [1.0]) for i in indexes], "episode_index long, frame_index long, action array<double>")
    for k in (1, 2):
        for block_rows in (1, 2, 4, 1 << 16):
            with pytest.raises(Exception, match="gap or a duplicate"):
                ch.action_chunk(df, k, block_rows=block_rows).collect()


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(1, 40), st.data())
def test_every_gap_fails_at_every_block_size(spark, n, data):
    """A run of missing frames anywhere but at the end; without one the chunks are those of brute force."""
    first = data.draw(st.integers(0, n))
    missing = data.draw(st.integers(0, n - first))
    k, block_rows = data.draw(st.integers(1, 9)), data.draw(st.integers(1, 20))
    left = [i for i in range(n) if not first <= i < first + missing]
    df = spark.createDataFrame([(0, i, [float(i)]) for i in left], "episode_index long, frame_index long, action array<double>").coalesce(1)
    got = ch.action_chunk(df, k, block_rows=block_rows)
    if left and left != list(range(len(left))):
        with pytest.raises(Exception, match="gap or a duplicate"):
            got.collect()
    else:
        want = {(0, i): [[float(min(i + s, len(left) - 1))] for s in range(k)] for i in left}
        assert {(r["episode_index"], r["frame_index"]): r["action_chunk"] for r in got.collect()} == want


def test_long_gap_at_the_edge_of_a_default_block_fails(spark):
    kept = spark.range(65_550).where("id < 65536 or id > 65542")
    df = kept.select(F.lit(0).alias("episode_index"), F.col("id").alias("frame_index"), F.array(F.lit(1.0)).alias("action"))
    with pytest.raises(Exception, match="gap or a duplicate"):
        ch.action_chunk(df, 8).count()


def test_validate_chunks(spark):
    good = ch.action_chunk(make_frames(spark, {0: 3}), 4)
    assert ch.validate_chunks(good, 4) is good
    with pytest.raises(ValueError):
        ch.validate_chunks(good, 5)
    with pytest.raises(ValueError):
        ch.validate_chunks(good.withColumn("action_chunk", F.lit(None).cast("array<array<double>>")), 4)


def test_stack_is_the_inverse_of_unstack(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]), (2, [[7.0, 8.0]])], "k long, action_chunk array<array<double>>")
    back = ch.stack_chunks(ch.unstack_chunks(df).repartition(3), "k")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_stack_vector(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 6.0],)], "action_chunk array<double>")
    assert ch.stack_vector(df, "action_chunk", 2).first()[0] == [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]
