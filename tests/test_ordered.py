"""Running totals and indexes: the split forms against brute force, with one group holding most rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trajspark.operators import episodes
from trajspark.operators.episodes import frame_index, global_index
from trajspark.plans import ordered


@pytest.fixture(scope="module")
def skewed():
    """Group 1 holds two thirds of the rows; positions have holes and come in random order."""
    rng = random.Random(7)
    rows = []
    for group, size in ((1, 400), (2, 1), (3, 150), (4, 49)):
        for position in rng.sample(range(size * 2), size):
            rows.append((group, position, rng.randint(0, 9)))
    rng.shuffle(rows)
    return rows


def brute(rows, by_group=True):
    totals, seen, out = defaultdict(int), defaultdict(int), {}
    for group, position, value in sorted(rows):
        key = group if by_group else None
        totals[key] += value
        seen[key] += 1
        out[(group, position)] = (totals[key], seen[key] - 1)
    return out


@pytest.mark.parametrize("block_rows", [1, 7, 64, 1 << 20])
def test_running_totals(spark, skewed, block_rows):
    df = spark.createDataFrame(skewed, "g long, p long, v long").repartition(3)
    got = ordered.running_totals(df, ["g"], "p", {"total": F.col("v")}, block_rows)
    assert got.columns == ["g", "p", "v", "total"]
    want = brute(skewed)
    result = {(r["g"], r["p"]): r["total"] for r in got.collect()}
    assert result == {k: t for k, (t, _) in want.items()}


@pytest.mark.parametrize("partitions", [1, 7, 40, None])
@pytest.mark.parametrize("by_group", [True, False])
def test_ordered_totals(spark, skewed, partitions, by_group):
    df = spark.createDataFrame(skewed, "g long, p long, v long").repartition(3)
    group, order = (["g"], ["p"]) if by_group else ([], ["g", "p"])
    totals = {"total": F.col("v"), "nth": F.lit(1).cast("long")}
    got = ordered.ordered_totals(df, group, order, totals, partitions)
    result = {(r["g"], r["p"]): (r["total"], r["nth"] - 1) for r in got.collect()}
    assert result == brute(skewed, by_group)


def test_ranges_cut_the_large_group(spark, skewed, monkeypatch):
    written = []
    real = ordered.materialize
    monkeypatch.setattr(ordered, "materialize", lambda df, name: written.append(real(df, name)) or written[-1])
    df = spark.createDataFrame(skewed, "g long, p long, v long")
    ordered.ordered_index(df, ["g"], ["p"], "i", partitions=24).collect()
    blocks = written[0].where("g = 1").groupBy(ordered.BLOCK).count().collect()
    assert len(blocks) >= 8
    assert max(r["count"] for r in blocks) <= 150  # sampled ranges are uneven, yet no block is the group


@pytest.mark.parametrize("partitions", [1, 30])
def test_frame_and_global_index(spark, skewed, partitions):
    df = spark.createDataFrame(skewed, "episode_index long, t long, v long")
    numbered = frame_index(df, ["t"], partitions=partitions)
    indexed = global_index(numbered, partitions=partitions)
    by_group, overall = brute(skewed), brute(skewed, False)
    found = indexed.collect()
    assert len(found) == len(skewed)
    for r in found:
        key = (r["episode_index"], r["t"])
        assert r["frame_index"] == by_group[key][1]
        assert r["index"] == overall[key][1]


def test_null_is_a_group(spark):
    """The carry of earlier blocks reaches the rows of the NULL group, too."""
    df = spark.createDataFrame([(None, p) for p in range(20)] + [(1, p) for p in range(5)], "g long, p long")
    one = {"n": F.lit(1).cast("long")}
    for got in (ordered.running_totals(df, ["g"], "p", one, 4), ordered.ordered_totals(df, ["g"], ["p"], one, 9)):
        assert sorted((r["g"] or 0, r["p"], r["n"]) for r in got.collect()) == sorted(
            [(0, p, p + 1) for p in range(20)] + [(1, p, p + 1) for p in range(5)])
    frames = df.withColumnRenamed("g", "episode_index").withColumn("t", F.when(F.col("p") > 0, F.col("p")))
    assert global_index(frame_index(frames, ["t"])).count() == 25


def test_ties_of_frame_order_fail(spark):
    df = spark.createDataFrame([(1, 5), (1, 5), (1, 6)], "episode_index long, t long")
    with pytest.raises(Exception, match="same order"):
        frame_index(df, ["t"]).collect()


def test_empty_input(spark):
    df = spark.createDataFrame([], "g long, p long, v long")
    assert ordered.ordered_index(df, ["g"], ["p"], "i").count() == 0
    assert ordered.running_totals(df, ["g"], "p", {"t": F.col("v")}).count() == 0


def test_short_and_long_episodes_are_numbered_alike(spark, skewed, monkeypatch):
    """Short episodes take one window and store no ranges; longer ones are cut into ranges, whichever way the limit parts them."""
    written = {}
    real = ordered.materialize
    monkeypatch.setattr(ordered, "materialize", lambda df, name: written.update({name: real(df, name)}) or written[name])
    rows = [*skewed, *[(None, t, 0) for t in range(30)]]
    df = spark.createDataFrame(rows, "episode_index long, t long, v long")
    expected = sorted((r[0] is None, r[0] or 0, r[1], i) for g in {x[0] for x in rows} for i, r in enumerate(sorted(x for x in rows if x[0] == g)))
    sizes = [sum(x[0] == g for x in rows) for g in {x[0] for x in rows}]
    for most in (min(sizes), max(sizes)):
        monkeypatch.setattr(episodes, "LONG_EPISODE", most)
        got = frame_index(df, ["t"]).collect()
        assert sorted((r.episode_index is None, r.episode_index or 0, r.t, r.frame_index) for r in got) == expected
        assert written["ranges"].count() == sum(n for n in sizes if n > most)
    tied = spark.createDataFrame([(None, None), (None, None)], "episode_index long, t long")
    for most in (1, 2):
        monkeypatch.setattr(episodes, "LONG_EPISODE", most)
        with pytest.raises(Exception, match="same order"):
            frame_index(tied, ["t"]).collect()
