import pytest
from pyspark.sql import functions as F

from trajspark.operators.epochs import EpochOrder, batch_frames, epoch_rank, fetch_batches


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 16, 17, 101, 1000, 1023, 4099])
def test_a_bijection_in_both_directions(spark, n):
    order = EpochOrder(n, 42, 3)
    rows = epoch_rank(spark.range(n).withColumnRenamed("id", "index"), order).withColumn("back", order.index("rank")).collect()
    assert sorted(r["rank"] for r in rows) == list(range(n))
    assert all(r["back"] == r["index"] for r in rows)


def test_orders_differ_by_seed_and_epoch_and_look_random(spark):
    n = 5000
    ranks = spark.range(n).select(*[EpochOrder(n, s, e).rank("id").alias(f"r{s}{e}") for s, e in ((1, 0), (1, 1), (2, 0))]).collect()
    for a, b in ((0, 1), (0, 2), (1, 2)):
        assert sum(r[a] == r[b] for r in ranks) < 20
    for c in range(3):
        column = [r[c] for r in ranks]
        mean = sum(abs(x - y) for x, y in zip(column, column[1:])) / (n - 1)
        assert 0.30 * n < mean < 0.37 * n  # a third of n between neighbours in a random order
        assert 0.45 < sum(x < y for x, y in zip(column, column[1:])) / n < 0.55


def test_batches_without_reading_frames(spark):
    n, size = 1003, 32
    order = EpochOrder(n, 7)
    frames = spark.range(n).select(F.col("id").alias("index"), (F.col("id") * 2).alias("payload"))
    whole = {r["index"]: r["rank"] for r in epoch_rank(frames, order).collect()}
    some = fetch_batches(frames, order, size, [0, 31, 5, 5, 400, -1]).collect()
    expected = {(i, r, r // size, 2 * i) for i, r in whole.items() if r // size in (0, 5, 31)}
    assert {(r["index"], r["rank"], r["batch_id"], r["payload"]) for r in some} == expected and len(some) == len(expected) == 75
    every = batch_frames(spark, order, size).collect()
    assert {r["index"]: r["rank"] for r in every} == whole
    plan = epoch_rank(frames, order)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Sort" not in plan


def test_large_orders_without_all_their_frames(spark):
    n = 10**12 + 39
    order = EpochOrder(n, 1)
    picked = spark.range(2000).select((F.col("id") * 499_999_999).alias("index")).withColumn("rank", order.rank("index"))
    rows = picked.withColumn("back", order.index("rank")).collect()
    assert all(r["back"] == r["index"] and 0 <= r["rank"] < n for r in rows) and len({r["rank"] for r in rows}) == 2000


def test_edges(spark):
    order = EpochOrder(10, 1)
    assert spark.sql("SELECT CAST(NULL AS LONG) AS x").select(order.rank("x")).first()[0] is None
    for wrong in (-1, 10):
        with pytest.raises(Exception, match="not in 0"):
            spark.range(1).select(order.rank(F.lit(wrong))).collect()
    assert batch_frames(spark, EpochOrder(0, 1), 4).collect() == []
    with pytest.raises(ValueError):
        batch_frames(spark, order, 0)
