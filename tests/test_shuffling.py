import hashlib

import pytest
from pyspark.sql import functions as F

from trajspark.operators import episodes as ep
from trajspark.operators import shuffling as sh


def md5_order(keys, seed):
    return sorted(keys, key=lambda k: hashlib.md5(f"{seed}:{k}".encode()).hexdigest())


@pytest.mark.parametrize("prefix", [1, 2, 4])
def test_rank_is_the_sorted_hash_order(spark, prefix):
    got = sh.seeded_rank(spark.range(500).withColumnRenamed("id", "k"), "k", 7, prefix=prefix)
    ranks = {r["rank"]: r["k"] for r in got.collect()}
    assert [ranks[i] for i in range(500)] == md5_order(range(500), 7)


def test_rank_with_several_keys_and_groups(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("split"), F.col("id").alias("a"), (F.col("id") * 2).alias("b"))
    got = sh.seeded_rank(df, ["a", "b"], "s", within=["split"], prefix=1).collect()
    for split in range(3):
        mine = [r for r in got if r["split"] == split]
        want = sorted(mine, key=lambda r: hashlib.md5(f"s:{r['a']}:{r['b']}".encode()).hexdigest())
        assert [r["rank"] for r in want] == list(range(100))


def test_rank_counted_from_a_cheaper_table(spark):
    keys = spark.range(300).withColumnRenamed("id", "k")
    rich = keys.withColumn("x", F.col("k") * 2)
    got = sh.seeded_rank(rich, "k", 7, count_from=keys, prefix=2)
    assert got.exceptAll(sh.seeded_rank(rich, "k", 7, prefix=2)).isEmpty() and got.count() == 300


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_rank_laid_out_in_order(spark, partitions):
    df = spark.range(600).select((F.col("id") % 4 == 0).alias("split"), F.col("id").alias("k"))
    plain = sh.seeded_rank(df, "k", 7, within=["split"])
    laid = sh.seeded_rank(df, "k", 7, within=["split"], partitions=partitions, prefix=2)
    assert laid.columns == plain.columns and laid.exceptAll(plain).isEmpty() and laid.rdd.getNumPartitions() == partitions
    spans = laid.groupBy("split", F.spark_partition_id().alias("p")).agg(
        F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count("*").alias("n")).orderBy("split", "p").collect()
    assert all(r["hi"] - r["lo"] + 1 == r["n"] for r in spans)
    assert all(a["hi"] + 1 == b["lo"] for a, b in zip(spans, spans[1:]) if a["split"] == b["split"])


@pytest.mark.parametrize("below", [0, 1, 37, 499, 500, 10_000])
def test_bounded_rank(spark, below):
    got = sh.seeded_rank(spark.range(500).withColumnRenamed("id", "k"), "k", 7, below=below, prefix=2)
    assert sorted(r["rank"] for r in got.collect()) == list(range(min(below, 500)))


def test_epochs_differ_and_repeat(spark):
    df = spark.range(50).select(F.col("id").alias("episode_index"), F.lit(0).alias("frame_index"))
    orders = [[tuple(r) for r in sh.shuffle_epoch(df, 1, e).orderBy("rank").collect()] for e in (0, 1, 0)]
    assert orders[0] == orders[2] != orders[1]


@pytest.mark.parametrize("n,fraction,train", [(10, 0.8, 8), (10, 0.95, 9), (3, 0.5, 1), (100, 0.29, 28), (1, 0.8, 0), (7, 1.0, 7)])
def test_split_truncates_and_covers(spark, n, fraction, train):
    """0.29 * 100 is 28.999999999999996 in doubles, so 28 episodes train."""
    episodes = spark.range(n).withColumnRenamed("id", "episode_index")
    labelled = sh.split_episodes(episodes, fraction, 42)
    chosen = {r[0] for r in labelled.where("split = 'train'").select("episode_index").collect()}
    assert len(chosen) == train == int(fraction * n)
    rest = ep.complement_episodes(episodes, labelled.where("split = 'train'").select("episode_index"))
    assert {r[0] for r in rest.collect()} == set(range(n)) - chosen
    assert chosen == set(md5_order(range(n), 42)[:train])


def test_short_last_batch_is_kept_or_dropped(spark):
    ranked = sh.seeded_rank(spark.range(101).withColumnRenamed("id", "k"), "k", 0)
    sizes = {r["batch_id"]: r["count"] for r in sh.assign_batches(ranked, 32).groupBy("batch_id").count().collect()}
    assert sizes == {0: 32, 1: 32, 2: 32, 3: 5}
    assert sh.assign_batches(ranked, 32, drop_last=True).count() == 96
    assert sh.assign_batches(ranked, None, 50).agg(F.max("batch_id")).first()[0] == 2
    with pytest.raises(ValueError):
        sh.assign_batches(ranked, None)


@pytest.mark.parametrize("n,batch,steps,accumulation,save", [(101, 32, 11, 3, 5), (10, 5, 1, 1, 1), (7, 10, 4, 2, 3), (64, 8, 3, 2, 2)])
def test_schedule_against_a_loop(spark, n, batch, steps, accumulation, save):
    ranked = sh.seeded_rank(spark.range(n).withColumnRenamed("id", "k"), "k", 0)
    got = sh.step_schedule(sh.assign_batches(ranked, batch), steps, accumulation, save).orderBy("step").collect()
    per_epoch = -(-n // batch)
    assert [r["step"] for r in got] == list(range(steps))
    for r in got:
        s = r["step"]
        assert (r["epoch"], r["batch_id"]) == divmod(s, per_epoch)
        assert r["n_samples"] == min(batch, n - batch * r["batch_id"])
        assert r["is_update"] == ((s + 1) % accumulation == 0)
        assert r["is_save"] == ((s + 1) % save == 0 or s + 1 == steps)


def test_preview_and_every_n(spark):
    batched = sh.assign_batches(sh.seeded_rank(spark.range(70).withColumnRenamed("id", "k"), "k", 0), 32)
    assert sorted(r["rank"] for r in sh.batch_preview(batched, 32, 2).collect()) == [0, 1, 32, 33, 64, 65]
    steps = spark.range(11).withColumnRenamed("id", "step")
    due = lambda **kw: sorted(r[0] for r in sh.every_n(steps, 4, **kw).collect())
    assert due() == [0, 4, 8]
    assert due(offset=1) == [3, 7]
    assert due(include_last=True) == [0, 4, 8, 10]


def test_ranks_within_null_and_a_resumed_schedule(spark):
    df = spark.range(10).select("id", F.when(F.col("id") < 5, "a").alias("part"))
    ranks = {}
    for r in sh.seeded_rank(df, "id", 1, within=["part"]).collect():
        ranks.setdefault(r["part"], []).append(r["rank"])
    assert {k: sorted(v) for k, v in ranks.items()} == {"a": [0, 1, 2, 3, 4], None: [0, 1, 2, 3, 4]}
    batched = spark.range(7).select(F.col("id").alias("batch_id"))
    whole = sorted(map(tuple, sh.step_schedule(batched, 9000, 2, 50).collect()))
    assert [r[0] for r in whole] == list(range(9000))
    for start in (0, 1, 6, 7, 8990, 9000, 10_000):
        assert sorted(map(tuple, sh.step_schedule(batched, 9000, 2, 50, start).collect())) == whole[start:]
