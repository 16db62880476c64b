"""Shape of the physical plans, and every query against its SQL on the smallest tables."""

import glob
import importlib
import os
import re
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tools.check_oracle import compare
from trajspark.catalog import tables as src
from trajspark.catalog.oracle import ORACLE_SQL
from trajspark.catalog.queries import QUERIES
from trajspark.operators import chunks as ch
from trajspark.operators import layout as lay
from trajspark.operators import shuffling as sh
from trajspark.operators.bounds import normalize_actions
from trajspark.operators.episodes import global_index, project_keys, select_episodes, size_report
from trajspark.operators.tasks import attach_task

NO_PAIRS = re.compile("CartesianProduct|BroadcastNestedLoopJoin")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange (?:hash|range)partitioning", plan_of(df)))


@pytest.fixture(scope="module")
def con(sf):
    db = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql_and_forms_no_pairs(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    assert not NO_PAIRS.search(plan_of(df)), plan_of(df)
    assert compare(df.toPandas(), con.execute(ORACLE_SQL[name]).fetch_df()) == "ok"


def test_optional_modules_may_be_left_out_but_not_broken(monkeypatch):
    monkeypatch.setitem(sys.modules, "trajspark.left_out", None)
    assert contract._optional("trajspark.left_out.queries") is None and contract._optional("no_such_module") is None
    monkeypatch.setattr(importlib, "import_module", lambda name: (_ for _ in ()).throw(ModuleNotFoundError("x", name="missing_library")))
    with pytest.raises(ModuleNotFoundError):
        contract._optional("broken_module")


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_chunks_shuffle_the_frames_once(spark, sf):
    frames = src.event_rows(spark, sf).withColumn("frame_index", F.col("event_id"))
    assert shuffles(ch.action_chunk(frames, 8)) == 1
    bounds = spark.createDataFrame([(0, 0.0, 1.0)], "dim int, lower double, upper double")
    assert shuffles(ch.action_chunk(frames, 8, bounds)) == 1


def test_numbering_brings_neither_the_table_nor_wide_rows_into_one_task(spark, sf):
    """What meets in one partition are block totals, and what is stored are keys."""
    frames = src.lineitem_frames(spark, sf)
    for df in (frames, global_index(frames), lay.sequence_offsets(src.image_grids(spark, sf))):
        for part in plan_of(df).split("Exchange SinglePartition")[1:]:
            assert "HashAggregate" in part.split("\n")[1], part[:400]
    ranges = [x for x in frames.inputFiles() if "/ranges-" in x]
    stored = spark.read.parquet(*ranges).columns
    assert "action" not in stored and set(src.LINEITEM_ORDER) < set(stored)


def test_blocks_are_spread_even_if_the_input_is_partitioned_by_group(spark):
    stored = spark.createDataFrame([], "episode_index long, frame_index long, action array<double>")
    by_block = r"Exchange hashpartitioning\(episode_index#\w+, _block#\w+"
    assert re.search(by_block, plan_of(ch.action_chunk(stored, 8)))
    assert re.search(by_block, plan_of(ch.action_chunk(stored.repartition("episode_index"), 8)))
    tokens = spark.createDataFrame([], "sample long, pos long, token string, mask int").repartition("sample")
    assert re.search(r"Exchange hashpartitioning\(sample#\w+, _block#\w+", plan_of(lay.text_positions(tokens)))


def test_adaptive_execution_splits_a_hot_key_in_joins(spark):
    """Half of all frames share a task and an episode; both joins must be allowed to split it."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        key = F.when(F.col("id") % 2 == 0, F.lit(7)).otherwise(F.col("id"))
        frames = spark.range(0, 200_000, 1, 32).select(key.alias("episode_index"), key.alias("task_index"), F.col("id").alias("x"))
        tasks = spark.range(200_000).select(F.col("id").alias("task_index"), F.lit("t").alias("task"))
        joined = [attach_task(frames, tasks), select_episodes(frames, tasks.select(F.col("task_index").alias("episode_index")))]
        for df in joined:
            df.write.format("noop").mode("overwrite").save()
            assert df.count() == 200_000
            rows = df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]
            assert rows < 80_000, rows  # the hot key alone has 100,000
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_row_wise_operators_do_not_shuffle(spark, sf):
    frames = src.lineitem_rows(spark, sf)
    bounds = spark.createDataFrame([(i, 0.0, 1.0) for i in range(4)], "dim int, lower double, upper double")
    body = plan_of(normalize_actions(frames, bounds)).split("Subquery")[0]
    assert "Exchange" not in body and "Join" not in body
    batched = frames.select(F.lit(1).alias("rank"))
    assert shuffles(sh.batch_preview(sh.assign_batches(batched, 32), 32)) == 0


def test_ranking_shuffles_the_rows_once(spark, sf):
    """One exchange of the rows by bucket; the other one carries bucket counts."""
    orders = src.table(spark, sf, "orders")
    plan = plan_of(sh.seeded_rank(orders, "o_orderkey", 1))
    assert plan.count("Exchange hashpartitioning(_bucket") == 2 and "BroadcastHashJoin" in plan
    counting = plan[plan.index("BroadcastExchange"):]
    assert "ReadSchema: struct<o_orderkey:bigint>" in counting


def test_unused_columns_are_not_read(spark, sf):
    frames = project_keys(src.lineitem_rows(spark, sf), ["episode_index"])
    assert "ReadSchema: struct<l_orderkey:bigint>" in plan_of(frames)
    kept = select_episodes(frames, src.order_episodes(spark, sf))
    assert "o_totalprice" not in plan_of(kept)


def test_large_sides_are_not_broadcast_by_hint(spark, sf):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frames = src.lineitem_rows(spark, sf)
        assert "Broadcast" not in plan_of(select_episodes(frames, src.order_episodes(spark, sf)))
        tokens = src.conversation_tokens(spark, sf)
        assert "Broadcast" not in plan_of(lay.text_positions(tokens))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_neither_prompts_nor_chunks_are_moved(spark, sf):
    """The frames take their rank before they grow into chunks, and prompts are rendered last."""
    plan = plan_of(QUERIES["training_set"](spark, sf))
    above = plan[: plan.index("Exchange")]
    assert "collect_list" in above and "collect_list" not in plan[len(above):]
    moved = [line for line in plan[len(above):].split("\n") if "Project" in line]
    assert moved and not any("Overview cam" in line for line in moved)


def test_ranks_move_no_hash(spark, sf):
    """Rows are shuffled with their bucket; the hash that orders them is made where they arrive."""
    plan = plan_of(sh.seeded_rank(src.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 1, partitions=4))
    moved = plan[plan.index("Exchange"):]
    assert "AS _hash" in plan and "_hash#" not in moved


def test_size_report_counts_no_pairs_before_the_shuffle(spark, sf):
    plan = plan_of(QUERIES["size_report"](spark, sf))
    below = [part.split("\n")[1] for part in plan.split("Exchange hashpartitioning(episode_index")[1:] if "REPARTITION_BY_COL" in part.split("\n")[0]]
    assert below and not any("Aggregate" in line for line in below)


def test_size_report_tells_texts_of_one_task_number_apart(spark):
    frames = spark.createDataFrame([(1, 1, [0.0]), (1, 2, [0.0]), (2, 1, [0.0])], "episode_index long, task_index long, action array<double>")
    splits = spark.createDataFrame([(1, "train"), (2, "val")], "episode_index long, split string")
    tasks = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "task_index long, task string")
    got = sorted((r.split, r.task, r.n_episodes, r.n_frames) for r in size_report(frames, splits, tasks).where("level = 0").collect())
    assert got == [("train", "a", 1, 2), ("train", "b", 1, 1), ("val", "a", 1, 1), ("val", "b", 1, 1)]


def test_vectors_are_computed_once_where_they_are_unrolled(spark, sf):
    """No filter on the vector's size, which would hold the whole expression again, lies below."""
    for name in ("normalize_actions", "unnormalize_actions"):
        plan = plan_of(QUERIES[name](spark, sf))
        assert not re.search(r"Filter .*size\(", plan), plan[:2000]
