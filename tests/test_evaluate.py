import math

import numpy as np
import pytest
from hypothesis import HealthCheck, example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trajspark.functions.numeric import format_fixed4
from trajspark.operators import episodes as ep
from trajspark.operators import evaluate as ev
from trajspark.operators import norms
from trajspark.operators import tasks as tk
from trajspark.plans.training import TrainingPlan, evaluate_policy, prepare_training_set

CASES = [0.0, -0.0, 1.5, -1.5, 0.03125, -0.03125, 0.00015, -0.00015, 0.00005, -0.00001, 0.12345, 1.00005, 2.00015,
         99999.99995, 1e9 + 0.00005, 1e15, 5e-324, 123456789.87654321, 0.00025, 0.00035, float("inf"), float("-inf"), float("nan")]


def texts(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    return [r[0] for r in df.select(format_fixed4(F.col("x"))).collect()]


def test_fixed4_on_ties(spark):
    assert texts(spark, CASES) == [f"{x: 0.4f}" for x in CASES]
    assert texts(spark, [None]) == [None]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@example([i / 32 for i in range(-64, 64)])
@example([i / 20000 for i in range(-100, 100)])
@given(st.lists(st.one_of(st.floats(-1e6, 1e6), st.integers(-(10**7), 10**7).map(lambda i: i / 20000)), min_size=1, max_size=200))
def test_fixed4_equals_python(spark, values):
    assert texts(spark, values) == [f"{x: 0.4f}" for x in values]


def test_format_actions(spark):
    df = spark.createDataFrame([([[1.0, -2.5], [0.03125, 0.0]],)], "action_chunk array<array<double>>")
    assert ev.format_actions(df).first()["text"] == " 1.0000, -2.5000\n 0.0312,  0.0000"


def errors(spark, rows):
    return spark.createDataFrame(rows, "batch_id long, error double")


def test_validation_loss_is_a_mean_of_means(spark):
    many = errors(spark, [(0, 1.0)] * 32 + [(1, -3.0)])
    assert tuple(ev.validation_loss(many).first()) == (2.0, 2)
    assert ev.l1_loss(many).first()[0] == pytest.approx(35 / 33)


def test_no_batches_give_zero(spark):
    assert tuple(ev.validation_loss(errors(spark, [])).first()) == (0.0, 0)


def test_prediction_error_after_unnormalising(spark):
    schema = "k long, {} array<array<double>>"
    predicted = spark.createDataFrame([(1, [[1.0, -1.0]]), (2, [[0.0, 0.0]])], schema.format("predicted_chunk"))
    target = spark.createDataFrame([(1, [[-1.0, 0.0]]), (3, [[0.0, 0.0]])], schema.format("action_chunk"))
    bounds = spark.createDataFrame([(0, 0.0, 10.0), (1, -2.0, 2.0)], "dim int, lower double, upper double")
    got = ev.prediction_error(predicted, target, "k", bounds, strict=False).orderBy("dim").collect()
    assert [(r["k"], r["step"], r["dim"]) for r in got] == [(1, 0, 0), (1, 0, 1)]
    assert [r["error"] for r in got] == [pytest.approx(10.0, abs=1e-6), pytest.approx(-2.0, abs=1e-6)]
    raw = ev.prediction_error(predicted, target, "k", strict=False).orderBy("dim").collect()
    assert [r["error"] for r in raw] == [2.0, -1.0]


def test_error_profile_has_parts_and_total(spark):
    df = spark.createDataFrame([(0, 0, 1.0, 3.0, 2.0), (0, 1, 1.0, 0.0, -1.0), (1, 0, 0.0, 0.0, 0.0)],
                               "step int, dim int, target double, predicted double, error double")
    got = {(r["step"], r["dim"]): (r["n"], r["mean_abs_error"], r["max_abs_error"]) for r in ev.error_profile(df).collect()}
    assert got[(0, None)] == (2, 1.5, 2.0) and got[(None, None)] == (3, 1.0, 2.0) and len(got) == 6


def doubling():
    return lambda x: 2.0 * x


def test_score_and_evaluate(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0, 2.0, 3.0]) for i in range(10)], "k long, v array<double>")
    scored = ev.score_policy(df, doubling, ["v"], [[4]], batch_size=3, chunk_dim=2).orderBy("k").collect()
    assert scored[3]["predicted_chunk"] == [[6.0, 2.0], [4.0, 6.0]]
    samples = df.withColumn("action_chunk", F.array(F.slice("v", 1, 2), F.slice("v", 3, 2)))
    loss = evaluate_policy(samples, ["k"], doubling, ["v"], [[4]], 2, max_batches=5, batch_size=2).first()
    assert loss["num_batches"] == 5
    assert loss["val_loss"] == pytest.approx(np.mean([(i + 6) / 4 for i in range(10)]))


@pytest.mark.parametrize("arrow_rows", ["3", "10000"])
def test_map_batches_gets_whole_batches(spark, arrow_rows):
    """Arrow chunks may end inside a batch, or be smaller than one."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", arrow_rows)
    try:
        df = spark.range(103).select(F.call_function("div", F.col("id"), F.lit(8)).alias("batch_id"), F.col("id").cast("double").alias("value"))

        def summary(batch):
            return batch.groupby("batch_id", as_index=False).agg(n=("value", "size"), top=("value", "max"))

        got = ev.map_batches(df.repartition(5), summary, "batch_id long, n long, top double")
        want = [(b, min(8, 103 - 8 * b), float(min(8 * b + 7, 102))) for b in range(13)]
        assert sorted(map(tuple, got.collect())) == want
        assert ev.map_batches(df.where("id < 0"), summary, "batch_id long, n long, top double").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_grouped_norm_counts_overlaps_once_in_the_total(spark):
    values = spark.createDataFrame([("a", 3.0, True), ("a", None, True), ("b", 4.0, True), ("c", None, True), ("d", 12.0, False)],
                                   "param string, value double, trains boolean")
    members = spark.createDataFrame([("a", "left"), ("a", "all"), ("b", "all"), ("c", "empty"), ("d", "frozen")], "param string, component string")
    got = {r["component"]: (r["l2_norm"], r["n_values"]) for r in norms.grouped_l2_norm(values, members).collect()}
    assert got == {"left": (3.0, 1), "all": (5.0, 2), "frozen": (12.0, 1), "global": (13.0, 3)}
    trained = {r["component"]: r["l2_norm"] for r in norms.grouped_l2_norm(values, members, flag="trains").collect()}
    assert trained["global"] == 5.0
    nothing = norms.grouped_l2_norm(values.where("param = 'c'"), members)
    assert nothing.isEmpty()


def test_clipping(spark):
    df = spark.createDataFrame([(3.0,), (4.0,), (None,)], "value double")
    clipped = [r[0] for r in norms.clip_by_global_norm(df, 1.0).collect()]
    assert clipped[:2] == [pytest.approx(3 / (5 + 1e-6)), pytest.approx(4 / (5 + 1e-6))] and clipped[2] is None
    assert [r[0] for r in norms.clip_by_global_norm(df, 10.0).collect()] == [3.0, 4.0, None]


def frames(spark):
    return spark.createDataFrame([(0, 0, 1), (0, 1, 1), (1, 0, 2)], "episode_index long, frame_index long, task_index long")


def test_attach_task(spark):
    tasks = spark.createDataFrame([(1, "lift"), (2, None)], "task_index long, task string")
    got = tk.attach_task(frames(spark), tasks).orderBy("episode_index", "frame_index").collect()
    assert [r["task"] for r in got] == ["lift", "lift", None]
    with pytest.raises(Exception, match="no task with index 2"):
        tk.attach_task(frames(spark), tasks.where("task_index = 1")).collect()
    assert tk.attach_task(frames(spark), tasks.where("task_index = 1"), strict=False).count() == 3


def test_prompt(spark):
    df = spark.createDataFrame([("lift the cup", "a", "b")], "task string, image_ref string, image2_ref string")
    parts = tk.render_prompt(df).first()["prompt"]
    assert [tuple(p) for p in parts] == [
        ("text", "Overview cam:", None), ("image", None, "a"), ("text", "Wrist cam:", None), ("image", None, "b"),
        ("text", "What action should the robot take to lift the cup?", None),
    ]


@pytest.mark.parametrize("max_n,expected", [(0, 0), (2, 2), (9, 3)])
@pytest.mark.parametrize("random_order", [False, True])
def test_augmentation_plan(spark, max_n, expected, random_order):
    names = ["z", "y", "x"]
    df = spark.range(60).select(F.col("id").alias("episode_index"), F.lit(0).alias("frame_index"))
    plan = tk.augmentation_plan(df, names, max_n, 1, 0, random_order).collect()
    per_frame = {}
    for r in sorted(plan, key=lambda r: r["position"]):
        per_frame.setdefault(r["episode_index"], []).append(r["transform"])
    assert len(plan) == 60 * expected
    for chosen in per_frame.values():
        assert len(set(chosen)) == expected
        if not random_order:
            assert chosen == [n for n in names if n in chosen]
    if expected == 2:
        assert len({tuple(c) for c in per_frame.values()}) == (6 if random_order else 3)
    assert tk.augmentation_plan(df, names, max_n, 1, 0, random_order, enable=False).isEmpty()


def test_summary_and_report(spark):
    df = frames(spark).withColumns({"action": F.array(F.lit(1.0), F.lit(2.0)), "flag": F.col("frame_index") == 0})
    splits = df.select("episode_index", F.lit("train").alias("split")).distinct()
    tasks = spark.range(3).select(F.col("id").alias("task_index"), F.col("id").cast("string").alias("task"))
    summary = {r["episode_index"]: tuple(r)[1:] for r in ep.episode_summary(df).collect()}
    assert summary == {0: (2, 0, 1, 1), 1: (1, 0, 0, 1)}
    assert tuple(ep.dataset_totals(df).first()) == (2, 3)
    report = {(r["split"], r["task"]): tuple(r)[2:] for r in ep.size_report(df, splits, tasks, "flag").collect()}
    assert report[("train", None)] == (1, 2, 3, 6, 4) and report[(None, None)] == (3, 2, 3, 6, 4)
    assert report[("train", "1")] == (0, 1, 2, 4, 2)
    batches = {r["level"]: r["n_batches"] for r in ep.size_report(df, splits, tasks, batch_sizes={"train": 2}).collect()}
    assert batches == {0: None, 1: 2, 3: None}
    # Two numbers of one text are one task, and an episode with both counts once.
    same = tasks.withColumn("task", F.lit("t"))
    assert {r["level"]: r["n_episodes"] for r in ep.size_report(df, splits, same).collect()} == {0: 2, 1: 2, 3: 2}
    assert ep.size_report(df.limit(0), splits, tasks).collect() == []
    plan = ep.size_report(df, splits, tasks)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    with pytest.raises(ValueError):
        ep.project_keys(df, ["nope"])


def test_training_set_as_a_whole(spark):
    rows = [(e, i, e % 3, [float(i), float(-e)]) for e in range(20) for i in range(e + 1)]
    df = spark.createDataFrame(rows, "episode_index long, frame_index long, task_index long, action array<double>")
    tasks = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "task_index long, task string")
    plan = TrainingPlan(chunk_len=4, batch_size=8, val_batch_size=4, max_val_batches=2, fit_on="train")
    got = prepare_training_set(df, tasks, plan).collect()
    train, val = [[r for r in got if r["split"] == s] for s in ("train", "val")]
    episodes = {r["episode_index"] for r in train}
    assert len(episodes) == 16 and not episodes & {r["episode_index"] for r in val}
    assert sorted(r["rank"] for r in train) == list(range(sum(e + 1 for e in episodes)))
    assert sorted(r["rank"] for r in val) == list(range(8)) and {r["batch_id"] for r in val} == {0, 1}
    assert all(r["batch_id"] == r["rank"] // 8 for r in train)
    assert all(len(r["action_chunk"]) == 4 and all(-1 <= x <= 1 for s in r["action_chunk"] for x in s) for r in got)
    assert all(r["task"] == "abc"[r["task_index"]] for r in got)
    assert not any(math.isnan(x) for r in got for s in r["action_chunk"] for x in s)


def test_training_set_keeps_all_frames_by_default_and_has_prompts(spark):
    rows = [(e, i, 0, [float(i)], "o", "w") for e in range(10) for i in range(e + 1)]
    df = spark.createDataFrame(rows, "episode_index long, frame_index long, task_index long, action array<double>, o string, w string")
    tasks = spark.createDataFrame([(0, "a")], "task_index long, task string")
    got = prepare_training_set(df, tasks, TrainingPlan(chunk_len=2, batch_size=4, prompt_images=("o", "w"))).collect()
    assert {(r["episode_index"], r["frame_index"]) for r in got} == {r[:2] for r in rows} and len(got) == len(rows)
    assert all(len(r["prompt"]) == 5 and r["prompt"][1]["image_ref"] == "o" and "to a?" in r["prompt"][4]["text"] for r in got)


def chunks_of(spark, name, rows):
    return spark.createDataFrame(rows, f"k long, {name} array<array<double>>")


@pytest.mark.parametrize("predicted, target, message", [
    ([(1, [[1.0]])], [(1, [[1.0]]), (2, [[1.0]])], "do not match"),
    ([(1, [[1.0]]), (2, [[1.0]])], [(1, [[1.0]])], "do not match"),
    ([(1, [[1.0]])], [(1, [[1.0], [2.0]])], "differ in shape"),
    ([(1, [[1.0, 2.0]])], [(1, [[1.0]])], "differ in shape"),
    ([(1, None)], [(1, [[1.0]])], "differ in shape"),
])
def test_losses_cover_all_samples_and_steps(spark, predicted, target, message):
    ours, theirs = chunks_of(spark, "predicted_chunk", predicted), chunks_of(spark, "action_chunk", target)
    with pytest.raises(Exception, match=message):
        ev.l1_loss(ev.prediction_error(ours, theirs, "k")).collect()
    left = ev.prediction_error(ours, theirs, "k", strict=False).collect()
    assert all(r["error"] == 0.0 for r in left)


def test_error_quantiles(spark):
    df = spark.createDataFrame([(0, 0.0, 0.0, float(i) * (-1) ** i) for i in range(1, 101)], "step int, target double, predicted double, error double")
    got = ev.error_profile(df, ["step"], quantiles=[0.5, 0.99]).where("step IS NULL").first()
    assert got["abs_error_quantiles"] == [50.0, 99.0]


def test_repeated_tasks_fail_and_empty_transforms_give_no_plan(spark):
    tasks = spark.createDataFrame([(0, "a"), (0, "a"), (1, "b")], "task_index long, task string")
    with pytest.raises(Exception, match="more than one task"):
        tk.attach_task(frames(spark), tasks).collect()
    df = frames(spark)
    plan = tk.augmentation_plan(df, [], 3, 1, 0)
    assert plan.columns == ["episode_index", "frame_index", "position", "transform"] and plan.isEmpty()
    split = df.withColumn("split", F.when(F.col("episode_index") == 0, "train").otherwise("val"))
    episodes = lambda p: {r[0] for r in p.select("episode_index").collect()}
    every = {r[0] for r in df.select("episode_index").collect()}
    plans = [tk.augmentation_plan(split, ["x"], 1, 1, 0, enable=tk.augmented_splits(*a)) for a in ((True, False), (True, True), (False, True))]
    assert [episodes(p) for p in plans] == [{0}, every, set()]


def test_map_batches_on_contiguous_partitions(spark):
    from trajspark.operators.shuffling import assign_batches

    ranked = spark.range(64).withColumnRenamed("id", "rank").repartitionByRange(4, "rank")
    batched = assign_batches(ranked, 4)
    count = lambda pdf: pdf.groupby("batch_id", as_index=False).size()
    for options in ({"partitions": 3}, {}):
        got = ev.map_batches(batched, count, "batch_id long, size long", **options)
        assert sorted(map(tuple, got.collect())) == [(b, 4) for b in range(16)]
    plan = ev.map_batches(batched, count, "batch_id long, size long", contiguous=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
