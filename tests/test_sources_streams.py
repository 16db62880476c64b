import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from trajspark.catalog import tables as src
from trajspark.operators import shuffling as sh
from trajspark.operators.bounds import normalize_actions
from trajspark.session import materialize, scratch_path, scratch_root, scratch_scope
from trajspark.sources import frames as io
from trajspark.streaming import streams

BOUNDS = [(0, 0.0, 10.0)]


def test_scan_maps_checks_and_prunes(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, 2.5, "x", bytearray(b"pixels"))], "ep int, a float, note string, img binary").write.parquet(path)
    got = io.scan_frames(spark, path, {"episode_index": "ep", "action": F.array("a"), "note": "note"})
    assert got.schema.simpleString() == "struct<episode_index:bigint,action:array<double>,note:string>"
    assert tuple(got.first()) == (1, [2.5], "x")
    assert "img" not in plan_of(got)
    with pytest.raises(ValueError):
        io.scan_frames(spark, path, {"episode_index": "nope"})
    for name, source in (("episode_index", "note"), ("episode_index", "a"), ("action", "a")):
        with pytest.raises(TypeError):
            io.scan_frames(spark, path, {name: source})


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("in_order", [False, True])
def test_training_set_files(spark, tmp_path, in_order):
    path = str(tmp_path / "set")
    df = spark.range(1000).select(F.when(F.col("id") < 900, "train").otherwise("val").alias("split"), "id")
    ranked = sh.seeded_rank(df, "id", 1, within=["split"], partitions=5 if in_order else None)
    batched = sh.assign_batches(ranked, 32)
    io.write_training_set(batched, path, in_order=in_order)
    back = spark.read.parquet(path)
    assert back.select(batched.columns).exceptAll(batched).isEmpty() and back.count() == 1000
    spans = (back.withColumn("f", F.input_file_name()).groupBy("split", "f")
             .agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"), F.count("*").alias("n")).collect())
    assert all(r["hi"] - r["lo"] + 1 == r["n"] for r in spans)  # every file is a run of consecutive ranks
    assert not in_order or (len(spans) == 10 and max(r["n"] for r in spans) < 300)
    pruned = plan_of(back.where("split = 'val'"))
    assert "PartitionFilters: [isnotnull(split" in pruned


def test_metrics_append(spark, tmp_path):
    path = str(tmp_path / "m")
    first = spark.createDataFrame([(dt.datetime(2024, 1, 1), 0, "loss", 1.0), (dt.datetime(2024, 1, 1), 0, "lr", 0.1)], "ts timestamp, step long, name string, value double")
    io.append_metrics(first, path)
    io.append_metrics(first.withColumn("step", F.col("step") + 1), path)
    assert sorted((r["step"], r["name"]) for r in io.read_metrics(spark, path).collect()) == [(0, "loss"), (0, "lr"), (1, "loss"), (1, "lr")]


class Stub:
    """Stands in for a session, since the checkpoint folder of a running one cannot be changed."""

    def __init__(self, master, configured=None, current=None):
        self.conf = type("Conf", (), {"get": lambda _, key, default: configured or default})()
        self.sparkContext = type("Context", (), {
            "master": master, "applicationId": "app", "getCheckpointDir": lambda _: current, "setCheckpointDir": lambda _, d: None})()


def test_scratch_folder():
    assert scratch_root(Stub("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert scratch_root(Stub("yarn", None, "hdfs:///current")) == "hdfs:///current"
    assert scratch_path(Stub("yarn", "s"), "x").startswith("s/trajspark-app/x-")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(Stub("spark://host:7077"))  # never a machine-local folder on a cluster
    assert "trajspark-" in scratch_root(Stub("local[4]"))


def test_materialized_tables_are_fresh(spark):
    assert materialize(spark.range(5), "five").count() == 5
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def write_parts(spark, path, parts):
    for part in parts:
        spark.createDataFrame(part, "ts timestamp, name string, value double").coalesce(1).write.mode("append").parquet(path)


def test_stream_normalize_equals_batch(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([([float(i)],) for i in range(-5, 20)], "action array<double>").repartition(3).write.parquet(path)
    bounds = spark.createDataFrame(BOUNDS, "dim int, lower double, upper double")
    stream = spark.readStream.schema("action array<double>").option("maxFilesPerTrigger", 1).parquet(path)
    got = streams.drain_to_table(streams.stream_normalize(stream, bounds), scratch_path(spark, "t"))
    want = normalize_actions(spark.read.parquet(path), bounds)
    assert got.exceptAll(want).isEmpty() and got.count() == 25


def test_stream_metrics_equals_batch_over_several_micro_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    day = dt.datetime(2024, 1, 1)
    parts = [[(day + dt.timedelta(minutes=20 * (3 * p + i)), "ab"[i % 2], float(i)) for i in range(6)] for p in range(4)]
    write_parts(spark, path, parts)
    stream = spark.readStream.schema("ts timestamp, name string, value double").option("maxFilesPerTrigger", 1).parquet(path)
    aggregated = streams.stream_metrics(stream, "1 hour", "1 day")
    got = streams.drain_updates(aggregated, scratch_path(spark, "m"), ["start", "end", "name"])
    want = (spark.read.parquet(path).groupBy(F.window("ts", "1 hour").alias("w"), "name")
            .agg(F.avg("value").alias("mean_value"), F.count("value").alias("n")).select("w.start", "w.end", "name", "mean_value", "n"))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_watermark_drops_late_rows(spark, tmp_path):
    """The row of the last batch is older than the watermark that the batches before it left."""
    path = str(tmp_path / "in")
    day = dt.datetime(2024, 1, 1)
    write_parts(spark, path, [[(day + dt.timedelta(hours=h), "a", 1.0)] for h in (0, 5, 5, 0)])
    stream = spark.readStream.schema("ts timestamp, name string, value double").option("maxFilesPerTrigger", 1).parquet(path)
    got = streams.drain_updates(streams.stream_metrics(stream, "1 hour", "1 hour"), scratch_path(spark, "w"), ["start", "end", "name"])
    assert {r["start"].hour: r["n"] for r in got.collect()} == {0: 1, 5: 2}


def test_metric_times_do_not_depend_on_the_session_zone(spark, sf):
    events = src.table(spark, sf, "events")
    before = spark.conf.get("spark.sql.session.timeZone")
    micros = []
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            micros.append(sorted(r[0] for r in src.metric_rows(events).select(F.unix_micros("ts")).collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert micros[0] == micros[1]


def test_sinks_go_on_where_the_last_call_ended(spark, tmp_path):
    """Three calls with new input in between: every row once, and windows that span calls are summed up."""
    path, table, log = str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "log")
    day = dt.datetime(2024, 1, 1)
    bounds = spark.createDataFrame(BOUNDS[:1], "dim int, lower double, upper double")
    schema = "ts timestamp, name string, value double"
    for call in range(3):
        write_parts(spark, path, [[(day + dt.timedelta(minutes=25 * call), "a", float(call)), (day + dt.timedelta(minutes=25 * call + 1), "b", 1.0)]])
        stream = spark.readStream.schema(schema).parquet(path)
        normal = streams.stream_normalize(stream.select("ts", "name", F.array("value").alias("action")), bounds)
        assert streams.drain_to_table(normal, table).count() == 2 * (call + 1)
        counted = streams.drain_updates(streams.stream_metrics(stream, "1 hour", "1 day"), log, ["start", "end", "name"])
        assert {r["name"]: r["n"] for r in counted.collect()} == {"a": call + 1, "b": call + 1}
    named = streams.drain_to_table(normal, table + "2", checkpoint=str(tmp_path / "named"))
    assert named.count() == 6 and (tmp_path / "named").is_dir()


def test_a_scope_deletes_what_was_stored_in_it(spark):
    kept = materialize(spark.range(2), "kept")
    with scratch_scope(spark):
        gone = materialize(spark.range(3), "gone")
        folder = gone.inputFiles()[0].rpartition("/")[0].removeprefix("file://")
        assert gone.count() == 3 and os.path.isdir(folder)
    assert not os.path.exists(folder) and kept.count() == 2
