import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from trajspark.session import scratch_path
from trajspark.sources import frames as io
from trajspark.streaming import late

SCHEMA = "ts timestamp, name string, value double"
DAY = dt.datetime(2024, 1, 1)


def drained(spark, path, log, per_batch=None):
    reader = spark.readStream.schema(SCHEMA)
    late.drain_metrics((reader.option("maxFilesPerTrigger", per_batch) if per_batch else reader).parquet(path), log, "1 hour", "90 MINUTES")


def test_rows_in_time_and_late_ones_are_the_input(spark, tmp_path):
    rng = random.Random(3)
    path, log, latest, rows, behind, sums = str(tmp_path / "in"), scratch_path(spark, "late"), None, 0, [], {}
    for part in range(6):
        batch = [(DAY + dt.timedelta(minutes=rng.randint(0, 120) + 90 * part * (rng.random() < 0.8)), rng.choice("ab"), float(rng.randint(0, 9))) for _ in range(12)]
        mark = latest and latest - dt.timedelta(minutes=90)
        for ts, name, value in batch:
            start = ts.replace(minute=0)
            if mark and start + dt.timedelta(hours=1) <= mark:
                behind.append((start, name, ts, value, int((mark - ts).total_seconds() * 1e6)))
            else:
                sums.setdefault((start, name), []).append(value)
        latest = max([latest or DAY, *(b[0] for b in batch)])
        rows += len(batch)
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        if part % 2:  # two micro-batches in each call
            drained(spark, path, log, per_batch=1)
    got = {(r["start"], r["name"]): (r["mean_value"], r["n"]) for r in late.window_sums(spark, log).collect()}
    assert got == {k: (pytest.approx(sum(v) / len(v)), len(v)) for k, v in sums.items()}
    found = late.late_rows(spark, log).select("start", "name", "ts", "value", "delay_micros").collect()
    assert sorted(map(tuple, found)) == sorted(behind) and len(behind) > 3
    entries = late.ledger(spark, log).orderBy("batch").collect()
    assert len(entries) == 6 and sum(e["rows"] for e in entries) == rows
    assert sum(e["late"] for e in entries) == len(behind) == rows - sum(len(v) for v in sums.values())
    assert sum(e["windows_closed"] for e in entries) == sum(s + dt.timedelta(hours=1) <= latest - dt.timedelta(minutes=90) for s, _ in sums)
    drained(spark, path, log)
    assert late.ledger(spark, log).count() == 6  # nothing new


def test_rows_without_a_time_and_empty_input(spark, tmp_path):
    path, log = str(tmp_path / "in"), scratch_path(spark, "late")
    spark.createDataFrame([(None, "a", 1.0), (DAY, None, None)], SCHEMA).coalesce(1).write.parquet(path)
    drained(spark, path, log)
    got = {(r["start"], r["name"], r["mean_value"], r["n"], r["n_rows"]) for r in late.window_sums(spark, log).collect()}
    assert got == {(None, "a", 1.0, 1, 1), (DAY, None, None, 0, 1)}
    nothing = scratch_path(spark, "late")
    assert late.window_sums(spark, nothing).collect() == late.late_rows(spark, nothing).collect() == []


def test_logging_again_changes_nothing(spark):
    path = scratch_path(spark, "log")
    rows = [(DAY, s, n, float(s)) for s in range(0, 50) for n in ("loss", "lr")] + [(DAY, None, "loss", 1.0), (DAY, 3, None, 2.0)]
    frame = spark.createDataFrame(rows, "ts timestamp, step long, name string, value double")
    read = lambda: sorted(map(tuple, io.read_metrics(spark, path).collect()), key=repr)
    io.log_metrics(frame.where("step < 30 OR step IS NULL"), path, steps=20)
    io.log_metrics(frame.where("step >= 30"), path, steps=20)
    whole = read()
    assert whole == sorted(((t, s, n, v) for t, s, n, v in rows), key=repr)
    untouched = {f for f in io.read_metrics(spark, path).inputFiles() if "step_range=0" in f}
    io.log_metrics(frame.where("step >= 25 AND name = 'loss'"), path, steps=20)
    assert read() == whole
    left = {f for f in io.read_metrics(spark, path).inputFiles() if "step_range=0" in f}
    assert untouched == left  # ranges below the resumed step are not written again
    io.log_metrics(frame.where("step = 25 AND name = 'lr'").withColumn("value", F.lit(7.0)), path, steps=20)
    assert [r for r in read() if r[1:3] == (25, "lr")] == [(DAY, 25, "lr", 7.0)] and len(read()) == len(whole)


def test_checks_are_counted_while_writing(spark, tmp_path):
    path, calls = str(tmp_path / "t"), spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(x):
        calls.add(1)
        return x

    frame = spark.range(100).select(counted("id").alias("x"))
    assert io.checked_write(frame, path, {"positive": F.col("x") >= 0}) == {"rows": 100, "positive": 0}
    assert calls.value == 100 and spark.read.parquet(path).count() == 100
    bad = str(tmp_path / "bad")
    with pytest.raises(ValueError, match="'small': 50, 'known': 1"):
        nulls = F.when(F.col("x") != 0, F.col("x"))
        io.checked_write(frame, bad, {"small": F.col("x") < 50, "known": nulls > 0, "fine": F.col("x") < 100})
    assert not os.path.exists(bad)
