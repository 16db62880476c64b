"""Metric windows of a stream that lose no late row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark.session import exists
from trajspark.streaming.streams import progress_of

LEDGER = T.StructType([
    T.StructField(c, T.LongType()) for c in ("rows", "late", "latest_micros", "watermark_micros", "windows_closed", "batch")
])
SUMS = T.StructType([
    T.StructField("start", T.TimestampType()), T.StructField("end", T.TimestampType()), T.StructField("name", T.StringType()),
    T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("n_rows", T.LongType()),
    T.StructField("batch", T.LongType()),
])
LATE = T.StructType([
    *SUMS.fields[:3], T.StructField("ts", T.TimestampType()), T.StructField("value", T.DoubleType()),
    T.StructField("delay_micros", T.LongType()), T.StructField("batch", T.LongType()),
])


def _table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def window_sums(spark: SparkSession, path: str) -> DataFrame:
    """(start, end, name, mean_value, n, n_rows) of all rows that were in time."""
    sums = _table(spark, f"{path}/sums", SUMS).groupBy("start", "end", "name").agg(
        F.sum("total").alias("total"), F.sum("n").alias("n"), F.sum("n_rows").alias("n_rows")
    )
    return sums.select("start", "end", "name", (F.col("total") / F.col("n")).alias("mean_value"), "n", "n_rows")


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows whose window was closed when they came: with the window, and how far they were behind the watermark."""
    return _table(spark, f"{path}/late", LATE)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """A row per micro-batch: rows, late ones, the latest event time so far, the watermark it met, and the windows it closed."""
    return _table(spark, f"{path}/ledger", LEDGER)


def drain_metrics(
    stream: DataFrame, path: str, window: str, delay: str, ts: str = "ts", name: str = "name", value: str = "value",
    checkpoint: str | None = None,
) -> None:
    """Take all new input into window sums per metric name; rows that come too late go to a table of their own.

    A row is late if its window ended at or before the watermark, which is the latest event time of all earlier batches minus ``delay``.
    Rows in time plus late ones are the input, over any number of calls with the same ``path``; rows without an event time
    are in time and belong to no window. Each batch writes folders of its own, its ledger row last, so a batch that is run again
    after a failure changes nothing.
    """
    spark = stream.sparkSession
    wait = spark.range(1).select(F.expr(f"unix_micros(TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {delay})")).first()[0]

    def write(batch: DataFrame, batch_id: int) -> None:
        known = ledger(spark, path).where(F.col("batch") < batch_id).agg(F.max("latest_micros"), F.max("watermark_micros")).first()
        before, earlier = known
        mark = None if before is None else before - wait
        when = F.window(ts, window)
        rows = batch.select(when.alias("w"), F.col(ts).alias("ts"), F.col(name).alias("name"), F.col(value).cast("double").alias("value"))
        timeless = batch.where(F.col(ts).isNull()).select(
            F.lit(None).cast("struct<start:timestamp,end:timestamp>").alias("w"), F.col(ts).alias("ts"), F.col(name).alias("name"),
            F.col(value).cast("double").alias("value"),
        )  # a window function drops rows without a time
        is_late = F.lit(False) if mark is None else F.coalesce(F.unix_micros("w.end") <= mark, F.lit(False))
        seen = Observation()
        marked = rows.unionByName(timeless).select("w.start", "w.end", "name", "ts", "value", is_late.alias("late")).observe(
            seen, F.count(F.lit(1)).alias("rows"), F.count_if("late").alias("late"), F.max(F.unix_micros("ts")).alias("latest")
        )
        sums = marked.where("NOT late").groupBy("start", "end", "name").agg(
            F.sum("value").alias("total"), F.count("value").alias("n"), F.count(F.lit(1)).alias("n_rows")
        )
        sums.write.mode("overwrite").parquet(f"{path}/sums/batch={batch_id}")
        found = seen.get
        if found["late"]:
            behind = F.lit(mark) - F.unix_micros("ts")
            marked.where("late").select("start", "end", "name", "ts", "value", behind.alias("delay_micros")).write.mode("overwrite").parquet(
                f"{path}/late/batch={batch_id}"
            )
        latest = max((x for x in (before, found["latest"]) if x is not None), default=None)
        closed = 0
        if latest is not None:
            end = F.unix_micros("end")
            ended = (end <= latest - wait) & (F.lit(True) if mark is None else end > mark)
            closed = _table(spark, f"{path}/sums", SUMS).where(ended).select("start", "name").distinct().count()
        entry = (found["rows"], found["late"], latest, mark if mark is not None else earlier, closed)
        spark.createDataFrame([entry], T.StructType(LEDGER.fields[:-1])).write.mode("overwrite").parquet(f"{path}/ledger/batch={batch_id}")

    started = stream.writeStream.option("checkpointLocation", progress_of(path, checkpoint)).trigger(availableNow=True)
    started.foreachBatch(write).start().awaitTermination()
