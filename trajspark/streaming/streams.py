"""Structured-streaming forms of normalisation and metric aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark.operators.bounds import normalize_actions


def stream_normalize(stream: DataFrame, bounds: DataFrame, column: str = "action") -> DataFrame:
    """Normalise a stream of frames by a static bounds table; no state is kept."""
    return normalize_actions(stream, bounds, column)


def stream_metrics(
    stream: DataFrame, window: str, watermark: str, ts: str = "ts", name: str = "name", value: str = "value"
) -> DataFrame:
    """Mean and count per metric name and time window; windows older than the watermark are dropped from state."""
    return (
        stream.withWatermark(ts, watermark)
        .groupBy(F.window(ts, window).alias("window"), F.col(name).alias("name"))
        .agg(F.avg(value).alias("mean_value"), F.count(value).alias("n"))
        .select("window.start", "window.end", "name", "mean_value", "n")
    )


def progress_of(path: str, checkpoint: str | None) -> str:
    """Where a sink keeps its offsets and state: the named folder, else one beside its table."""
    return checkpoint or f"{path.rstrip('/')}-progress"


def drain_to_table(stream: DataFrame, path: str, checkpoint: str | None = None) -> DataFrame:
    """Run a stateless stream over all input that is new since the last call into Parquet files; read back all of them.

    Calls with the same ``path`` and ``checkpoint`` continue each other.
    """
    spark = stream.sparkSession
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", progress_of(path, checkpoint))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain_updates(stream: DataFrame, path: str, keys: list[str], checkpoint: str | None = None) -> DataFrame:
    """Run an aggregating stream in update mode over the new input; the latest version of every key is read back.

    Calls with the same ``path`` and ``checkpoint`` continue each other: state lives on, and batch numbers go up.

    Append mode would hold back the newest windows, and complete mode would keep all state.
    Each micro-batch overwrites its own folder, so a batch that is run again does no harm.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        stream.writeStream.outputMode("update")
        .option("checkpointLocation", progress_of(path, checkpoint))
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    written = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    values = [c for c in stream.columns if c not in keys]
    latest = F.max_by(F.struct(*values), "batch").alias("v")
    return written.groupBy(*keys).agg(latest).select(*keys, "v.*")
