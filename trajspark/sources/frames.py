"""Reading and writing frames, bounds, training sets and metrics."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark.operators.bounds import check_bounds
from trajspark.schemas import BOUNDS, FRAMES, METRICS
from trajspark.session import exists, materialize, remove


def scan_frames(
    spark: SparkSession,
    path: str,
    mapping: Mapping[str, str | Column],
    schema: T.StructType = FRAMES,
    format: str = "parquet",
) -> DataFrame:
    """Read a frame table and map its columns to the frame layout.

    ``mapping`` gives, per frame column, a source column or an expression. Names that the layout
    knows are checked against its types (numbers may be widened); others pass through, for
    example ordering columns. Only mapped columns are read.
    """
    table = spark.read.format(format).load(path)
    layout = {field.name: field.dataType for field in schema.fields}
    columns = []
    for name, source in mapping.items():
        if isinstance(source, str) and source not in table.columns:
            raise ValueError(f"no column {source!r} for {name!r} in {path}")
        column = F.col(source) if isinstance(source, str) else source
        if name in layout:
            found = table.select(column.alias(name)).schema[0].dataType
            if not _fits(found, layout[name]):
                raise TypeError(f"{name!r} is {found.simpleString()}, expected {layout[name].simpleString()}")
            column = column.cast(layout[name])
        columns.append(column.alias(name))
    return table.select(*columns)


def _fits(found: T.DataType, wanted: T.DataType) -> bool:
    if isinstance(found, T.ArrayType) and isinstance(wanted, T.ArrayType):
        return _fits(found.elementType, wanted.elementType)
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    if isinstance(wanted, T.LongType):
        return isinstance(found, whole)
    if isinstance(wanted, T.DoubleType):
        return isinstance(found, (*whole, T.FloatType, T.DoubleType))
    return type(found) is type(wanted)


def save_bounds(bounds: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store the bounds table with a run; the bounds are checked first."""
    check_bounds(bounds).select([F.col(f.name).cast(f.dataType) for f in BOUNDS]).coalesce(1).write.mode(mode).parquet(path)


def load_bounds(spark: SparkSession, path: str) -> DataFrame:
    """Restore a bounds table; bounds that violate lower <= upper are refused."""
    return check_bounds(spark.read.schema(BOUNDS).parquet(path))


def write_training_set(
    batched: DataFrame, path: str, by: str = "split", in_order: bool = False, mode: str = "errorifexists"
) -> None:
    """Write batched frames, one folder per ``by`` value, each file a run of consecutive batches.

    ``in_order`` says that the partitions follow the rank already (``seeded_rank`` with
    ``partitions``): they are written as they are, without a shuffle. Otherwise the rows are
    range-partitioned by (by, batch, rank), which gives even files whatever the sizes of the
    splits. Either way a batch is rarely cut, and a ``split`` filter reads only its own folder.
    """
    order = [by, "batch_id", "rank"]
    placed = batched if in_order else batched.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.write.mode(mode).partitionBy(by).parquet(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Append metric rows (ts, step, name, value), one folder per metric name.

    The rebalance hint lets adaptive execution merge rare names and split frequent ones, so
    neither many small files nor one long task come out of it.
    """
    rows = metrics.select([F.col(f.name).cast(f.dataType) for f in METRICS])
    rows.hint("rebalance", "name").write.mode("append").partitionBy("name").parquet(path)


def log_metrics(metrics: DataFrame, path: str, steps: int = 10_000) -> None:
    """Log metric rows so that a repeated call changes nothing: rows of a (name, step) replace what was logged for it.

    The log is partitioned by name and by ranges of ``steps`` steps. Only the ranges that ``metrics`` touches are read and written
    anew (dynamic overwrite), so a resumed run that logs its last steps again costs as much as those steps.
    """
    spark = metrics.sparkSession
    span = F.floor(F.col("step") / F.lit(steps)).alias("step_range")
    new = materialize(metrics.select([F.col(f.name).cast(f.dataType) for f in METRICS]).select("*", span), "metrics-new")
    if exists(spark, path):
        logged = read_metrics(spark, path).select("*", span)

        def same(a: DataFrame, b: DataFrame, keys: list[str]) -> list[Column]:
            return [a[k].eqNullSafe(b[k]) for k in keys]

        ranges, steps_again = new.select("name", "step_range").distinct(), new.select("name", "step").distinct()
        old = logged.join(ranges, same(logged, ranges, ["name", "step_range"]), "left_semi")
        new = new.unionByName(old.join(steps_again, same(old, steps_again, ["name", "step"]), "left_anti"))
        new = materialize(new, "metrics-merged")  # a table can't be read while it is overwritten
    writer = new.hint("rebalance", "name", "step_range").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("name", "step_range").parquet(path)


def checked_write(df: DataFrame, path: str, checks: Mapping[str, Column], mode: str = "errorifexists") -> dict[str, int]:
    """Write ``df`` and count, in the same pass, the rows (``rows``) and those for which each check does not hold.

    If a check fails on any row (NULL fails), what was written is removed and the call fails; a column is evaluated once.
    """
    seen = Observation()
    counts = [F.count_if(~F.coalesce(check, F.lit(False))).alias(name) for name, check in checks.items()]
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *counts).write.mode(mode).parquet(path)
    found = dict(seen.get)
    failed = {name: found[name] for name in checks if found[name]}
    if failed:
        remove(df.sparkSession, path)
        raise ValueError(f"of {found['rows']} rows these fail a check: {failed}")
    return found


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS).parquet(path).select(*METRICS.names)
