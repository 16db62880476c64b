"""Scoring policies and measuring their errors."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark.functions.numeric import format_fixed4, unnormalize_value
from trajspark.operators.bounds import read_bounds
from trajspark.operators.chunks import stack_vector


def score_policy(
    df: DataFrame,
    make_predict_fn: Callable,
    inputs: Sequence[str],
    input_shapes: Sequence[Sequence[int]] | None = None,
    batch_size: int = 128,
    chunk_dim: int | None = None,
    name: str = "predicted_chunk",
) -> DataFrame:
    """Run a policy over batches of rows; its output vector becomes a column.

    ``make_predict_fn`` builds the policy once per Python worker and returns a function from
    numpy arrays to one ``[batch, n]`` array. With ``chunk_dim`` the vector is cut into steps.
    """
    shapes = [list(s) for s in input_shapes] if input_shapes is not None else None
    predict = predict_batch_udf(
        make_predict_fn,
        return_type=T.ArrayType(T.DoubleType()),
        batch_size=batch_size,
        input_tensor_shapes=shapes,
    )
    scored = df.withColumn(name, predict(*inputs))
    return scored if chunk_dim is None else stack_vector(scored, name, chunk_dim, name)


def map_batches(
    batched: DataFrame,
    fn: Callable,
    schema: str | T.StructType,
    partitions: int | None = None,
    contiguous: bool = False,
) -> DataFrame:
    """Apply a pandas function to each batch and return its rows.

    The rows are clustered by batch and come to Python in Arrow chunks of many batches, so the
    cost of a hand-over is shared. A task holds one chunk and at most one unfinished batch.

    ``partitions`` is the number of tasks (default: the shuffle partitions); size it by the data. With
    ``contiguous`` each partition already holds whole batches, as
    ``seeded_rank(partitions=...)`` lays out shards of a multiple of the batch size, and nothing is shuffled.
    """

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unfinished = None
        for chunk in chunks:
            rows = chunk if unfinished is None else pd.concat([unfinished, chunk], ignore_index=True)
            ids = rows["batch_id"].to_numpy()
            starts = np.flatnonzero(ids[1:] != ids[:-1]) + 1
            edges = [0, *starts]
            results = [fn(rows.iloc[a:b].reset_index(drop=True)) for a, b in zip(edges, edges[1:])]
            if results:
                yield pd.concat(results, ignore_index=True)
            unfinished = rows.iloc[edges[-1]:]
        if unfinished is not None and len(unfinished):
            yield fn(unfinished.reset_index(drop=True))

    # A fixed number of partitions, because adaptive execution would merge rows by their bytes and
    # knows nothing of the Python work on them.
    if not contiguous:
        tasks = partitions or int(batched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        batched = batched.repartition(tasks, "batch_id")
    return batched.sortWithinPartitions("batch_id").mapInPandas(run, schema)


def prediction_error(
    predicted: DataFrame,
    target: DataFrame,
    key: str | Sequence[str],
    bounds: DataFrame | None = None,
    predicted_column: str = "predicted_chunk",
    target_column: str = "action_chunk",
    strict: bool = True,
) -> DataFrame:
    """Rows (key, step, dim, target, predicted, error); with ``bounds`` after unnormalising both.

    The sides are joined as whole chunks, one row per sample, and unrolled afterwards. In strict mode a
    sample that only one side has, or chunks of different shape, fail the query; otherwise such samples
    are left out.
    """
    keys = [key] if isinstance(key, str) else list(key)
    ours = predicted.select(*keys, F.col(predicted_column).alias("_p"), F.lit(True).alias("_predicted"))
    theirs = target.select(*keys, F.col(target_column).alias("_t"), F.lit(True).alias("_target"))
    if not strict:
        return chunk_error(ours.join(theirs, keys).where(_same_shape("_p", "_t")), keys, bounds, "_p", "_t")
    pairs = ours.join(theirs, keys, "full")
    alone = F.col("_predicted").isNull() | F.col("_target").isNull()
    message = F.concat(F.lit("prediction and target do not match in sample "), F.to_json(F.struct(*keys)))
    checked = pairs.withColumn("_p", F.when(alone, F.raise_error(message)).otherwise(F.col("_p")))
    return chunk_error(checked, keys, bounds, "_p", "_t")


def _same_shape(predicted: str, actual: str) -> Column:
    """Whether both chunks are there and have the same number of steps, and of values in each step."""
    sizes = [F.transform(c, F.size) for c in (predicted, actual)]
    return F.coalesce((F.size(predicted) == F.size(actual)) & (sizes[0] == sizes[1]), F.lit(False))


def chunk_error(
    pairs: DataFrame,
    keep: Sequence[str],
    bounds: DataFrame | None = None,
    predicted_column: str = "predicted_chunk",
    target_column: str = "action_chunk",
) -> DataFrame:
    """The same for rows that already hold both chunks: no join, no shuffle. Chunks of different shape fail."""
    differ = F.raise_error(F.lit("prediction and target differ in shape"))
    zipped = F.arrays_zip(F.col(predicted_column).alias("p"), F.col(target_column).alias("t"))
    whole = F.when(_same_shape(predicted_column, target_column), zipped).otherwise(differ)
    steps = pairs.select(*keep, F.posexplode(whole).alias("step", "_s"))
    cells = steps.select(
        *keep, "step", F.posexplode(F.arrays_zip(F.col("_s.p").alias("p"), F.col("_s.t").alias("t"))).alias("dim", "_c")
    )
    predicted, actual = F.col("_c.p"), F.col("_c.t")
    if bounds is not None:
        limits = read_bounds(bounds)
        beyond = F.raise_error(F.lit(f"a step has more dimensions than the bounds ({len(limits)})"))
        known = F.col("dim") < len(limits)
        lower = F.when(known, F.get(F.array(*[F.lit(lo) for lo, _ in limits]), F.col("dim"))).otherwise(beyond)
        upper = F.when(known, F.get(F.array(*[F.lit(hi) for _, hi in limits]), F.col("dim"))).otherwise(beyond)
        predicted, actual = unnormalize_value(predicted, lower, upper), unnormalize_value(actual, lower, upper)
    return cells.select(
        *keep, "step", "dim", actual.alias("target"), predicted.alias("predicted"), (predicted - actual).alias("error")
    )


def l1_loss(errors: DataFrame) -> DataFrame:
    """Mean absolute error over all elements."""
    return errors.agg(F.avg(F.abs("error")).alias("l1_loss"))


def validation_loss(errors: DataFrame) -> DataFrame:
    """Mean of the batch means (a short batch weighs the same), 0.0 without batches, and their number."""
    per_batch = errors.groupBy("batch_id").agg(F.avg(F.abs("error")).alias("loss"))
    return per_batch.agg(
        F.coalesce(F.avg("loss"), F.lit(0.0)).alias("val_loss"), F.count(F.lit(1)).alias("num_batches")
    )


def error_profile(
    errors: DataFrame,
    by: Sequence[str] = ("step", "dim"),
    quantiles: Sequence[float] = (),
    accuracy: int = 10_000,
) -> DataFrame:
    """Mean target, mean prediction, mean and largest absolute error per part, with subtotals.

    With ``quantiles`` also column ``abs_error_quantiles``, an array of those of the absolute error, from a sketch
    that is built map-side and errs by at most ``1 / accuracy`` of the ranks.
    """
    sketch = F.percentile_approx(F.abs("error"), F.array(*map(F.lit, quantiles)), accuracy) if quantiles else None
    return errors.rollup(*by).agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("n"),
        F.avg("target").alias("mean_target"),
        F.avg("predicted").alias("mean_predicted"),
        F.avg(F.abs("error")).alias("mean_abs_error"),
        F.max(F.abs("error")).alias("max_abs_error"),
        *([] if sketch is None else [sketch.alias("abs_error_quantiles")]),
    )


def format_actions(df: DataFrame, column: str = "action_chunk", name: str = "text") -> DataFrame:
    """A chunk as text: four decimals with a sign slot, ", " between values, one line per step."""
    rows = F.transform(F.col(column), lambda row: F.array_join(F.transform(row, format_fixed4), ", "))
    return df.withColumn(name, F.array_join(rows, "\n"))
