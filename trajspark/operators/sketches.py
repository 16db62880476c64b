"""Bounds from stored sketches: new episodes change the bounds without reading old ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark.operators.bounds import exact_quantiles
from trajspark.session import materialize

SKETCH_K = 4096     # size of a KLL sketch: about 40 KB per part and dimension at most
SKETCHES = T.StructType([
    T.StructField("part", T.StringType()), T.StructField("dim", T.IntegerType()),
    T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType()),
])


def rank_error(k: int = SKETCH_K) -> float:
    """How far the rank of a sketch's quantile is off, as a share of n, with 99 % confidence (published formula of KLL sketches)."""
    return 2.446 / k**0.9433


def sketch_parts(frames: DataFrame, part: str, action: str = "action", k: int = SKETCH_K) -> DataFrame:
    """(part, dim, n, sketch) of each part (an episode, a file, a day) and action dimension; null and NaN are left out.

    Sketches are filled map-side, so a part with a third of all frames is one small row per task.
    """
    values = frames.select(F.col(part).cast("string").alias("part"), F.posexplode(action).alias("dim", "value")).where(
        F.col("value").isNotNull() & ~F.isnan("value")
    )
    return values.groupBy("part", "dim").agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("value", F.lit(k)).alias("sketch"))


def store_sketches(sketches: DataFrame, path: str) -> None:
    """Add parts to a sketch table; a part that is there already is replaced, so a repeated call changes nothing."""
    rows = sketches.select([F.col(f.name).cast(f.dataType) for f in SKETCHES])
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def read_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SKETCHES).parquet(path)


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """(dim, n, sketch) over all parts; the order of merging does not matter beyond the sketch's error."""
    return sketches.groupBy("dim").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_bounds(sketches: DataFrame, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Bounds table from the sketches alone, each within ``rank_error`` of its quantile's rank."""
    merged = merge_sketches(sketches)
    return merged.select("dim", *[
        F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(name) for q, name in ((lo, "lower"), (hi, "upper"))
    ])


def refined_bounds(
    sketches: DataFrame,
    frames: DataFrame,
    lo: float = 0.01,
    hi: float = 0.99,
    action: str = "action",
    k: int = SKETCH_K,
    partitions: int | None = None,
) -> DataFrame:
    """Exact bounds: the sketches bracket each quantile, and one pass over the frames settles it.

    ``frames`` must be the frames that the sketches hold. A bracket that misses (the sketch's error is no certainty) is noticed,
    and the full range is taken, as :func:`~trajspark.operators.bounds.fit_bounds` does.
    """
    values = frames.select(F.posexplode(action).alias("dim", "value")).where(F.col("value").isNotNull() & ~F.isnan("value"))
    merged = materialize(merge_sketches(sketches), "merged-sketches")
    for margin in (2 * rank_error(k), 1.0):
        ends = [q for target in (lo, hi) for q in (max(target - margin, 0.0), min(target + margin, 1.0))]
        wide = [F.lit(float("-inf")), F.lit(float("inf"))] * 2
        found = wide if margin == 1.0 else [F.kll_sketch_get_quantile_double("sketch", F.lit(q)) for q in ends]
        names = ("low_from", "low_to", "high_from", "high_to")
        brackets = merged.select("dim", F.col("n").alias("total"), *[e.alias(c) for e, c in zip(found, names)])
        fitted = materialize(exact_quantiles(values, brackets, lo, hi, partitions), "refined-bounds")
        if fitted.where("NOT bracketed").isEmpty():
            break
    return fitted.drop("bracketed")
