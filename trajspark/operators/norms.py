"""Norms of parameter or gradient values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: keeps the clipping factor finite.
CLIP_EPSILON = 1e-6


def grouped_l2_norm(
    values: DataFrame, membership: DataFrame, key: str = "param", flag: str | None = None, total: str = "global"
) -> DataFrame:
    """``sqrt(sum of squares)`` per component, and once over all values as component ``total``.

    Missing values are skipped and a component without any value is left out. Components
    may overlap, so the total is taken before the membership join (and over rows with
    ``flag`` only, if given). Squares are summed per key before the join: a large component
    costs one row per key, not one per value.
    """
    kept = F.col(flag) if flag else F.lit(True)
    per_key = values.where(F.col("value").isNotNull()).groupBy(key).agg(
        F.sum(F.col("value") * F.col("value")).alias("squares"),
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(kept, F.col("value") * F.col("value"))).alias("kept_squares"),
        F.count(F.when(kept, F.lit(1))).alias("kept_n"),
    )
    parts = per_key.join(membership.select(key, "component"), key).groupBy("component").agg(
        F.sqrt(F.sum("squares")).alias("l2_norm"), F.sum("n").alias("n_values")
    )
    whole = per_key.agg(F.sqrt(F.sum("kept_squares")).alias("l2_norm"), F.sum("kept_n").alias("n_values")).select(
        F.lit(total).alias("component"), "l2_norm", "n_values"
    )
    return parts.unionByName(whole.where("n_values > 0"))


def clip_by_global_norm(values: DataFrame, max_norm: float, column: str = "value") -> DataFrame:
    """Scale all values by one factor when their joint norm is above ``max_norm``."""
    norm = values.agg(F.sqrt(F.sum(F.col(column) * F.col(column))).alias("norm")).scalar()
    factor = F.least(F.lit(1.0), F.lit(float(max_norm)) / (norm + F.lit(CLIP_EPSILON)))
    return values.withColumn(column, F.col(column) * factor)
