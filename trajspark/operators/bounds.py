"""Normalisation bounds: fitting, checking, applying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.functions.numeric import normalize_value, unnormalize_value
from trajspark.operators.episodes import select_episodes
from trajspark.plans.ordered import ordered_totals
from trajspark.session import materialize


def bounds_from_stats(stats: DataFrame, lower: str = "q01", upper: str = "q99") -> DataFrame:
    """Bounds table from one row of dataset statistics that holds two equally long vectors."""
    return stats.select(F.posexplode(F.arrays_zip(lower, upper)).alias("dim", "b")).select(
        "dim", F.col("b")[lower].cast("double").alias("lower"), F.col("b")[upper].cast("double").alias("upper")
    )


def fit_bounds(
    frames: DataFrame,
    lo: float = 0.01,
    hi: float = 0.99,
    episodes: DataFrame | None = None,
    exact: bool = True,
    accuracy: int = 10_000,
    action: str = "action",
    partitions: int | None = None,
) -> DataFrame:
    """Per-dimension ``lo`` and ``hi`` quantiles of the action vectors; null and NaN are left out.

    All episodes are used unless ``episodes`` names some (for example the training split). The
    result is a stored table of one row per dimension.

    ``exact=False`` gives the sketch's answer in one pass. ``exact=True`` interpolates between the
    two neighbouring order statistics: a first pass brackets each quantile with the sketch, a
    second pass counts what lies outside the brackets and each distinct value inside them. Only
    those few values are ever sorted, not the data.
    """
    if episodes is not None:
        frames = select_episodes(frames, episodes)
    values = frames.select(F.posexplode(action).alias("dim", "value")).where(
        F.col("value").isNotNull() & ~F.isnan("value")
    )
    if not exact:
        sketch = F.percentile_approx("value", F.array(F.lit(lo), F.lit(hi)), accuracy)
        fitted = values.groupBy("dim").agg(sketch.alias("q"))
        return materialize(fitted.select("dim", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper")), "bounds")
    # The sketch errs by at most 1/accuracy of the ranks; the second try takes the full range.
    for margin in (2.0 / accuracy, 1.0):
        fitted = materialize(_exact_quantiles(values, lo, hi, margin, accuracy, partitions), "bounds")
        if fitted.where("NOT bracketed").isEmpty():
            break
    return fitted.drop("bracketed")


def _exact_quantiles(
    values: DataFrame, lo: float, hi: float, margin: float, accuracy: int, partitions: int | None
) -> DataFrame:
    everything = (F.lit(float("-inf")), F.lit(float("inf"))) * 2
    ends = [q for target in (lo, hi) for q in (max(target - margin, 0.0), min(target + margin, 1.0))]
    sketch = values.groupBy("dim").agg(
        F.count(F.lit(1)).alias("total"), F.percentile_approx("value", F.array(*map(F.lit, ends)), accuracy).alias("q")
    )
    found = [F.col("q")[i] for i in range(4)] if margin < 1 else everything
    names = ("low_from", "low_to", "high_from", "high_to")
    brackets = sketch.select("dim", "total", *[end.alias(name) for end, name in zip(found, names)])
    return exact_quantiles(values, brackets, lo, hi, partitions)


def exact_quantiles(values: DataFrame, brackets: DataFrame, lo: float, hi: float, partitions: int | None = None) -> DataFrame:
    """(dim, lower, upper, bracketed) of (dim, value) rows, given for each dimension its number of values and a bracket for each
    quantile (dim, total, low_from, low_to, high_from, high_to). A bracket that misses its quantile leaves ``bracketed`` false.
    """
    value = F.col("value")
    in_bracket = value.between(F.col("low_from"), F.col("low_to")) | value.between(F.col("high_from"), F.col("high_to"))
    # A value outside the brackets only counts: below the lower one, or between the two.
    region = F.when(value < F.col("low_from"), F.lit(float("-inf"))).otherwise(F.col("low_to"))
    # One row per action dimension, so the broadcast cannot grow with the number of frames.
    counts = materialize(
        values.join(F.broadcast(brackets), "dim")
        .where("value <= high_to")
        .groupBy("dim", "total", F.when(in_bracket, value).otherwise(region).alias("point"), (~in_bracket).alias("gap"))
        .agg(F.count(F.lit(1)).alias("n")),
        "bracket-counts",
    )
    running = ordered_totals(counts, ["dim"], ["point", "gap"], {"upto": F.col("n")}, partitions)

    def order_statistic(rank: Column) -> Column:
        here = (F.col("upto") > rank) & (F.col("upto") - F.col("n") <= rank) & ~F.col("gap")
        return F.max(F.when(here, F.col("point")))

    def at(target: float) -> Column:
        return F.lit(target) * (F.col("total") - 1)

    picked = running.groupBy("dim", "total").agg(*[
        order_statistic(round_to(at(target))).alias(f"{name}{i}")
        for name, target in (("lower", lo), ("upper", hi))
        for i, round_to in enumerate((F.floor, F.ceil))
    ])

    def quantile(name: str, target: float) -> Column:
        below, above = F.col(f"{name}0"), F.col(f"{name}1")
        return (below + (above - below) * (at(target) - F.floor(at(target)))).alias(name)

    fitted = picked.select("dim", quantile("lower", lo), quantile("upper", hi))
    return fitted.withColumn("bracketed", F.col("lower").isNotNull() & F.col("upper").isNotNull())


def _is_bad() -> Column:
    lower, upper = F.col("lower"), F.col("upper")
    return lower.isNull() | upper.isNull() | F.isnan(lower) | F.isnan(upper) | (lower > upper)


def bound_violations(bounds: DataFrame) -> DataFrame:
    """Dimensions whose lower bound is above the upper one, or undefined."""
    return bounds.where(_is_bad())


def check_bounds(bounds: DataFrame) -> DataFrame:
    """Return ``bounds`` unchanged, or fail if a dimension violates ``lower <= upper``."""
    if not bound_violations(bounds).isEmpty():
        raise ValueError("a lower bound is larger than its upper bound")
    return bounds


def assert_bounds(bounds: DataFrame) -> DataFrame:
    """The same check inside the plan: it fails when the bounds are read, without a job of its own."""
    message = F.concat(F.lit("bad bounds in dimension "), F.col("dim").cast("string"))
    return bounds.withColumn("lower", F.when(_is_bad(), F.raise_error(message)).otherwise(F.col("lower")))


# Same results either way, only the plan differs: up to this many dimensions the vector is mapped by one compiled expression per dimension, which
# runs several times faster than a lambda over the array.
UNROLLED_DIMS = 64


def read_bounds(bounds: DataFrame) -> list[tuple[float, float]]:
    """The checked bounds as numbers, by dimension. They are settings of the run, not data."""
    rows = bounds.select("dim", "lower", "upper").collect()
    pairs = {r["dim"]: (r["lower"], r["upper"]) for r in rows}
    if sorted(pairs) != list(range(len(rows))):
        raise ValueError(
            "bounds need exactly one row for each dimension 0, 1, 2, ...; a dimension without any value has no bounds"
        )
    ordered = [pairs[dim] for dim in range(len(rows))]
    if not all(lower is not None and upper is not None and lower <= upper for lower, upper in ordered):
        raise ValueError("a lower bound is larger than its upper bound")
    return ordered


def _mapped(vector: Column, pairs: list[tuple[float, float]], fn) -> Column:
    if len(pairs) <= UNROLLED_DIMS:
        mapped = F.array(*[fn(F.get(vector, F.lit(i)), F.lit(lo), F.lit(hi)) for i, (lo, hi) in enumerate(pairs)])
    else:
        box = F.array(*[F.struct(F.lit(lo).alias("lower"), F.lit(hi).alias("upper")) for lo, hi in pairs])
        mapped = F.zip_with(vector, box, lambda x, b: fn(x, b["lower"], b["upper"]))
    mismatch = F.raise_error(F.lit(f"vector and bounds differ in length (bounds: {len(pairs)})"))
    return F.when(vector.isNull(), vector).when(F.size(vector) == len(pairs), mapped).otherwise(mismatch)


def _apply(df: DataFrame, bounds: DataFrame, column: str, fn) -> DataFrame:
    return df.withColumn(column, _mapped(F.col(column), read_bounds(bounds), fn))


def _apply_steps(df: DataFrame, bounds: DataFrame, column: str, fn) -> DataFrame:
    pairs = read_bounds(bounds)
    return df.withColumn(column, F.transform(column, lambda step: _mapped(step, pairs, fn)))


def normalize_actions(df: DataFrame, bounds: DataFrame, column: str = "action") -> DataFrame:
    """Clamp each action to its bounds and map it linearly to [-1, 1].

    The bounds enter the plan as constants, so this is a projection: no join, no shuffle. Works on
    streams as well.
    """
    return _apply(df, bounds, column, normalize_value)


def unnormalize_actions(df: DataFrame, bounds: DataFrame, column: str = "action") -> DataFrame:
    """Inverse of :func:`normalize_actions` on the clamped values."""
    return _apply(df, bounds, column, unnormalize_value)


def normalize_chunks(df: DataFrame, bounds: DataFrame, column: str = "action_chunk") -> DataFrame:
    """:func:`normalize_actions` for each step of a chunk, in place."""
    return _apply_steps(df, bounds, column, normalize_value)


def unnormalize_chunks(df: DataFrame, bounds: DataFrame, column: str = "action_chunk") -> DataFrame:
    """Inverse of :func:`normalize_chunks` on the clamped values."""
    return _apply_steps(df, bounds, column, unnormalize_value)
