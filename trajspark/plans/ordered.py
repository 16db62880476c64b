"""Running totals over ordered rows, split so that no group has to fit one task.

A window over ``PARTITION BY group`` puts a whole group into one task. Here a group is cut
into blocks of consecutive rows; each block is totalled on its own, the block totals are
summed up per group (one row per block), and the sum of the earlier blocks is added back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.session import materialize

BLOCK_ROWS = 1 << 20  # rows per block where a position column gives the blocks

BLOCK = "_block"


def int_div(value: Column, divisor: int | Column) -> Column:
    """Integer division of non-negative values (exact above 2**53, unlike ``floor(a / b)``)."""
    divisor = F.lit(divisor).cast("long") if isinstance(divisor, int) else divisor
    return F.call_function("div", value, divisor)


def _add_totals(
    blocked: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    totals: Mapping[str, Column],
    few_blocks: bool,
) -> DataFrame:
    """Inclusive running totals, given a ``_block`` column that grows with ``order`` in each group."""
    keys = [*group, BLOCK]
    sums = blocked.groupBy(*keys).agg(*[F.sum(v).alias(f"_sum_{n}") for n, v in totals.items()])
    spec = Window.partitionBy(*group) if group else Window
    earlier = spec.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(
        *[F.col(k).alias(f"_at_{k}") for k in keys],
        F.count(F.lit(1)).over(earlier).alias("_blocks_before"),
        *[F.sum(f"_sum_{n}").over(earlier).alias(f"_carry_{n}") for n in totals],
    ).where("_blocks_before > 0").drop("_blocks_before")
    # Only the second and later blocks of a group carry anything, so this side has at most one
    # row per block boundary; with range blocks that is below the number of range partitions.
    carried = F.broadcast(carried) if few_blocks else carried
    same = [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in keys]  # NULL is a group like any other
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = [F.col(c) for c in blocked.columns if c != BLOCK]
    # The shuffle by block is spelled out: rows that happen to arrive partitioned by group would
    # satisfy the window as they are, with a large group in one task.
    return blocked.repartition(*keys).join(carried, same, "left").select(
        *kept,
        *[(F.sum(v).over(inside) + F.coalesce(f"_carry_{n}", F.lit(0))).alias(n) for n, v in totals.items()],
    )


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    position: str,
    totals: Mapping[str, Column],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Inclusive running totals of each group by an integer ``position``, unique in its group.

    Blocks are ``position div block_rows``: known without looking at the data, so the plan is
    lazy and a retried task lands on the same blocks.
    """
    blocked = df.withColumn(BLOCK, int_div(F.col(position).cast("long"), block_rows))
    return _add_totals(blocked, group, [position], totals, few_blocks=False)


def ordered_totals(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    totals: Mapping[str, Column],
    partitions: int | None = None,
) -> DataFrame:
    """Inclusive running totals of each group by any ``order`` that has no ties in a group.

    The rows are range-partitioned by (group, order), which cuts groups at sampled keys wherever they are large,
    and written once, so that the blocks are the same for every reader. Neither a group nor
    the table (if ``group`` is empty) is ever one task, at any size. All columns of ``df`` are written: give narrow rows.

    ``partitions`` is the number of ranges; by default Spark's shuffle partitions, merged by adaptive execution where
    they are small.
    """
    keys = [*group, *order]
    ranged = df.repartitionByRange(*keys) if partitions is None else df.repartitionByRange(partitions, *keys)
    blocks = materialize(ranged.withColumn(BLOCK, F.spark_partition_id()), "ranges")
    return _add_totals(blocks, group, order, totals, few_blocks=True)


def ordered_index(
    df: DataFrame, group: Sequence[str], order: Sequence[str], name: str, partitions: int | None = None
) -> DataFrame:
    """Zero-based BIGINT index of each row in its group."""
    counted = ordered_totals(df, group, order, {name: F.lit(1).cast("long")}, partitions)
    return counted.withColumn(name, F.col(name) - 1)
