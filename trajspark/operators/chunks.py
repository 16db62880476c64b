"""Future-action chunks and the matrix/long forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajspark.operators.bounds import normalize_actions
from trajspark.plans.ordered import BLOCK, int_div

# Frames per window task group. An episode of any length is spread over as many tasks as it has
# blocks, and k - 1 of this many rows are copied to the block before.
CHUNK_BLOCK = 1 << 16


def action_chunk(
    frames: DataFrame,
    k: int,
    bounds: DataFrame | None = None,
    block_rows: int = CHUNK_BLOCK,
) -> DataFrame:
    """Add ``action_chunk``: this and the next ``k - 1`` actions of the same episode.

    Past the end of the episode the last action is repeated. With ``bounds`` the actions are
    normalised first (once per frame, before the shuffle). ``frame_index`` must run 0, 1, 2, ...
    in every episode; a gap, a duplicate or another start fails the query (use ``frame_index()``
    to number frames again).

    Frames are grouped by (episode, block of frame indexes) and the first ``k - 1`` frames of a
    block (at least one) are also sent to the block before it, so an episode is never one task. This
    is the one shuffle, and it is spelled out: frames that arrive partitioned by episode would
    otherwise stay in one task. Every block must begin with its first index, follow without a gap, and
    be there if the next one is; together this holds for every gap, wherever it lies.
    """
    if k < 1:
        raise ValueError("a chunk needs at least one step")
    block_rows = max(block_rows, k)
    columns = frames.columns
    frames = frames.withColumn("_step", F.col("action"))
    if bounds is not None:
        frames = normalize_actions(frames, bounds, "_step")
    position = F.col("frame_index").cast("long")
    home = int_div(position, block_rows)
    offset = F.pmod(position, F.lit(block_rows))
    is_head = (offset < max(k - 1, 1)) & (home > 0)
    spread = frames.withColumn(
        BLOCK, F.explode(F.when(is_head, F.array(home, home - 1)).otherwise(F.array(home)))
    )
    spread = spread.repartition("episode_index", BLOCK)
    order = Window.partitionBy("episode_index", BLOCK).orderBy("frame_index")
    # Wrapped in a struct because collect_list would skip a NULL action and shift the steps.
    steps = F.collect_list(F.struct(F.col("_step").alias("a"))).over(order.rowsBetween(0, k - 1))
    at_home = F.col(BLOCK) == home
    follows = F.coalesce(F.lead("frame_index").over(order) == F.col("frame_index") + 1, F.lit(True))
    # The first row of a block is its first index; a copy there means that the block itself is missing.
    starts = F.lag("frame_index").over(order).isNotNull() | (at_home & (offset == 0))
    gap = F.raise_error(F.lit("frame_index has a gap or a duplicate, or doesn't start at 0"))
    chunked = (
        spread.select("*", steps.alias("_steps"), (follows & starts).alias("_whole"))
        # The check is part of the filter, so that no action leaves it out, not even a count.
        .where(F.when(F.col("_whole"), at_home).otherwise(gap))
        .withColumn("_steps", F.col("_steps.a"))
    )
    missing = F.lit(k) - F.size("_steps")
    padded = F.concat("_steps", F.array_repeat(F.element_at("_steps", -1), missing))
    return chunked.select(*columns, padded.alias("action_chunk"))


def invalid_chunks(chunks: DataFrame, k: int, column: str = "action_chunk") -> DataFrame:
    """Rows whose chunk is missing or does not have exactly ``k`` steps."""
    return chunks.where(F.col(column).isNull() | (F.size(column) != k))


def validate_chunks(chunks: DataFrame, k: int, column: str = "action_chunk") -> DataFrame:
    """Return ``chunks`` unchanged, or fail if a chunk does not have ``k`` steps."""
    if not invalid_chunks(chunks, k, column).isEmpty():
        raise ValueError(f"a chunk does not have {k} steps")
    return chunks


def unstack_chunks(chunks: DataFrame, column: str = "action_chunk") -> DataFrame:
    """Matrix to long form: one row per (..., step, dim, value)."""
    others = [c for c in chunks.columns if c != column]
    steps = chunks.select(*others, F.posexplode(column).alias("step", "_row"))
    return steps.select(*others, "step", F.posexplode("_row").alias("dim", "value"))


def stack_chunks(long: DataFrame, key: str, name: str = "action_chunk") -> DataFrame:
    """Long form to matrix; a group is one chunk, so its size is steps x dims by definition."""
    rows = long.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("step", "dim", "value"))).alias("_cells"))
    steps = F.array_sort(F.array_distinct(F.col("_cells.step")))
    matrix = F.transform(
        steps,
        lambda s: F.transform(F.filter(F.col("_cells"), lambda c: c["step"] == s), lambda c: c["value"]),
    )
    return rows.select(key, matrix.alias(name))


def stack_vector(df: DataFrame, vector: str, width: int, name: str = "action_chunk") -> DataFrame:
    """Cut a flat vector into rows of ``width`` values, in place."""
    count = F.call_function("div", F.size(vector), F.lit(width)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(vector, i * width + 1, width))
    return df.withColumn(name, cut)
