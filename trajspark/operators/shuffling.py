"""Seeded order, sampling, batching and the step schedule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.plans.ordered import int_div
from trajspark.session import materialize

# 16**HASH_PREFIX buckets: 65,536 rows of bucket totals are broadcast (about 1 MB). A bucket holds rows / 65,536,
# which one window task sorts: some 15 million at 10**12 rows. Beyond that, give ``prefix=5``
# (a million buckets) or more: the result doesn't depend on it.
HASH_PREFIX = 4
EPOCH_RUN = 1024


def seeded_rank(
    df: DataFrame,
    key: str | Sequence[str],
    seed: int | str,
    name: str = "rank",
    below: int | Column | None = None,
    within: Sequence[str] = (),
    count_from: DataFrame | None = None,
    partitions: int | None = None,
    prefix: int = HASH_PREFIX,
) -> DataFrame:
    """Zero-based rank of every row in a pseudo-random order fixed by ``seed``; ``key`` is unique.

    The order is by ``md5("seed:key")``. Rows are bucketed by the first hex digits of the hash,
    so the buckets are even whatever the keys look like; a bucket's rank offset is the
    count of the earlier buckets. No task sorts the whole table.

    With ``below`` only ranks under that number are kept (all rows if there are fewer); buckets
    that lie beyond it are dropped before the shuffle. With ``within`` the ranks are counted per
    value of those columns (NULL is a value, too), meant for a handful of values such as the splits. The
    bucket totals are hinted for broadcast only without ``within``: their number is then at most
    ``16 ** prefix``; with it they are stored, and Spark broadcasts them if their measured size allows.

    With ``partitions`` the result comes in that many partitions which follow the rank: each is a
    run of consecutive ranks (of every ``within`` value), as a writer of shards wants it. The
    hash decides the partition, so this is the same single shuffle, without sampling.

    Counting the buckets reads only the key columns, yet it does evaluate ``df``. Where a
    cheaper table has the same keys (frames before chunks and tasks are attached), name it in
    ``count_from``.
    """
    keys = [key] if isinstance(key, str) else list(key)
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])

    def hash_rows(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.substring(F.md5(text), 1, prefix))

    hashed = hash_rows(df)
    counted = hashed if count_from is None else hash_rows(count_from)
    buckets = [*within, "_bucket"]
    spec = Window.partitionBy(*within) if within else Window
    earlier = spec.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.groupBy(*buckets).agg(F.count(F.lit(1)).alias("_n")).select(
        *buckets, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start")
    )
    if below is not None:
        limit = F.lit(below) if isinstance(below, int) else below
        starts = starts.where(F.col("_start") < limit)
    # NULL is a value of ``within`` like any other.
    renamed = starts.select(*[F.col(c).alias(f"_at_{c}") for c in buckets], "_start")
    same = [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in buckets]
    # With ``within`` the totals are stored first, so that Spark knows their size when it chooses the join.
    known = materialize(renamed, "rank-starts") if within else F.broadcast(renamed)
    placed = hashed.join(known, same).drop(*[f"_at_{c}" for c in buckets])
    groups = buckets
    if partitions is not None:
        number = F.conv("_bucket", 16, 10).cast("long")
        placed = placed.withColumn("_part", int_div(number * partitions, 16**prefix).cast("int"))
        placed = placed.repartitionById(partitions, "_part")
        groups = [*within, "_part", "_bucket"]
    else:
        placed = placed.repartition(*groups)
    # The hash is made anew where the rows have arrived, so that it isn't moved.
    placed = placed.withColumn("_hash", F.md5(text))
    inside = Window.partitionBy(*groups).orderBy("_hash", *keys)
    local = F.sum(F.lit(1).cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = placed.withColumn(name, F.col("_start") + local - 1).drop("_bucket", "_hash", "_start", "_part")
    return ranked if below is None else ranked.where(F.col(name) < limit)


def split_episodes(episodes: DataFrame, fraction: float, seed: int, key: str = "episode_index") -> DataFrame:
    """Label episodes ``train`` or ``val``: the first ``int(fraction * N)`` of the seeded order train.

    The product is taken in doubles and truncated, never rounded.
    """
    size = episodes.agg((F.lit(float(fraction)) * F.count(F.lit(1))).cast("long").alias("n")).scalar()
    return (
        seeded_rank(episodes, key, seed, "_rank")
        .withColumn("split", F.when(F.col("_rank") < size, "train").otherwise("val"))
        .drop("_rank")
    )


def shuffle_epoch(
    frames: DataFrame,
    seed: int,
    epoch: int,
    key: str | Sequence[str] = ("episode_index", "frame_index"),
    name: str = "rank",
) -> DataFrame:
    """A fresh frame order for each epoch: the seeded rank with the epoch as part of the seed."""
    return seeded_rank(frames, key, f"{seed}:{epoch}", name)


def bounded_sample(
    frames: DataFrame,
    max_batches: int,
    batch_size: int,
    seed: int,
    key: str | Sequence[str] = ("episode_index", "frame_index"),
    name: str = "rank",
) -> DataFrame:
    """Draw ``min(n, max_batches * batch_size)`` frames without replacement, ranked in draw order."""
    return seeded_rank(frames, key, seed, name, below=max_batches * batch_size)


def assign_batches(
    ranked: DataFrame,
    batch_size: int | None,
    default_size: int | None = None,
    drop_last: bool = False,
    rank: str = "rank",
) -> DataFrame:
    """``batch_id`` = rank div size; the short last batch is kept unless ``drop_last``.

    ``batch_size=None`` falls back to ``default_size`` (validation falls back to the train size).
    """
    size = batch_size or default_size
    if not size or size < 0:
        raise ValueError("batch_size or default_size must be a positive number")
    batched = ranked.withColumn("batch_id", int_div(F.col(rank), size))
    if not drop_last:
        return batched
    full = ranked.agg(int_div(F.count(F.lit(1)), size).alias("full")).scalar()
    return batched.where(F.col("batch_id") < full)


def step_schedule(
    batched: DataFrame,
    max_steps: int,
    accumulation: int = 1,
    save_every: int | None = None,
    start_step: int = 0,
) -> DataFrame:
    """One row per training step: batches run in order, epoch after epoch, until ``max_steps``.

    Columns: step (from 0), epoch, batch_id, n_samples, is_update (an optimiser update ends the
    step), and with ``save_every`` is_save (a checkpoint follows it; the final step always saves).
    With ``start_step`` (the stored number of steps done) the schedule is resumed: the same
    rows from that step on, its epoch and batch included.

    Every batch is repeated once per epoch that is left, so the rows stay spread over the batches; the epochs of a batch
    come in runs of ``EPOCH_RUN``, so no row holds a long array.
    """
    batches = batched.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_samples"))
    per_epoch = batches.agg(F.count(F.lit(1)).alias("n")).scalar()
    first_epoch = int_div(F.lit(start_step).cast("long"), F.col("_per_epoch"))
    last_epoch = int_div(F.lit(max(max_steps - 1, start_step)).cast("long"), F.col("_per_epoch"))
    run_end = F.least(F.col("_run") + EPOCH_RUN - 1, last_epoch)
    steps = (
        batches.withColumn("_per_epoch", per_epoch)
        .withColumn("_run", F.explode(F.sequence(first_epoch, last_epoch, F.lit(EPOCH_RUN).cast("long"))))
        .withColumn("epoch", F.explode(F.sequence(F.col("_run"), run_end)))
        .withColumn("step", F.col("epoch") * F.col("_per_epoch") + F.col("batch_id"))
        .where((F.col("step") < max_steps) & (F.col("step") >= start_step))
        .withColumn("is_update", F.pmod(F.col("step") + 1, F.lit(accumulation)) == 0)
    )
    columns = ["step", "epoch", "batch_id", "n_samples", "is_update"]
    if save_every:
        done = F.col("step") + 1
        steps = steps.withColumn("is_save", (F.pmod(done, F.lit(save_every)) == 0) | (done == max_steps))
        columns.append("is_save")
    return steps.select(*columns)


def batch_preview(batched: DataFrame, batch_size: int, n: int = 1, rank: str = "rank") -> DataFrame:
    """The first ``n`` samples of every batch, read off the rank: a filter, no shuffle."""
    return batched.where(F.pmod(F.col(rank), F.lit(batch_size)) < n)


def every_n(df: DataFrame, n: int, step: str = "step", offset: int = 0, include_last: bool = False) -> DataFrame:
    """Rows whose step is due: ``(step + offset) % n == 0``, and the last step as well if asked."""
    due = F.pmod(F.col(step) + offset, F.lit(n)) == 0
    if include_last:
        due = due | (F.col(step) == df.agg(F.max(step)).scalar())
    return df.where(due)
