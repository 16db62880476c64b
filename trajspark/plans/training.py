"""The whole preparation of a training set, and the evaluation of a policy, as one plan each."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.operators.bounds import fit_bounds
from trajspark.operators.chunks import action_chunk
from trajspark.operators.evaluate import chunk_error, score_policy, validation_loss
from trajspark.operators.shuffling import assign_batches, bounded_sample, seeded_rank, split_episodes
from trajspark.operators.tasks import attach_task, render_prompt
from trajspark.plans.ordered import int_div
from trajspark.session import materialize


@dataclass(frozen=True)
class TrainingPlan:
    """Settings of a run; the defaults are the usual ones."""

    seed: int = 42
    chunk_len: int = 8
    train_fraction: float = 0.8
    batch_size: int = 32
    val_batch_size: int | None = None
    max_val_batches: int | None = None  # None keeps all validation frames; a number draws a sample for each evaluation
    quantiles: tuple[float, float] = (0.01, 0.99)
    fit_on: str = "all"
    prompt_images: tuple[str, str] | None = None  # columns with the references of both images; gives each frame its prompt


def prepare_training_set(
    frames: DataFrame,
    tasks: DataFrame,
    plan: TrainingPlan = TrainingPlan(),
    epoch: int = 0,
    partitions: int | None = None,
) -> DataFrame:
    """Frames to batches: split, bounds, chunks, tasks, shuffled order, batch numbers.

    Every training frame is kept, and every validation frame unless ``max_val_batches`` asks for a sample. Split and task
    are attached to the frames before these grow into chunks; the prompt is rendered at the very end, so it is never moved. Frames take
    their rank before they grow as well, unless a sample is drawn (a chunk needs the frames that the sample leaves out) or, with
    ``partitions``, the result is to be laid out in batch order, ready for ``write_training_set(..., in_order=True)``: then
    the chunks are moved once to their block and once to their rank.
    """
    # One row per episode, read several times; and the split must not change between its readers.
    episodes = materialize(frames.select("episode_index").distinct(), "episodes")
    splits = materialize(split_episodes(episodes, plan.train_fraction, plan.seed), "splits")
    fit_episodes = splits.where("split = 'train'") if plan.fit_on == "train" else None
    bounds = fit_bounds(frames, *plan.quantiles, episodes=fit_episodes)
    described = attach_task(frames.join(splits, "episode_index"), tasks)
    val_size = plan.val_batch_size or plan.batch_size
    is_train = F.col("split") == "train"
    limit = None
    if plan.max_val_batches is not None:
        limit = F.when(is_train, F.lit(2**63 - 1)).otherwise(F.lit(plan.max_val_batches * val_size))

    def rank(rows: DataFrame) -> DataFrame:
        return seeded_rank(
            rows,
            ["episode_index", "frame_index"],
            f"{plan.seed}:{epoch}",
            below=limit,
            within=["split"],
            count_from=frames.select("episode_index", "frame_index").join(splits, "episode_index"),
            partitions=partitions,
        )

    if limit is None and partitions is None:
        ranked = action_chunk(rank(described), plan.chunk_len, bounds)
    else:
        ranked = rank(action_chunk(described, plan.chunk_len, bounds))
    if plan.prompt_images is not None:
        ranked = render_prompt(ranked, *plan.prompt_images)
    size = F.when(is_train, F.lit(plan.batch_size)).otherwise(F.lit(val_size)).cast("long")
    return ranked.withColumn("batch_id", int_div(F.col("rank"), size))


def evaluate_policy(
    samples: DataFrame,
    key: Sequence[str],
    make_predict_fn: Callable,
    inputs: Sequence[str],
    input_shapes: Sequence[Sequence[int]],
    action_dim: int,
    max_batches: int = 256,
    batch_size: int = 128,
    seed: int = 42,
) -> DataFrame:
    """Bounded sample, batches, prediction, error, mean of the batch means."""
    batched = assign_batches(bounded_sample(samples, max_batches, batch_size, seed, key), batch_size)
    scored = score_policy(batched, make_predict_fn, inputs, input_shapes, batch_size, action_dim)
    return validation_loss(chunk_error(scored, [*key, "batch_id"]))
