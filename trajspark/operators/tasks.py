"""Task texts, prompts and the augmentation plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The wording of the prompt.
OVERVIEW_LABEL = "Overview cam:"
WRIST_LABEL = "Wrist cam:"
QUESTION_HEAD = "What action should the robot take to "
QUESTION_TAIL = "?"


def attach_task(frames: DataFrame, tasks: DataFrame, strict: bool = True) -> DataFrame:
    """Add the task text by ``task_index``; in strict mode a frame without a task fails the query.

    ``tasks`` has one row per index; in strict mode a repeated index fails the query as well, instead of
    doubling frames. It carries no broadcast hint because its size is not
    bounded: Spark broadcasts it below its threshold, otherwise a frequent task is split
    by adaptive execution.
    """
    known = tasks.select("task_index", "task", F.lit(True).alias("_known"))
    joined = frames.join(known, "task_index", "left")
    if strict:
        # The check of the tasks is a subquery of its own, so that the join stays one that can be split.
        most = tasks.groupBy("task_index").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).scalar()
        twice = F.raise_error(F.lit("more than one task with the same index"))
        message = F.concat(F.lit("no task with index "), F.coalesce(F.col("task_index").cast("string"), F.lit("NULL")))
        joined = joined.withColumn("task", F.when(F.col("_known").isNull(), F.raise_error(message)).when(most > 1, twice).otherwise(F.col("task")))
    return joined.drop("_known")


def render_prompt(frames: DataFrame, image: str = "image_ref", image2: str = "image2_ref") -> DataFrame:
    """Add ``prompt``: five content parts; images enter as references, never as pixels."""

    def part(kind: str, text: Column | None = None, ref: Column | None = None) -> Column:
        nothing = F.lit(None).cast("string")
        return F.struct(
            F.lit(kind).alias("type"),
            (nothing if text is None else text).alias("text"),
            (nothing if ref is None else ref.cast("string")).alias("image_ref"),
        )

    question = F.concat(F.lit(QUESTION_HEAD), F.col("task"), F.lit(QUESTION_TAIL))
    return frames.withColumn(
        "prompt",
        F.array(
            part("text", F.lit(OVERVIEW_LABEL)),
            part("image", ref=F.col(image)),
            part("text", F.lit(WRIST_LABEL)),
            part("image", ref=F.col(image2)),
            part("text", question),
        ),
    )


def augmentation_plan(
    frames: DataFrame,
    transforms: Sequence[str],
    max_n: int,
    seed: int,
    epoch: int,
    random_order: bool = False,
    enable: bool | Column = True,
    key: Sequence[str] = ("episode_index", "frame_index"),
) -> DataFrame:
    """Which transforms each frame gets, and in which order: rows (key, position, transform).

    ``min(len(transforms), max_n)`` are drawn uniformly without repetition; they keep the list's
    order unless ``random_order``. The draw is a sort of a short array inside the row, so
    nothing is joined or shuffled. ``enable`` may be a condition on the frame, such as ``augmented_splits()``; frames
    for which it isn't true get no rows, and without transforms nobody does.
    """
    if not transforms:
        return frames.select(*key, F.lit(0).alias("position"), F.lit("").alias("transform")).where(F.lit(False))
    frames = frames.where(enable if isinstance(enable, Column) else F.lit(enable))
    stem = F.concat_ws(":", F.lit(f"{seed}:{epoch}"), *[F.col(k).cast("string") for k in key])
    drawn = F.array_sort(F.array(*[
        F.struct(
            F.md5(F.concat_ws(":", stem, F.lit(name))).alias("draw"),
            F.lit(number).alias("number"),
            F.lit(name).alias("transform"),
        )
        for number, name in enumerate(transforms)
    ]))
    chosen = F.slice(drawn, 1, max_n)
    if not random_order:
        chosen = F.array_sort(F.transform(chosen, lambda c: F.struct(c["number"].alias("number"), c["transform"].alias("transform"))))
    picked = frames.select(*key, F.posexplode(chosen).alias("position", "_choice"))
    return picked.select(*key, "position", F.col("_choice.transform").alias("transform"))


def augmented_splits(enable: bool = True, validation: bool = False, split: str = "split") -> Column:
    """Whether a frame is augmented: training frames if enabled, validation frames only if asked for as well."""
    if not enable:
        return F.lit(False)
    return F.lit(True) if validation else F.col(split).eqNullSafe("train")
