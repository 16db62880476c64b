"""One query per operator over the given tables; each takes (spark, sf_dir)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.catalog import tables as src
from trajspark.operators import bounds as bd
from trajspark.operators import chunks as ch
from trajspark.operators import episodes as ep
from trajspark.operators import epochs as eo
from trajspark.operators import evaluate as ev
from trajspark.operators import layout as lay
from trajspark.operators import norms
from trajspark.operators import shuffling as sh
from trajspark.operators import sketches as sk
from trajspark.operators import tasks as tk
from trajspark.plans.ordered import ordered_index
from trajspark.plans.training import TrainingPlan, evaluate_policy, prepare_training_set
from trajspark.session import materialize, scratch_path
from trajspark.sources import frames as io
from trajspark.streaming import late, streams
from trajspark.streaming.chunks import stream_chunks as chunk_stream
from trajspark.streaming.state import keyed_state

SEED = 42
CHUNK = 8
BATCH = 32
FRACTION = 0.8
TRANSFORMS = ["brightness", "contrast", "saturation", "hue", "sharpness"]
FRAME_KEY = ["episode_index", "frame_index"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(column: str | Column) -> Column:
    return F.round(column, 6)


def unrolled(df: DataFrame, keys: list[str], column: str = "action") -> DataFrame:
    # The outer form, since for the inner one Spark infers a filter on the vector, which computes it two more times.
    cells = df.select(*keys, F.posexplode_outer(column).alias("dim", "v")).where("dim IS NOT NULL")
    return cells.select(*keys, "dim", r6("v").alias("value"))


def numbered_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as numbered frames, stored: for queries that read them more than once."""
    return materialize(src.lineitem_frames(spark, sf), "numbered-frames")


def long_chunks(df: DataFrame, keys: list[str], column: str = "action_chunk") -> DataFrame:
    cells = ch.unstack_chunks(df.select(*keys, column), column)
    return cells.select(*keys, "step", "dim", r6("value").alias("value"))


# --- sources and sinks -------------------------------------------------------------------------


@query
def scan_frames(spark, sf):
    frames = src.lineitem_rows(spark, sf)
    return frames.select("episode_index", "task_index", *[F.col("action")[i].alias(f"a{i}") for i in range(4)])


@query
def episode_summary(spark, sf):
    return ep.episode_summary(src.lineitem_frames(spark, sf))


@query
def dataset_totals(spark, sf):
    return ep.dataset_totals(src.lineitem_rows(spark, sf))


@query
def saved_bounds(spark, sf):
    path = scratch_path(spark, "saved-bounds")
    io.save_bounds(bd.fit_bounds(src.lineitem_rows(spark, sf)), path)
    return io.load_bounds(spark, path).select("dim", r6("lower").alias("lower"), r6("upper").alias("upper"))


@query
def write_training_set(spark, sf):
    path = scratch_path(spark, "training-set")
    splits = materialize(sh.split_episodes(src.order_episodes(spark, sf), FRACTION, SEED), "splits")
    frames = numbered_frames(spark, sf).join(splits, "episode_index")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = frames.select(*FRAME_KEY, "split")
    ranked = sh.seeded_rank(frames, FRAME_KEY, f"{SEED}:0", within=["split"], count_from=keys, partitions=shards)
    io.write_training_set(sh.assign_batches(ranked, BATCH), path, in_order=True)
    return spark.read.parquet(path).select("split", "batch_id", "rank", "episode_index", "frame_index", "task_index")


@query
def append_metrics(spark, sf):
    """The even steps are logged first and the odd ones appended; the whole log is read back."""
    path = scratch_path(spark, "metrics")
    metrics = src.metric_rows(src.table(spark, sf, "events"))
    io.append_metrics(metrics.where("step % 2 = 0"), path)
    io.append_metrics(metrics.where("step % 2 = 1"), path)
    return io.read_metrics(spark, path).select(F.unix_micros("ts").alias("ts_micros"), "step", "name", "value")


@query
def log_metrics(spark, sf):
    """Two parts of a log, the second one twice, as after a resume: the log is the same."""
    path = scratch_path(spark, "metric-log")
    metrics = src.metric_rows(src.table(spark, sf, "events"))
    for part in (0, 1, 1):
        io.log_metrics(metrics.where(F.col("step") % 2 == part), path)
    return io.read_metrics(spark, path).select(F.unix_micros("ts").alias("ts_micros"), "step", "name", "value")


# --- projections, filters, predicates ----------------------------------------------------------


@query
def project_keys(spark, sf):
    return ep.project_keys(src.lineitem_frames(spark, sf), [*FRAME_KEY, "task_index"])


@query
def check_bounds(spark, sf):
    """Violations among candidate bounds: the largest discount and tax of every part."""
    candidates = src.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("dim")).agg(
        F.max("l_discount").alias("lower"), F.max("l_tax").alias("upper")
    )
    return bd.bound_violations(candidates)


@query
def every_n(spark, sf):
    metrics = src.table(spark, sf, "events").select(F.col("event_id").alias("step"), "event_type", "value")
    return sh.every_n(metrics, 10, offset=1, include_last=True)


@query
def drop_padding(spark, sf):
    return lay.drop_padding(src.conversation_tokens(spark, sf)).select("sample", "pos", "token")


@query
def validate_chunks(spark, sf):
    """Chunks are checked while they are written, so that they are made once."""
    path = scratch_path(spark, "validated-chunks")
    chunks = ch.action_chunk(src.event_frames(spark, sf), CHUNK)
    io.checked_write(chunks, path, {"whole": F.size("action_chunk") == CHUNK})
    bad = F.col("action_chunk").isNull() | (F.size("action_chunk") != CHUNK)
    return spark.read.schema(chunks.schema).parquet(path).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.count_if(bad).alias("n_invalid")
    )


# --- joins -------------------------------------------------------------------------------------


@query
def select_episodes(spark, sf):
    train = sh.split_episodes(src.order_episodes(spark, sf), FRACTION, SEED).where("split = 'train'")
    return ep.select_episodes(src.lineitem_frames(spark, sf), train).select(*FRAME_KEY, "task_index")


@query
def attach_task(spark, sf):
    frames = src.lineitem_frames(spark, sf)
    return tk.attach_task(frames, src.part_tasks(spark, sf)).select(*FRAME_KEY, "task_index", "task")


@query
def ordinal_join(spark, sf):
    """The n-th image slot of a conversation takes the n-th of its feature rows."""
    slots = src.conversation_tokens(spark, sf).where(F.col("token") == lay.IMAGE).select("sample", "pos")
    vectors = src.table(spark, sf, "embeddings")
    count = vectors.agg(F.count(F.lit(1)).alias("n")).scalar()
    cells = src.image_grids(spark, sf).withColumn(
        "cell", F.explode(F.sequence(F.lit(0).cast("long"), lay.image_tokens() - 1))
    )
    features = cells.select(
        "sample",
        (F.col("image_no") * 16 + F.col("cell")).alias("feature"),
        F.pmod(F.col("sample") * 31 + F.col("image_no") * 7 + F.col("cell"), count).alias("vec_id"),
    ).join(vectors.select("vec_id", F.col("embedding")[0].cast("double").alias("v")), "vec_id")
    joined = lay.ordinal_join(slots, features)
    return joined.select("sample", "pos", "ordinal", "vec_id", r6("v").alias("value"))


@query
def prediction_error(spark, sf):
    """Errors on the original scale: chunks are normalised, compared, and unnormalised."""
    target = src.vector_chunks(spark, sf)
    bounds = bd.fit_bounds(target.select(F.explode("action_chunk").alias("action")), 0.0, 1.0)
    predicted = bd.normalize_chunks(src.next_vector_chunks(spark, sf), bounds, "predicted_chunk")
    errors = ev.prediction_error(predicted, bd.normalize_chunks(target, bounds), "vec_id", bounds)
    return errors.select("vec_id", "step", "dim", *[r6(c).alias(c) for c in ("target", "predicted", "error")])


def vector_errors(spark, sf) -> DataFrame:
    ranked = sh.seeded_rank(src.vector_chunks(spark, sf), "vec_id", SEED)
    batched = sh.assign_batches(ranked, BATCH)
    pairs = batched.join(src.next_vector_chunks(spark, sf), "vec_id")
    return ev.chunk_error(pairs, ["vec_id", "batch_id", "label"])


@query
def assign_segment(spark, sf):
    tokens = src.conversation_tokens(spark, sf).select("sample", "pos", "token")
    lengths = src.token_turns(spark, sf).select("sample", "segment", F.size("tokens").alias("length"))
    return lay.assign_segment(tokens, lay.segment_spans(lengths))


@query
def augmentation_plan(spark, sf):
    return tk.augmentation_plan(src.event_frames(spark, sf), TRANSFORMS, 3, SEED, epoch=0)


@query
def augmentation_plan_splits(spark, sf):
    """Validation frames are left as they are."""
    frames = src.event_frames(spark, sf)
    splits = sh.split_episodes(frames.select("episode_index").distinct(), FRACTION, SEED)
    return tk.augmentation_plan(
        frames.join(splits, "episode_index"), TRANSFORMS, 3, SEED, epoch=0, enable=tk.augmented_splits(validation=False)
    )


@query
def augmentation_plan_random(spark, sf):
    return tk.augmentation_plan(src.event_frames(spark, sf), TRANSFORMS, 3, SEED, epoch=1, random_order=True)


# --- aggregations ------------------------------------------------------------------------------


@query
def fit_bounds(spark, sf):
    fitted = bd.fit_bounds(src.lineitem_rows(spark, sf))
    return fitted.select("dim", r6("lower").alias("lower"), r6("upper").alias("upper"))


@query
def fit_bounds_train(spark, sf):
    train = sh.split_episodes(src.order_episodes(spark, sf), FRACTION, SEED).where("split = 'train'")
    fitted = bd.fit_bounds(src.lineitem_rows(spark, sf), episodes=train)
    return fitted.select("dim", r6("lower").alias("lower"), r6("upper").alias("upper"))


@query
def l1_loss(spark, sf):
    return ev.l1_loss(vector_errors(spark, sf)).select(r6("l1_loss").alias("l1_loss"))


@query
def validation_loss(spark, sf):
    return ev.validation_loss(vector_errors(spark, sf)).select(r6("val_loss").alias("val_loss"), "num_batches")


@query
def error_profile(spark, sf):
    profile = ev.error_profile(vector_errors(spark, sf), ["step", "dim", "label"])
    measures = ("mean_target", "mean_predicted", "mean_abs_error", "max_abs_error")
    return profile.select("step", "dim", "label", F.col("level").cast("int").alias("level"), "n", *[r6(m).alias(m) for m in measures])


@query
def error_quantiles(spark, sf):
    """The sketch is fine enough here to give each part's own order statistics."""
    profile = ev.error_profile(vector_errors(spark, sf), ["step", "dim"], quantiles=[0.5, 0.95], accuracy=10_000_000)
    quantile = F.col("abs_error_quantiles")
    return profile.select(
        "step", "dim", F.col("level").cast("int").alias("level"), r6(quantile[0]).alias("median_abs_error"), r6(quantile[1]).alias("p95_abs_error")
    )


@query
def bounds_from_stats(spark, sf):
    """Statistics of the whole table in one row, as two vectors over all four measures."""
    measures = [f"l_{c}" for c in ("quantity", "extendedprice", "discount", "tax")]
    stats = src.table(spark, sf, "lineitem").agg(
        F.array(*map(F.min, measures)).alias("q01"), F.array(*map(F.max, measures)).alias("q99")
    )
    return bd.bounds_from_stats(stats)


def stored_sketches(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Sketches of 16 parts of the order lines, the last four added later; and the frames."""
    path = scratch_path(spark, "sketches")
    frames = src.lineitem_rows(spark, sf).withColumn("part", F.pmod("episode_index", F.lit(16)))
    for parts in (F.col("part") < 12, F.col("part") >= 12):
        sk.store_sketches(sk.sketch_parts(frames.where(parts), "part"), path)
    return sk.read_sketches(spark, path), frames


@query
def refined_bounds(spark, sf):
    """Exact bounds from stored sketches and one pass over the frames."""
    fitted = sk.refined_bounds(*stored_sketches(spark, sf))
    return fitted.select("dim", r6("lower").alias("lower"), r6("upper").alias("upper"))


@query
def sketched_bounds(spark, sf):
    """For each bound taken from the sketches alone: whether its rank is within the stated error of its quantile."""
    sketches, frames = stored_sketches(spark, sf)
    bounds = materialize(sk.sketched_bounds(sketches), "sketched-bounds")
    values = frames.select(F.posexplode("action").alias("dim", "value")).join(bounds, "dim")
    share = lambda holds: F.avg(F.when(holds, 1.0).otherwise(0.0))
    error = F.lit(sk.rank_error())
    within = [
        ((share(F.col("value") < F.col(c)) - error <= q) & (share(F.col("value") <= F.col(c)) + error >= q)).alias(f"{c}_within")
        for c, q in (("lower", 0.01), ("upper", 0.99))
    ]
    return values.groupBy("dim").agg(F.count(F.lit(1)).alias("n_values"), *within)


@query
def grouped_l2_norm(spark, sf):
    """Every vector belongs to its label's component; labels under 5 also to a joint one."""
    vectors = src.table(spark, sf, "embeddings")
    values = vectors.select(F.col("vec_id").alias("param"), F.explode(F.col("embedding").cast("array<double>")).alias("value"))
    own = F.concat(F.lit("label_"), F.col("label").cast("string"))
    membership = vectors.select(
        F.col("vec_id").alias("param"),
        F.explode(F.when(F.col("label") < 5, F.array(own, F.lit("low_labels"))).otherwise(F.array(own))).alias("component"),
    )
    return norms.grouped_l2_norm(values, membership).select("component", r6("l2_norm").alias("l2_norm"), "n_values")


@query
def clip_by_global_norm(spark, sf):
    values = src.table(spark, sf, "embeddings").select(
        "vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "value")
    )
    return norms.clip_by_global_norm(values, 1.0).select("vec_id", "dim", F.round("value", 9).alias("value"))


@query
def size_report(spark, sf):
    splits = sh.split_episodes(src.order_episodes(spark, sf), FRACTION, SEED)
    flagged = src.lineitem_rows(spark, sf).withColumn("large", F.col("action")[0] > 25)
    return ep.size_report(flagged, splits, src.part_tasks(spark, sf), "large", {"train": BATCH, "val": 128})


@query
def image_token_count(spark, sf):
    return lay.image_token_count(src.image_grids(spark, sf))


# --- windows -----------------------------------------------------------------------------------


@query
def action_chunk(spark, sf):
    return long_chunks(ch.action_chunk(src.event_frames(spark, sf), CHUNK), ["event_id"])


@query
def action_chunk_small_blocks(spark, sf):
    """Blocks of 16 frames, so that most chunks lie at an edge."""
    return long_chunks(ch.action_chunk(src.event_frames(spark, sf), CHUNK, block_rows=16), ["event_id"])


@query
def action_chunk_normalized(spark, sf):
    frames = src.event_frames(spark, sf)
    bounds = bd.fit_bounds(frames)
    return long_chunks(ch.action_chunk(frames, CHUNK, bounds), ["event_id"])


@query
def frame_index(spark, sf):
    return src.event_frames(spark, sf).select("event_id", "episode_index", "frame_index")


@query
def frame_index_many_ranges(spark, sf):
    """As many ranges as it takes to cut most episodes."""
    rows = src.event_rows(spark, sf)
    return ep.frame_index(rows, src.EVENT_ORDER, partitions=64).select("event_id", "episode_index", "frame_index")


@query
def global_index(spark, sf):
    return ep.global_index(src.lineitem_frames(spark, sf)).select(*FRAME_KEY, "index")


@query
def text_positions(spark, sf):
    return lay.text_positions(src.conversation_tokens(spark, sf)).select("sample", "pos", "mask", "position")


@query
def position_deltas(spark, sf):
    positions = lay.text_positions(src.conversation_tokens(spark, sf))
    strict = lay.position_deltas(positions, strict_max=True).withColumnRenamed("delta", "strict_delta")
    return lay.position_deltas(positions).join(strict, "sample")


@query
def grid_positions(spark, sf):
    return lay.grid_positions(src.layout_segments(spark, sf))


@query
def grid_positions_video(spark, sf):
    """Every user turn shows a video of several frames, or an image of several."""
    return lay.grid_positions(src.video_segments(spark, sf))


@query
def grid_deltas_video(spark, sf):
    return lay.grid_deltas(src.video_segments(spark, sf))


@query
def grid_deltas(spark, sf):
    return lay.grid_deltas(src.layout_segments(spark, sf))


@query
def media_counts(spark, sf):
    return lay.media_counts(src.conversation_tokens(spark, sf))


@query
def media_counts_video(spark, sf):
    """The images of odd turns are videos, one run of video slots per frame."""
    video = (F.col("segment") % 2 == 1) & (F.col("token") == lay.IMAGE)
    tokens = src.conversation_tokens(spark, sf)
    return lay.media_counts(tokens.withColumn("token", F.when(video, lay.VIDEO).otherwise(F.col("token"))))


@query
def sequence_offsets_video(spark, sf):
    grids = src.image_grids(spark, sf).withColumn("t", (1 + F.pmod("image_no", F.lit(3))).cast("int"))
    return lay.sequence_offsets(grids, block_rows=2)


@query
def sequence_offsets(spark, sf):
    return lay.sequence_offsets(src.image_grids(spark, sf))


# --- order, sampling, batches ------------------------------------------------------------------


@query
def seeded_rank(spark, sf):
    return sh.seeded_rank(src.order_episodes(spark, sf), "episode_index", SEED)


@query
def split_episodes(spark, sf):
    return sh.split_episodes(src.order_episodes(spark, sf), FRACTION, SEED)


def event_keys(spark, sf) -> DataFrame:
    return src.table(spark, sf, "events").select("event_id", F.col("event_type"), "value")


@query
def shuffle_epoch(spark, sf):
    epochs = [sh.shuffle_epoch(event_keys(spark, sf), SEED, e, "event_id").withColumn("epoch", F.lit(e)) for e in (0, 1)]
    return epochs[0].unionByName(epochs[1]).select("epoch", "event_id", "rank")


def indexed_events(spark, sf) -> tuple[DataFrame, int]:
    events = src.table(spark, sf, "events").select("event_id")
    return ordered_index(events, [], ["event_id"], "index"), events.count()


@query
def epoch_order(spark, sf):
    """The place of every event in two epochs, by a permutation of its index."""
    events, n = indexed_events(spark, sf)
    orders = {f"rank_{e}": eo.EpochOrder(n, SEED, e).rank("index") for e in (0, 1)}
    return events.withColumns(orders).select("event_id", *orders)


@query
def epoch_batches(spark, sf):
    """All batches of an epoch, fetched by the inverse permutation."""
    events, n = indexed_events(spark, sf)
    return eo.fetch_batches(events, eo.EpochOrder(n, SEED, 0), BATCH).select("batch_id", "rank", "event_id")


@query
def bounded_sample(spark, sf):
    return sh.bounded_sample(event_keys(spark, sf), 16, 128, SEED, "event_id").select("event_id", "rank")


@query
def assign_batches(spark, sf):
    ranked = sh.shuffle_epoch(event_keys(spark, sf), SEED, 0, "event_id")
    return sh.assign_batches(ranked, None, BATCH).select("event_id", "rank", "batch_id")


@query
def assign_batches_full_only(spark, sf):
    ranked = sh.shuffle_epoch(event_keys(spark, sf), SEED, 0, "event_id")
    return sh.assign_batches(ranked, 48, drop_last=True).select("event_id", "rank", "batch_id")


@query
def step_schedule(spark, sf):
    """Steps of two and a half epochs over all events, an update every fourth step."""
    batched = sh.assign_batches(sh.shuffle_epoch(event_keys(spark, sf), SEED, 0, "event_id"), BATCH)
    n = event_keys(spark, sf).count()
    return sh.step_schedule(batched, int(2.5 * -(-n // BATCH)), accumulation=4, save_every=100)


@query
def step_schedule_resumed(spark, sf):
    """The same schedule, taken up after one and a half epochs."""
    batched = sh.assign_batches(sh.shuffle_epoch(event_keys(spark, sf), SEED, 0, "event_id"), BATCH)
    per_epoch = -(-event_keys(spark, sf).count() // BATCH)
    return sh.step_schedule(batched, int(2.5 * per_epoch), accumulation=4, save_every=100, start_step=int(1.5 * per_epoch))


@query
def batch_preview(spark, sf):
    batched = sh.assign_batches(sh.shuffle_epoch(event_keys(spark, sf), SEED, 0, "event_id"), BATCH)
    return sh.batch_preview(batched, BATCH, 2).select("batch_id", "rank", "event_id", "value")


@query
def complement_episodes(spark, sf):
    episodes = src.order_episodes(spark, sf)
    train = sh.split_episodes(episodes, FRACTION, SEED).where("split = 'train'")
    return ep.complement_episodes(episodes, train)


# --- scalar and array functions ----------------------------------------------------------------


@query
def normalize_actions(spark, sf):
    frames = numbered_frames(spark, sf)
    return unrolled(bd.normalize_actions(frames, bd.fit_bounds(frames)), FRAME_KEY)


@query
def unnormalize_actions(spark, sf):
    frames = numbered_frames(spark, sf)
    bounds = bd.assert_bounds(bd.fit_bounds(frames))
    return unrolled(bd.unnormalize_actions(bd.normalize_actions(frames, bounds), bounds), FRAME_KEY)


@query
def normalize_chunks(spark, sf):
    chunks = src.vector_chunks(spark, sf)
    bounds = bd.fit_bounds(chunks.select(F.explode("action_chunk").alias("action")))
    return long_chunks(bd.normalize_chunks(chunks, bounds), ["vec_id"])


@query
def unnormalize_chunks(spark, sf):
    chunks = src.vector_chunks(spark, sf)
    bounds = bd.fit_bounds(chunks.select(F.explode("action_chunk").alias("action")))
    return long_chunks(bd.unnormalize_chunks(bd.normalize_chunks(chunks, bounds), bounds), ["vec_id"])


def with_images(frames: DataFrame) -> DataFrame:
    name = F.concat_ws("/", F.col("episode_index").cast("string"), F.col("frame_index").cast("string"))
    return frames.withColumns({"image_ref": F.concat(F.lit("overview/"), name), "image2_ref": F.concat(F.lit("wrist/"), name)})


@query
def render_prompt(spark, sf):
    frames = tk.attach_task(src.lineitem_frames(spark, sf), src.part_tasks(spark, sf))
    parts = tk.render_prompt(with_images(frames)).select(*FRAME_KEY, F.posexplode("prompt").alias("part", "p"))
    return parts.select(*FRAME_KEY, "part", "p.type", "p.text", "p.image_ref")


@query
def format_actions(spark, sf):
    return ev.format_actions(src.vector_chunks(spark, sf)).select("vec_id", "text")


@query
def pad_left(spark, sf):
    padded = lay.pad_left(src.turn_sequences(spark, sf), F.lit(0).cast("long"), "sample")
    zipped = F.arrays_zip(F.col("input_ids").alias("id"), F.col("attention_mask").alias("mask"))
    cells = padded.select("sample", "segment", F.posexplode(zipped).alias("pos", "z"))
    return cells.select("sample", "segment", "pos", F.col("z.id").alias("token_id"), F.col("z.mask").alias("mask"))


@query
def append_suffix(spark, sf):
    length = F.size("input_ids")
    sequences = src.turn_sequences(spark, sf).withColumns({
        "attention_mask": F.array_repeat(F.lit(1), length),
        "position_ids": F.transform(F.sequence(F.lit(1), length), lambda i: (i - 1).cast("long")),
    })
    zipped = F.arrays_zip(
        F.col("input_ids").alias("id"), F.col("attention_mask").alias("mask"), F.col("position_ids").alias("position")
    )
    cells = lay.append_suffix(sequences).select("sample", "segment", F.posexplode(zipped).alias("pos", "z"))
    return cells.select("sample", "segment", "pos", F.col("z.id").alias("token_id"), F.col("z.mask").alias("mask"), F.col("z.position").alias("position"))


def image_rows(spark, sf) -> DataFrame:
    return ordered_index(src.image_grids(spark, sf), ["sample"], ["image_no"], "row")


@query
def repeat_samples(spark, sf):
    copies = lay.repeat_samples(image_rows(spark, sf), 3, "row")
    return copies.select("sample", "image_no", "repeat", "position")


@query
def repeat_sample_blocks(spark, sf):
    copies = lay.repeat_samples(image_rows(spark, sf), 3, "block")
    return copies.select("sample", "image_no", "repeat", "position")


@query
def unstack_chunks(spark, sf):
    return long_chunks(src.vector_chunks(spark, sf), ["vec_id"])


@query
def stack_chunks(spark, sf):
    """Matrix, long form, matrix again, written out in one text per step."""
    long = ch.unstack_chunks(src.vector_chunks(spark, sf).select("vec_id", "action_chunk"))
    stacked = ch.stack_chunks(long, "vec_id")
    steps = stacked.select("vec_id", F.posexplode("action_chunk").alias("step", "row"))
    return steps.select("vec_id", "step", F.size("row").alias("n_dims"), *[r6(F.col("row")[i]).alias(f"d{i}") for i in range(8)])


# --- streaming ---------------------------------------------------------------------------------


def event_stream(spark, sf) -> DataFrame:
    schema = src.table(spark, sf, "events").schema
    # A pattern, because a streaming path without one must be a folder, and this may be one file.
    return spark.readStream.schema(schema).parquet(f"{sf}/[e]vents.parquet")


@query
def stream_normalize(spark, sf):
    bounds = bd.fit_bounds(src.table(spark, sf, "events").select(F.array("value").alias("action")))
    frames = event_stream(spark, sf).select("event_id", F.array("value").alias("action"))
    normal = streams.stream_normalize(frames, bounds)
    done = streams.drain_to_table(normal, scratch_path(spark, "stream-normalize"))
    return done.select("event_id", r6(F.col("action")[0]).alias("value"))


@query
def stream_chunks(spark, sf):
    """Frames arrive in three parts by time; chunks go out as they become whole, the rest when a much later row ends all episodes."""
    numbered = materialize(src.event_frames(spark, sf).select("episode_index", "frame_index", "action", src.utc().alias("ts")), "event-frames")
    first, last = numbered.agg(F.min("ts"), F.max("ts")).first()
    arriving, table = scratch_path(spark, "stream-frames"), scratch_path(spark, "stream-chunks")
    cuts = [first + (last - first) * k / 3 for k in (1, 2)]
    parts = [
        numbered.where(F.col("ts") < cuts[0]), numbered.where(F.col("ts").between(cuts[0], cuts[1])), numbered.where(F.col("ts") > cuts[1]),
        spark.createDataFrame([(None, None, None, last + dt.timedelta(days=4000))], numbered.schema),
    ]
    done = None
    for part in parts:
        part.write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(numbered.schema).parquet(arriving)
        with keyed_state(spark):
            done = streams.drain_to_table(chunk_stream(stream, CHUNK, "3650 DAYS", "1 day"), table)
    return long_chunks(done, FRAME_KEY)


@query
def stream_metrics_late(spark, sf):
    """Three parts that all span the whole time, so that most of the later two is late; every row is in time or late."""
    events = src.table(spark, sf, "events")
    arriving, log = scratch_path(spark, "late-events"), scratch_path(spark, "late-metrics")
    for part in range(3):
        events.where(F.pmod("event_id", F.lit(3)) == part).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(events.schema).parquet(arriving)
        late.drain_metrics(src.metric_rows(stream), log, "1 day", "10 DAYS")
    behind = late.late_rows(spark, log).groupBy("start", "name").agg(F.count(F.lit(1)).alias("n_late"), F.sum("delay_micros").alias("delay_micros"))
    both = late.window_sums(spark, log).join(behind, ["start", "name"], "full")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select(F.unix_seconds("start").alias("start_seconds"), "name", r6("mean_value").alias("mean_value"), zero("n"), zero("n_late"), zero("delay_micros"))


@query
def stream_metrics(spark, sf):
    """The events arrive in three parts by time, each drained when it is there: state and results go on."""
    events = src.table(spark, sf, "events")
    first, last = events.agg(F.min("ts"), F.max("ts")).first()
    arriving, log = scratch_path(spark, "stream-events"), scratch_path(spark, "stream-metrics")
    done = None
    for part in range(3):
        begin, end = (first + (last - first) * k / 3 for k in (part, part + 1))
        of_part = (F.col("ts") >= F.lit(begin)) & ((F.col("ts") < F.lit(end)) | F.lit(part == 2))
        events.where(of_part).write.mode("append").parquet(arriving)
        stream = spark.readStream.schema(events.schema).parquet(arriving)
        done = streams.drain_updates(streams.stream_metrics(src.metric_rows(stream), "1 day", "1 hour"), log, ["start", "end", "name"])
    return done.select(F.unix_seconds("start").alias("start_seconds"), "name", r6("mean_value").alias("mean_value"), "n")


# --- user functions ----------------------------------------------------------------------------


def make_mixing_policy():
    """A fixed linear policy: each value moves half way to the mean of its step."""

    def predict(vectors):
        steps = vectors.reshape(len(vectors), -1, src.VECTOR_WIDTH)
        mixed = 0.5 * steps + 0.5 * steps.mean(axis=2, keepdims=True)
        return mixed.reshape(len(vectors), -1)

    return predict


def policy_samples(spark, sf) -> DataFrame:
    vector = F.col("embedding").cast("array<double>")
    return ch.stack_vector(
        src.table(spark, sf, "embeddings").select("vec_id", vector.alias("vector"), vector.alias("action_chunk")),
        "action_chunk", src.VECTOR_WIDTH,
    )


@query
def score_policy(spark, sf):
    scored = ev.score_policy(policy_samples(spark, sf), make_mixing_policy, ["vector"], [[64]], 128, src.VECTOR_WIDTH)
    return long_chunks(scored, ["vec_id"], "predicted_chunk")


@query
def evaluate_policy_loss(spark, sf):
    loss = evaluate_policy(
        policy_samples(spark, sf), ["vec_id"], make_mixing_policy, ["vector"], [[64]], src.VECTOR_WIDTH, 256, 128, SEED
    )
    return loss.select(r6("val_loss").alias("val_loss"), "num_batches")


def batch_mean(batch: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"batch_id": batch["batch_id"].iloc[:1], "n": [len(batch)], "mean_value": [batch["value"].mean()]})


@query
def map_batches(spark, sf):
    batched = sh.assign_batches(sh.shuffle_epoch(event_keys(spark, sf), SEED, 0, "event_id"), BATCH)
    means = ev.map_batches(batched.select("batch_id", "value"), batch_mean, "batch_id long, n long, mean_value double")
    # Means of 32 two-decimal values end at the 7th decimal, so the 8th leaves no tie to round.
    return means.withColumn("mean_value", F.round("mean_value", 8))


# --- the whole preparation ---------------------------------------------------------------------


@query
def training_set(spark, sf):
    """Every frame of the input, each with its chunk, its prompt and its batch."""
    frames, tasks = with_images(numbered_frames(spark, sf)), src.part_tasks(spark, sf)
    plan = TrainingPlan(SEED, CHUNK, FRACTION, BATCH, val_batch_size=128, prompt_images=("image_ref", "image2_ref"))
    batched = prepare_training_set(frames, tasks, plan)
    first, last = F.element_at("action_chunk", 1), F.element_at("action_chunk", -1)
    return batched.select(
        "split", "batch_id", "rank", *FRAME_KEY, "task", F.element_at("prompt", -1)["text"].alias("question"),
        r6(first[1]).alias("first_price"), r6(last[1]).alias("last_price"),
        r6(first[0]).alias("first_quantity"), r6(last[0]).alias("last_quantity"),
    )
