"""Layout of token sequences: padding, positions, media slots, segments.

Tokens in long form are rows (sample, pos, token, mask) with ``pos`` unique in its sample. A sample may
be arbitrarily long, so nothing here windows over a whole sample.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.plans.ordered import BLOCK, BLOCK_ROWS, int_div, ordered_totals, running_totals

# What the model's layout prescribes.
MERGE_SIZE = 2        # image patches merged per axis into one token
SUFFIX_SLOTS = 64     # extra slots after the prompt
SUFFIX_POSITION = 500  # position that all extra slots share
MASKED_POSITION = 1   # position of a masked slot

# Names of the special tokens in string form; give ids instead where tokens are integers.
IMAGE, VIDEO, VISION_START, VISION_END = "<image>", "<video>", "<vision_start>", "<vision_end>"


# --- masks and padding -------------------------------------------------------------------------


def drop_padding(tokens: DataFrame) -> DataFrame:
    """Keep the positions whose mask is 1."""
    return tokens.where(F.col("mask") == 1)


def pad_sequences(
    sequences: DataFrame,
    pad: Column | int | str,
    batch: str | None = None,
    tokens: str = "input_ids",
    side: str = "left",
) -> DataFrame:
    """Pad each token array to the longest of its batch (of the table, if ``batch`` is None).

    Adds ``attention_mask`` (0 on padding). Only the batch maxima are shuffled with
    map-side combine; sequences meet them by an ordinary join, which adaptive execution may
    broadcast or split when one batch is large.
    """
    if side not in ("left", "right"):
        raise ValueError("side is 'left' or 'right'")
    longest = F.max(F.size(tokens)).alias("_longest")
    if batch is None:
        sized = sequences.withColumn("_longest", sequences.agg(longest).scalar())
    else:
        sizes = sequences.groupBy(F.col(batch).alias("_batch")).agg(longest)
        sized = sequences.join(sizes, F.col(batch).eqNullSafe(F.col("_batch")))  # NULL is a batch, too
    gap = F.col("_longest") - F.size(tokens)
    padding = F.array_repeat(pad if isinstance(pad, Column) else F.lit(pad), gap)
    zeros, ones = F.array_repeat(F.lit(0), gap), F.array_repeat(F.lit(1), F.size(tokens))
    left = side == "left"
    columns = [c for c in sequences.columns if c != tokens]
    return sized.select(
        *columns,
        (F.concat(padding, tokens) if left else F.concat(tokens, padding)).alias(tokens),
        (F.concat(zeros, ones) if left else F.concat(ones, zeros)).alias("attention_mask"),
    )


def pad_left(
    sequences: DataFrame, pad: Column | int | str, batch: str | None = None, tokens: str = "input_ids"
) -> DataFrame:
    """:func:`pad_sequences` on the left, the side that generation needs."""
    return pad_sequences(sequences, pad, batch, tokens, "left")


def append_suffix(
    sequences: DataFrame,
    n: int = SUFFIX_SLOTS,
    position: int = SUFFIX_POSITION,
    tokens: str = "input_ids",
    mask: str = "attention_mask",
    positions: str | None = "position_ids",
) -> DataFrame:
    """Append ``n`` slots to each sequence: id 0, mask 1, all at the same fixed position."""
    longer = sequences.withColumn(tokens, F.concat(tokens, F.array_repeat(F.lit(0).cast("long"), n)))
    longer = longer.withColumn(mask, F.concat(mask, F.array_repeat(F.lit(1), n)))
    if positions is None:
        return longer
    return longer.withColumn(positions, F.concat(positions, F.array_repeat(F.lit(position).cast("long"), n)))


# --- positions ---------------------------------------------------------------------------------


def text_positions(tokens: DataFrame, with_mask: bool = True, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``position``: the number of unmasked slots so far, minus 1; masked slots get 1.

    Without a mask the position is ``pos`` itself.
    """
    if not with_mask:
        return tokens.withColumn("position", F.col("pos").cast("long"))
    counted = running_totals(tokens, ["sample"], "pos", {"_seen": F.col("mask").cast("long")}, block_rows)
    return counted.withColumn(
        "position", F.when(F.col("mask") == 0, F.lit(MASKED_POSITION).cast("long")).otherwise(F.col("_seen") - 1)
    ).drop("_seen")


def position_deltas(positions: DataFrame, with_mask: bool = True, strict_max: bool = False) -> DataFrame:
    """Per sample ``delta`` = largest position + 1 - length (0 without a mask).

    The maximum runs over the masked slots' 1 as well, unless ``strict_max``.
    """
    highest = F.max(F.when(F.col("mask") == 1, F.col("position"))) if strict_max else F.max("position")
    delta = highest + 1 - F.count(F.lit(1)) if with_mask else F.lit(0).cast("long")
    return positions.groupBy("sample").agg(delta.alias("delta"))


def _segment_sizes(segments: DataFrame, merge: int) -> DataFrame:
    """Add merged ``height`` and ``width``, the positions a segment ``advance``s, and its ``slots``."""
    kind = F.col("kind")
    sized = segments.withColumns({
        "height": F.call_function("div", F.col("h"), F.lit(merge)).cast("long"),
        "width": F.call_function("div", F.col("w"), F.lit(merge)).cast("long"),
    })
    # A video is a run of one-frame grids, each starting where the one before it ends.
    advance = (
        F.when(kind == "text", F.col("length"))
        .when(kind == "image", F.greatest("t", "height", "width"))
        .when(kind == "video", F.col("t") * F.greatest(F.lit(1), "height", "width"))
        .otherwise(0)
    )
    slots = F.when(kind.isin("text", "pad"), F.col("length")).otherwise(F.col("t") * F.col("height") * F.col("width"))
    return sized.withColumns({"advance": advance.cast("long"), "slots": slots.cast("long")})


def _placed_segments(segments: DataFrame, merge: int, block_rows: int) -> DataFrame:
    """Segments with their sizes, first slot and first position."""
    sized = _segment_sizes(segments, merge).select("sample", "segment", "kind", "height", "width", "advance", "slots")
    totals = {"_positions": F.col("advance"), "_slots": F.col("slots")}
    return running_totals(sized, ["sample"], "segment", totals, block_rows).withColumns({
        "first_position": F.col("_positions") - F.col("advance"),
        "first_slot": F.col("_slots") - F.col("slots"),
    })


def grid_positions(segments: DataFrame, merge: int = MERGE_SIZE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows (sample, slot, mask, pos_t, pos_h, pos_w) for sequences that mix text and images.

    ``segments`` is (sample, segment, kind, length, t, h, w): ``text`` and ``pad`` have a length,
    ``image`` and ``video`` a grid. Text advances all axes by its length; a grid starts where
    the text before it ends, and what follows it starts after its largest position. Padding
    takes slots but no positions: it is masked and sits at position 1. The running sums are over
    segments, of which there are far fewer than slots; each segment is then unrolled in place.
    """
    placed = _placed_segments(segments, merge, block_rows).where("slots > 0")
    cells = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("i"))
    start, i, kind = F.col("first_position"), F.col("i"), F.col("kind")
    plane = F.greatest(F.col("height") * F.col("width"), F.lit(1))
    frame = F.call_function("div", i, plane)
    # Frames of a video follow each other, frames of one image share the start.
    frame_start = start + frame * F.greatest(F.lit(1), F.col("height"), F.col("width"))
    row = F.call_function("div", F.pmod(i, plane), F.greatest(F.col("width"), F.lit(1)))
    column = F.pmod(i, F.greatest(F.col("width"), F.lit(1)))

    def axis(image: Column, video: Column) -> Column:
        return (
            F.when(kind == "pad", F.lit(MASKED_POSITION))
            .when(kind == "text", start + i)
            .when(kind == "image", start + image)
            .otherwise(frame_start + video)
            .cast("long")
        )

    return cells.select(
        "sample",
        (F.col("first_slot") + i).alias("slot"),
        F.when(kind == "pad", 0).otherwise(1).alias("mask"),
        axis(frame, F.lit(0)).alias("pos_t"),
        axis(row, row).alias("pos_h"),
        axis(column, column).alias("pos_w"),
    )


def grid_deltas(segments: DataFrame, merge: int = MERGE_SIZE) -> DataFrame:
    """Per sample ``delta`` = largest position + 1 - padded length, from segment totals alone.

    Where no sample of the table has an image or video, the text rule applies, under which a
    padded slot's 1 counts towards the maximum.
    """
    # The order of the segments does not matter here: the largest position is the sum of the advances - 1.
    kind = F.col("kind")
    padding = F.when(kind == "pad", F.col("length")).otherwise(0)
    any_media = segments.agg(F.coalesce(F.bool_or(kind.isin("image", "video")), F.lit(False))).scalar()
    sums = _segment_sizes(segments, merge).groupBy("sample").agg(
        F.sum("advance").alias("end"),
        F.sum("slots").alias("slots"),
        F.sum(padding.cast("long")).alias("padding"),
    )
    text_only_end = F.when(F.col("padding") > 0, F.greatest(F.col("end"), F.lit(MASKED_POSITION + 1))).otherwise(F.col("end"))
    end = F.when(any_media, F.col("end")).otherwise(text_only_end)
    return sums.select("sample", (end - F.col("slots")).alias("delta"))


# --- media -------------------------------------------------------------------------------------


def image_tokens(merge: int = MERGE_SIZE) -> Column:
    """Tokens of one image grid: t * h * w over the merged patch area, in whole numbers."""
    patches = F.col("t").cast("long") * F.col("h") * F.col("w")
    return F.call_function("div", patches, F.lit(merge * merge))


def image_token_count(grids: DataFrame, merge: int = MERGE_SIZE) -> DataFrame:
    """Number of images and of image tokens per sample."""
    return grids.groupBy("sample").agg(
        F.count(F.lit(1)).alias("n_images"), F.sum(image_tokens(merge)).alias("n_tokens")
    )


def media_counts(
    tokens: DataFrame,
    image: int | str = IMAGE,
    video: int | str = VIDEO,
    start: int | str = VISION_START,
    wrap: bool = True,
) -> DataFrame:
    """Images and videos per sample: media tokens that directly follow a vision-start token.

    With ``wrap`` the slot before the first one is the last one. A start token is sent to
    the position after it, where it meets the media token by an aggregation on (sample, pos): only
    the special tokens are shuffled, and no sample is brought together as a whole.
    """
    token, pos = F.col("token"), F.col("pos").cast("long")
    ends = tokens.groupBy("sample").agg(
        F.min_by("token", "pos").alias("first"), F.max_by("token", "pos").alias("last")
    )
    wrapped = F.lit(wrap) & (F.col("last") == F.lit(start))
    at_seam = ends.select(
        "sample",
        (wrapped & (F.col("first") == F.lit(image))).cast("long").alias("images"),
        (wrapped & (F.col("first") == F.lit(video))).cast("long").alias("videos"),
    )
    is_start = token == F.lit(start)
    meets = (
        tokens.where(token.isin(start, image, video))
        .groupBy("sample", F.when(is_start, pos + 1).otherwise(pos).alias("at"))
        .agg(
            F.bool_or(is_start).alias("after_start"),
            F.bool_or(token == F.lit(image)).alias("image"),
            F.bool_or(token == F.lit(video)).alias("video"),
        )
        .where("after_start")
        .select("sample", F.col("image").cast("long").alias("images"), F.col("video").cast("long").alias("videos"))
    )
    return at_seam.unionByName(meets).groupBy("sample").agg(
        F.sum("images").alias("n_images"), F.sum("videos").alias("n_videos")
    )


def ordinal_join(
    slots: DataFrame, features: DataFrame, strict: bool = True, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Give the n-th slot of a sample (by ``pos``) its n-th feature row (by ``feature``).

    Both sides get an ordinal per sample and meet on (sample, ordinal), a unique key, so a long
    sample spreads over all tasks. In strict mode a slot without a feature, or the other way
    round, fails the query.
    """
    one = F.lit(1).cast("long")
    left = running_totals(slots, ["sample"], "pos", {"ordinal": one}, block_rows)
    right = running_totals(features, ["sample"], "feature", {"ordinal": one}, block_rows)
    keys = ["sample", "ordinal"]
    if not strict:
        return left.join(right, keys)
    left, right = left.withColumn("_slot", F.lit(True)), right.withColumn("_feature", F.lit(True))
    unmatched = F.col("_slot").isNull() | F.col("_feature").isNull()
    message = F.concat(F.lit("slots and features do not match in sample "), F.col("sample").cast("string"))
    joined = left.join(right, keys, "full").withColumn(
        "ordinal", F.when(unmatched, F.raise_error(message)).otherwise(F.col("ordinal"))
    )
    return joined.drop("_slot", "_feature")


# --- segments and offsets ----------------------------------------------------------------------


def sequence_offsets(
    grids: DataFrame,
    sample: str = "sample",
    image: str = "image_no",
    block_rows: int = BLOCK_ROWS,
    partitions: int | None = None,
) -> DataFrame:
    """Prefix offsets over all frames of all grids, by (sample, image): rows (entry, offset), starting with (0, 0).

    Totals of whole samples are summed up first; within a sample the running sums go by blocks of images, and
    the t frames of a grid then follow in place.
    """
    frames, area = F.col("t").cast("long"), F.col("h").cast("long") * F.col("w")
    totals = {"_entries": frames, "_tokens": frames * area}
    shown = grids.select(sample, image, "t", "h", "w").where("t > 0")
    sizes = shown.groupBy(sample).agg(*[F.sum(v).alias(f"_all{n}") for n, v in totals.items()])
    ends = ordered_totals(sizes, [], [sample], {f"_end{n}": F.col(f"_all{n}") for n in totals}, partitions)
    starts = ends.select(
        F.col(sample).alias("_sample"), *[(F.col(f"_end{n}") - F.col(f"_all{n}")).alias(f"_start{n}") for n in totals]
    )
    inside = running_totals(shown, [sample], image, totals, block_rows)
    placed = inside.join(starts, F.col(sample).eqNullSafe(F.col("_sample")))
    each = placed.select("*", F.explode(F.sequence(F.lit(1).cast("long"), frames)).alias("i"))
    offsets = each.select(
        (F.col("_start_entries") + F.col("_entries") - frames + F.col("i")).alias("entry"),
        (F.col("_start_tokens") + F.col("_tokens") + (F.col("i") - frames) * area).alias("offset"),
    )
    zero = F.lit(0).cast("long")
    first = grids.sparkSession.range(1).select(zero.alias("entry"), zero.alias("offset"))
    return first.unionByName(offsets)


def segment_spans(segments: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(sample, segment, start, end) from (sample, segment, length), end exclusive."""
    ends = running_totals(segments, ["sample"], "segment", {"end": F.col("length").cast("long")}, block_rows)
    return ends.select("sample", "segment", (F.col("end") - F.col("length")).alias("start"), "end")


def assign_segment(positions: DataFrame, spans: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add the ``segment`` whose [start, end) holds ``pos``; NULL outside every segment.

    A range join by sorting: in each block of positions the last start at or before ``pos`` names
    its segment. A segment that reaches into later blocks leaves a mark at their beginning, so
    blocks are independent; no pair of a position and a span is ever formed. The spans of a
    sample must not overlap; where one begins before the last one has ended, the query fails.
    """
    first = int_div(F.col("start"), block_rows)
    last = int_div(F.col("end") - 1, block_rows)
    marks = spans.where(F.col("end") > F.col("start")).select(
        "sample",
        F.explode(F.sequence(first, last)).alias(BLOCK),
        F.col("start").alias("_at"),
        F.struct("segment", "end").alias("_span"),
    )
    columns = positions.columns
    placed = positions.select(
        "sample",
        int_div(F.col("pos").cast("long"), block_rows).alias(BLOCK),
        F.col("pos").cast("long").alias("_at"),
        F.struct(*columns).alias("_row"),
    )
    in_order = Window.partitionBy("sample", BLOCK).orderBy("_at", F.col("_row").isNotNull())
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    marked = placed.unionByName(marks, allowMissingColumns=True).repartition("sample", BLOCK).select(
        "_row", "_at",
        F.last("_span", ignorenulls=True).over(so_far).alias("_span"),
        # The end of every span that has begun: none may reach beyond the start of a later one.
        (F.max("_span.end").over(in_order.rowsBetween(Window.unboundedPreceding, -1)) > F.col("_at")).alias("_open"),
        F.col("_span").isNotNull().alias("_begins"),
    )
    overlap = F.col("_begins") & F.col("_open")
    inside = F.col("_at") < F.col("_span.end")
    shown = F.when(overlap, F.raise_error(F.lit("spans of a sample overlap"))).when(inside, F.col("_span.segment"))
    return marked.where(F.col("_row").isNotNull() | overlap).select("_row.*", shown.alias("segment"))


# --- repetition --------------------------------------------------------------------------------


def repeat_samples(rows: DataFrame, n: int, mode: str = "row") -> DataFrame:
    """Repeat rows ``n`` times; ``repeat`` numbers the copies and ``position`` orders each sample.

    ``rows`` has (sample, row) with ``row`` = 0, 1, ... in its sample. In mode ``row`` the copies
    of a row stay together; in mode ``block`` the whole sample is repeated as a block.
    """
    repeat = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    if mode == "row":
        return rows.withColumn("repeat", repeat).withColumn("position", F.col("row") * n + F.col("repeat"))
    if mode != "block":
        raise ValueError("mode is 'row' or 'block'")
    # The lengths join before the rows multiply, so the copies are never shuffled.
    lengths = rows.groupBy("sample").agg(F.count(F.lit(1)).alias("_length"))
    return (
        rows.join(lengths, "sample")
        .withColumn("repeat", repeat)
        .withColumn("position", F.col("repeat") * F.col("_length") + F.col("row"))
        .drop("_length")
    )
