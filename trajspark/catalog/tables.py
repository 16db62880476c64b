"""The given tables seen as frames, token sequences and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.operators.chunks import stack_vector
from trajspark.operators.episodes import frame_index
from trajspark.operators.layout import IMAGE, VISION_END, VISION_START
from trajspark.plans.ordered import running_totals
from trajspark.sources.frames import scan_frames

LINEITEM_ORDER = ["l_shipdate", "l_linenumber", "task_index", "l_suppkey"]
EVENT_ORDER = ["ts", "event_id"]
VECTOR_WIDTH = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as unnumbered frames: an order is an episode, four measures are the action."""
    measures = F.array("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    mapping = {"episode_index": "l_orderkey", "task_index": "l_partkey", "action": measures}
    mapping.update({c: c for c in ("l_shipdate", "l_linenumber", "l_suppkey")})
    return scan_frames(spark, f"{sf_dir}/lineitem.parquet", mapping)


def lineitem_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = frame_index(lineitem_rows(spark, sf_dir), LINEITEM_ORDER)
    return numbered.select("episode_index", "frame_index", "task_index", "action")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as unnumbered frames: a user is an episode, the value is a one-dimensional action."""
    mapping = {"episode_index": "user_id", "action": F.array("value")}
    mapping.update({c: c for c in ("event_id", "ts", "event_type")})
    return scan_frames(spark, f"{sf_dir}/events.parquet", mapping)


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_index(event_rows(spark, sf_dir), EVENT_ORDER)


def part_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("task_index"), F.col("p_name").alias("task"))


def order_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("episode_index"))


def words() -> Column:
    return F.filter(F.split("text", r"\s+"), lambda w: w != "")


def token_id(token: Column) -> Column:
    """A stable integer for a word."""
    return F.conv(F.substring(F.md5(token), 1, 7), 16, 10).cast("long")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with their words; each user turn is followed by an image grid."""
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("sample"),
        F.col("turn").alias("segment"),
        "role",
        words().alias("words"),
        F.lit(1).alias("t"),
        (2 * (1 + F.pmod("turn", F.lit(4)))).cast("int").alias("h"),
        (2 * (1 + F.pmod("conv_id", F.lit(4)))).cast("int").alias("w"),
    )


def image_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = turns(spark, sf_dir).where(F.col("role") == "user")
    return seen.select("sample", F.col("segment").alias("image_no"), "t", "h", "w")


def token_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with all their tokens: the words and, after a user turn, the image's slots."""
    slots = F.call_function("div", F.col("h") * F.col("w"), F.lit(4)).cast("int")
    image = F.concat(F.array(F.lit(VISION_START)), F.array_repeat(F.lit(IMAGE), slots), F.array(F.lit(VISION_END)))
    tokens = F.when(F.col("role") == "user", F.concat("words", image)).otherwise(F.col("words"))
    return turns(spark, sf_dir).select("sample", "segment", "role", tokens.alias("tokens"))


def conversation_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (sample, segment, pos, token, mask); system turns are masked out."""
    sized = token_turns(spark, sf_dir).withColumn("length", F.size("tokens").cast("long"))
    placed = running_totals(sized, ["sample"], "segment", {"end": F.col("length")})
    each = placed.select("*", F.posexplode("tokens").alias("i", "token"))
    return each.select(
        "sample",
        "segment",
        (F.col("end") - F.col("length") + F.col("i")).alias("pos"),
        "token",
        F.when(F.col("role") == "system", 0).otherwise(1).alias("mask"),
    )


def turn_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One token-id sequence per turn, the turn's words."""
    ids = F.transform("words", token_id)
    return turns(spark, sf_dir).select("sample", "segment", ids.alias("input_ids"))


def layout_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text, image and padding segments; a batch is 32 neighbouring conversations, padded on the left."""
    none = F.lit(None).cast("int")

    def part(number: int, kind: str, length: Column | None, grid: bool = False) -> Column:
        return F.struct(
            (F.col("segment") * 4 + number).alias("segment"),
            F.lit(kind).alias("kind"),
            (none if length is None else length).alias("length"),
            *[(F.col(c) if grid else none).alias(c) for c in ("t", "h", "w")],
        )

    text = F.size("words")
    user = F.array(part(1, "text", text + 1), part(2, "image", None, True), part(3, "text", F.lit(1)))
    content = turns(spark, sf_dir).select(
        "sample", F.explode(F.when(F.col("role") == "user", user).otherwise(F.array(part(1, "text", text)))).alias("s")
    ).select("sample", "s.*")
    slots = F.coalesce("length", F.call_function("div", F.col("t") * F.col("h") * F.col("w"), F.lit(4)))
    lengths = content.groupBy("sample").agg(F.sum(slots).alias("slots"))
    batch = F.call_function("div", F.col("sample"), F.lit(32))
    longest = lengths.groupBy(batch.alias("batch")).agg(F.max("slots").alias("longest"))
    padding = lengths.withColumn("batch", batch).join(longest, "batch").select(
        "sample",
        F.lit(0).cast("long").alias("segment"),
        F.lit("pad").alias("kind"),
        (F.col("longest") - F.col("slots")).cast("int").alias("length"),
        *[none.alias(c) for c in ("t", "h", "w")],
    )
    return content.unionByName(padding.where("length > 0"))


def video_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without padding: odd user turns show a video of 2 or 3 frames, even ones an image of as many."""
    segments = layout_segments(spark, sf_dir).where("kind <> 'pad'")
    turn = F.call_function("div", F.col("segment"), F.lit(4))
    media = F.col("kind") == "image"
    return segments.withColumns({
        "kind": F.when(media & (F.pmod(turn, F.lit(2)) == 1), "video").otherwise(F.col("kind")),
        "t": F.when(media, 2 + F.pmod(turn, F.lit(2))).cast("int"),
    })


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 chunks: (vec_id, label, action_chunk)."""
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("action_chunk")
    )
    return stack_vector(vectors, "action_chunk", VECTOR_WIDTH)


def next_vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As a prediction for each vector: the chunk of the next one, the first for the last."""
    chunks = vector_chunks(spark, sf_dir)
    n = table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("n")).scalar()
    return chunks.select(F.pmod(F.col("vec_id") - 1, n).alias("vec_id"), F.col("action_chunk").alias("predicted_chunk"))


def utc(ts: str = "ts") -> Column:
    """A zoneless time taken as UTC, whatever the session's zone."""
    return F.expr(f"TIMESTAMP '1970-01-01 00:00:00Z' + ({ts} - TIMESTAMP_NTZ '1970-01-01 00:00:00')")


def metric_rows(events: DataFrame) -> DataFrame:
    """Events as metric rows."""
    return events.select(utc().alias("ts"), F.col("event_id").alias("step"), F.col("event_type").alias("name"), "value")
