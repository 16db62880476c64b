"""Exact deduplication with a keyed streaming state.

Every arriving row sends (digest, size, id, address) through a streaming aggregation whose state lives
in RocksDB on disk, is written to the checkpoint after each batch and never expires. The state keeps, for
each digest, the stable id and the address of the row that stays, and the number of rows seen. Rows whose
digest was met more than once are then compared by their whole bytes.

Defined results: a null text is the empty text; a null id comes after all others; among rows that are alike
in size and id the first address stays, so exactly one row of each group does; an empty table gives
an empty result; other columns are never looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.llm.common import FILE, ROW, addressed, on_disk
from trajspark.session import materialize, scratch_path

SPACES = "[\\x20\\x09-\\x0D]+"  # fixed value: what two equal texts may differ in

STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # All stores of an executor share this memory; what doesn't fit is on disk.
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # A store takes memory in eighths of this, and an executor has a store per partition.
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "2",
    "spark.sql.streaming.stateStore.rocksdb.maxWriteBufferNumber": "2",
    # Log space isn't reserved in advance: with a store per partition that would be far more than the state.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def squeezed(text: str = "text") -> Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACES, "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def arrivals(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """What the state needs of each row: digest, rank among equal texts (smaller is better), id and address."""
    rows = addressed(on_disk(docs), "doc_id", "text")
    size = F.char_length(F.coalesce("text", F.lit(""))).cast("long")
    return rows.select("doc_id", digest(squeezed()).alias("digest"), (-size).alias("rank"), FILE, ROW)


def remember(stream: DataFrame, checkpoint: str) -> None:
    """Take what has arrived on ``stream`` (rows of ``arrivals``) into the state below ``checkpoint``, and stop.

    A later call with the same checkpoint goes on where this one ended: old digests are still known.
    """
    spark = stream.sparkSession
    best = F.struct("rank", F.isnull("doc_id").alias("unnamed"), "doc_id", FILE, ROW)
    state = stream.groupBy("digest").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("size"))
    before = {key: spark.conf.get(key, None) for key in STATE_CONF}
    for key, value in STATE_CONF.items():
        spark.conf.set(key, value)
    try:
        sink = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)
        sink.trigger(availableNow=True).start().awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def remembered(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state as a table: digest, best (id and address of the row that stays), size."""
    state = spark.read.format("statestore").load(checkpoint)
    (best,) = [f.name for f in state.schema["value"].dataType if f.dataType.typeName() == "struct"]
    (size,) = [f.name for f in state.schema["value"].dataType if f.dataType.typeName() == "long"]
    return state.select("key.digest", F.col(f"value.{best}").alias("best"), F.col(f"value.{size}").alias("size"))


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """A row per row of ``docs``: doc_id, digest, keep_id, group_size, kept, and its address."""
    spark, docs = docs.sparkSession, on_disk(docs)
    folder = scratch_path(spark, "arrivals")
    arrivals(docs, digest).write.parquet(folder)
    arrived = spark.read.parquet(folder)
    if arrived.isEmpty():
        return _shown(arrived.withColumn("best", F.struct("doc_id", FILE, ROW)).withColumn("size", F.lit(1)))
    checkpoint = scratch_path(spark, "dedup-state")
    remember(spark.readStream.schema(arrived.schema).parquet(folder), checkpoint)
    known = remembered(spark, checkpoint)
    decided = materialize(arrived.join(known, "digest"), "decided")

    # Every hit is checked by its bytes: rows of one digest must hold one text.
    hits = decided.where("size > 1").select("digest", "doc_id", "rank", FILE, ROW)
    texts = addressed(docs, squeezed().alias("_squeezed"))
    checked = texts.join(hits, [FILE, ROW])
    per_digest = checked.select("digest", "_squeezed").distinct().groupBy("digest").count()
    mixed = materialize(per_digest.where("count > 1").select("digest"), "mixed")
    if mixed.isEmpty():
        return _shown(decided)
    # Different texts under one digest: these rows are grouped by the text itself.
    apart = checked.join(mixed, "digest")
    best = F.struct("rank", F.isnull("doc_id").alias("unnamed"), "doc_id", FILE, ROW)
    groups = apart.groupBy("digest", "_squeezed").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("size"))
    again = apart.join(groups, ["digest", "_squeezed"]).select(*decided.columns)
    return _shown(decided.join(mixed, "digest", "left_anti").select(*decided.columns).unionByName(again))


def _shown(decided: DataFrame) -> DataFrame:
    stays = (F.col("best")[FILE] == F.col(FILE)) & (F.col("best")[ROW] == F.col(ROW))
    return decided.select(
        "doc_id", "digest", F.col("best.doc_id").alias("keep_id"), F.col("size").cast("long").alias("group_size"),
        stays.alias("kept"), FILE, ROW,
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text an other row has that stays; columns as they are."""
    docs = on_disk(docs)
    gone = exact_groups(docs).where(~F.col("kept")).select(FILE, ROW)
    columns = docs.columns
    rows = addressed(docs, *[F.col(f"`{c}`") for c in columns])
    return rows.join(gone, [FILE, ROW], "left_anti").select(*[F.col(f"`{c}`") for c in columns])
