"""What the operators share: row addresses, free column names, whole-table helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trajspark.session import materialize

FILE, ROW = "_llm_file", "_llm_row"
BATCH_ROWS = 512
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark) -> None:
    """From now on the session hands at most ``BATCH_ROWS`` rows at a time to Python.

    Whole rows with long texts are held by the executor and its worker at once; results never depend on the batches.
    """
    rows = int(spark.conf.get(BATCH_CONF, "10000"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def addressed(df: DataFrame, *columns: str | Column) -> DataFrame:
    """The given columns plus ``FILE`` and ``ROW``: the file of each row and its number in that file.

    The address is unique even where ids are null or repeated, and a retried task finds the same one.
    ``df`` must be a plain file scan, as ``on_disk`` gives.
    """
    meta = df.metadataColumn("_metadata")
    return df.select(*columns, meta.getField("file_path").alias(FILE), meta.getField("row_index").alias(ROW))


def on_disk(df: DataFrame) -> DataFrame:
    """``df`` itself if it is a plain scan of Parquet files, else a copy of it in the shared folder."""
    return df if _has_addresses(df) else materialize(df, "rows")


def _has_addresses(df: DataFrame) -> bool:
    try:
        df.select(df.metadataColumn("_metadata").getField("row_index")).schema  # analysed here
        return True
    except AnalysisException:
        return False


def annotate(
    df: DataFrame, text: str, added: StructType, each: Callable[[Iterable[bytes | None]], list[pa.Array]]
) -> DataFrame:
    """``df`` and the columns ``added``, which ``each`` makes from the UTF-8 bytes of column ``text``, batch by batch."""
    names = [f.name for f in added]
    clash = {c.lower() for c in df.columns} & {n.lower() for n in names}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already")
    own = free_name(df, "_llm_text")
    given = df.select("*", F.col(f"`{text}`").cast("binary").alias(own))
    width = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = each(batch.column(width).to_pylist())
            yield pa.RecordBatch.from_arrays(batch.columns[:width] + made, names=batch.schema.names[:width] + names)

    return given.mapInArrow(run, StructType(df.schema.fields + added.fields))
