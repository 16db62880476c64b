"""The corpus pipeline: documents in known languages, of good quality, once each, packed into sequences.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet to the shared folder and read back as the next
stage's docs, so a stage that fails is run again from what is stored. All stages but the last
return rows and columns of ``documents`` as they are.

Defined results: a null, empty or blank text has no language and goes in the first stage; rows with equal text or id are told
apart by their place in the files, and one of each group stays; ties go to the smallest id; columns beyond those of
``documents``, of any name, are kept by all stages but the last; an empty table gives an empty result, and a table
without usable labels loses nothing in the quality stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trajspark.llm import dedup, language, packing, quality, simhash
from trajspark.llm.common import small_batches, table
from trajspark.session import scratch_path, scratch_scope


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and texts unlike every language."""
    small_batches(spark)
    return language.keep_known(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that rank below the quality threshold."""
    small_batches(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts."""
    small_batches(spark)
    return dedup.exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies: SimHash fingerprints through BK-trees, exact Jaccard checks, prefix filtering for the rest."""
    small_batches(spark)
    return simhash.near_dedup(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of token ids."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", known_language),
    ("quality", good_quality),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("packing", packed),
]

ORACLE_SQL = None  # SQL can express neither the models nor the tokenizer; tests/llm holds the result against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        kept = scratch_path(spark, f"stage-{name}")
        with scratch_scope(spark):  # what the stage stores on its way goes when its result is written
            result = stage(spark, docs, sf_dir)
            result.write.parquet(kept)
        docs = spark.read.schema(result.schema).parquet(kept)
    return STAGES[-1][1](spark, docs, sf_dir)
