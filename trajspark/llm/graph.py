"""Connected components by alternating star contractions, each round a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.session import materialize


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, label) for each node of ``edges`` (columns a, b; any order, repeats and loops allowed).

    The label is the smallest node of the component. Each round ties the larger neighbours of every node
    to its smallest one (large star), then the smaller ones too (small star); it ends when nothing
    changes, after a number of rounds that grows with the logarithm of the longest path. A node
    with many neighbours is never gathered in one row: minima are taken with map-side combine and the joins
    are plain, so that adaptive execution may split a hot node.
    """
    ordered = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = materialize(ordered, f"{name}-edges")
    seen = _mark(pairs)
    while seen[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{name}-stars")
        before, seen = seen, _mark(pairs)
        if seen == before:
            break
    # Every pair is now (node, label); labels themselves have no pair.
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )


def _mark(pairs: DataFrame) -> tuple[int, int]:
    """Number of pairs and a checksum of them: two rounds with the same mark hold the same pairs."""
    row = pairs.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]
