"""Random-access epoch order: a seeded permutation of the global index that needs no count, join or sort.

A Feistel network over two halves of a mixed radix permutes 0 .. a*b - 1, where a*b is the smallest such product above n with
a about the square root of n; a number that leaves 0 .. n - 1 is put through again until it is back (cycle
walking). Both directions are column expressions, so the rank of any frame, and the frames of any batch, are known
without looking at any other frame.
"""

from __future__ import annotations

from collections.abc import Iterable
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.plans.ordered import int_div

ROUNDS = 4
DIGITS = 12     # hex digits of a round's hash
WALKS = 64      # steps of a walk at most. At least one number in sqrt(n) is outside, so a longer walk hardly exists; it would fail


class EpochOrder:
    """The order of one epoch over ``n`` frames. Equal (n, seed, epoch) give the same order everywhere."""

    def __init__(self, n: int, seed: int | str, epoch: int = 0) -> None:
        if n < 0:
            raise ValueError("the number of frames is negative")
        self.n, self.key = n, f"{seed}:{epoch}"
        self.high = isqrt(max(n, 1) - 1) + 1
        self.low = -(-max(n, 1) // self.high)

    def _noise(self, number: Column, half: Column) -> Column:
        text = F.concat_ws(":", F.lit(self.key), number.cast("string"), half.cast("string"))
        return F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("long")

    def _through(self, value: Column, back: bool) -> Column:
        """One pass of the network, or of its inverse."""
        sign = -1 if back else 1

        def turn(halves: Column, number: Column) -> Column:
            high, low = halves["high"], halves["low"]
            return F.struct(
                F.when(number % 2 == 0, F.pmod(high + sign * self._noise(number, low), F.lit(self.high))).otherwise(high).alias("high"),
                F.when(number % 2 == 1, F.pmod(low + sign * self._noise(number, high), F.lit(self.low))).otherwise(low).alias("low"),
            )

        order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
        start = F.struct(int_div(value, self.low).alias("high"), (value % self.low).alias("low"))
        return F.aggregate(F.array(*map(F.lit, order)), start, turn, lambda h: h["high"] * self.low + h["low"])

    def _walk(self, value: Column, back: bool) -> Column:
        value = value.cast("long")
        inside = (value >= 0) & (value < self.n)
        once = self._through(value, back)
        outside = self.high * self.low - self.n
        steps = min(outside, WALKS)
        if steps:
            again = F.aggregate(
                F.array_repeat(F.lit(0), steps), once, lambda x, _: F.when(x < self.n, x).otherwise(self._through(x, back))
            )
            lost = F.raise_error(F.lit("a walk of the permutation is too long: use another seed"))
            done = again if outside <= WALKS else F.when(again < self.n, again).otherwise(lost)
            once = F.when(once < self.n, once).otherwise(done)
        wrong = F.raise_error(F.concat(F.lit(f"not in 0 .. {self.n} - 1: "), value.cast("string")))
        return F.when(value.isNull(), value).when(inside, once).otherwise(wrong)

    def rank(self, index: Column | str) -> Column:
        """The place of frame ``index`` in the epoch; NULL for NULL, and a number outside 0 .. n - 1 fails."""
        return self._walk(F.col(index) if isinstance(index, str) else index, back=False)

    def index(self, rank: Column | str) -> Column:
        """The frame at place ``rank``: the inverse of :meth:`rank`."""
        return self._walk(F.col(rank) if isinstance(rank, str) else rank, back=True)


def epoch_rank(frames: DataFrame, order: EpochOrder, index: str = "index", name: str = "rank") -> DataFrame:
    """Add the place of each frame in the epoch: a projection of its global index."""
    return frames.withColumn(name, order.rank(index))


def batch_frames(spark: SparkSession, order: EpochOrder, batch_size: int, batches: Iterable[int] | None = None) -> DataFrame:
    """(batch_id, rank, index) of the named batches (all, if none are named), without reading a frame.

    The short last batch is kept; a batch beyond it has no rows.
    """
    if batch_size < 1:
        raise ValueError("a batch needs at least one frame")
    if batches is None:
        ranks = spark.range(order.n).select(int_div(F.col("id"), batch_size).alias("batch_id"), F.col("id").alias("rank"))
    else:
        named = spark.createDataFrame([(b,) for b in sorted(set(batches)) if b >= 0], "batch_id long")
        first = F.col("batch_id") * batch_size
        every = named.select("batch_id", F.explode(F.sequence(first, first + batch_size - 1)).alias("rank"))
        ranks = every.where(F.col("rank") < order.n)
    return ranks.withColumn("index", order.index("rank"))


def fetch_batches(frames: DataFrame, order: EpochOrder, batch_size: int, batches: Iterable[int] | None = None, index: str = "index") -> DataFrame:
    """The frames of the named batches with ``batch_id`` and ``rank``, found by their global index.

    No hint: the few places of some batches are broadcast by their measured size, those of a whole epoch are shuffled.
    """
    places = batch_frames(frames.sparkSession, order, batch_size, batches).withColumnRenamed("index", index)
    return frames.join(places, index)
