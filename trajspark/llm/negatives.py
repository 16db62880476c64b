"""Hard negatives: for each anchor and positive, the best rows of another label within a window of scores.

Vectors become whole numbers, floor(256 * x), and a score is an inner product of them, exact in 64 bits. Anchors and
candidates meet in tiles (a block of anchors, a block of candidates); within a tile, products are made
by Strassen's recursion on int64 matrices padded with zeros to even sizes, seven products for eight, and only whole numbers
are added, so nothing is rounded. Two passes over the tiles: the first keeps, per anchor, a heap of the best rows of its
label; heaps of different tiles are merged by Spark. The second pass knows each positive's score, and so
its window, and keeps a heap per positive of the best rows of other labels inside it.

A tile holds a bounded block of anchors in memory and lets its candidates stream past, batch by batch. Each anchor
meets each candidate once a pass: work grows with anchors times rows, as the result is defined on all of them. A label or a
vector that a third of all rows have makes no difference: blocks are cut by hash of the id.

Defined results: rows with a null label, a null id, a null vector, or a null or non-finite component take no part; an
empty vector has score 0 with every empty vector; only vectors of the same length are compared; of rows that share an id the one
with the shortest vector, then the smallest label, then the smallest vector counts; equal scores go to the smaller id; an anchor
without positives, or a positive without negatives, has no rows; an empty table gives an empty result; other columns are never
looked at. A component so large that a product might pass 64 bits fails the query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.session import materialize

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
LEAF = 16                   # matrices with a side of at most this are multiplied as they are
ANCHOR_BLOCK = 1 << 20      # components of a block of anchors (16,384 vectors of 64, 8 MB)
CANDIDATE_BLOCK = 1 << 18   # components of a block of candidates, more if there would be over SPREAD blocks
SPREAD = 4096
TASKS = 1 << 16             # tiles beyond this number share tasks, one after the other
ROWS, COLUMNS = 1024, 2048  # of one product
NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices by recursion over quarters; odd sides are padded with a zero row or column."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2))) if m % 2 or k % 2 else a
    b = np.pad(b, ((0, k % 2), (0, n % 2))) if k % 2 or n % 2 else b
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    m6 = strassen(a21 - a11, b11 + b12, leaf)
    m7 = strassen(a12 - a22, b21 + b22, leaf)
    c = np.empty((2 * i, 2 * l), np.int64)
    c[:i, :l] = m1 + m4 - m5 + m7
    c[:i, l:] = m3 + m5
    c[i:, :l] = m2 + m4
    c[i:, l:] = m1 - m2 + m3 + m6
    return c[:m, :n]


class Heaps:
    """The best ``k`` (score, id) of each row; ids are offered in ascending order, so an equal score never enters later."""

    def __init__(self, rows: int, k: int) -> None:
        self.k, self.least = k, np.full(rows, NONE)  # a row with k entries takes only scores above its least one
        self.row, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def offer(self, first: int, scores: np.ndarray, may: np.ndarray, ids: np.ndarray) -> None:
        """Scores of rows ``first``, ``first + 1``, ... with all ``ids``, where ``may`` allows them."""
        may = may & (scores > self.least[first : first + len(scores), None])
        if np.count_nonzero(may) > 8 * self.k * len(scores) and len(ids) > self.k:
            masked = np.where(may, scores, NONE)
            bar = np.partition(masked, len(ids) - self.k, axis=1)[:, len(ids) - self.k, None]
            above = masked > bar
            level = may & (masked == bar)
            may = above | (level & (np.cumsum(level, axis=1) <= self.k - above.sum(axis=1, keepdims=True)))
        at, column = np.nonzero(may)
        if not len(at):
            return
        row = np.concatenate((self.row, at + first))
        score, id_ = np.concatenate((self.score, scores[at, column])), np.concatenate((self.id, ids[column]))
        order = np.lexsort((id_, -score, row))
        row, score, id_ = row[order], score[order], id_[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < self.k
        self.row, self.score, self.id = row[keep], score[keep], id_[keep]
        full = rank == self.k - 1
        self.least[row[full]] = score[full]


class Anchors:
    """The anchors of one tile that have vectors of one length."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, positives: list | None) -> None:
        self.ids, self.labels, self.vectors, self.positives = ids, labels, vectors, positives
        if positives is None:
            self.heaps = [Heaps(len(ids), POSITIVES)]
            return
        most = max(map(len, positives), default=0)
        self.heaps = [Heaps(len(ids), NEGATIVES) for _ in range(most)]
        # 30 * positive <= 100 * negative <= 90 * positive, without products that could pass 64 bits.
        self.low, self.high = np.full((most, len(ids)), 1), np.full((most, len(ids)), 0)
        for i, found in enumerate(positives):
            for j, one in enumerate(found):
                tens, rest = divmod(one["score"], 10)
                self.low[j, i], self.high[j, i] = 3 * tens - (-3 * rest // 10), 9 * tens + 9 * rest // 10

    def meet(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        for left in range(0, len(self.ids), ROWS):
            part = slice(left, left + ROWS)
            for right in range(0, len(ids), COLUMNS):
                there = slice(right, right + COLUMNS)
                scores = strassen(self.vectors[part], vectors[there].T)
                same = self.labels[part, None] == labels[there]
                if self.positives is None:
                    self.heaps[0].offer(left, scores, same & (self.ids[part, None] != ids[there]), ids[there])
                    continue
                for heap, low, high in zip(self.heaps, self.low, self.high):
                    inside = ~same & (scores >= low[part, None]) & (scores <= high[part, None])
                    heap.offer(left, scores, inside, ids[there])

    def found(self) -> Iterator[list[np.ndarray]]:
        """Columns of the result: anchor, (positive and its score,) id, score."""
        for j, heap in enumerate(self.heaps):
            columns = [self.ids[heap.row], heap.id, heap.score]
            if self.positives is not None:
                known = [self.positives[i][j] for i in heap.row.tolist()]
                columns[1:1] = [np.array([x[c] for x in known], np.int64) for c in ("vec_id", "score")]
            yield columns


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label (moved on where the id is divisible by 7), dim, vector (whole numbers) of the rows that take part."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    rows = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").where(finite)
    bound = F.sqrt(F.lit(float(2**62)) / F.greatest(F.size("x"), F.lit(1)))
    whole = F.transform("x", lambda v: F.floor(v * SCALE))
    large = F.raise_error(F.concat(F.lit("components too large for exact products in vector "), F.col("vec_id").cast("string")))
    fits = F.forall("x", lambda v: F.abs(v * SCALE) < bound)
    return rows.select(
        "vec_id",
        F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.size("x").alias("dim"),
        F.when(fits, whole).otherwise(large).alias("vector"),
    )


def _every(number: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(number - 1)).cast("array<long>"))


def _block(number: int) -> Column:
    return F.pmod(F.xxhash64("vec_id"), F.lit(number).cast("long"))


def _pass(anchors: DataFrame, rows: DataFrame, sizes: tuple[int, int], names: list[str], known: bool) -> DataFrame:
    """Lets every block of anchors meet every block of rows; a tile's anchors come before its rows, both in order of id."""
    a_blocks, blocks = sizes
    columns = ["tile", "guest", "vec_id", "dim", "label", "vector", "positives"]
    none = F.lit(None).cast("array<struct<vec_id:bigint,score:bigint>>")
    left = anchors if known else anchors.withColumn("positives", none)
    left = left.select("*", _block(a_blocks).alias("_own"), _every(blocks).alias("_other"), F.lit(0).alias("guest"))
    right = rows.select("*", none.alias("positives"), _block(blocks).alias("_other"), _every(a_blocks).alias("_own"), F.lit(1).alias("guest"))
    tile = (F.col("_own") * blocks + F.col("_other")).alias("tile")
    dealt = left.select(tile, *columns[1:]).unionByName(right.select(tile, *columns[1:]))
    tasks = min(a_blocks * blocks, TASKS)
    placed = dealt.repartitionById(tasks, F.pmod("tile", F.lit(tasks)).cast("int")).sortWithinPartitions(*columns[:6])

    def matrix(part: pa.RecordBatch, dim: int) -> np.ndarray:
        return part.column(5).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, gathered, tiled = None, None, [], {}

        def flush() -> Iterator[pa.RecordBatch]:
            for one in tiled.values():
                for found in one.found():
                    if len(found[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=names)

        for batch in batches:
            tiles, guests, ids, dims = (batch.column(i).to_numpy() for i in range(4))
            turn = np.flatnonzero((tiles[1:] != tiles[:-1]) | (guests[1:] != guests[:-1])) + 1
            for begin, end in zip((0, *turn.tolist()), (*turn.tolist(), len(tiles))):
                if begin == end:
                    continue
                if tiles[begin] != at:
                    yield from flush()
                    at, last, gathered, tiled = tiles[begin], None, [], {}
                guest = bool(guests[begin])
                fresh = np.ones(end - begin, bool)
                fresh[1:] = ids[begin + 1 : end] != ids[begin : end - 1]
                fresh[0] = last != (guest, ids[begin])
                last = (guest, ids[end - 1])
                part, dim = batch.slice(begin, end - begin).filter(pa.array(fresh)), dims[begin:end][fresh]
                if not guest:
                    gathered += [part.filter(pa.array(dim == d)) for d in np.unique(dim)]
                    continue
                for d in {p.column(3)[0].as_py() for p in gathered}:
                    parts = [p for p in gathered if p.column(3)[0].as_py() == d]
                    vectors = np.concatenate([matrix(p, d) for p in parts])
                    own, labels = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in (2, 4))
                    tiled[d] = Anchors(own, labels, vectors, [x for p in parts for x in p.column(6).to_pylist()] if known else None)
                gathered = []
                for d, one in tiled.items():
                    alike = part.filter(pa.array(dim == d))
                    if alike.num_rows:
                        one.meet(alike.column(2).to_numpy(), alike.column(4).to_numpy(), matrix(alike, d))
        yield from flush()

    return placed.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def mine(vectors: DataFrame, is_anchor: Callable[[], Column] = lambda: F.col("vec_id") % 100 == 0) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``vectors`` has vec_id, embedding, label."""
    rows = usable(vectors)
    anchors = rows.where(is_anchor())
    width = F.greatest("dim", F.lit(1)).cast("long")
    every, own = rows.agg(F.sum(width), F.sum(F.when(is_anchor(), width))).first()
    sizes = (max(1, -(-(own or 0) // ANCHOR_BLOCK)), max(1, min(-(-(every or 0) // CANDIDATE_BLOCK), SPREAD)))

    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    first = _pass(anchors, rows, sizes, ["anchor_id", "vec_id", "score"], known=False)
    ranked = first.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= POSITIVES)
    positives = ranked.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("vec_id", "score")).alias("positives"))
    known = materialize(anchors.join(materialize(positives, "positives"), "vec_id"), "anchors")

    names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
    second = _pass(known, rows, sizes, names, known=True)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = second.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


# The same in DuckDB.
MINE_SQL = """
    WITH whole AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY len(v), label, v) = 1
    ), scored AS (
        SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
               coalesce(list_sum([a.v[i] * c.v[i] FOR i IN range(1, len(a.v) + 1)]), 0)::BIGINT AS score
        FROM whole a JOIN whole c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v)
        WHERE a.vec_id % 100 = 0
    ), positives AS (
        SELECT * FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    )
    SELECT p.anchor_id, p.vec_id AS positive_id,
           row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank,
           n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
    FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
     AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
    QUALIFY rank <= 10
"""
