"""Near copies by the Jaccard similarity of their word shingles: all pairs of 0.8 or more, none missed.

A text is the set of the XXH64 of its five-word shingles (A-Z lowered, words between ASCII white space; a text of fewer
words is one shingle). In any fixed order of shingles, two sets of similarity 0.8 share one of the first n // 5 + 1 of
each (prefix filter), so only those are shuffled. The order puts common shingles last (counted on a sample, which can
change the work but not the result), so that licence lines and common passages bring few texts together. Pairs that
sizes and positions rule out are dropped; all others are compared by their whole sets.

A group of more than ``SMALL_GROUP`` texts with one shingle isn't paired at once: each text meets its neighbour, the
first of the group and those that its fingerprint finds (``simhash.near_pairs``). Only those still in different components are
paired in a second round, within the task that holds the group, and only pairs that may be close by their bucket counts leave it, once
each. So a large group of near copies moves a number of pairs that grows with its size and its true links, not with its square.

Before whole sets are fetched, an upper bound of the overlap decides: each set keeps how many of its shingles fall into each of
``BUCKETS`` buckets of their hash, and the sum of the smaller counts of two sets is at least what they share. A finer
count, one bucket for two shingles, does the same for what is left. Only pairs that both let through are compared by their sets, and only while their ends are in different components: components
lose nothing, and few sets are moved.

Equal sets are one node, named by 64 bits of a 128-bit digest; should two sets share the name, their rows get new names from all 128.

Defined results: a null text is the empty text; texts without words have the empty set and are alike; repeated rows are one
node; a null id is like any other; an empty table has no nodes; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajspark.llm.common import FILE, ROW, addressed, majority
from trajspark.llm.graph import components
from trajspark.session import materialize

WIDTH = 5
SEED = 42
SMALL_GROUP = 8
COMMON = 4096        # common shingles that are put last, at most
SAMPLED = 16         # one text of so many is counted for them
BUCKETS = 128
ROWS = 512           # rows of a batch that are worked on at a time, so that a worker holds little beside the batch itself
MET = 32            # first hashes of large groups that a row carries
PLACES = 23          # a filter of 2**23 bits says which texts are fetched (1 MB, at any size)


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The set of shingle hashes, in ascending order."""
    words = (text or b"").lower().split()  # on bytes both touch ASCII only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: 1 - width or None]
    return np.unique(np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())], np.uint64
    ))


def prefix(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first n // 5 + 1 shingles of a set (ascending), with those in ``common`` (ascending) at the end."""
    if len(common):
        late = common[np.minimum(np.searchsorted(common, found), len(common) - 1)] == found
        found = np.concatenate((found[~late], found[late]))
    return found[: len(found) // 5 + 1]


def close(shared, a, b):
    """Whether sets of sizes a and b that share so many have similarity 0.8 or more (numbers, arrays or columns)."""
    return shared * 9 >= (a + b) * 4


def bucket_counts(found: np.ndarray) -> bytes:
    """How many shingles fall into each bucket, in as few bytes as hold the largest count."""
    counts = np.bincount((found >> np.uint64(57)).astype(np.int64), minlength=BUCKETS)
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def may_share(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """For each pair of bucket counts an upper bound of what the sets share."""
    return np.minimum(_matrix(a), _matrix(b)).sum(axis=1, dtype=np.int64)


def _matrix(rows: list[bytes]) -> np.ndarray:
    """Bucket counts as a row each, of the type of the widest."""
    width = np.array([len(r) // BUCKETS for r in rows], np.int64)
    out = np.zeros((len(rows), BUCKETS), f"u{width.max(initial=1)}")
    for size in set(width.tolist()):
        at = np.flatnonzero(width == size)
        out[at] = np.frombuffer(b"".join(rows[i] for i in at.tolist()), f"u{size}").reshape(-1, BUCKETS)
    return out


def fine_counts(found: np.ndarray) -> bytes:
    """The same with about one bucket for two shingles, so that long sets can be told apart: size of a count, then the counts."""
    bits = max(len(found) // 2, 1).bit_length()
    counts = np.bincount((found >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    kind = np.min_scalar_type(int(counts.max()))
    return bytes([kind.itemsize]) + counts.astype(kind).tobytes()


def fine_share(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """The same bound from fine counts; of two numbers of buckets the smaller one is used."""

    def bound(x: bytes, y: bytes) -> int:
        p, q = (np.frombuffer(z, f"u{z[0]}", offset=1) for z in (x, y))
        width = min(len(p), len(q))
        p, q = (z.reshape(width, -1).sum(axis=1, dtype=np.int64) for z in (p, q))
        return int(np.minimum(p, q).sum())

    return np.array([bound(x, y) for x, y in zip(a, b)], np.int64)


def _in_parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def _common(rows: DataFrame) -> np.ndarray:
    sample = rows.where(F.pmod(F.xxhash64(FILE, ROW), F.lit(SAMPLED)) == 0).select("_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_parts(batches):
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(text).view(np.int64))], names=["hash"])

    counts = sample.mapInArrow(run, "hash long").groupBy("hash").count().where("count > 3")
    top = counts.orderBy(F.desc("count"), "hash").limit(COMMON).collect()
    return np.sort(np.array([r["hash"] for r in top], np.int64).view(np.uint64))


def prints(docs: DataFrame) -> DataFrame:
    """doc_id, node and check (digest of the set), fp (its fingerprint), n (its size), first (its prefix), counts, and the address of each row."""
    rows = addressed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("_text"))
    common = _common(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_parts(batches):
            digests, marks, sizes, firsts, counts = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text)
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                marks.append(majority(found))
                sizes.append(len(found))
                firsts.append(prefix(found, common).view(np.int64))
                counts.append(bucket_counts(found))
            names = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array(np.array(marks, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()),
                 pa.array(firsts, pa.list_(pa.int64())), pa.array(counts, pa.binary()), batch.column(2), batch.column(3)],
                names=["doc_id", "node", "check", "fp", "n", "first", "counts", FILE, ROW],
            )

    schema = f"doc_id long, node long, check long, fp long, n int, first array<long>, counts binary, {FILE} string, {ROW} long"
    return rows.mapInArrow(run, schema)


def told_apart(prints: DataFrame) -> DataFrame:
    """``prints`` with one name per set: where sets of different digests share a node, the nodes are named anew."""
    shared = materialize(
        prints.groupBy("node").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a <> b").select("node"), "shared-names"
    )
    if shared.isEmpty():
        return prints
    marked = prints.join(shared.withColumn("_shared", F.lit(True)), "node", "left")
    node = F.when(F.col("_shared"), F.xxhash64("node", "check")).otherwise(F.col("node"))
    return told_apart(materialize(marked.withColumn("node", node).select(*prints.columns), "renamed"))


def _whole_groups(batches: Iterator[pa.RecordBatch], numbers: int) -> Iterator[tuple]:
    """Blocks of rows sorted by hash in which no hash goes on in the next block: the first ``numbers`` columns as rows of an array,
    then the others as they are.
    """
    held: list[pa.RecordBatch] = []

    def whole() -> tuple:
        rows = pa.Table.from_batches(held).combine_chunks()
        columns = [pa.concat_arrays(c.chunks) for c in rows.columns]
        return np.stack([c.to_numpy(zero_copy_only=False) for c in columns[:numbers]]), *columns[numbers:]

    for batch in batches:
        if batch.num_rows:
            hashes = batch.column(0).to_numpy()
            cut = int(np.searchsorted(hashes, hashes[-1]))
            if cut or (held and held[-1].column(0)[0].as_py() != hashes[0]):
                held.append(batch.slice(0, cut))
                yield whole()
                held.clear()
            held.append(batch.slice(cut))
    if held:
        yield whole()


def _candidates(rows: DataFrame, small: int) -> DataFrame:
    """Pairs (a, b) of nodes with one hash in their prefixes; the rows of groups larger than ``small``, with b null, too."""
    placed = rows.repartition("hash").sortWithinPartitions("hash", "n", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, in _whole_groups(batches, 4):
            same = np.zeros(block.shape[1], bool)  # equal sets have equal prefixes and are one node
            same[1:] = (block[0, 1:] == block[0, :-1]) & (block[3, 1:] == block[3, :-1])
            h, n, at, node = block[:, ~same]
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            sizes = np.diff(np.append(starts, len(h)))
            start, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
            index = np.arange(len(h))
            ends, large = start + size, size > small
            found = [(index[large & (index > start)] - 1, index[large & (index > start)]),
                     (start[large & (index > start + 1)], index[large & (index > start + 1)])]
            for k in range(1, small):
                first = index[~large & (index + k < ends)]
                found.append((first, first + k))
            a, b = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
            ok = _possible(n[a], at[a], n[b], at[b])
            pairs = np.unique(np.sort(np.stack((node[a[ok]], node[b[ok]])), axis=0), axis=1)
            none = np.zeros(pairs.shape[1], np.int64)
            for x in ((none, pairs[0], pa.array(pairs[1]), none, none),
                      (h[large], node[large], pa.nulls(int(large.sum()), pa.int64()), n[large], at[large])):
                if len(x[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in x], names=["hash", "a", "b", "n", "at"])

    return placed.mapInArrow(run, "hash long, a long, b long, n long, at long")


def _apart(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of different label with one hash in their prefixes that may be close by their counts.

    A pair meets under each hash that both have; it is given out under the first of them (among the ``MET`` that a row carries), so that
    what is shuffled does not grow with the number of hashes two near copies share. The bound is taken where a group is
    paired, and only what may be close leaves the task.
    """
    each = rows.select("hash", "n", "at", "node", "label", "counts", "met")
    placed = each.repartition("hash").sortWithinPartitions("hash", "n", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, counts, met in _whole_groups(batches, 5):
            starts = np.flatnonzero(np.concatenate(([True], block[0, 1:] != block[0, :-1])))
            for x, y in zip(starts, np.append(starts[1:], block.shape[1])):
                h, n, at, node, label = block[:, x:y]
                if (label == label[0]).all():
                    continue
                buckets = _matrix(counts[x:y].to_pylist())
                before = [set(m) for m in met[x:y].to_pylist()]
                for k in range(1, len(n)):
                    low = int(np.searchsorted(n[:k] * 5, n[k] * 4))
                    ok = low + np.flatnonzero((label[low:k] != label[k]) & _possible(n[low:k], at[low:k], n[k], at[k]))
                    hit = []
                    for start in range(0, len(ok), ROWS):
                        some = ok[start : start + ROWS]
                        shared = np.minimum(buckets[some], buckets[k]).sum(axis=1, dtype=np.int64)
                        hit += some[close(shared, n[some], n[k])].tolist()
                    hit = [i for i in hit if min(before[i] & before[k], default=h[0]) >= h[0]]
                    if hit:
                        yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(np.full(len(hit), node[k]))], names=["a", "b"])

    return placed.mapInArrow(run, "a long, b long")


def _possible(na, ia, nb, ib):
    """Whether sets may be close that have a shingle in common at places ia and ib of their order."""
    shared = np.minimum(ia, ib) + 1 + np.minimum(na - ia - 1, nb - ib - 1)
    return close(shared, na, nb)


def _bounded(pairs: DataFrame, known: DataFrame, share: Callable[[list[bytes], list[bytes]], np.ndarray]) -> DataFrame:
    """Those of the pairs (a, b) that may be close by the counts of ``known`` (node, n, counts)."""
    for end in ("a", "b"):
        pairs = pairs.join(known.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("counts").alias(f"counts_{end}")), end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_parts(batches):
            n = [batch.column(i).to_numpy().astype(np.int64) for i in (2, 3)]
            ok = close(share(batch.column(4).to_pylist(), batch.column(5).to_pylist()), *n)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok))

    return pairs.select("a", "b", "n_a", "n_b", "counts_a", "counts_b").mapInArrow(run, "a long, b long")


def _sets(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, set) of rows (node, FILE, ROW). Sets are made where the texts are read; only they are moved, not texts."""
    bit = F.pmod(F.xxhash64(FILE, ROW), F.lit(1 << PLACES))
    words = wanted.select(bit.alias("bit")).groupBy(F.expr("shiftright(bit, 6)").alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(bit & 63 AS INT)))").alias("bits")
    ).toArrow()  # at most 2**17 rows
    field = np.zeros(1 << (PLACES - 6), np.uint64)
    field[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    known = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy().astype(np.uint64)
            asked = (known.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
            part = batch.filter(pa.array(asked))
            for few in _in_parts([part]):
                sets = pa.array([shingles(t).view(np.int64) for t in few.column(3).to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([few.column(1), few.column(2), sets], names=[FILE, ROW, "set"])

    rows = addressed(docs, F.col("text").cast("binary").alias("_text")).select(bit, FILE, ROW, "_text")
    return rows.mapInArrow(run, f"{FILE} string, {ROW} long, set array<long>").join(wanted, [FILE, ROW]).select("node", "set")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """Links (a, b) among the pairs that join what all close pairs would join: whole sets are compared.

    First one pair per node is compared, then all pairs whose ends these links leave apart. A close pair whose ends are
    joined already would change nothing.
    """
    once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    coarse = nodes.select("node", F.col("first.n").alias("n"), F.col("first.counts").alias("counts"))
    pairs = materialize(_bounded(once, coarse, may_share), f"{name}-pairs")
    wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node").select(
        "node", F.col("first")[FILE].alias(FILE), F.col("first")[ROW].alias(ROW)
    ), f"{name}-wanted")
    sets = materialize(_sets(wanted, docs), f"{name}-sets")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _in_parts(batches):
            found = [x.values.to_numpy().view(np.uint64) for x in batch.column(1)]
            columns = [pa.array([len(x) for x in found], pa.int32()), pa.array([fine_counts(x) for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["node", "n", "counts"])

    fine = materialize(sets.mapInArrow(counted, "node long, n int, counts binary"), f"{name}-counts")

    def compared(some: DataFrame, part: str) -> DataFrame:
        likely = materialize(_bounded(some, fine, fine_share), f"{name}-{part}-likely")
        both = likely.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(
            sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b"
        )
        shared = F.size(F.array_intersect("x", "y"))
        return materialize(both.where(close(shared, F.size("x"), F.size("y"))).select("a", "b"), f"{name}-{part}")

    links = compared(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "first-links")
    labels = materialize(components(links, f"{name}-first"), f"{name}-first-labels")
    apart = pairs
    for end in ("a", "b"):
        apart = apart.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}")), end, "left")
    differ = F.coalesce("label_a", "a") != F.coalesce("label_b", "b")
    return links.unionByName(compared(apart.where(differ).select("a", "b"), "links"))


def components_of(
    prints: DataFrame, nodes: DataFrame, docs: DataFrame, small: int = SMALL_GROUP, near: DataFrame | None = None,
    rest: Callable[[DataFrame], DataFrame | None] | None = None,
) -> DataFrame:
    """(node, label) for each node that has a link. ``nodes`` has node and first: address, n and counts of one of its rows.

    ``near`` are pairs (a, b) found in another way: they are compared first, so that fewer texts are apart afterwards. ``rest`` gives
    more such pairs, if there are any, for what is joined then: (node, label) of nodes that have a link.
    """
    rows = prints.select(F.col("n").cast("long").alias("n"), "node", F.posexplode("first").alias("at", "hash"))
    rows = rows.select("hash", "n", F.col("at").cast("long").alias("at"), "node")
    found = materialize(_candidates(rows, small), "jaccard-candidates")
    pairs = found.where("b IS NOT NULL").select("a", "b")
    links = _verified(pairs if near is None else pairs.unionByName(near), nodes, docs, "jaccard")
    labels = components(links, "jaccard")
    larger = found.where("b IS NULL").select("hash", "n", "at", F.col("a").alias("node"))
    large = not larger.isEmpty()
    if not large and rest is None:
        return labels
    known = materialize(labels, "jaccard-labels")
    apart = rest(known) if rest else None
    if large:
        met = larger.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("hash")), 1, MET).alias("met"))
        carried = met.join(nodes.select("node", F.col("first.counts").alias("counts")), "node").join(known, "node", "left")
        groups = larger.join(carried.withColumn("label", F.coalesce("label", "node")), "node")
        apart = _apart(groups) if apart is None else _apart(groups).unionByName(apart)
    if apart is None:
        return known
    return components(links.unionByName(_verified(apart, nodes, docs, "jaccard-more")), "jaccard-all")
