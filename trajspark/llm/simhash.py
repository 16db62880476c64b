"""SimHash near-duplicates: 64-bit fingerprints linked through shard trees (BK-trees).

Two fingerprints that differ in at most ``radius`` bits agree wholly in one of ``radius + 1`` blocks of bits. All
fingerprints with one value of one block form a shard; a shard with more than ``tree_nodes`` fingerprints is
cut into several. Each shard is one BK-tree: children hang on their parent by the integer Hamming distance
to it, and a search follows only edges within the radius of its own distance (triangle inequality).
A fingerprint is searched in every tree of its shards, and nowhere else. The trees of a corpus grow with it, so they
reach the tasks through the shuffle (at most ``tree_nodes`` nodes at a time in memory) and not
through the driver.

Defined results: null text is the empty text; a text without words has fingerprint 0, which links like any other; a
null id is larger than all others; equal fingerprints are one node however many rows have them; an empty table
gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.llm import jaccard
from trajspark.llm.common import FILE, ROW, addressed, majority, on_disk
from trajspark.llm.graph import components
from trajspark.session import materialize

BITS = 64
RADIUS = 2
WIDTH = 3
SEED = 42
TREE_NODES = 4096
NEAR_RADIUS = 5       # near copies: bits in which fingerprints of five-word shingles may differ
NEAREST = 4           # links that a fingerprint has to the nearest of one tree in the first round; the second one takes all others
ALL = (1 << BITS) - 1


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """Majority bits of the XXH64 of all word shingles (A-Z lowered, words between ASCII white space)."""
    words = (text or b"").lower().split()  # on bytes both touch ASCII only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: 1 - width or None]
    digest = xxhash.xxh64_intdigest
    hashes = np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[width - 1 :].tolist())], np.uint64
    )
    return majority(hashes)


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), and the address of each row of ``docs``."""
    rows = addressed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(bits), batch.column(2), batch.column(3)], names=["doc_id", "fp", FILE, ROW]
            )

    return rows.mapInArrow(run, f"doc_id long, fp long, {FILE} string, {ROW} long")


class ShardTree:
    """A BK-tree over integers."""

    def __init__(self) -> None:
        self.nodes: list[tuple[int, dict[int, int]]] = []

    def add(self, value: int) -> None:
        if not self.nodes:
            self.nodes.append((value, {}))
            return
        at = 0
        while True:
            held, children = self.nodes[at]
            distance = (held ^ value).bit_count()
            following = children.get(distance)
            if following is None:
                children[distance] = len(self.nodes)
                self.nodes.append((value, {}))
                return
            at = following

    def within(self, value: int, radius: int) -> list[int]:
        found, todo = [], [0] if self.nodes else []
        while todo:
            held, children = self.nodes[todo.pop()]
            distance = (held ^ value).bit_count()
            if distance <= radius:
                found.append(held)
            if len(children) <= 2 * radius:
                todo += [child for edge, child in children.items() if abs(edge - distance) <= radius]
            else:
                todo += [c for e in range(distance - radius, distance + radius + 1) if (c := children.get(e)) is not None]
        return found


def block_masks(radius: int, agree: int = 1) -> list[int]:
    """Masks of ``agree`` of ``radius + agree`` runs of bits of nearly equal length: two values within the radius agree on one mask."""
    blocks = radius + agree
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    runs = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(some) for some in combinations(runs, agree)]


def signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def dealt(distinct: DataFrame, masks: list[int], tree_nodes: int) -> DataFrame:
    """block, value, tree, fp, guest: a row for each fingerprint and mask, so that their number grows as the fingerprints do.

    Only a shard of more than ``tree_nodes`` fingerprints has several trees; a fingerprint is at home in one and a guest of the others.
    """
    values: list[Column] = [F.col("fp").bitwiseAND(F.lit(signed(m))) for m in masks]
    shares = distinct.select("fp", F.posexplode(F.array(*values)).alias("block", "value"))
    sizes = shares.groupBy("block", "value").agg(F.count(F.lit(1)).alias("size"))
    trees = F.ceil(F.col("size") / F.lit(tree_nodes)).cast("int")
    large = materialize(sizes.where(F.col("size") > tree_nodes).select("block", "value", trees.alias("trees")), "large-shards")
    if large.isEmpty():
        return shares.select("block", "value", F.lit(0).alias("tree"), "fp", F.lit(False).alias("guest"))
    split = shares.join(large, ["block", "value"], "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
    sent = split.select(
        "block", "value", "fp",
        F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"),
        F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int").alias("home"),
    )
    return sent.select("block", "value", "tree", "fp", (F.col("tree") != F.col("home")).alias("guest"))


def links(
    distinct: DataFrame, radius: int = RADIUS, tree_nodes: int = TREE_NODES, agree: int = 1, nearest: int | None = None
) -> DataFrame:
    """All pairs (a, b) of different values in column fp that differ in at most ``radius`` bits, each pair once.

    More blocks that must ``agree`` make more, smaller shards. With ``nearest`` a value is linked to so many of the nearest of a tree only.
    """
    masks = block_masks(radius, agree)
    return searched(dealt(distinct, masks, tree_nodes), masks, radius, nearest).where("b IS NOT NULL").select("a", "b")


def searched(rows: DataFrame, masks: list[int], radius: int, nearest: int | None = None) -> DataFrame:
    """a, b, block, value, tree, guest: the links (a, b) that the trees of ``rows`` (as ``dealt`` gives them) hold, each once.

    With ``nearest`` a value is linked to so many of the nearest of a tree only. Where there were more, rows with b null hold
    that value and all that are near it: a search of these rows finds what was left out. Values with an equal
    ``label``, if ``rows`` has that column, aren't linked; null is unlike every label.
    """
    keys = ["block", "value", "tree"]
    labelled = "label" in rows.columns
    columns = [*keys, "fp", "guest", F.col("label") if labelled else F.lit(None).cast("long").alias("label")]
    placed = rows.select(*columns).repartition(*keys).sortWithinPartitions(*keys, "guest", "fp")
    schema = "a long, b long, block int, value long, tree int, guest boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, label_of, more = None, ShardTree(), {}, set()
        found: list[tuple] = []

        def close() -> None:
            found.extend((signed(held), None, *key, False) for held in more)

        def given() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*found), types)], names=["a", "b", *keys, "guest"]
            )

        for batch in batches:
            # A row between others of other shards is alone in its shard; the last one of a batch may not be.
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:5]]
            new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:3]])
            begins = np.concatenate(([key != tuple(c[0].item() for c in columns[:3])], new)) if batch.num_rows else new
            alone = begins & np.concatenate((new, [False]))[: len(begins)]
            labels = batch.column(5).filter(pa.array(~alone)).to_pylist()
            for block, value, number, fp, guest, label in zip(*(c[~alone].tolist() for c in columns), labels):
                if (block, value, number) != key:
                    close()
                    key, tree, label_of, more = (block, value, number), ShardTree(), {}, set()
                bits = fp & ALL
                # Each pair once: guests look for smaller ones only, and only the first block in which both agree reports.
                near = [
                    other for other in tree.within(bits, radius)
                    if (not guest or other < bits) and all((bits ^ other) & m for m in masks[:block])
                    and (label is None or label_of.get(other) != label)
                ]
                if nearest is not None and len(near) > nearest:
                    more.update(near)
                    if guest:
                        found.append((fp, None, *key, True))
                    else:
                        more.add(bits)
                    near = sorted(near, key=lambda other: ((bits ^ other).bit_count(), other))[:nearest]
                found += [(signed(min(bits, other)), signed(max(bits, other)), *key, False) for other in near]
                if not guest:
                    tree.add(bits)
                    if label is not None:
                        label_of[bits] = label
            if found:
                yield given()
                found.clear()
        close()
        if found:
            yield given()

    return placed.mapInArrow(run, schema)


def fingerprint_groups(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """A row per row of ``docs``: doc_id, fp, component_id (smallest doc_id of its group), kept, and its address.

    One row of each group is kept: that with the smallest id, and among equal ids with the first address.
    """
    prints = materialize(fingerprints(on_disk(docs), width), "fingerprints")
    distinct = materialize(_firsts(prints, "fp"), "fingerprint-nodes")
    return _grouped(prints, distinct, components(links(distinct.select("fp"), radius, tree_nodes), "simhash"), "fp")


def near_groups(docs: DataFrame) -> DataFrame:
    """The same for groups of texts linked by a Jaccard similarity of 0.8 or more of their five-word shingles (node for fp).

    Fingerprints of the shingles go through the BK-trees with a wider radius, and whole sets of what these link are compared.
    Similarity 0.8 is about 10 bits of 64, so that no radius of feasible shards finds every link: prefix filtering
    (``jaccard``) brings together what these leave apart. A fingerprint's links beyond the ``NEAREST`` of a tree, and links of
    nodes that share one, are followed in a second round, as far as their ends are still apart.

    Nulls, ties, repeated rows and empty tables are as in ``fingerprint_groups``; a text without words is like every other such one.
    """
    docs = on_disk(docs)
    prints = jaccard.told_apart(materialize(jaccard.prints(docs), "shingles"))
    distinct = materialize(_firsts(prints, "node", "n", "counts"), "shingle-nodes")
    near, rest = near_rounds(prints)
    return _grouped(prints, distinct, jaccard.components_of(prints, distinct, docs, near=near, rest=rest), "node")


def near_pairs(prints: DataFrame, radius: int = NEAR_RADIUS, tree_nodes: int = TREE_NODES, nearest: int = NEAREST) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints are equal or linked through the trees; of one fingerprint's nodes all meet the first."""
    return near_rounds(prints, radius, tree_nodes, nearest)[0]


def near_rounds(
    prints: DataFrame, radius: int = NEAR_RADIUS, tree_nodes: int = TREE_NODES, nearest: int = NEAREST
) -> tuple[DataFrame, Callable[[DataFrame], DataFrame | None]]:
    """``near_pairs``, and a function that takes what these pairs have joined, (node, label), and gives all other pairs of linked nodes
    that are still apart, or None if the first round left out nothing.

    So a large group of near copies gives a number of pairs that grows with its size and with what is apart in it, and every link is followed.
    """
    masks = block_masks(radius, 2)
    marks = materialize(prints.select("fp", "node").distinct(), "near-fingerprints")
    firsts = materialize(marks.groupBy("fp").agg(F.min("node").alias("first"), (F.count(F.lit(1)) > 1).alias("several")), "near-fingerprint-nodes")
    equal = marks.join(firsts, "fp").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    found = materialize(searched(dealt(firsts.select("fp"), masks, tree_nodes), masks, radius, nearest), "near-links")
    linked = found.where("b IS NOT NULL").select("a", "b")
    pairs = linked
    for end in ("a", "b"):
        named = firsts.select(F.col("fp").alias(end), F.col("first").alias(f"node_{end}"))
        pairs = pairs.join(named, end)

    def rest(labels: DataFrame) -> DataFrame | None:
        cut = found.where("b IS NULL").select("block", "value", "tree", F.col("a").alias("fp"), "guest")
        several = firsts.where("several").select("fp")
        if cut.isEmpty() and several.isEmpty():
            return None
        known = marks.join(labels, "node", "left").select("fp", "node", F.coalesce("label", "node").alias("label"))
        one = known.groupBy("fp").agg(F.min("label").alias("least"), F.max("label").alias("most"))
        one = one.select("fp", F.when(F.col("least") == F.col("most"), F.col("least")).alias("label"))  # null: its nodes are apart
        prints_apart = searched(cut.join(one, "fp"), masks, radius).select("a", "b")
        for end in ("a", "b"):  # nodes that aren't the first of their fingerprint
            prints_apart = prints_apart.unionByName(linked.join(several.withColumnRenamed("fp", end), end, "left_semi").select("a", "b"))
        prints_apart = prints_apart.unionByName(several.select(F.col("fp").alias("a"), F.col("fp").alias("b")))
        for end in ("a", "b"):
            named = known.select(F.col("fp").alias(end), F.col("node").alias(f"node_{end}"), F.col("label").alias(f"label_{end}"))
            prints_apart = prints_apart.join(named, end)
        ends = [F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")]
        return prints_apart.where("label_a <> label_b").select(*ends).distinct()

    return equal.unionByName(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))), rest


def _firsts(prints: DataFrame, key: str, *more: str) -> DataFrame:
    """For each value of the key, its first row."""
    first = F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", FILE, ROW, *more)
    return prints.groupBy(key).agg(F.min(first).alias("first"))


def _grouped(prints: DataFrame, distinct: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    grouped = labels.withColumnRenamed("node", key).join(distinct, key)
    firsts = grouped.groupBy("label").agg(F.min("first").alias("_first"))
    joined = grouped.join(firsts, "label").select(key, "_first")
    # Only nodes with a link have a label; all others are groups of their own.
    known = distinct.join(joined, key, "left").select(key, F.coalesce("_first", "first").alias("first"))
    kept = (F.col("first")[FILE] == F.col(FILE)) & (F.col("first")[ROW] == F.col(ROW))
    return prints.drop("first").join(known, key).select(
        "doc_id", key, F.col("first.doc_id").alias("component_id"), kept.alias("kept"), FILE, ROW
    )


def near_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies (``near_groups``); columns as they are."""
    docs = on_disk(docs)
    gone = near_groups(docs).where(~F.col("kept")).select(FILE, ROW)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return addressed(docs, *columns).join(gone, [FILE, ROW], "left_anti").select(*columns)


def as_hex(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), BITS // 4, "0"))


