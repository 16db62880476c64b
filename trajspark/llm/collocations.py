"""Phrases of two to four words that occur together more often than their parts suggest, per language.

Texts are cut into words once: a stored block holds its distinct words and two bytes for each word of the text, its number among
them. All that follows looks at distinct words and arrays of such numbers.

Counting is exact and goes level by level (Apriori: a phrase is frequent only if all phrases inside it are):

1. Filters. Phrases of 1, 2, 3 and 4 words are counted by a 32-bit hash; a bit field of fixed size (``FILTER_BITS``) marks the
   hashes that reach ``least``, each by ``PROBES`` bits, so that what passes by chance stays a small share as the marks become more. A hash
   counts at least as much as any phrase that has it, so no frequent phrase is lost. A level looks only at places whose two shorter phrases are marked.
2. Candidates. Marked phrases (the longest at a place, then all inside them) are made distinct and dealt by their first two words into
   shards of about ``SHARD`` phrases or ``SHARD_BYTES`` bytes. Each shard becomes one double-array trie over its words, built in a task.
3. Counts. ``AT_ONCE`` tries after the other are broadcast, so what is broadcast is bounded whatever the corpus. A task
   starts a state at every word of a block, moves all states on together, one word a level, and counts accepting states
   with ``bincount``; Spark adds up the counts of all tasks. A place goes on beyond two words in one trie only.

Scores use decimals wherever a product might pass 64 bits.

Defined results: a null text is empty, a null lang is ``und`` (together with rows that say so); words are compared byte by byte
after A-Z is lowered; a text of any length is read in blocks that carry on the last words; repeated rows count as often as they
are there; an empty table, or one without a frequent phrase, gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajspark.llm.common import BATCH_CONF
from trajspark.session import materialize

LEAST = 30
TOP = 2000
MOST_WORDS = 4
FILTER_BITS = 26        # a filter is 2**26 bits, 8 MB
PART_BITS = 10          # counts of a filter are added up in 2**10 parts of 2**22 counters
PROBES = 4              # bits of a filter that mark a hash, all in its part (of at most 2**16 bits)
SHARD = 1 << 18
SHARD_BYTES = 1 << 23
AT_ONCE = 4             # tries that are broadcast together
BLOCK = 1 << 20         # bytes of text that are cut into words at a time
CODES = 1 << 16         # distinct words of a stored block, the break included
BLOCKS = 8              # stored blocks that are handed to Python at a time
HELD = 1 << 21          # hashes, or states, that a task gathers before it adds them up
RUN = 1 << 14           # counters in a packed run
PHRASES = 1 << 18       # phrases that a task gathers before it hands them on
PART = 1 << 15          # phrases that are made distinct together, about

BREAK = b"!"
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MAPPED = bytes.maketrans(_UPPER + _BREAKS, _UPPER.lower() + BREAK * len(_BREAKS))


def _words(mapped: bytes) -> list[bytes]:
    return mapped.replace(BREAK, b" ! ").split()


def word_blocks(rows: Iterable[tuple[bytes, bytes | None]]) -> Iterator[tuple[bytes, list[bytes], int]]:
    """(lang, words, carried) of (lang, text) rows: blocks of words with ``BREAK`` between pieces and texts.

    Short texts of one language share a block. A long one is cut at white space or breaks, and each block but its first begins
    with the last three words of the one before (``carried`` of them): phrases that end among these were seen there.
    """
    held: dict[bytes, list[bytes]] = {}
    sizes: dict[bytes, int] = {}
    for lang, text in rows:
        mapped = (text or b"").translate(_MAPPED)
        if len(mapped) > BLOCK:
            yield from ((lang, words, carried) for words, carried in _cut(mapped))
            continue
        held.setdefault(lang, []).append(mapped)
        sizes[lang] = sizes.get(lang, 0) + len(mapped)
        if sizes[lang] > BLOCK:
            yield lang, _words(BREAK.join(held.pop(lang))), 0
            del sizes[lang]
    for lang, texts in held.items():
        yield lang, _words(BREAK.join(texts)), 0


def _cut(mapped: bytes) -> Iterator[tuple[list[bytes], int]]:
    at, carried = 0, []
    while at < len(mapped):
        end = len(mapped)
        if end - at > BLOCK:
            cut = max(mapped.rfind(c, at, at + BLOCK) for c in (b" ", b"\t", BREAK))
            if cut < 0:  # one word is longer than a block
                cut = min((p for c in (b" ", b"\t", BREAK) if (p := mapped.find(c, at + BLOCK)) >= 0), default=end)
            end = min(end, cut + 1)
        words = carried + _words(mapped[at:end])
        yield words, len(carried)
        at, carried = end, words[1 - MOST_WORDS :]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list[bytes], int]]:
    for batch in batches:
        yield from word_blocks(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))


def _coded(words: list[bytes], carried: int) -> Iterator[tuple[pa.Array, np.ndarray, int]]:
    """(distinct words, the first of them ``BREAK``; number of each word; carried): blocks of so few distinct words that two bytes tell them apart."""
    found = pa.array([BREAK, *words], pa.binary()).dictionary_encode()
    if len(found.dictionary) <= CODES:
        yield found.dictionary, found.indices.to_numpy()[1:].astype(np.uint16), carried
        return
    half = len(words) // 2
    yield from _coded(words[:half], carried)
    yield from _coded(words[half + 1 - MOST_WORDS :], MOST_WORDS - 1)


def _stored(docs: DataFrame) -> DataFrame:
    """lang, carried, words (distinct ones of the block, joined by spaces), codes: all texts cut into words, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, carried in _rows(batches):
            for distinct, codes, before in _coded(words, carried):
                joined = pc.binary_join(pa.ListArray.from_arrays([0, len(distinct)], distinct), b" ")
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang], pa.binary()), pa.array([before], pa.int32()), joined, pa.array([codes.tobytes()], pa.binary())],
                    names=["lang", "carried", "words", "codes"],
                )

    return materialize(_texts(docs).mapInArrow(run, "lang binary, carried int, words binary, codes binary"), "words")


@contextmanager
def _few_rows(spark: SparkSession) -> Iterator[None]:
    """Inside, ``BLOCKS`` rows at a time are read and handed to Python: a stored block is a row of about half a megabyte."""
    names = (BATCH_CONF, "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(name) for name in names]
    for name in names:
        spark.conf.set(name, str(BLOCKS))
    try:
        yield
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list[bytes], np.ndarray, int]]:
    """(lang, distinct words, codes, carried) of stored blocks; code 0 is the break."""
    for batch in batches:
        for lang, carried, words, codes in zip(*(batch.column(c) for c in ("lang", "carried", "words", "codes"))):
            yield lang.as_py(), words.as_py().split(b" "), np.frombuffer(codes.as_buffer(), np.uint16), carried.as_py()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _probe(grams: np.ndarray, bits: int, k: int) -> np.ndarray:
    """The bit, of a field of 2**bits, that is number ``k`` of those that mark the hashes."""
    inner = bits - PART_BITS
    mixed = (_mix(grams * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(16 * k)) & np.uint64(0xFFFF)
    return ((grams >> np.uint64(32 - PART_BITS)) << np.uint64(inner)) | (mixed >> np.uint64(16 - inner))


def _marked(field: np.ndarray, grams: np.ndarray) -> np.ndarray:
    bits = (64 * len(field)).bit_length() - 1
    found, at = np.zeros(len(grams), bool), np.arange(len(grams))
    for k in range(PROBES):
        bit = _probe(grams[at], bits, k)
        at = at[(field[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) != 0]
    found[at] = True
    return found


def _levels(
    lang: bytes, words: list[bytes], codes: np.ndarray, fields: list[np.ndarray]
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per level (phrases of 1, 2, ... words): a 64-bit hash at each start, and whether all shorter phrases there are marked.

    The upper half of a hash is what is counted and marked; the last level has one more word than there are fields.
    """
    hashes = np.array([0, *[xxhash.xxh64_intdigest(w) or 1 for w in words[1:]]], np.uint64)
    first = _mix(hashes ^ np.uint64(xxhash.xxh64_intdigest(lang, 1)))
    gram, may = first[codes], codes != 0
    yield gram, may
    for size, field in enumerate(fields, 2):
        if size == 2:
            may = (_marked(field, first >> np.uint64(32)) & (hashes != 0))[codes]
        else:
            at = np.flatnonzero(may)
            may = np.zeros(len(gram), bool)
            may[at] = _marked(field, gram[at] >> np.uint64(32))
        may = may[:-1] & may[1:]
        gram = _mix(gram[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[codes[size - 1 :]])
        yield gram, may


def _texts(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und"))
    return docs.select(lang.cast("binary").alias("lang"), F.col("text").cast("binary").alias("text"))


def _filter(blocks: DataFrame, fields: list[np.ndarray], least: int) -> np.ndarray:
    """The bit field of phrases one word longer than the last of ``fields``.

    A task hands on its counts packed by the top bits of the hash; whoever gets such a part adds it up in one dense array, so
    memory is the same for any corpus.
    """
    known = blocks.sparkSession.sparkContext.broadcast(fields)
    low = np.uint32(32 - PART_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            parts, first = np.unique(grams >> low, return_index=True)
            ends = [*first[1:].tolist(), len(grams)]
            inner, n = grams & ((np.uint32(1) << low) - np.uint32(1)), n.astype(np.uint32)
            packed = [[x[a:b].tobytes() for a, b in zip(first.tolist(), ends)] for x in (inner, n)]
            return pa.RecordBatch.from_arrays(
                [pa.array(parts.astype(np.int32)), *[pa.array(x, pa.binary()) for x in packed]], names=["part", "grams", "n"]
            )

        for lang, words, codes, carried in _blocks(batches):
            *_, (gram, may) = _levels(lang, words, codes, known.value)
            fresh = max(0, carried - len(known.value))
            held.append((gram[fresh:][may[fresh:]] >> np.uint64(32)).astype(np.uint32))
            size += len(held[-1])
            if size > HELD:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    filter_bits, bits = FILTER_BITS, 1 << (FILTER_BITS - PART_BITS)  # of all parts, of each part

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts, seen, size = None, np.zeros(1 << int(low), np.int64), [], 0

        def marks() -> pa.RecordBatch:
            grams = np.concatenate(seen)
            marked = np.zeros(bits, bool)
            often = grams[counts[grams] >= least].astype(np.uint64) | (np.uint64(at) << np.uint64(low))
            for k in range(PROBES):
                marked[_probe(often, filter_bits, k) & np.uint64(bits - 1)] = True
            counts[grams] = 0
            packed = np.packbits(marked, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([packed], pa.binary())], names=["part", "bits"])

        for batch in batches:
            for part, grams, n in zip(*(c.to_pylist() for c in batch.columns)):
                if part != at:
                    if at is not None:
                        yield marks()
                    at, seen, size = part, [], 0
                seen.append(np.frombuffer(grams, np.uint32))
                counts[seen[-1]] += np.frombuffer(n, np.uint32)
                size += len(seen[-1])
                if size > 2 * len(counts):
                    seen = [np.flatnonzero(counts).astype(np.uint32)]
                    size = len(seen[0])
        if at is not None:
            yield marks()

    counted = blocks.mapInArrow(count, "part int, grams binary, n binary")
    found = counted.repartition("part").sortWithinPartitions("part").mapInArrow(add, "part int, bits binary").toArrow()
    field = np.zeros((1 << PART_BITS, bits // 8), np.uint8)
    for part, packed in zip(found.column("part").to_pylist(), found.column("bits").to_pylist()):
        field[part] = np.frombuffer(packed, np.uint8)
    known.destroy()
    return field.ravel().view("<u8").astype(np.uint64)


def _longest(levels: list[tuple[np.ndarray, np.ndarray]], fields: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of the marked phrases of two words and more that lie in no other one."""
    size = np.zeros(len(levels[0][0]) + 1, np.int64)
    for k, ((gram, may), field) in enumerate(zip(levels, fields), 1):
        if k > 1:
            at = np.flatnonzero(may)
            size[at[_marked(field, gram[at] >> np.uint64(32))]] = k
    inside = np.zeros(len(size), bool)
    inside[1:] = size[1:] < size[:-1]
    starts = np.flatnonzero((size > 0) & ~inside)
    return starts, size[starts]


def _candidates(blocks: DataFrame, fields: list[np.ndarray]) -> DataFrame:
    """lang, size, phrase: all phrases of up to 4 words that pass the filters; stored."""
    known = blocks.sparkSession.sparkContext.broadcast(fields)
    parts = max(1, int(sum(np.bitwise_count(f).sum() for f in fields)) // PROBES // PART)

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[bytes, int], set[bytes]] = {}

        def flush() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays(
                [pa.array([x for x, _ in held], pa.binary()), pa.array([x for _, x in held], pa.int32()),
                 pa.array([b"\n".join(x) for x in held.values()], pa.binary())], names=["lang", "part", "phrases"],
            )
            held.clear()
            return found

        for lang, words, codes, _ in _blocks(batches):
            levels = list(_levels(lang, words, codes, known.value[:-1]))
            starts, sizes = _longest(levels, known.value)
            for size in range(2, MOST_WORDS + 1):
                at = starts[sizes == size]
                key = np.zeros(len(at), np.uint64)  # codes of two bytes: equal keys are equal phrases
                for k in range(size):
                    key = (key << np.uint64(16)) | codes[at + k]
                at = at[np.unique(key, return_index=True)[1]]
                part = (levels[size - 1][0][at] % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                at, part = at[order], part[order]
                phrases = [b" ".join(x) for x in zip(*(map(words.__getitem__, codes[at + k].tolist()) for k in range(size)))]
                numbers, first = np.unique(part, return_index=True)
                for number, a, b in zip(numbers.tolist(), first.tolist(), [*first[1:].tolist(), len(at)]):
                    held.setdefault((lang, number), set()).update(phrases[a:b])
            if sum(map(len, held.values())) > PHRASES:
                yield flush()
        if held:
            yield flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, set[bytes]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, phrases in held.items():
                named = pa.array([lang] * len(phrases), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([named, pa.array(list(phrases), pa.binary()).cast(pa.string())], names=["lang", "phrase"])
            held.clear()

        for batch in batches:
            for lang, _, phrases in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(lang, set()).update(phrases.split(b"\n") if phrases else ())
                if sum(map(len, held.values())) > 2 * PHRASES:  # what is repeated after this is made single below
                    yield from flush()
        yield from flush()

    proposed = blocks.mapInArrow(propose, "lang binary, part int, phrases binary").repartition("part")
    longest = proposed.mapInArrow(merge, "lang string, phrase string").select("lang", F.split("phrase", " ").alias("words"))
    inner = F.transform(
        F.sequence(F.lit(1), F.size("words")),
        lambda size: F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda start: F.slice("words", start, size)),
    )
    every = longest.select("lang", F.explode(F.flatten(inner)).alias("words"))
    phrases = every.select("lang", F.size("words").alias("size"), F.array_join("words", " ").alias("phrase")).distinct()
    stored = materialize(phrases, "phrases")
    known.destroy()
    return stored


class DoubleArray:
    """A trie over whole numbers above 0 in two arrays: the child of ``s`` by code ``c`` is ``base[s] + c`` if its ``check`` is ``s``.

    State 0 is the root.
    """

    def __init__(self, base: np.ndarray, check: np.ndarray) -> None:
        self.base, self.check = base, check

    @classmethod
    def build(cls, keys: np.ndarray) -> tuple[DoubleArray, np.ndarray]:
        """From a matrix with one key a row, filled up with 0; also the state of each key."""
        width = int(keys.max(initial=0)) + 1
        node = np.zeros(len(keys), np.int64)  # of each key, at its present depth
        parents, codes, total = [], [], 1
        for column in keys.T.astype(np.int64):
            on = column > 0
            edges, place = np.unique(node[on] * width + column[on], return_inverse=True)
            parents.append(edges // width)
            codes.append(edges % width)
            node[on] = total + place
            total += len(edges)
        parent, code = np.concatenate(parents), np.concatenate(codes)
        base, slot = cls._place(parent, code, total, width)
        size = width + 1 + max(int(base.max()), int(slot.max()))
        by_slot, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        by_slot[slot] = base
        check[slot[1:]] = slot[parent]
        return cls(by_slot, check), slot[node]

    @staticmethod
    def _place(parent: np.ndarray, code: np.ndarray, total: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Base and slot of each node; slots start at ``width``, so that no base is negative. Child ``i`` is node ``i + 1``."""
        base, slot = np.zeros(total, np.int64), np.zeros(total, np.int64)
        owners, first, count = np.unique(parent, return_index=True, return_counts=True)
        used = np.ones(width, bool)
        tried = width
        for at in np.argsort(-count, kind="stable"):
            if count[at] == 1:
                break
            children = slice(first[at], first[at] + count[at])
            steps = code[children] - code[first[at]]
            window = max(16, 4096 // len(steps))
            while True:  # ends: all is free beyond the last slot in use. Gaps left behind are filled by only children.
                if len(used) < tried + window + width:
                    used = np.append(used, np.zeros(len(used) + window + width, bool))
                free = np.flatnonzero(~used[tried : tried + window]) + tried
                fits = free[~used[free[:, None] + steps].any(axis=1)]
                if len(fits):
                    break
                tried, window = tried + window, window * 2 if window * len(steps) < 1 << 18 else window
            used[fits[0] + steps] = True
            slot[np.arange(children.start, children.stop) + 1] = fits[0] + steps
            base[owners[at]] = fits[0] - code[first[at]]
        alone = count == 1
        free = np.flatnonzero(~np.append(used, np.zeros(alone.sum(), bool)))[: alone.sum()]
        slot[first[alone] + 1] = free
        base[owners[alone]] = free - code[first[alone]]
        return base, slot

    def step(self, states: np.ndarray | int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and which of them exist."""
        following = self.base[states] + codes
        return following, self.check[following] == states


def _tries(candidates: DataFrame, shards: int) -> DataFrame:
    """Stored rows (shard, state, lang, size, phrase), and one row per shard that holds the packed trie."""

    def build(table: pa.Table) -> pa.Table:
        langs = sorted(set(table.column("lang").to_pylist()))
        phrases = table.column("phrase").cast(pa.binary()).to_pylist()
        words = sorted({w for p in phrases for w in p.split(b" ")})
        lang_code, word_code = ({x: i for i, x in enumerate(xs, 1)} for xs in (langs, words))
        keys = np.zeros((len(phrases), 1 + MOST_WORDS), np.int64)
        for i, (lang, phrase) in enumerate(zip(table.column("lang").to_pylist(), phrases)):
            codes = [lang_code[lang], *map(word_code.__getitem__, phrase.split(b" "))]
            keys[i, : len(codes)] = codes
        trie, states = DoubleArray.build(keys)
        packed = pickle.dumps((trie, b" ".join(words), [x.encode() for x in langs]))
        one = table.slice(0, 1)
        return pa.Table.from_arrays(
            [pa.concat_arrays([table.column("shard").combine_chunks(), one.column("shard").combine_chunks()]),
             pa.array([*states.tolist(), -1], pa.int64()),
             *[pa.array([*table.column(c).to_pylist(), None], t) for c, t in (("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()))],
             pa.array([None] * len(phrases) + [packed], pa.binary())],
            names=["shard", "state", "lang", "size", "phrase", "trie"],
        )

    shard = F.pmod(F.xxhash64("lang", F.substring_index("phrase", " ", 2)), F.lit(shards)).cast("int")
    dealt = candidates.select(shard.alias("shard"), "lang", "size", "phrase")
    schema = "shard int, state long, lang string, size int, phrase string, trie binary"
    return materialize(dealt.groupBy("shard").applyInArrow(build, schema), "tries")


def _count(blocks: DataFrame, packed: dict[int, bytes]) -> DataFrame:
    """(shard, state, lang, n) added up over all texts for the tries of some shards; rows with state -1 hold the number of all words of a language.

    A task hands on its counters in packed runs, which are added up run by run.
    """
    known = blocks.sparkSession.sparkContext.broadcast(packed)
    names = ["shard", "part", "lang", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = {}  # of a word of any trie
        tries = []
        for shard, one in known.value.items():
            trie, words, langs = pickle.loads(one)
            own = np.array([number.setdefault(w, len(number)) for w in words.split(b" ")])
            roots = {lang: int(trie.base[0]) + i for i, lang in enumerate(langs, 1)}
            tries.append([shard, trie, own, roots, np.zeros(len(trie.check), np.int64), []])
        for one in tries:  # the code of each word, 0 for words of other tries and of none
            code = np.zeros(len(number) + 1, np.int32)
            code[one[2]] = np.arange(1, len(one[2]) + 1)
            one[2] = code
        totals: dict[bytes, int] = {}
        for lang, words, codes, carried in _blocks(batches):
            totals[lang] = totals.get(lang, 0) + np.count_nonzero(codes[carried:])
            numbers = np.array([len(number), *[number.get(w, len(number)) for w in words[1:]]])
            for _, trie, code, roots, counts, held in tries:
                if lang not in roots:
                    continue
                own = code[numbers]
                state, there = trie.step(np.int32(roots[lang]), own)
                state = np.where(there, state, -1)[codes]
                end = np.flatnonzero(state >= 0)  # where each state's last word is
                state = state[end]
                for _ in range(MOST_WORDS):
                    held.append(state[end >= carried])
                    on = end + 1 < len(codes)
                    state, end = state[on], end[on] + 1
                    state, there = trie.step(state, own[codes[end]])
                    state, end = state[there], end[there]
                if sum(map(len, held)) > HELD // AT_ONCE:
                    counts += np.bincount(np.concatenate(held), minlength=len(counts))
                    held.clear()
        found = []
        for shard, _, _, _, counts, held in tries:
            if held:
                counts += np.bincount(np.concatenate(held), minlength=len(counts))
            runs = [(part, counts[at : at + RUN]) for part, at in enumerate(range(0, len(counts), RUN))]
            found += [(shard, part, None, x.tobytes()) for part, x in runs if x.any()]
        found += [(-1, -1, lang, np.array([n], np.int64).tobytes()) for lang, n in totals.items()]
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*found), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=names
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(1, np.int64)

        def sums() -> pa.RecordBatch:
            shard, part, lang = at
            states = np.flatnonzero(total)
            named = pa.array([None if lang is None else lang.decode()] * len(states), pa.string())
            numbers = np.full(len(states), -1) if part < 0 else states + part * RUN
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(states), shard, np.int32)), pa.array(numbers.astype(np.int64)), named, pa.array(total[states])],
                names=["shard", "state", "lang", "n"],
            )

        for batch in batches:
            for shard, part, lang, n in zip(*(c.to_pylist() for c in batch.columns)):
                counts = np.frombuffer(n, np.int64)
                if (shard, part, lang) == at:
                    total = total + counts
                    continue
                if at is not None:
                    yield sums()
                at, total = (shard, part, lang), counts
        if at is not None:
            yield sums()

    keys = ["shard", "part", "lang"]
    counted = blocks.mapInArrow(run, "shard int, part int, lang binary, n binary").repartition(*keys).sortWithinPartitions(*keys)
    stored = materialize(counted.mapInArrow(add, "shard int, state long, lang string, n long"), "phrase-counts")
    known.destroy()
    return stored


def phrase_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, f) of all phrases of 2 to 4 words that occur ``least`` times, and their words; and (lang, n)."""
    blocks = _stored(docs)
    fields: list[np.ndarray] = []
    with _few_rows(docs.sparkSession):
        for _ in range(MOST_WORDS):
            fields.append(_filter(blocks, fields, least))
        candidates = _candidates(blocks, fields)
    number, size = candidates.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("phrase")), F.lit(0))).first()
    shards = max(-(-number // SHARD), -(-size // SHARD_BYTES))
    tries = _tries(candidates, max(shards, 1))
    found: DataFrame | None = None
    totals = docs.sparkSession.createDataFrame([], "lang string, n long")
    for first in range(0, shards, AT_ONCE):  # a bounded number of bounded tries at a time
        of = F.col("shard").between(first, first + AT_ONCE - 1)
        packed = {r["shard"]: bytes(r["trie"]) for r in tries.where(of & F.col("trie").isNotNull()).select("shard", "trie").collect()}
        if not packed:
            continue
        with _few_rows(docs.sparkSession):
            counts = _count(blocks, packed)
        phrases = tries.where(of & F.col("trie").isNull()).select("shard", "state", "lang", "size", "phrase")
        named = phrases.join(counts.where("state >= 0").select("shard", "state", F.col("n").alias("f")), ["shard", "state"])
        part = named.where(F.col("f") >= least).select("lang", "size", "phrase", "f")
        found = part if found is None else found.unionByName(part)
        totals = counts.where("state < 0").select("lang", "n")
    if found is None:
        found = docs.sparkSession.createDataFrame([], "lang string, size int, phrase string, f long")
    return materialize(found, "phrase-table"), totals


def _phrase(words: Column, start: Column | int, length: Column | int) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def _exact(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return column.cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language; ``docs`` has text and lang."""
    known, totals = phrase_counts(docs, least)
    candidates = known.where("size > 1").select("lang", "size", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("words"))
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    parts = cut.select(
        "lang", "phrase", "size", "a", "k",
        _phrase(F.col("words"), 1, F.col("k")).alias("head"), _phrase(F.col("words"), F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"),
    )
    heads = known.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    rests = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    score = F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * _exact("a"), _exact("l") + _exact("r"))
    cuts = parts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"])
    scored = cuts.groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    inside = F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("size") - 1),
        lambda length: F.transform(
            F.sequence(F.lit(1), F.col("size") - length + 1), lambda start: _phrase(F.col("words"), start, length)
        ),
    ))
    longer = candidates.where("size > 2").select("lang", F.explode(inside).alias("phrase"), "a")
    around = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    percent = lambda n, c: F.lit(n).cast("decimal(3,0)") * _exact(c)
    held = F.coalesce(percent(100, "longer") >= percent(80, "a"), F.lit(False))
    kept = scored.join(around, ["lang", "phrase"], "left").where(~held)
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "best.l", "best.r", "n", "best.score")


# The same in DuckDB.
COLLOCATIONS_SQL = """
    WITH texts AS (
        SELECT coalesce(lang, 'und') AS lang,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body
        FROM documents
    ), pieces AS (
        SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(body, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w FROM texts
    ), totals AS (
        SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang
    ), places AS (
        SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces
    ), grams AS (
        SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
        FROM places, range(1, 5) AS sizes(k) WHERE i + k - 1 <= len(w)
    ), known AS (
        SELECT lang, k::INTEGER AS size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
    ), candidates AS (
        SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM known WHERE size > 1
    ), cuts AS (
        SELECT lang, size, phrase, a, w, unnest(range(1, size)) AS k FROM candidates
    ), scored AS (
        SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, (2000000 * c.a::HUGEINT // (x.f + y.f))::BIGINT AS score
        FROM cuts c
        JOIN known x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.k], ' ')
        JOIN known y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1 : c.size], ' ')
        QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, c.k) = 1
    ), lengths AS (
        SELECT lang, size, a, w, unnest(range(2, size)) AS k FROM candidates WHERE size > 2
    ), inner_starts AS (
        SELECT lang, a, w, k, unnest(range(1, size - k + 2)) AS i FROM lengths
    ), around AS (
        SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, max(a) AS longer FROM inner_starts GROUP BY ALL
    )
    SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, encode(s.phrase)) AS rank,
           s.phrase, s.a, s.l, s.r, t.n, s.score
    FROM scored s JOIN totals t USING (lang) LEFT JOIN around o USING (lang, phrase)
    WHERE NOT coalesce(100 * o.longer::HUGEINT >= 80 * s.a::HUGEINT, false)
    QUALIFY rank <= 2000
"""
