"""Bulk-synchronous best-fit packing of documents into sequences.

Documents become token ids (and an end id) and are cut only where they are longer than a sequence. Pieces are range-sorted by length and
numbered within each length; open sequences are sorted by their gap and numbered in the same way. In each superstep the longest
pieces that are left take the smallest gap that is not smaller (the successor); where several pieces want the same gaps the ranks decide: the
i-th piece of the length takes the i-th sequence with that gap. Gaps shrink and the next superstep follows. Where no gap is
left, as many sequences are opened as pieces of that length need.

Lengths and gaps are whole numbers up to the capacity, so what a superstep decides depends only on how many pieces and
sequences have each size. The supersteps work on these counts (at most ``capacity`` numbers, whatever the corpus) and
give runs: "pieces r to r + n of length l go to sequences s to s + n at offset o". Numbering pieces and placing
them by their run are Spark jobs; no piece passes through the driver.

Defined results: a null text is the empty text, which is the end id alone; each row is packed for itself, repeated or null ids or
not; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajspark.llm.common import FILE, ROW, addressed, on_disk
from trajspark.session import materialize

if TYPE_CHECKING:
    from tokenizers import Tokenizer

CAPACITY = 2048
END_ID = 0
NUMBERED = 20_000        # pieces that one window numbers, about
WORDS_KEPT = 200_000     # words whose ids a task remembers
CHUNK = 2_000            # words encoded in one call
PIECES_AT_ONCE = 250     # pieces in one call: fewer than words, since the call makes one text of them
# The tokenizer's pieces of a word without contractions, names of special tokens or control characters, if all beyond ASCII are letters.
PIECES = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]|[!-&(-/:;=-@\[-`{-~]+")
APART = re.compile(rb"[\x00-\x20'<\x7f]")


class WordEncoder:
    """Ids of texts, word by word. Exact because this kind of tokenizer drops white space and never joins across it.

    Arrow splits a part's texts and finds its distinct words; only these become Python objects. New words are made of pieces
    (letters, a digit, marks), which go to the tokenizer's model without its normalizer and its pattern. Other words take the whole way.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        self.tokenizer = Tokenizer.from_file(path)
        at_blanks, as_bytes = pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.ascii_pieces, self.pieces = Tokenizer(self.tokenizer.model), Tokenizer(self.tokenizer.model)
        self.ascii_pieces.pre_tokenizer = at_blanks
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence([at_blanks, as_bytes])
        self.known: dict[bytes, bytes] = {}
        self.letters = set(map(chr, range(128)))  # PIECES tells these apart; added are the letters met beyond ASCII
        self.no_letters: set[str] = set()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = self._words(texts)
        words = split.values.dictionary_encode()
        own = values(words.dictionary)
        fresh = [w for w in own if w and w not in self.known]
        if len(self.known) + len(fresh) > WORDS_KEPT:  # frequent words are in most parts: those of this one stay
            known = self.known
            self.known = {w: known[w] for w in own if w in known}
        self._learn(fresh)
        known = self.known
        ids = pa.array([w and known[w] for w in own], pa.large_binary()).take(words.indices)
        return values(ids, split.offsets.to_numpy())

    def forget(self) -> None:
        self.known = {}

    @staticmethod
    def _words(texts: list[bytes | None]) -> pa.ListArray:
        # Only ASCII is lowered and split at here. Names of special tokens are taken as they are.
        given = pa.array([t or b"" for t in texts], pa.binary()).view(pa.string())
        lower = pc.ascii_lower(given)
        special = pc.match_substring(given, "<|")
        return pc.ascii_split_whitespace(pc.if_else(special, given, lower) if special.true_count else lower)

    def _learn(self, words: list[bytes]) -> None:
        pieces: set[bytes] = set()
        made: dict[bytes, list[bytes]] = {}
        odd: list[bytes] = []
        for word in words:
            if word.isalpha():  # ASCII only
                pieces.add(word)
                continue
            if APART.search(word) or not (word.isascii() or self._has_letters_only(word)):
                odd.append(word)
                continue
            own = PIECES.findall(word)
            pieces.update(own)
            if len(own) > 1:
                made[word] = own
        pieces.difference_update(self.known)
        ascii_only = [p for p in pieces if p.isascii()]
        odd += self._learn_pieces(ascii_only, self.ascii_pieces, str.lower)
        odd += self._learn_pieces(list(pieces.difference(ascii_only)), self.pieces, self.tokenizer.normalizer.normalize_str)
        for at in range(0, len(odd), CHUNK):
            part = odd[at : at + CHUNK]
            found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)
            self.known.update((w, np.array(x.ids, "<u4").tobytes()) for w, x in zip(part, found))
        known = self.known
        for word, own in made.items():
            known[word] = b"".join([known[p] for p in own])

    def _learn_pieces(self, pieces: list[bytes], tokenizer: Tokenizer, normalize: Callable[[str], str]) -> list[bytes]:
        """Learns pieces that have one end-of-word id each. Returns the rest."""
        rest: list[bytes] = []
        for at in range(0, len(pieces), PIECES_AT_ONCE):
            part = pieces[at : at + PIECES_AT_ONCE]
            text = normalize(b" ".join(part).decode("utf-8"))
            ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(part) and ends[-1] == len(ids):
                data, cuts = ids.tobytes(), [0, *(4 * ends).tolist()]
                self.known.update(zip(part, (data[a:b] for a, b in zip(cuts, cuts[1:]))))
            else:
                rest += part
        return rest

    def _has_letters_only(self, word: bytes) -> bool:
        """Whether each character beyond ASCII is a letter that the tokenizer's normalizer turns into letters (U+0130 isn't)."""
        try:
            text = word.decode("utf-8")
        except UnicodeDecodeError:
            return False
        if self.letters.issuperset(text):
            return True
        for c in set(text).difference(self.letters, self.no_letters):
            normal = self.tokenizer.normalizer.normalize_str(f"a{c}a")
            one = c.isalpha() and len(self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)) == 1
            (self.letters if one else self.no_letters).add(c)
        return self.letters.issuperset(text)


def values(array: pa.Array, cuts: np.ndarray | None = None) -> list[bytes]:
    """The values of a text or binary array without nulls as bytes, or what lies between the ``cuts`` joined. Faster than ``to_pylist``."""
    _, offsets, data = array.buffers()
    wide = pa.types.is_large_binary(array.type)
    ends = np.frombuffer(offsets or bytes(8), np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1]
    ends = (ends if cuts is None else ends[cuts]).tolist()
    data = memoryview(data or b"")
    return [data[a:b].tobytes() for a, b in zip(ends, ends[1:])]


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One per worker, so that the vocabulary is read once. A worker lives on through later stages: tasks ``forget`` their words."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task its core
    return WordEncoder(path)


def parts(texts: list[bytes | None]) -> Iterator[slice]:
    """Cuts a batch so that each part has some megabytes of text at most (or one text)."""
    start = held = 0
    for k, text in enumerate(texts):
        held += len(text or b"")
        if held > 4_000_000:
            yield slice(start, k + 1)
            start, held = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids, if asked) of every piece, with the address of its row."""
    rows = addressed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("_text"))
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        try:
            for batch in batches:
                yield from cut(encoder, batch)
        finally:
            encoder.forget()

    def cut(encoder: WordEncoder, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(1).to_pylist()
        for part in parts(texts):
            source, piece, start, length, crc, data = [], [], [], [], [], []
            for k, found in enumerate(encoder.encode(texts[part]), part.start):
                found += end
                for n, at in enumerate(range(0, len(found), 4 * capacity)):
                    own = found[at : at + 4 * capacity]
                    source.append(k), piece.append(n), start.append(at // 4), length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
                    if ids:
                        data.append(np.frombuffer(own, "<u4").astype(np.int64))
            of = lambda column: column.take(pa.array(source, pa.int64()))
            made = [
                of(batch.column(0)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                pa.array(length, pa.int64()), pa.array(crc, pa.int64()), of(batch.column(2)), of(batch.column(3)),
            ]
            yield pa.RecordBatch.from_arrays(made + [pa.array(data, pa.list_(pa.int64()))] * ids, names=names)

    schema = f"doc_id long, piece int, start long, length long, ids_crc32 long, {FILE} string, {ROW} long"
    schema += ", ids array<long>" * ids
    names = [field.split()[0] for field in schema.split(", ")]
    return rows.mapInArrow(run, schema)


def supersteps(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first piece, first sequence, how many, offset) that place all pieces of the given numbers per length."""
    gaps: list[deque[tuple[int, int]]] = [deque() for _ in range(capacity + 1)]  # by size: runs of sequences (first, how many)
    open_in = np.zeros(capacity + 1, np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    opened = 0
    for length in sorted(counts, reverse=True):
        placed, left = 0, counts[length]
        while left:
            fits = np.flatnonzero(open_in[length:])
            if not len(fits):
                new = -(-left // (capacity // length))
                gaps[capacity].append((opened, new))
                open_in[capacity] += new
                opened += new
                continue
            gap = length + int(fits[0])
            take = min(left, int(open_in[gap]))
            open_in[gap] -= take
            open_in[gap - length] += take
            while take:
                first, number = gaps[gap].popleft()
                used = min(take, number)
                if used < number:
                    gaps[gap].appendleft((first + used, number - used))
                gaps[gap - length].append((first, used))
                runs.append((length, placed, first, used, capacity - gap))
                placed, left, take = placed + used, left - used, take - used
    return runs


def _known(spark: SparkSession, rows: list[tuple[int, ...]], *names: str) -> DataFrame:
    """Whole numbers of the driver as a table. They go as Arrow: a list of rows would start Python processes on the executors, and these stay."""
    columns = np.array(rows, np.int64).reshape(-1, len(names)).T
    return spark.createDataFrame(pa.table([pa.array(c) for c in columns], names=list(names)))


def numbered(cut: DataFrame, counts: dict[int, int], share: int = NUMBERED) -> DataFrame:
    """``cut`` with the rank of each piece among those of its length.

    A frequent length is spread over windows of about ``share`` pieces by hash; the windows' sizes give their offsets.
    """
    spark = cut.sparkSession
    spread = [(length, -(-n // share)) for length, n in counts.items()]
    widths = F.broadcast(_known(spark, spread, "length", "windows"))  # at most a row per length
    keyed = cut.join(widths, "length").withColumn("window", F.pmod(F.xxhash64(FILE, ROW, "piece"), "windows"))
    sizes = keyed.groupBy("length", "window").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("length").orderBy("window").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "window", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "window").orderBy(FILE, ROW, "piece")
    ranked = keyed.withColumn("place", F.row_number().over(inside) - 1)
    return ranked.join(offsets, ["length", "window"]).withColumn("rank", F.col("before") + F.col("place")).select(*cut.columns, "rank")


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id and offset for each stored piece (with column length, 1 to ``capacity``)."""
    spark: SparkSession = cut.sparkSession
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs = _known(spark, supersteps(counts, capacity), "length", "first_rank", "first_sequence", "number", "offset")
    ranked = numbered(cut, counts)
    # The number of runs depends on the capacity, not on the number of pieces.
    inside = (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("number"))
    on = (ranked["length"] == runs["length"]) & inside
    return ranked.join(F.broadcast(runs), on).select(
        *[ranked[c] for c in cut.columns],
        (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset",
    )


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row of ``docs``."""
    cut = materialize(pieces(on_disk(docs), path, capacity), "pieces")
    return place(cut, capacity).drop(FILE, ROW)


def sequences(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id and its ids (at most ``capacity``)."""
    cut = materialize(pieces(on_disk(docs), path, capacity, ids=True), "pieces-with-ids")
    return place(cut, capacity).groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids")
    )
