"""N-best segmentation of texts into the pieces of a SentencePiece vocabulary, and back.

The score of a segmentation is the sum of its pieces' scores. The search runs over the lattice of pieces: a forward Viterbi pass gives the
best score from the start to every place, and that is the exact heuristic of a backward A-star search from the end, which therefore
completes segmentations from best to worst and never looks at a place that none of them passes.

Places that no piece of the vocabulary can cross cut the lattice, and the best segmentations of a text are the best sums over the parts
between the cuts: the whole text is segmented, however long it is. Of each part a worker remembers the best segmentation and how much worse the
second best is; that tells which parts can take part in the n best of a text, and only these are searched for their n best.

Text form: a space before a non-empty text, spaces as U+2581. A character that no piece covers becomes its UTF-8 bytes as byte pieces, at
the cost of the worst piece and ten more. Equal scores: of one part, the segmentation whose ids read from the end are smaller comes first; of a
text, the one that takes better segmentations of later parts.

Defined results: a null or empty text has one segmentation, without pieces; a text with fewer than n segmentations has as many rows; decoding gives
the text back (U+2581 in it comes back as a space); each row has its own result, repeated or null ids or not; an empty
table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import insort
from collections.abc import Iterator
from functools import lru_cache
from heapq import nsmallest
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

NBEST = 4
SPACE = "▁"
PENALTY = 10              # fixed value: what an unknown character costs beyond the worst piece
HELD = 12_000_000         # characters of parts that a worker remembers with their best segmentation
OTHERS = 50_000           # parts that it remembers with all n
WORD = 64                 # longer runs without a space are taken part by part
CHUNKS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

INFINITE = float("inf")
# A segmentation: cost beyond the best one of its part, ids as little-endian 32-bit numbers.
Path = tuple[float, bytes]
# A piece that ends at a place: where it starts, its ids from last to first, its cost.
Edge = tuple[int, tuple[int, ...], float]
# The best segmentation of a part: its cost, how much worse the second is, ids.
Part = tuple[float, float, bytes]


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Behind:
    """What a hypothesis has behind it: its last pieces, as a chain that hypotheses share.

    Compared only where costs are equal: by ids from the end of the text.
    """

    __slots__ = ("own", "rest", "depth")

    def __init__(self, own: tuple[int, ...], rest: Behind | None) -> None:
        self.own, self.rest = own, rest
        self.depth = 0 if rest is None else rest.depth + 1

    def __lt__(self, other: Behind) -> bool:
        a, b = self, other
        while a.depth > b.depth:
            a = a.rest
        while b.depth > a.depth:
            b = b.rest
        while a.rest is not b.rest:
            a, b = a.rest, b.rest
        return a.own < b.own

    def ids(self) -> list[int]:
        """The ids in order of the text."""
        found, at = [], self
        while at is not None:
            found += reversed(at.own)
            at = at.rest
        return found


class Lattice:
    """The vocabulary as a lattice over texts."""

    def __init__(
        self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], n: int = NBEST, decoder: Decoder | None = None
    ) -> None:
        """``pieces``: id and cost (negative score) of each piece; ``byte_ids``: id of each byte's piece.

        With a decoder each segmentation of a part is decoded once, when it's found.
        """
        self.byte_ids, self.n = byte_ids, n
        self.pieces = {piece: ((number,), cost) for piece, (number, cost) in pieces.items()}
        self.unknown = max(cost for _, cost in pieces.values()) + PENALTY
        # A tree over the pieces' characters: each node has its children by character, and the piece that ends there (or None).
        self.tree: dict[str, list] = {}
        for piece, found in self.pieces.items():
            node = [self.tree, None]
            for character in piece:
                node = node[0].setdefault(character, [{}, None])
            node[1] = found
        self.longest = max(map(len, pieces))
        self.inside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}  # neighbours that a piece spans
        # Space runs apart, a chunk starts where a space follows something else; no piece may cross that.
        self.by_chunk = not any(b == SPACE and a != SPACE for a, b in self.inside)
        self.known: dict[str, Part] = {}
        self.others: dict[str, list[Path]] = {}
        self.held = 0  # characters in ``known``
        self.decoder = decoder
        self.odd: set[str] = set()  # parts with a segmentation that doesn't decode to the part

    def forward(self, text: str) -> tuple[list[list[Edge]], list[float]]:
        """For each place the pieces that end there, and the Viterbi cost from the start to it."""
        size = len(text)
        ending: list[list[Edge]] = [[] for _ in range(size + 1)]
        best = [0.0] + [INFINITE] * size
        for start in range(size):
            here, children = best[start], self.tree
            for end in range(start + 1, size + 1):
                node = children.get(text[end - 1])
                if node is None:
                    break
                children, piece = node
                if piece is not None:
                    ids, cost = piece
                    ending[end].append((start, ids, cost))
                    if here + cost < best[end]:
                        best[end] = here + cost
            if text[start] not in self.pieces:
                ids = tuple(self.byte_ids[b] for b in reversed(text[start].encode("utf-8", "replace")))
                ending[start + 1].append((start, ids, self.unknown))
                best[start + 1] = min(best[start + 1], here + self.unknown)
        return ending, best

    def best(self, text: str) -> Part:
        """The best segmentation of a part, and how much worse the second best is: a forward pass that keeps the two best costs of each place.

        Of equally good last pieces the one with smaller ids is kept, as in the search.
        """
        size, tree, longest, single = len(text), self.tree, self.longest, self.pieces
        first, second = [0.0] + [INFINITE] * size, [INFINITE] * (size + 1)
        last: list[tuple[tuple[int, ...], int]] = [((), 0)] * (size + 1)  # ids and start of the last piece
        for start in range(size):
            here, other, children, end = first[start], second[start], tree, start
            for character in text[start : start + longest]:
                node = children.get(character)
                if node is None:
                    break
                end += 1
                children, piece = node
                if piece is not None:
                    own, cost = piece
                    through, known = here + cost, first[end]
                    if through < known:
                        also = other + cost
                        first[end], second[end], last[end] = through, known if known < also else also, (own, start)
                    else:
                        if through < second[end]:
                            second[end] = through
                        if through == known and (own, start) < last[end]:
                            last[end] = (own, start)
            if text[start] not in single:
                own = tuple(self.byte_ids[b] for b in reversed(text[start].encode("utf-8", "replace")))
                through, end = here + self.unknown, start + 1
                known = first[end]
                if through < known:
                    first[end], second[end], last[end] = through, min(known, other + self.unknown), (own, start)
                else:
                    second[end] = min(second[end], through)
                    if through == known and (own, start) < last[end]:
                        last[end] = (own, start)
        ids: list[int] = []
        place = size
        while place:
            own, place = last[place]
            ids += own
        return first[-1], second[-1] - first[-1], packed(ids[::-1])

    def search(self, text: str) -> list[tuple[float, list[int]]]:
        """Up to n segmentations (cost, ids), best first, by A-star search from the end.

        The heuristic is exact, so each hypothesis stands for a segmentation of just its cost, and no two for the same: of more
        hypotheses than segmentations are still wanted the last ones are let go.
        """
        ending, best = self.forward(text)
        found: list[tuple[float, list[int]]] = []
        agenda: list[tuple[float, Behind, int, float]] = [(best[-1], Behind((), None), len(text), 0.0)]
        while agenda:
            total, behind, place, spent = agenda.pop(0)
            if not place:
                found.append((total, behind.ids()))
                continue
            wanted = self.n - len(found)
            limit = agenda[wanted - 1][0] if len(agenda) >= wanted else INFINITE
            for start, own, cost in ending[place]:
                through = best[start] + cost + spent
                if through <= limit:
                    insort(agenda, (through, Behind(own, behind), start, cost + spent))
            del agenda[wanted:]
        return found

    def paths(self, part: str) -> list[Path]:
        """The n best segmentations of a known part."""
        found = self.others.get(part)
        if found is None:
            if len(self.others) > OTHERS:
                for old in list(islice(self.others, len(self.others) // 2)):
                    del self.others[old]
            own = self._cut(part)
            if len(own) > 1:
                found = self._sums(own)
            else:
                found = self.search(part)
                found = [(cost - found[0][0], packed(ids)) for cost, ids in found]
            self.others[part] = found
            for _, ids in found:
                self._check(part, ids)
        return found

    def _sums(self, parts: list[str]) -> list[Path]:
        """The n best segmentations of parts in a row."""
        best: list[Path] = [(0.0, b"")]
        for part in parts:
            more = [
                (a[0] + p[0], which, before, a[1] + p[1])
                for which, p in enumerate(self.paths(part)) for before, a in enumerate(best)
            ]
            more.sort(key=lambda m: m[:3])
            best = [(cost, ids) for cost, _, _, ids in more[: self.n]]
        return best

    def segment(self, text: str) -> tuple[float, list[Path]]:
        """The best cost and the n best segmentations of a whole text."""
        return self.segment_parts(self.parts(text))

    def decodes(self, parts: list[str]) -> bool:
        """Whether all segmentations seen of these parts decode to them. Ids are decoded one by one, so those of whole texts do as well."""
        return self.decoder is not None and (not self.odd or self.odd.isdisjoint(parts))

    def segment_parts(self, parts: list[str]) -> tuple[float, list[Path]]:
        """The best cost and the n best segmentations of known parts in a row."""
        n = self.n
        firsts = list(map(self.known.__getitem__, parts))
        costs, seconds, ids = zip(*firsts) if firsts else ((), (), ())
        # The second choice of each part makes a segmentation of its own, so n - 1 of them bound the n-th best.
        limit = nsmallest(n - 1, seconds)[-1] if 1 < n <= len(seconds) + 1 else INFINITE
        # The n best choices so far: (cost beyond the best, other choices as (part, which) pairs from the last to the first).
        best: list[tuple[float, tuple | None]] = [(0.0, None)]
        for k in [k for k, second in enumerate(seconds) if second <= limit and second < INFINITE]:
            if len(best) == n and seconds[k] >= best[-1][0]:
                continue
            more = [
                (b + p[0], which, before, rest)
                for which, p in enumerate(self.paths(parts[k])) for before, (b, rest) in enumerate(best)
            ]
            more.sort(key=lambda x: x[:3])
            best = [(c, (k, which, rest) if which else rest) for c, which, _, rest in more[:n]]
        result = []
        for cost, changed in best:
            own = ids if changed is None else list(ids)
            while changed is not None:
                k, which, changed = changed
                own[k] = self.paths(parts[k])[which][1]
            result.append((cost, b"".join(own)))
        return sum(costs), result

    def parts(self, text: str) -> list[str]:
        """The parts of a text, all of them known."""
        if not text:
            return []
        if self.held > HELD:
            for old in list(islice(self.known, len(self.known) // 2)):
                del self.known[old]
                self.held -= len(old)
            self.odd = {part for part in self.odd if part in self.known or part in self.others}
        form = SPACE + text.replace(" ", SPACE)
        parts = CHUNKS.findall(form) if self.by_chunk else [form]
        long = {}
        for part in set(parts).difference(self.known):
            own = self._cut(part)
            for x in own:
                if x not in self.known:
                    found = self.best(x)
                    self._keep(x, found)
                    self._check(x, found[2])
            if len(own) > 1:
                if len(part) > WORD:
                    long[part] = own
                else:
                    each = [self.known[x] for x in own]
                    costs, seconds, ids = zip(*each)
                    self._keep(part, (sum(costs), min(seconds), b"".join(ids)))
                    if self.odd and not self.odd.isdisjoint(own):
                        self.odd.add(part)
        return parts if not long else [x for p in parts for x in long.get(p, (p,))]

    def _cut(self, part: str) -> list[str]:
        cuts = [i for i in range(1, len(part)) if part[i - 1 : i + 1] not in self.inside]
        return [part[a:b] for a, b in zip([0, *cuts], [*cuts, len(part)])] if cuts else [part]

    def _keep(self, part: str, found: Part) -> None:
        self.known[part] = found
        self.held += len(part)

    def _check(self, part: str, ids: bytes) -> None:
        if self.decoder is not None and self.decoder.shown(ids) != part.replace(SPACE, " ").encode("utf-8", "replace"):
            self.odd.add(part)


class Decoder:
    """Texts from ids."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.pieces = pieces

    def shown(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, memoryview(ids).cast("I")))

    def decode(self, ids: bytes) -> bytes:
        text = self.shown(ids)
        return text[1:] if text[:1] == b" " else text  # the space that encoding puts in front


@lru_cache(maxsize=2)
def vocabulary(path: str, n: int = NBEST) -> tuple[Lattice, Decoder]:
    """Lattice and decoder of a model file; one per worker, so that parts are remembered from task to task."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    pieces, byte_ids, shown = {}, [0] * 256, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
            shown.append(bytes([int(piece[1:-1], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            shown.append(b"")
        else:
            pieces[piece] = (i, -model.get_score(i))
            shown.append(piece.replace(SPACE, " ").encode())
    decoder = Decoder(shown)
    return Lattice(pieces, byte_ids, n, decoder), decoder


def encode(docs: DataFrame, path: str, n: int = NBEST, ids: bool = False) -> DataFrame:
    """doc_id, rank (from 1), n_pieces, score, ids_crc32, round_trip of the n best segmentations of each text; the ids, if asked.

    round_trip tells whether decoding the ids gives the text.
    """
    schema = "doc_id long, rank int, n_pieces long, score double, ids_crc32 long, round_trip boolean" + ", ids array<long>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, decoder = vocabulary(path, n)
        names = [field.split()[0] for field in schema.split(", ")]
        for batch in batches:
            rows: list[list] = [[] for _ in range(7)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                parts = lattice.parts(text)
                total, found = lattice.segment_parts(parts)
                plain = None if lattice.decodes(parts) else text.encode().replace(SPACE.encode(), b" ")
                for rank, (cost, own) in enumerate(found, 1):
                    made = (doc_id, rank, len(own) // 4, -(total + cost), zlib.crc32(own), plain is None or decoder.decode(own) == plain,
                            np.frombuffer(own, "<u4").astype(np.int64) if ids else None)
                    for column, value in zip(rows, made):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)][: len(names)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("_text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (with column ids, an array of ids) and the text that the ids stand for."""
    at = encoded.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = vocabulary(path)[1]
        for batch in batches:
            texts = [
                None if ids is None else decoder.decode(np.array(ids, "<u4").tobytes()).decode("utf-8", "replace")
                for ids in batch.column(at).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(batch.columns + [pa.array(texts, pa.string())], names=batch.schema.names + ["text"])

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField("text", StringType())]))
