import random
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.conftest import SMALL, odd_texts
from trajspark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def sequential_best_fit(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fits = [k for k, g in enumerate(gaps) if g >= x]
        if fits:
            gaps[min(fits, key=lambda k: gaps[k])] -= x
        else:
            gaps.append(capacity - x)
    return len(gaps)


def check_layout(rows, capacity=packing.CAPACITY):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by)


def test_supersteps_pack_as_well_as_sequential_best_fit():
    rng = random.Random(2)
    for capacity in (1, 7, 50, 100):
        for _ in range(30):
            lengths = [rng.randint(1, capacity) for _ in range(rng.randint(1, 200))]
            counts = {x: lengths.count(x) for x in set(lengths)}
            runs = packing.supersteps(counts, capacity)
            placed = {(length, first + i): (s + i, o) for length, first, s, n, o in runs for i in range(n)}
            assert len(placed) == len(lengths)
            used = {}
            for (length, _), (s, o) in placed.items():
                used.setdefault(s, []).append((o, length))
            for parts in used.values():
                ends = [0] + [o + n for o, n in sorted(parts)]
                assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= capacity
            assert len(used) <= 1.05 * sequential_best_fit(lengths, capacity) + 1


def test_word_ids_equal_the_tokenizer():
    tokenizer = Tokenizer.from_file(PATH)
    texts = [t or "" for t in odd_texts()] + [
        "Don't stop, they'll we've I'm. He'd 's", "a,, b... c!? d.", "<|endoftext|> x<|startoftext|>", "<|ENDOFTEXT|>", "İstanbul ΣΑΣ ǅ", "é ́x ä.",
        "한글 각", "ﬁ ﬂ", "a b c\x1cd\x85e", "½ ² ٣ १२", "abͅ ẞ",
    ]
    encoder = packing.word_encoder(PATH)
    found = encoder.encode([t.encode() for t in texts])
    for text, ids in zip(texts, found):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:50]


def whole_ids(tokenizer, texts):
    decoded = [(t or b"").decode("utf-8", "replace") for t in texts]
    return [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in decoded]


def test_marks_behind_letters_that_the_tokenizer_takes_apart():
    encoder = packing.WordEncoder(PATH)
    texts = ["ALİ.", "İ, x", "\ufb3c.", "\u0958***", "ΑΣ. ΑΣ,Σ", "한.글! ᄒ", "zͅ. é.", "don't, (it's)", "a\x1f.b\x7f! x\u2028y."]
    given = [t.encode() for t in texts] + [b"a\xff. \xc3", b" \n a ", b" ", b"", None]
    assert encoder.encode(given) == whole_ids(encoder.tokenizer, given)
    assert encoder.encode([]) == [] and encoder.encode([None]) == [b""]


def test_words_of_letters_digits_and_marks_never_take_the_whole_way():
    encoder = packing.WordEncoder(PATH)
    given = [t.encode() for t in ("Arm (left), arm!!! grip*** 3.5kg [a_b]", "Écoute: Öl, naïve? жук.", "x" * 300)]
    expected = whole_ids(encoder.tokenizer, given)
    # Only these two parts are left of the tokenizer, for letters beyond ASCII: nothing can be encoded with it.
    encoder.tokenizer = SimpleNamespace(normalizer=encoder.tokenizer.normalizer, pre_tokenizer=encoder.tokenizer.pre_tokenizer)
    assert encoder.encode(given) == expected


def test_query_matches_the_tokenizer_and_packs_tightly(spark):
    from trajspark.llm.queries import QUERIES

    rows = QUERIES["op6_best_fit_packing"](spark, SMALL).collect()
    tokenizer = Tokenizer.from_file(PATH)
    expected = set()
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [0], "<u4")
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            expected.add((r.doc_id, k, at, len(part), zlib.crc32(part.tobytes())))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == expected and len(rows) == len(expected)
    used = check_layout(rows)
    assert used <= sequential_best_fit([r.length for r in rows], 2048) + 1


def test_odd_rows_and_sequences(docs):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(None, "a b"), (6, "a b"), (6, "a b")]
    odd = docs(rows).withColumns({c: F.lit(7) for c in ("piece", "length", "rank", "window")})
    found = packing.pack(odd, PATH, 64).collect()
    check_layout(found, 64)
    assert [r.length for r in found if r.doc_id == 0] == [1]
    assert sum(r.doc_id == 6 for r in found) == 3 and sum(r.doc_id is None for r in found) == 1
    whole = packing.sequences(odd, PATH, 64).collect()
    assert sum(len(r.ids) for r in whole) == sum(r.length for r in found) and all(len(r.ids) <= 64 for r in whole)
    assert packing.pack(docs([]), PATH).collect() == []


def test_workers_keep_no_words_after_a_task(docs, spark):
    rows = [(i, " ".join(f"word{i}x{j}" for j in range(50))) for i in range(40)]
    check_layout(packing.pack(docs(rows).repartition(4), PATH).collect())

    def left(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(packing.word_encoder(PATH).known)])], names=["n"])

    # The workers are those that packed: Spark gives them to the next stages too.
    assert {r.n for r in spark.range(0, 100, 1, 8).mapInArrow(left, "n long").collect()} == {0}


def test_full_memory_keeps_the_words_of_the_part_at_hand(monkeypatch):
    tokenizer = Tokenizer.from_file(PATH)
    learned = Counter()
    learn = packing.WordEncoder._learn
    monkeypatch.setattr(packing.WordEncoder, "_learn", lambda self, words: (learned.update(words), learn(self, words)))
    monkeypatch.setattr(packing, "WORDS_KEPT", 300)
    encoder = packing.WordEncoder(PATH)
    for k in range(30):
        texts = [f"the model and a robot, word{k}x{j}. " for j in range(20)] + ["arm? arm!", ""]
        found = encoder.encode([t.encode() for t in texts])
        assert [np.frombuffer(x, "<u4").tolist() for x in found] == [
            tokenizer.encode(t, add_special_tokens=False).ids for t in texts
        ]
        assert len(encoder.known) <= 300
    assert learned[b"robot,"] == learned[b"arm!"] == 1 and learned[b"word0x0."] == 1


def test_numbers_of_the_driver_start_no_python(spark):
    frame = packing._known(spark, [(3, 1), (5, 2)], "length", "windows")
    assert sorted(map(tuple, frame.collect())) == [(3, 1), (5, 2)] and frame.dtypes == [("length", "bigint"), ("windows", "bigint")]
    assert "PythonRDD" not in frame._jdf.queryExecution().toRdd().toDebugString()
    assert packing._known(spark, [], "length", "windows").collect() == []
