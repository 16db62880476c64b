import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from tests.llm.conftest import SMALL, odd_texts
from trajspark.llm import segmentation as sg

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def every(lattice, text):
    """All segmentations (cost, ids) in the order that is promised for one part."""
    ending = lattice.forward(text)[0]

    def back(place):
        if not place:
            return [(0.0, ())]
        return [(c + cost, own + rest) for start, own, cost in ending[place] for c, rest in back(start)]

    return [(c, list(ids[::-1])) for c, ids in sorted(back(len(text)))]


def lattice_like(other):
    return sg.Lattice({p: (ids[0], cost) for p, (ids, cost) in other.pieces.items()}, other.byte_ids, other.n)


def test_search_equals_all_segmentations_with_ties():
    rng = random.Random(1)
    pieces = {p: (k, float(rng.randint(1, 3) * len(p))) for k, p in enumerate(["a", "b", "c", "ab", "bc", "ca", "aa", "abc", "bca", "▁", "▁a"])}
    lattice = sg.Lattice(pieces, list(range(1000, 1256)), n=5)
    for _ in range(200):
        text = "".join(rng.choice("abcdé▁") for _ in range(rng.randint(1, 9)))
        found = every(lattice, text)
        assert lattice.search(text) == found[:5]
        cost, second, ids = lattice.best(text)
        assert (cost, list(memoryview(ids).cast("I"))) == found[0]
        assert second == (found[1][0] - found[0][0] if len(found) > 1 else sg.INFINITE)


@pytest.mark.parametrize("text", ["hello, world", "a  b\nc", "¡Ünï çødé!", "漢字 text 🙂", "x" * 40, "'); {\r\n}", "the the the"])
def test_texts_match_a_search_over_the_whole_lattice(text):
    lattice, decoder = sg.vocabulary(MODEL, 4)
    total, found = lattice.segment(text)
    whole = lattice_like(lattice).search(sg.SPACE + text.replace(" ", sg.SPACE))
    assert [total + c for c, _ in found] == [c for c, _ in whole]
    assert len({ids for _, ids in found}) == len(found)
    assert all(decoder.decode(ids).decode() == text for _, ids in found)
    model = SentencePieceProcessor(model_file=MODEL)
    assert all(model.decode([int(x) for x in memoryview(ids).cast("I")]) == text for _, ids in found)


def test_long_part_without_cuts():
    lattice, decoder = sg.vocabulary(MODEL, 4)
    text = "ab" * 30_000
    total, found = lattice.segment(text)
    assert len(found) == 4 and all(decoder.decode(ids).decode() == text for _, ids in found)
    assert [c for c, _ in found] == sorted(c for c, _ in found)


def test_forgetting_changes_nothing(monkeypatch):
    texts = ["some words, here", "other words there", "x" * 100 + "?!" * 50]
    fresh = [lattice_like(sg.vocabulary(MODEL, 4)[0]).segment(t) for t in texts]
    monkeypatch.setattr(sg, "HELD", 3)
    monkeypatch.setattr(sg, "OTHERS", 1)
    assert [sg.vocabulary(MODEL, 4)[0].segment(t) for t in texts] == fresh


def test_odd_rows_and_round_trip(docs, spark):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(None, "a b"), (6, "a b"), (6, "a b")]
    found = sg.encode(docs(rows), MODEL, ids=True)
    got = found.collect()
    assert all(r.round_trip for r in got)
    assert [(r.rank, r.n_pieces, r.score) for r in got if r.doc_id == 1] == [(1, 0, 0.0)]
    assert sum(r.doc_id == 6 and r["rank"] == 1 for r in got) == 3
    texts = {i: t or "" for i, t in rows if i is not None}
    assert all(r.text == texts[r.doc_id] for r in sg.decode(found, MODEL).collect() if r.doc_id is not None)
    assert sg.encode(docs([]), MODEL).collect() == []


def test_query_has_every_text(spark):
    from trajspark.llm.queries import QUERIES

    found = QUERIES["op3_nbest_pieces"](spark, SMALL).toPandas()
    assert found.round_trip.all() and (found["rank"] == 1).sum() == 1000
    assert (found.sort_values(["doc_id", "rank"]).groupby("doc_id").score.diff().dropna() <= 0).all()
