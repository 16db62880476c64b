import random
import re
from collections import Counter

import numpy as np

from tests.conftest import rows
from tests.llm.conftest import odd_texts
from trajspark.llm import collocations as co

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(data, least, top):
    counts, totals = Counter(), Counter()
    for lang, text in data:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    frequent = {key: n for key, n in counts.items() if n >= least and len(key[1]) > 1}
    longer = {}
    for (lang, words), a in frequent.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                inner = lang, words[i : i + k]
                longer[inner] = max(longer.get(inner, 0), a)
    best = {}
    for (lang, words), a in frequent.items():
        cuts = []
        for k in range(1, len(words)):
            l, r = counts[lang, words[:k]], counts[lang, words[k:]]
            cuts.append((2_000_000 * a // (l + r), k, l, r))
        if 100 * longer.get((lang, words), 0) < 80 * a:
            best.setdefault(lang, []).append((min(cuts), a, " ".join(words)))
    result = []
    for lang, found in best.items():
        found.sort(key=lambda x: (-x[0][0], -x[1], x[2].encode()))
        result += [(lang, i, p, a, l, r, totals[lang], s) for i, ((s, _, l, r), a, p) in enumerate(found[:top], 1)]
    return sorted(result, key=repr)


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = ["Über", "the", "cat", "sat", "mat", "a\x00b", "x" * 40, "漢字", "\U0001f600", "THE", "on", "é", "z\x1cy"]
    data = []
    for _ in range(n):
        text = []
        for _ in range(rng.randint(0, 60)):
            text.append("New York City hall" if rng.random() < 0.1 else rng.choice(words))
            text.append(rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", ",", "!? ", "\r\n", "\x0b"]))
        data.append((rng.choice(["en", "en", "de", None, "und", ""]), "".join(text)))
    return data


def frame(spark, data):
    return spark.createDataFrame([(t, lang, i) for i, (lang, t) in enumerate(data)], "text string, lang string, phrase int")


def test_equals_brute_force(spark, monkeypatch):
    data = corpus(1) + [("en", t) for t in odd_texts()] + [("xx", None)]
    for least, top in ((3, 2000), (12, 20)):
        expected = brute(data, least, top)
        assert len(expected) >= (10 if least == 12 else 200)
        assert rows(co.collocations(frame(spark, data).repartition(3), least, top)) == expected
    # Several shards, and filters that mark many phrases wrongly.
    monkeypatch.setattr(co, "SHARD", 40)
    monkeypatch.setattr(co, "FILTER_BITS", 14)
    data = corpus(2, 60)
    assert rows(co.collocations(frame(spark, data), 4, 30)) == brute(data, 4, 30)


def test_without_frequent_phrases(spark):
    assert co.collocations(frame(spark, [])).collect() == []
    assert co.collocations(frame(spark, [("en", "a b c"), (None, None)])).collect() == []


def test_few_phrases_are_candidates_by_chance(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    often = [" ".join(rng.choices(words, k=3)) for _ in range(2_000)]
    data = [("en", ". ".join(rng.sample(often, 1_000) + [" ".join(rng.choices(words, k=2)) for _ in range(3_000)])) for _ in range(10)]
    stored, store = {}, co.materialize
    monkeypatch.setattr(co, "materialize", lambda df, name: stored.setdefault(name, store(df, name)))
    monkeypatch.setattr(co, "FILTER_BITS", 18)  # frequent phrases fill some 2 % of the filter
    known, _ = co.phrase_counts(frame(spark, data), 4)
    assert known.count() > 5_000
    # Phrases that others' marks let through would grow as the number of marks times that of different phrases.
    assert known.count() <= stored["phrases"].count() < 1.01 * known.count()


def test_blocks_of_many_different_words_are_split_without_loss(monkeypatch):
    monkeypatch.setattr(co, "CODES", 16)
    rng = random.Random(7)
    words = [co.BREAK if rng.random() < 0.2 else b"w%d" % rng.randint(0, 40) for _ in range(500)]
    for before in (0, 3):
        blocks = [([d.to_pylist()[c] for c in codes], carried) for d, codes, carried in co._coded(words, before)]
        assert len(blocks) > 10 and [w for own, carried in blocks for w in own[carried:]] == words[before:]
        for k in range(1, 5):
            seen = [tuple(own[i : i + k]) for own, c in blocks for i in range(max(0, c - k + 1), len(own) - k + 1)]
            assert sorted(seen) == sorted(tuple(words[i : i + k]) for i in range(max(0, before - k + 1), len(words) - k + 1))


def test_settings_of_the_session_stay(spark):
    before = spark.conf.get(co.BATCH_CONF)
    co.collocations(frame(spark, [("en", "New York City. " * 40)]), 20, 50).collect()
    assert spark.conf.get(co.BATCH_CONF) == before


def test_scores_are_exact_beyond_64_bits(spark):
    large = 2**62
    row = spark.createDataFrame([(large, large, large - 1)], "a long, l long, r long")
    product = co.F.lit(2_000_000).cast("decimal(7,0)") * co._exact("a")
    score = co.F.call_function("div", product, co._exact("l") + co._exact("r"))
    assert row.select(score).first()[0] == 2_000_000 * large // (2 * large - 1)


def test_long_texts_are_cut_without_loss(monkeypatch):
    monkeypatch.setattr(co, "BLOCK", 30)
    rng = random.Random(4)
    text = "".join(rng.choice(["ab ", "c", "\t", "d! ", "x" * 50 + " "]) for _ in range(300)).encode()
    whole = co._words(text.translate(co._MAPPED))
    blocks = list(co._cut(text.translate(co._MAPPED)))
    assert len(blocks) > 10
    assert [w for words, carried in blocks for w in words[carried:]] == whole
    for k in range(1, 5):
        seen = [tuple(words[i : i + k]) for words, c in blocks for i in range(max(0, c - k + 1), len(words) - k + 1)]
        assert sorted(seen) == sorted(tuple(whole[i : i + k]) for i in range(len(whole) - k + 1))


def test_double_array_holds_its_keys_and_no_others():
    rng = random.Random(5)
    for width, n in ((3, 10), (50, 400), (1000, 5000)):
        keys = sorted({tuple(rng.randint(1, width) for _ in range(rng.randint(1, 5))) for _ in range(n)})
        table = np.array([k + (0,) * (5 - len(k)) for k in keys])
        trie, states = co.DoubleArray.build(table)
        assert len(set(states.tolist())) == len(keys) and (trie.base >= 0).all()
        known = dict(zip(keys, states.tolist()))
        prefixes = {k[:i] for k in keys for i in range(1, 6)}
        for probe in keys + [tuple(rng.randint(0, width) for _ in range(3)) for _ in range(300)]:
            state, there = 0, True
            for at, code in enumerate(probe):
                following, found = trie.step(np.array([state]), np.array([code]))
                there = bool(found[0])
                assert there == (probe[: at + 1] in prefixes)
                if not there:
                    break
                state = int(following[0])
            if there and probe in known:
                assert known[probe] == state
