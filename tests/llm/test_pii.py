import hashlib
import random
import re

import numpy as np
import pytest

from tests.llm.conftest import SMALL, odd_texts
from trajspark.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """The base spans by the patterns as they are written."""
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card":
                doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
                if not 13 <= len(digits) <= 19 or sum(doubled) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            found.append(f"{kind}:{m.start()}:{m.end()}")
    return found


def card(rng):
    body = "4" + "".join(rng.choices("0123456789", k=14))
    return next(body + c for c in "0123456789" if pii.luhn(body + c))


def entity(rng, kind):
    number = lambda: str(rng.randint(1, 250))
    if kind == "email":
        return "".join(rng.choices("abcdefgh", k=5)) + f".{rng.randint(10, 99)}@mail{rng.randint(1, 9)}.example.com"
    if kind == "ip":
        return ".".join(number() for _ in range(4))
    if kind == "card":
        return card(rng)
    return f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"


def corpus(seed, n=260):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeéñ", k=rng.randint(2, 8)))
    texts = []
    for i in range(n):
        parts = [word() for _ in range(rng.randint(10, 60))]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randint(0, len(parts)), entity(rng, rng.choice(pii.KINDS)))
        if rng.random() < 0.3:
            parts.insert(rng.randint(0, len(parts)), f"token={rng.getrandbits(64):x}")
        texts.append(" ".join(parts))
    return texts


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    alphabet = ["a", "Z", "1", "9", "25", "255", "256", "@", ".", ".", "-", " ", "+", "(", ")", "é", "%", "_", "00", "4111111111111111"]
    for _ in range(4000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 40)))
        assert [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in pii.base_spans(text)] == plain(text), text
    for text in corpus(2):
        assert pii.as_text(pii.base_spans(text)) == ",".join(plain(text))


def test_base_spans_of_long_runs_take_linear_time():
    for text in ("a" * 300_000 + " ", "1" * 300_000 + "x", "1." * 150_000, "a@" * 150_000, "+1" * 150_000, "1 " * 150_000):
        pii.base_spans(text)
        pii.windows(text)


def test_windows_hold_every_digit_twice():
    text = "a" * 500 + "7" + "b" * 700 + "@"
    starts = pii.windows(text)
    for at in (500, 1201):
        assert sum(s <= at < s + pii.WINDOW for s in starts) == 2
    assert len(starts) == 4 and pii.windows("letters only") == [] == pii.windows("")


def test_gradient_equals_differences():
    rng = np.random.default_rng(3)
    tagger = pii.Tagger.fresh(hidden=3)
    tagger.w = {k: v.astype(np.float64) for k, v in tagger.w.items()}
    for k in ("step", "first", "bias"):
        tagger.w[k] = tagger.w[k] + rng.normal(0, 0.3, tagger.w[k].shape)
    texts = ["ab 12", "+1 2", "x"]
    x = np.stack([pii.symbols(t, 7) for t in texts], axis=1)
    y = np.stack([pii.labelled(s, 7) for s in ([(2, 3, 5)], [(3, 0, 4)], [])], axis=1)
    _, grad = tagger.gradient(x, y)
    for name, g in grad.items():
        for index in {tuple(i) for i in np.argwhere(np.abs(g) > 1e-4)[:4].tolist()}:
            values = []
            for sign in (1, -1):
                tagger.w[name][index] += sign * 1e-3
                values.append(tagger.gradient(x, y)[0])
                tagger.w[name][index] -= sign * 1e-3
            assert (values[0] - values[1]) / 2e-3 == pytest.approx(g[index], rel=0.03, abs=3e-4), (name, index)


def test_decoding_finds_the_best_path():
    rng = np.random.default_rng(4)
    tagger = pii.Tagger.fresh(hidden=4)
    tagger.w["step"] += rng.normal(0, 1, tagger.w["step"].shape).astype(np.float32)
    text = "a1@"
    scores, _ = tagger.emissions(pii.symbols(text, pii.WINDOW)[:, None])
    step, first = tagger.transitions()
    paths = [(first[a] + scores[0, 0, a] + step[a, b] + scores[1, 0, b] + step[b, c] + scores[2, 0, c], (a, b, c))
             for a in range(9) for b in range(9) for c in range(9)]
    best = max(paths)[1]
    expected = [(k, i) for i, label in enumerate(best) if label % 2 for k in [label // 2]]
    assert [(k, a) for _, k, a, _ in tagger.decode([text])[0]] == expected


def test_reconciling_joins_cut_spans_and_keeps_the_heaviest():
    text = "x 10.0.0.1 and +1 222 333 4444"
    of = lambda a, b: text[a:b]
    assert pii.reconcile([(1.0, 1, 2, 7, True), (2.0, 1, 5, 10, True)], of) == [(1, 2, 10)]
    assert pii.reconcile([(1.0, 1, 2, 10, False), (1.0, 1, 2, 10, False)], of) == [(1, 2, 10)]
    assert pii.reconcile([(1.0, 3, 15, 30, False), (3.0, 3, 18, 30, False), (0.5, 1, 2, 10, False)], of) == [(1, 2, 10), (3, 18, 30)]
    assert pii.reconcile([(9.0, 2, 2, 10, False)], of) == []  # no card number
    assert not pii.passes(2, "405768150e0411590525") and not pii.passes(3, "555a123456")


def test_finds_what_patterns_miss_and_leaves_clean_texts_alone(docs):
    texts = corpus(5)
    rng = random.Random(6)
    held = []
    for i in range(60):
        pair = f"{entity(rng, 'phone')} {card(rng)}"  # side by side: each pattern reads too many digits
        held.append(f"abc dé {'ab cde ' * rng.randint(0, 30)}{pair} abc de")
    clean = ["abc " * 50, "version 2.0 of 1999, 12 34", f"token={rng.getrandbits(160):x} abc", "a @ b 5"]
    frame = docs(list(enumerate(texts + held + clean)))
    found = {r.doc_id: r for r in pii.find(frame).collect()}
    assert all(plain(t) == [] for t in held)
    caught = sum(
        {"card", "phone"} <= {s.split(":")[0] for s in found[len(texts) + i].spans.split(",")} for i in range(len(held))
    )
    assert caught >= 0.9 * len(held)
    for i in range(len(clean)):
        assert found[len(texts) + len(held) + i].spans == ""
    extra = 0
    for i, text in enumerate(texts):
        base = plain(text)
        assert found[i].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(found[i].spans.split(",")) | {""}
        assert [found[i][f"n_{k}"] for k in pii.KINDS] == [sum(s.startswith(k) for s in base) for k in pii.KINDS]
        extra += len(set(found[i].spans.split(",")) - set(base) - {""})
    assert extra <= 0.1 * len(texts)


def test_query_on_the_table(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = {r.doc_id: r for r in pii.find(table).collect()}
    rows = table.select("doc_id", "text").collect()
    assert len(found) == len(rows)
    for r in rows:
        base = plain(r.text)
        assert found[r.doc_id].base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(found[r.doc_id].spans.split(",")) | {""}


def test_odd_rows(spark, docs):
    rows = list(enumerate(odd_texts())) + [(None, "1.2.3.4"), (2, "1.2.3.4 x@y.z"), (2, "1.2.3.4 x@y.z"), (90, "9" * 200_000)]
    frame = docs(rows).withColumn("spans", pii.F.lit("clash")).withColumn("base", pii.F.lit(1))
    found = sorted(pii.find(frame, sample=5).collect(), key=repr)
    assert len(found) == len(rows)
    assert [r.spans for r in found if r.doc_id == 2 and r.n_ip] == ["email:8:13,ip:0:7"] * 2
    assert pii.find(docs([])).collect() == []
    assert [r.spans for r in pii.find(docs([(1, "a"), (2, None)])).collect()] == ["", ""]
