import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from trajspark.llm import jaccard, simhash
from trajspark.session import materialize


def grams(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def planted(rng, copies):
    """Texts of their own, and near copies of some that differ in a few words, all with a common passage."""
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    passage = [word() for _ in range(12)]
    texts = []
    for k in range(12):
        base = [word() for _ in range(rng.randint(60, 300))] + passage
        texts.append(" ".join(base))
        for _ in range(copies if k == 0 else k % 4):
            other = list(base)
            for at in rng.sample(range(len(base)), rng.randint(1, max(1, len(base) // 45))):
                other[at] = word()
            texts.append(" ".join(other))
    rng.shuffle(texts)
    return texts


def brute(texts):
    sets = [grams(t) for t in texts]
    root, levels = list(range(len(texts))), []

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            share = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            if share >= 0.8:
                levels.append(share)
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))], levels


def test_stage_drops_copies_of_0_8_and_more(docs, spark):
    texts = planted(random.Random(4), 40)
    expected, levels = brute(texts)
    assert sum(0.8 <= s <= 0.85 for s in levels) >= 10 and sum(0.85 < s <= 0.95 for s in levels) >= 10
    frame = docs(list(enumerate(texts)))
    found = {r.doc_id: r.component_id for r in simhash.near_groups(frame).collect()}
    assert [found[i] for i in range(len(texts))] == expected
    left = {r.doc_id for r in corpus_pipeline.near_copies(spark, frame, "").collect()}
    assert left == set(expected)


def test_large_groups_are_linked_in_two_rounds(docs):
    texts = planted(random.Random(5), 12)
    stored = materialize(docs(list(enumerate(texts))), "t")
    prints = materialize(jaccard.prints(stored), "t")
    nodes = materialize(simhash._firsts(prints, "node", "n", "counts"), "t")
    node = {r.doc_id: r.node for r in prints.collect()}
    expected, _ = brute(texts)
    for small in (1, 3, 1000):
        label = {r.node: r.label for r in jaccard.components_of(prints, nodes, stored, small).collect()}
        got = [label.get(node[i], node[i]) for i in range(len(texts))]
        assert all((got[i] == got[j]) == (expected[i] == expected[j]) for i in range(len(texts)) for j in range(i))


def test_bucket_counts_bound_the_overlap():
    rng = np.random.default_rng(6)
    for _ in range(200):
        pool = rng.integers(0, 2**64, 400, np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(0, 300))) for _ in "ab")
        bound = jaccard.may_share([jaccard.bucket_counts(a)], [jaccard.bucket_counts(b)])[0]
        fine = jaccard.fine_share([jaccard.fine_counts(a)], [jaccard.fine_counts(b)])[0]
        assert len(np.intersect1d(a, b)) <= min(bound, fine) and max(bound, fine) <= min(len(a), len(b))
    many = np.arange(70_000, dtype=np.uint64)  # all in one bucket, which takes more than 16 bits
    some = np.unique(np.concatenate((many[:300], a)))
    assert jaccard.may_share([jaccard.bucket_counts(many)], [jaccard.bucket_counts(some)])[0] >= 300


def test_sets_that_share_a_name_are_told_apart(docs):
    texts = ["a b c d e f g", "h i j k l m n", "a b c d e f g"]
    prints = jaccard.prints(materialize(docs(list(enumerate(texts))), "t")).withColumn("node", F.lit(1).cast("long"))
    found = {r.doc_id: r.node for r in jaccard.told_apart(materialize(prints, "t")).collect()}
    assert found[0] == found[2] != found[1]


def test_fingerprints_find_near_copies_through_the_trees(docs):
    texts = planted(random.Random(7), 20)
    prints = jaccard.told_apart(materialize(jaccard.prints(materialize(docs(list(enumerate(texts))), "t")), "t"))
    marks = {r.node: r.fp & simhash.ALL for r in prints.select("node", "fp").collect()}
    expected = {
        tuple(sorted((a, b))) for a in marks for b in marks if a < b and (marks[a] ^ marks[b]).bit_count() <= simhash.NEAR_RADIUS
    }
    assert len(set(marks.values())) == len(marks) and len(expected) > 20
    for nodes in (3, 1000):
        got = [tuple(sorted(r)) for r in simhash.near_pairs(prints, tree_nodes=nodes, nearest=1000).collect()]
        assert set(got) == expected and len(got) == len(expected)
    assert {tuple(sorted(r)) for r in simhash.near_pairs(prints).collect()} <= expected


def test_copies_that_stay_apart_are_not_handed_on_in_pairs(docs):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    base = [word() for _ in range(120)]
    texts = []
    for _ in range(60):
        other = list(base)
        for at in rng.sample(range(len(base)), 8):  # two of them are some 0.4 alike, so none is linked
            other[at] = word()
        texts.append(" ".join(other))
    rows = materialize(docs(list(enumerate(texts))), "t")
    prints = materialize(jaccard.prints(rows), "t")
    nodes = materialize(simhash._firsts(prints, "node", "n", "counts"), "t")
    own = nodes.select("node", F.col("first.counts").alias("counts"), F.col("node").alias("label"))
    hashes = prints.select(F.col("n").cast("long").alias("n"), "node", F.posexplode("first").alias("at", "hash"))
    met = hashes.groupBy("node").agg(F.slice(F.sort_array(F.collect_set("hash")), 1, jaccard.MET).alias("met"))
    pairs = jaccard._apart(hashes.withColumn("at", F.col("at").cast("long")).join(own, "node").join(met, "node")).collect()
    _, levels = brute(texts)
    assert len(levels) <= len(pairs) <= len(levels) + 20
    assert len({tuple(sorted(p)) for p in pairs}) == len(pairs)
