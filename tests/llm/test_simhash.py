import random
import re

import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.conftest import SMALL, odd_texts
from trajspark.llm import simhash
from trajspark.llm.graph import components
from trajspark.llm.queries import QUERIES


def plain(text, width=3):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints, radius=2):
    ids, parent = sorted(prints), {}
    for i in ids:
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for i in ids:
        parent[i] = by.setdefault(prints[i], i)
    firsts = sorted(by.values())
    for n, i in enumerate(firsts):
        for j in firsts[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in ids}


@given(st.text(max_size=60))
@settings(deadline=None, max_examples=200)
def test_fingerprint_equals_plain_form(text):
    if text.isascii() or text.encode("utf-8", "ignore").decode() == text:
        assert simhash.fingerprint(text.encode("utf-8", "ignore")) == plain(text)


def test_spark_hash_is_the_same_hash(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert got & simhash.ALL == xxhash.xxh64_intdigest(b"a b c", seed=42)


def test_links_match_brute_force_with_small_trees(spark):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(6)] + [0, simhash.ALL]
    values = set(centres)
    for c in centres:
        for _ in range(25):
            bits = c
            for _ in range(rng.randint(0, 3)):
                bits ^= 1 << rng.randrange(64)
            values.add(bits)
    expected = {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2}
    frame = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    for nodes in (3, 4096):
        found = [(r.a & simhash.ALL, r.b & simhash.ALL) for r in simhash.links(frame, 2, nodes).collect()]
        assert len(found) == len(set(found)) and set(found) == expected


def test_rows_sent_to_the_trees_grow_with_the_fingerprints(spark):
    rng = random.Random(9)
    values = [rng.getrandbits(64) for _ in range(5_000)]
    masks = simhash.block_masks(simhash.NEAR_RADIUS, 2)
    for n in (1_000, 5_000):
        frame = spark.createDataFrame([(simhash.signed(v),) for v in values[:n]], "fp long")
        assert simhash.dealt(frame, masks, simhash.TREE_NODES).count() == len(masks) * n
    # Rows that meet only where a shard has two of them would grow with the square of n: no join picks them.
    plan = simhash.links(frame, simhash.NEAR_RADIUS, agree=2)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_no_link_of_the_trees_is_left_out(spark):
    rng = random.Random(12)
    centres, nodes = [rng.getrandbits(64) for _ in range(3)], []
    for c in centres:
        for _ in range(30):  # far more than the nearest of the first round
            bits = c
            for _ in range(rng.randint(0, 3)):
                bits ^= 1 << rng.randrange(64)
            nodes.append((simhash.signed(bits), len(nodes)))
    nodes += [(fp, 100 + node) for fp, node in nodes[::7]]  # several nodes of one fingerprint
    close = {(a, b) for x, a in nodes for y, b in nodes if a < b and ((x ^ y) & simhash.ALL).bit_count() <= simhash.NEAR_RADIUS}
    label = {node: rng.choice([node, 1000, 1001]) for _, node in nodes}
    apart = {(a, b) for a, b in close if label[a] != label[b]}
    labels = spark.createDataFrame([(a, b) for a, b in label.items() if a != b], "node long, label long")
    for size in (7, 4096):  # with guests and without
        first, rest = simhash.near_rounds(spark.createDataFrame(nodes, "fp long, node long"), tree_nodes=size)
        pairs = {tuple(sorted(r)) for r in first.collect()}
        more = [tuple(r) for r in rest(labels).collect()]
        assert pairs < close
        assert set(more) <= apart <= pairs | set(more) and len(set(more)) == len(more)
    alone = spark.createDataFrame([(simhash.signed(c), n) for n, c in enumerate(centres)], "fp long, node long")
    assert simhash.near_rounds(alone)[1](labels) is None


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    found = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert found == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}


def test_query_matches_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    prints = {i: plain(t) for i, t in texts.items()}
    root = roots(prints)
    found = QUERIES["op10_simhash"](spark, SMALL).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in found} == {(i, f"{p:016x}", root[i]) for i, p in prints.items()}
    assert len(found) == len(texts)


def test_odd_rows_and_stage(docs):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(None, "a b"), (6, "a b"), (6, "a b")]
    odd = docs(rows).withColumns({c: F.lit(7) for c in ("fp", "first", "kept", "label")})
    found = simhash.near_groups(odd).collect()
    assert len(found) == len(rows)
    groups = {}
    for r in found:
        groups.setdefault(r.component_id, []).append(r)
    assert all(sum(r.kept for r in g) == 1 for g in groups.values())
    assert {r.component_id for r in found if r.doc_id in (0, 1, 2)} == {0}
    left = simhash.near_dedup(odd)
    assert left.columns == odd.columns and left.count() == len(groups)
    assert simhash.near_groups(docs([])).collect() == []
