import random

import pytest
from pyspark.sql import functions as F

from trajspark.operators import layout as lay

TOKENS = "sample long, pos long, token string, mask int"


def token_rows(spark, samples):
    rows = [(s, p, t, m) for s, tokens in samples.items() for p, (t, m) in enumerate(tokens)]
    random.Random(3).shuffle(rows)
    return spark.createDataFrame(rows, TOKENS).repartition(3)


def positions(spark, masks, **kw):
    got = lay.text_positions(token_rows(spark, {s: [("w", m) for m in mask] for s, mask in masks.items()}), **kw)
    out = {}
    for r in got.orderBy("sample", "pos").collect():
        out.setdefault(r["sample"], []).append(r["position"])
    return out, got


@pytest.mark.parametrize("block_rows", [1, 2, 3, 1 << 20])
def test_text_positions(spark, block_rows):
    rng = random.Random(block_rows)
    masks = {0: [0, 0, 1, 1, 1], 1: [1], 2: [0, 1], 3: [rng.randint(0, 1) for _ in range(40)]}
    out, got = positions(spark, masks, block_rows=block_rows)
    assert out[0] == [1, 1, 0, 1, 2]
    for sample, mask in masks.items():
        assert out[sample] == [sum(mask[: i + 1]) - 1 if m else 1 for i, m in enumerate(mask)]
    deltas = {r["sample"]: r["delta"] for r in lay.position_deltas(got).collect()}
    strict = {r["sample"]: r["delta"] for r in lay.position_deltas(got, strict_max=True).collect()}
    assert (deltas[0], deltas[1]) == (-2, 0)
    assert (deltas[2], strict[2]) == (0, -1)  # the filled 1 counts, unless strict


def test_positions_without_mask(spark):
    out, got = positions(spark, {0: [0, 1, 1]}, with_mask=False)
    assert out[0] == [0, 1, 2]
    assert lay.position_deltas(got, with_mask=False).first()["delta"] == 0


def test_drop_padding(spark):
    tokens = token_rows(spark, {0: [("a", 0), ("b", 1)]})
    assert [r["token"] for r in lay.drop_padding(tokens).collect()] == ["b"]


def sequences(spark):
    return spark.createDataFrame([(0, [1, 2, 3]), (0, [4]), (1, [5, 6]), (1, [])], "batch long, input_ids array<long>")


def test_padding(spark):
    key = lambda r: (r["batch"], r["input_ids"])
    left = sorted(lay.pad_left(sequences(spark), F.lit(9).cast("long"), "batch").collect(), key=key)
    assert [(r["input_ids"], r["attention_mask"]) for r in left] == [
        ([1, 2, 3], [1, 1, 1]), ([9, 9, 4], [0, 0, 1]), ([5, 6], [1, 1]), ([9, 9], [0, 0])]
    right = sorted(lay.pad_sequences(sequences(spark), F.lit(9).cast("long"), None, side="right").collect(), key=key)
    assert [(r["input_ids"], r["attention_mask"]) for r in right] == [
        ([1, 2, 3], [1, 1, 1]), ([4, 9, 9], [1, 0, 0]), ([5, 6, 9], [1, 1, 0]), ([9, 9, 9], [0, 0, 0])]
    with pytest.raises(ValueError):
        lay.pad_sequences(sequences(spark), 0, side="top")


def test_suffix(spark):
    df = spark.createDataFrame([([7, 8], [0, 1], [1, 0])], "input_ids array<long>, attention_mask array<int>, position_ids array<long>")
    r = lay.append_suffix(df, 3).first()
    assert r["input_ids"] == [7, 8, 0, 0, 0] and r["attention_mask"] == [0, 1, 1, 1, 1] and r["position_ids"] == [1, 0, 500, 500, 500]
    assert len(lay.append_suffix(df).first()["input_ids"]) == 66


SEGMENTS = "sample long, segment long, kind string, length int, t int, h int, w int"


def text(n):
    return ("text", n, None, None, None)


def pad(n):
    return ("pad", n, None, None, None)


def grid(kind, t, h, w):
    return (kind, None, t, h, w)


def segment_table(spark, layouts):
    rows = [(s, i, *seg) for s, layout in layouts.items() for i, seg in enumerate(layout)]
    random.Random(5).shuffle(rows)
    return spark.createDataFrame(rows, SEGMENTS)


def walk(layout, merge=2):
    """The rule, one segment after the other."""
    out, following = [], 0
    for kind, length, t, h, w in layout:
        if kind == "pad":
            out += [(0, 1, 1, 1)] * length
        elif kind == "text":
            out += [(1, following + i, following + i, following + i) for i in range(length)]
            following += length
        else:
            frames = [(1, f) for f in range(t)] if kind == "video" else [(t, 0)]
            for depth, _ in frames:
                cells = [(a, b, c) for a in range(depth) for b in range(h // merge) for c in range(w // merge)]
                out += [(1, following + a, following + b, following + c) for a, b, c in cells]
                following += max(max(c) for c in cells) + 1
    return out, following - len(out)


@pytest.mark.parametrize("block_rows", [1, 3, 1 << 20])
def test_grid_positions_against_the_rule(spark, block_rows):
    rng = random.Random(block_rows)
    layouts = {0: [text(2), grid("image", 1, 4, 4), text(1)], 1: [pad(3), text(4)], 2: [grid("image", 3, 2, 4), text(2)],
               3: [text(1), grid("video", 3, 4, 2), text(1), grid("video", 2, 2, 2)]}
    for sample in range(4, 20):
        kinds = [lambda: text(rng.randint(0, 5)), lambda: grid("image", rng.randint(1, 2), 2 * rng.randint(1, 4), 2 * rng.randint(1, 4)),
                 lambda: grid("video", rng.randint(1, 4), 2 * rng.randint(1, 3), 2 * rng.randint(1, 3))]
        layouts[sample] = [pad(rng.randint(0, 4)), *[rng.choice(kinds)() for _ in range(rng.randint(1, 9))], text(1)]
    table = segment_table(spark, layouts)
    got = {}
    for r in lay.grid_positions(table, block_rows=block_rows).orderBy("sample", "slot").collect():
        got.setdefault(r["sample"], []).append((r["mask"], r["pos_t"], r["pos_h"], r["pos_w"]))
    assert got[0] == [(1, *p) for p in [(0, 0, 0), (1, 1, 1), (2, 2, 2), (2, 2, 3), (2, 3, 2), (2, 3, 3), (4, 4, 4)]]
    deltas = {r["sample"]: r["delta"] for r in lay.grid_deltas(table).collect()}
    for sample, layout in layouts.items():
        assert (got[sample], deltas[sample]) == walk(layout)


def test_grid_deltas_of_text_only_tables_follow_the_text_rule(spark):
    table = segment_table(spark, {0: [pad(2), text(1)], 1: [text(1)], 2: [pad(1), text(4)]})
    assert {r["sample"]: r["delta"] for r in lay.grid_deltas(table).collect()} == {0: -1, 1: 0, 2: -1}


def test_image_tokens(spark):
    df = spark.createDataFrame([(0, 1, 4, 6), (0, 1, 3, 3), (1, 2, 4, 4)], "sample long, t int, h int, w int")
    assert {r["sample"]: tuple(r)[1:] for r in lay.image_token_count(df).collect()} == {0: (2, 6 + 2), 1: (1, 8)}


@pytest.mark.parametrize("wrap", [True, False])
def test_media_counts(spark, wrap):
    i, v, s, w = lay.IMAGE, lay.VIDEO, lay.VISION_START, "w"
    samples = {0: [s, i, i, s, v, w], 1: [i, w, s], 2: [w], 3: [v, s, i, s], 4: [i], 5: [s], 6: [s, s, i, i, s]}
    got = lay.media_counts(token_rows(spark, {k: [(t, 1) for t in ts] for k, ts in samples.items()}), wrap=wrap)
    want = {}
    for k, ts in samples.items():
        pairs = [(ts[p - 1] if p or wrap else None, t) for p, t in enumerate(ts)]
        want[k] = (pairs.count((s, i)), pairs.count((s, v)))
    assert {r["sample"]: (r["n_images"], r["n_videos"]) for r in got.collect()} == want


@pytest.mark.parametrize("block_rows", [2, 1 << 20])
def test_ordinal_join(spark, block_rows):
    slots = spark.createDataFrame([(0, p) for p in (9, 3, 5, 30)] + [(1, 0)], "sample long, pos long")
    features = spark.createDataFrame([(0, f, f * 10) for f in (7, 2, 40, 8)] + [(1, 5, 50)], "sample long, feature long, x long")
    got = lay.ordinal_join(slots, features, block_rows=block_rows)
    assert {(r["sample"], r["pos"]): r["x"] for r in got.collect()} == {(0, 3): 20, (0, 5): 70, (0, 9): 80, (0, 30): 400, (1, 0): 50}
    for a, b in ((slots.where("pos > 0"), features), (slots, features.where("sample = 0"))):
        with pytest.raises(Exception, match="do not match in sample 1"):
            lay.ordinal_join(a, b).collect()
        assert lay.ordinal_join(a, b, strict=False).count() == 4


@pytest.mark.parametrize("block_rows", [1, 1_000])
def test_sequence_offsets(spark, block_rows):
    df = spark.createDataFrame([(0, 0, 1, 2, 2), (0, 1, 2, 2, 2), (1, 0, 3, 1, 5)], "sample long, image_no long, t int, h int, w int")
    got = lay.sequence_offsets(df, block_rows=block_rows, partitions=3).orderBy("entry").collect()
    assert [tuple(r) for r in got] == list(enumerate([0, 4, 8, 12, 17, 22, 27]))


@pytest.mark.parametrize("block_rows", [1, 4, 7, 1 << 20])
def test_assign_segment(spark, block_rows):
    lengths = {0: [3, 0, 20, 1, 1, 0], 1: [2], 2: [0, 5]}
    table = spark.createDataFrame([(s, i, n) for s, ns in lengths.items() for i, n in enumerate(ns)], "sample long, segment long, length long")
    points = spark.createDataFrame([(s, p, f"x{p}") for s, ns in lengths.items() for p in range(sum(ns) + 2)], "sample long, pos long, extra string")
    got = lay.assign_segment(points, lay.segment_spans(table, block_rows), block_rows)
    assert got.columns == ["sample", "pos", "extra", "segment"]
    want = {}
    for s, ns in lengths.items():
        flat = [i for i, n in enumerate(ns) for _ in range(n)] + [None, None]
        want.update({(s, p): i for p, i in enumerate(flat)})
    assert {(r["sample"], r["pos"]): r["segment"] for r in got.collect()} == want


def test_repetition(spark):
    df = spark.createDataFrame([(0, 0, "a"), (0, 1, "b"), (1, 0, "c")], "sample long, row long, x string")

    def order(mode):
        return [r["x"] for r in lay.repeat_samples(df, 2, mode).orderBy("sample", "position").collect()]

    assert order("row") == ["a", "a", "b", "b", "c", "c"]
    assert order("block") == ["a", "b", "a", "b", "c", "c"]
    with pytest.raises(ValueError):
        lay.repeat_samples(df, 2, "column")


def test_rows_without_a_batch_are_a_batch(spark):
    df = spark.createDataFrame([(1, [1, 2], 0), (2, [3], None), (3, [4, 5, 6], None)], "sample long, input_ids array<long>, batch int")
    got = {r["sample"]: r["input_ids"] for r in lay.pad_left(df, F.lit(0).cast("long"), "batch").collect()}
    assert got == {1: [1, 2], 2: [0, 0, 3], 3: [4, 5, 6]}


@pytest.mark.parametrize("block_rows", [2, 3, 100])
def test_overlapping_spans_fail(spark, block_rows):
    points = spark.range(10).select(F.lit(1).cast("long").alias("sample"), F.col("id").alias("pos"))
    for spans in ([(0, 8), (2, 4)], [(0, 5), (4, 9)], [(1, 4), (1, 6)]):
        table = spark.createDataFrame([(1, i, *s) for i, s in enumerate(spans)], "sample long, segment long, start long, end long")
        with pytest.raises(Exception, match="overlap"):
            lay.assign_segment(points, table, block_rows).collect()
