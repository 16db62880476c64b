import datetime as dt
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import Row

from trajspark.operators.chunks import action_chunk
from trajspark.session import scratch_path
from trajspark.streaming import streams
from trajspark.streaming.chunks import _Chunker, stream_chunks
from trajspark.streaming.state import keyed_state

SCHEMA = "episode_index long, frame_index long, action array<double>, ts timestamp"
DAY = dt.datetime(2024, 1, 1)


def frames_of(sizes):
    return [(e, i, [float(100 * e + i), -1.0], DAY + dt.timedelta(seconds=10 * i + e)) for e, n in sizes.items() for i in range(n)]


def drained(spark, path, table, k):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    with keyed_state(spark):
        return streams.drain_to_table(stream_chunks(stream, k, "1 HOUR", "10 minutes"), table)


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


END = [(None, None, None, DAY + dt.timedelta(days=2))]


@pytest.mark.parametrize("seed, k", [(1, 4), (2, 1)])
def test_any_cut_of_the_input_gives_the_chunks_of_the_table(spark, tmp_path, seed, k):
    """Frames arrive in any order, cut anywhere, over several runs that continue each other; some come twice."""
    rng = random.Random(seed)
    rows = frames_of({0: 9, 1: 1, 2: 3, 3: 17})
    whole = action_chunk(spark.createDataFrame(rows, SCHEMA), k).select("episode_index", "frame_index", "action_chunk")
    rng.shuffle(rows)
    cuts = sorted(rng.sample(range(1, len(rows)), 3))
    path, table = str(tmp_path / "in"), scratch_path(spark, "chunks")
    for run, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
        write(spark, path, rows[a:b] + rows[:b][:2])
        if run % 2:  # two files a run, one after the other
            early = drained(spark, path, table, k)
    assert early.exceptAll(whole).isEmpty()
    write(spark, path, END)
    got = drained(spark, path, table, k)
    assert got.exceptAll(whole).isEmpty() and whole.exceptAll(got).isEmpty()
    assert drained(spark, path, table, k).count() == len(rows)  # nothing new, nothing twice


def test_only_the_last_frames_wait(spark, tmp_path):
    path, table = str(tmp_path / "in"), scratch_path(spark, "chunks")
    write(spark, path, frames_of({0: 10}))
    got = drained(spark, path, table, 4)
    assert sorted(r["frame_index"] for r in got.collect()) == list(range(7))
    state = spark.read.format("statestore").option("stateVarName", "waiting").load(streams.progress_of(table, None))
    assert [sorted(r["value"]["indexes"]) for r in state.collect()] == [[7, 8, 9]]


def test_a_gap_fails_when_the_episode_ends(spark, tmp_path):
    path, table = str(tmp_path / "in"), scratch_path(spark, "chunks")
    write(spark, path, [r for r in frames_of({0: 6}) if r[1] != 3])
    assert {r["frame_index"] for r in drained(spark, path, table, 2).collect()} == {0, 1}
    write(spark, path, END)
    with pytest.raises(Exception, match="has a gap"):
        drained(spark, path, table, 2)


def test_null_actions_are_steps(spark, tmp_path):
    path, table = str(tmp_path / "in"), scratch_path(spark, "chunks")
    write(spark, path, [(0, 0, [1.0], DAY), (0, 1, None, DAY), (0, 2, [3.0], DAY)])
    write(spark, path, END)
    got = {r["frame_index"]: r["action_chunk"] for r in drained(spark, path, table, 3).collect()}
    assert got == {0: [[1.0], None, [3.0]], 1: [None, [3.0], [3.0]], 2: [[3.0], [3.0], [3.0]]}


def test_a_batch_does_not_move_the_timer_and_an_early_one_ends_nothing():
    calls, held = [], []
    handle = SimpleNamespace(
        getValueState=lambda *a: SimpleNamespace(get=lambda: held[-1] if held else None, update=held.append, clear=held.clear),
        registerTimer=lambda ms: calls.append(("set", ms)), deleteTimer=lambda ms: calls.append(("delete", ms)),
    )
    chunker = _Chunker(2, 100)
    chunker.init(handle)
    row = lambda i, ms: Row("episode_index", "frame_index", "action", "ts", "at_ms")(7, i, [float(i)], None, ms)
    assert list(chunker.handleInputRows((7,), iter([row(0, 0)]), None)) == []
    assert [tuple(c) for c in chunker.handleInputRows((7,), iter([row(1, 50)]), None)] == [(7, 0, [[0.0], [1.0]])]
    assert calls == [("set", 100)]
    passed = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    assert list(chunker.handleExpiredTimer((7,), passed(120), None)) == [] and calls[1:] == [("set", 150)]
    assert [tuple(c) for c in chunker.handleExpiredTimer((7,), passed(150), None)] == [(7, 1, [[1.0], [1.0]])] and not held


def test_an_episode_goes_on_past_its_first_timer(spark, tmp_path):
    path, table = str(tmp_path / "in"), scratch_path(spark, "chunks")
    at = lambda minutes: DAY + dt.timedelta(minutes=minutes)
    for row in ((0, 0, [0.0], at(0)), (0, 1, [1.0], at(50)), (None, None, None, at(85))):
        write(spark, path, [row])
        got = drained(spark, path, table, 2)
    assert [tuple(r) for r in got.collect()] == [(0, 0, [[0.0], [1.0]])]  # the watermark has passed the timer of the first frame
    write(spark, path, [(0, 2, [2.0], at(90))])
    drained(spark, path, table, 2)
    write(spark, path, END)
    got = {r["frame_index"]: r["action_chunk"] for r in drained(spark, path, table, 2).collect()}
    assert got == {0: [[0.0], [1.0]], 1: [[1.0], [2.0]], 2: [[2.0], [2.0]]}
