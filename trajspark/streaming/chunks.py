"""Future-action chunks on a stream of frames."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHUNKS = "episode_index long, frame_index long, action_chunk array<array<double>>"
# Frames of an episode that wait for others, the first index whose chunk is not out yet, and when the episode is over.
WAITING = "following long, due long, indexes array<long>, actions array<array<double>>"
Chunk = Row("episode_index", "frame_index", "action_chunk")


class _Chunker(StatefulProcessor):
    """State of one episode: frames that have arrived and whose chunk isn't whole, and the timer that ends the episode.

    Every call to the state costs far more than a row, so the timer is not moved with each batch, but set anew if it expires early.
    """

    def __init__(self, k: int, idle_ms: int) -> None:
        self.k, self.idle_ms = k, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", WAITING)

    def _known(self) -> tuple[int, int, dict]:
        held = self.waiting.get()
        if held is None:
            return 0, -1, {}
        following, due, indexes, actions = held
        return following, due, dict(zip(indexes, actions))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        if key[0] is None:
            return
        following, due, frames = self._known()
        latest = due
        for _, index, action, _, ms in rows:
            if index >= following:  # a frame that comes again is the same frame
                frames.setdefault(index, action)
            latest = max(latest, ms + self.idle_ms)
        ready, there = [], following  # frames from following on up to there have come
        while there in frames:
            there += 1
        while following + self.k <= there:
            ready.append(Chunk(key[0], following, [frames[following + step] for step in range(self.k)]))
            del frames[following]
            following += 1
        if due < 0:  # a timer that is set already finds the later end when it expires
            self.handle.registerTimer(latest)
        self.waiting.update((following, latest, list(frames), list(frames.values())))
        yield from ready

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        following, due, frames = self._known()
        if due > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)
            return
        self.waiting.clear()
        if sorted(frames) != list(range(following, following + len(frames))):
            raise ValueError(f"frame_index of episode {key[0]} has a gap, or doesn't start at 0")
        last = frames.get(following + len(frames) - 1)
        padded = [frames.get(following + i, last) for i in range(len(frames) + self.k - 1)]
        for i in range(len(frames)):
            yield Chunk(key[0], following + i, padded[i : i + self.k])

    def close(self) -> None:
        pass


def stream_chunks(stream: DataFrame, k: int, idle: str, watermark: str, ts: str = "ts") -> DataFrame:
    """(episode_index, frame_index, action_chunk) of a stream of frames, the same chunks as ``action_chunk`` gives a table.

    ``stream`` has episode_index, frame_index (0, 1, 2, ... in an episode, in any order of arrival), action, and an event time.
    A chunk is given out when its ``k`` frames are there. Only frames that still wait are kept: the last k - 1 of an episode, and
    those that came before an earlier one. When the watermark passes the episode's latest event time by
    ``idle``, the episode is over: its last action is repeated for the chunks that are left, and its state is removed.
    A gap then fails the query. Frames later than the watermark are dropped by Spark, which shows as a gap.

    Rows without an episode give nothing, but their time moves the watermark: a source can end all episodes with one.
    Start the result with :func:`~trajspark.streaming.state.keyed_state` on, in append mode.
    """
    if k < 1:
        raise ValueError("a chunk needs at least one step")
    length = F.expr(f"CAST(to_unix_timestamp(TIMESTAMP '1970-01-01 00:00:00Z' + INTERVAL {idle}) AS LONG)")
    idle_ms = int(stream.sparkSession.range(1).select(length * 1000).first()[0])
    frames = (
        stream.withWatermark(ts, watermark)
        .select("episode_index", "frame_index", "action", ts, F.coalesce(F.unix_millis(ts), F.lit(0)).alias("at_ms"))
    )
    return frames.groupBy("episode_index").transformWithState(
        statefulProcessor=_Chunker(k, idle_ms), outputStructType=CHUNKS, outputMode="append", timeMode="eventTime"
    )
