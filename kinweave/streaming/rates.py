"""A sliding-log rate limit: a hit is accepted while fewer than ``limit`` accepted ones lie in the window before it."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

LIMIT, WINDOW_SECONDS = 5, 3600


def _decide(times: list[float], log: deque, limit: int, window: float) -> list[bool]:
    """Rejected hits leave no trace; a hit exactly one window old no longer counts."""
    out = []
    for t in times:
        while log and t - log[0] >= window:
            log.popleft()
        out.append(len(log) < limit)
        if out[-1]:
            log.append(t)
    return out


def limited(hits: DataFrame, key: str, time: str, tie: str, limit: int = LIMIT, window: float = WINDOW_SECONDS) -> DataFrame:
    """hits with ``accepted``. Keys are dealt over tasks and sorted there; a task streams its rows and holds one key's last
    accepted times, so a key of any size takes constant memory. Null keys form one key; null times are rejected."""
    timed = hits.withColumn("_at", F.unix_micros(F.col(time).cast("timestamp")) / 1e6)
    dealt = timed.repartition(F.col(key)).sortWithinPartitions(F.col(key), "_at", tie)
    schema = hits.select("*", F.lit(True).alias("accepted")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, log = object(), deque()
        for frame in frames:
            accepted = []
            for k, t in zip(frame[key], frame["_at"], strict=True):
                k = None if pd.isna(k) else k
                if k != held:
                    held, log = k, deque()
                accepted += [False] if pd.isna(t) else _decide([t], log, limit, window)
            yield frame.drop(columns="_at").assign(accepted=accepted)

    return dealt.mapInPandas(run, schema)


#: State that is read and appended by entry, which timers and lists of hits need.
_STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Limiter(StatefulProcessor):
    """Holds a key's hits until the watermark has passed them, then decides them in order of time and tie.

    waiting: (micros, tie) of hits that may still be overtaken; log: micros of the accepted hits that still count, at most ``limit``.
    One timer stands at the earliest waiting hit, or, with none waiting, where the log has run out.
    """

    def __init__(self, key: str, time: str, tie: str | None, kind: str, limit: int, window: float):
        self.key, self.time, self.tie, self.kind, self.limit, self.window = key, time, tie, kind, limit, int(window * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at long, tie {self.kind}")
        self.log = handle.getListState("log", "at long")
        self.next = handle.getValueState("next", "at long")

    def _wait_until(self, micros: int) -> None:
        at = -(-micros // 1000)
        old = self.next.get()[0] if self.next.exists() else None
        if old is not None and old <= at:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)
        self.next.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            known = frame[frame[self.time].notna()]
            at = known[self.time].astype("datetime64[us]").astype("int64").tolist()
            ties = known[self.tie].tolist() if self.tie else [0] * len(at)
            if at:
                self.waiting.appendList(list(zip(at, ties, strict=True)))
                first = min(at) if first is None else min(first, *at)
            if len(known) < len(frame):  # a hit without a time is rejected
                lost = frame[frame[self.time].isna()]
                yield self._told(key, [(None, t, False) for t in (lost[self.tie] if self.tie else [0] * len(lost))])
        if first is not None:
            self._wait_until(first)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.next.clear()
        passed = 1000 * timerValues.getCurrentWatermarkInMs()
        hits = list(self.waiting.get()) if self.waiting.exists() else []
        due, later = sorted((h[0], h[1]) for h in hits if h[0] <= passed), [(h[0], h[1]) for h in hits if h[0] > passed]
        log = deque(x[0] for x in self.log.get()) if self.log.exists() else deque()
        decided = _decide([at for at, _ in due], log, self.limit, self.window)
        while log and passed - log[0] >= self.window:
            log.popleft()
        for state, left in ((self.waiting, later), (self.log, [(at,) for at in log])):
            state.put(left) if left else state.clear()
        if later:
            self._wait_until(min(later)[0])
        elif log:
            self._wait_until(log[-1] + self.window)
        if due:
            yield self._told(key, [(at, tie, yes) for (at, tie), yes in zip(due, decided, strict=True)])

    def _told(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame({self.key: [key[0]] * len(rows), self.time: pd.to_datetime([at for at, _, _ in rows], unit="us")})
        if self.tie:
            out[self.tie] = [tie for _, tie, _ in rows]
        return out.assign(accepted=[yes for _, _, yes in rows])

    def close(self) -> None:
        pass


def limited_stream(hits: DataFrame, key: str, time: str, tie: str | None = None, limit: int = LIMIT, window: float = WINDOW_SECONDS, delay: str = "0 seconds") -> DataFrame:
    """The same over a stream: key, time, tie if there is one, accepted.

    Hits may come up to ``delay`` late and in any order, over any number of batches: a hit is decided when the watermark has passed it,
    so its answer is that of the batch form, and state per key is what came within the delay and at most ``limit`` accepted times.
    Hits later than that are dropped by the watermark, as are those of the last moments before a stream ends. A key without hits for
    a window leaves no state. Sets the session's state store to the one with lists and timers, which must be so when the query starts.
    """
    spark, kinds = hits.sparkSession, dict(hits.dtypes)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE)
    columns = [key, time, *([tie] if tie else [])]
    processor = _Limiter(key, time, tie, kinds[tie] if tie else "int", limit, window)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", accepted boolean"
    timed = hits.select(columns).withWatermark(time, delay).groupBy(key)
    return timed.transformWithStateInPandas(processor, schema, "append", "eventTime")
