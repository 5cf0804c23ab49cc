"""Hysteresis and merging of episodes over a stream, with state by trial."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_SAMPLE = "ts long, t double, gate double, thr_on double, thr_off double"
#: state of the recurrence, onset of the open stretch, the episode that may still grow (t_on, t_off), last sample's time and event time.
_MACHINE = "up boolean, since double, t_on double, t_off double, last double, last_ts long"


class Episodes:
    """The recurrence itself: push samples in order of time, take finished episodes.

    A sample sets (gate >= thr_on), resets (gate <= thr_off), toggles (both hold) or holds the state.  A closed
    stretch joins the episode before it if it began at most `gap` after its end; an episode is finished once the
    time that has passed since its end says that nothing can join it.
    """

    def __init__(self, gap: float, state: tuple | None = None) -> None:
        self.gap = gap
        self.up, self.since, self.t_on, self.t_off, self.last, self.last_ts = state or (False, None, None, None, None, None)

    def state(self) -> tuple:
        return self.up, self.since, self.t_on, self.t_off, self.last, self.last_ts

    def _close(self, t: float) -> Iterator[tuple[float, float]]:
        if self.t_off is not None and self.since - self.t_off <= self.gap:
            self.t_off = max(self.t_off, t)
        else:
            yield from self._take()
            self.t_on, self.t_off = self.since, t
        self.since = None

    def _take(self) -> Iterator[tuple[float, float]]:
        if self.t_on is not None:
            yield self.t_on, self.t_off
        self.t_on = self.t_off = None

    def push(self, ts: int, t: float, gate: float, on: float, off: float) -> Iterator[tuple[float, float]]:
        set_, reset = gate >= on, gate <= off
        up = not self.up if set_ and reset else set_ or (self.up and not reset)
        if up and not self.up:
            self.since = t
        elif self.up and not up:
            yield from self._close(t)
        self.up, self.last, self.last_ts = up, t, ts
        if not up and self.t_off is not None and t - self.t_off > self.gap:
            yield from self._take()

    def end(self) -> Iterator[tuple[float, float]]:
        """No further sample comes: an open stretch closes at the last one."""
        if self.up:
            yield from self._close(self.last)
        yield from self._take()
        self.up = False


class _Tracker(StatefulProcessor):
    """Samples wait in a list until the watermark has passed them, then run through the recurrence in order of time.

    One timer a batch makes the waiting samples run, another ends a trial that has been silent for `idle` seconds.
    Samples that arrive behind the watermark are dropped, as every stateful operator of Spark drops them.
    """

    def __init__(self, keys: list[str], gap: float, idle: float) -> None:
        self.keys, self.gap, self.idle = keys, gap, int(idle * 1000)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _SAMPLE)
        self.machine = handle.getValueState("machine", _MACHINE)
        self.ends = handle.getValueState("ends", "at long")

    def _run(self, key, watermark: int, ended: bool) -> Iterator:
        import pandas as pd

        held = sorted(tuple(r) for r in self.waiting.get())
        ready = [r for r in held if r[0] // 1000 < watermark]
        left = held[len(ready) :]
        if ready:
            self.waiting.put(left) if left else self.waiting.clear()
        e = Episodes(self.gap, tuple(self.machine.get()) if self.machine.exists() else None)
        found = [x for r in sorted(ready, key=lambda r: r[1]) for x in e.push(*r)]
        silent = ended and not left and e.last_ts is not None and e.last_ts // 1000 + self.idle < watermark
        if silent:
            found += e.end()
            self.machine.clear()
            self.ends.clear()
        elif ready:
            self.machine.update(e.state())
        if ready and not silent:
            self._end_at(e.last_ts // 1000 + self.idle + 1)
        if found:
            yield pd.DataFrame([(*key, *x) for x in found], columns=[*self.keys, "t_on", "t_off"])

    def _end_at(self, at: int) -> None:
        if self.ends.exists():
            before = self.ends.get()[0]
            if before == at:
                return
            self.handle.deleteTimer(before)
        self.handle.registerTimer(at)
        self.ends.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        watermark = timerValues.getCurrentWatermarkInMs()
        last = None
        for p in rows:
            ts = p["us"].to_numpy()
            p = p[(ts // 1000 >= watermark) & p["gate"].notna().to_numpy() & p["t"].notna().to_numpy()]
            if len(p):
                self.waiting.appendList([(int(a), float(b), float(c), float(d), float(e)) for a, b, c, d, e in p[["us", "t", "gate", "thr_on", "thr_off"]].itertuples(index=False)])
                last = max(last or 0, int(p["us"].max()) // 1000)
        if last is not None:
            self.handle.registerTimer(last + 1)
        yield from self._run(key, watermark, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        yield from self._run(key, timerValues.getCurrentWatermarkInMs(), True)

    def close(self) -> None: ...


def use_state_store(spark: SparkSession) -> None:
    """Operators with timers and lists need the RocksDB store; state larger than an executor's memory lies on its disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def track_episodes(stream: DataFrame, gap: float, keys=("subject", "trial"), ts: str = "ts", late: str = "10 seconds", idle: float = 60.0) -> DataFrame:
    """keys, t_on, t_off: hysteresis() and then merge_close() of a stream of keys, ts, t, gate, thr_on, thr_off.

    Rows may come in any order within `late` of the newest event time; an episode leaves as soon as nothing can join
    it, and a trial ends when none of its samples comes for `idle` seconds of event time (equal to the batch where its
    samples are closer than that).  Samples without t or gate are left out.  State is the samples within `late` and one
    row a live trial.
    """
    use_state_store(stream.sparkSession)
    keys = list(keys)
    s = stream.select(*keys, ts, F.unix_micros(ts).alias("us"), *[F.col(c).cast("double").alias(c) for c in ("t", "gate", "thr_on", "thr_off")]).withWatermark(ts, late)
    schema = T.StructType([*[stream.schema[k] for k in keys], T.StructField("t_on", T.DoubleType()), T.StructField("t_off", T.DoubleType())])
    return s.groupBy(*keys).transformWithStateInPandas(_Tracker(keys, gap, idle), schema, "append", "eventtime")
