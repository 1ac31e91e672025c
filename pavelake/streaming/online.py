"""Streams: the detector as a stateful operator with timers, sessions and windowed counts with watermarks."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import vocab as v
from ..operators.detector import Detector
from ..operators.folds import at_quantile

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "t0 long, peak double, closed_at long, last long, timer long"
RECENT = "t_ms long, size double"
OUT = "pack_id long, t0_ms long, duration_ms long, peak double"
QUIET_MS = 600_000


def dead_time(speed: float | None, version: float) -> float:
    """Milliseconds after an event in which none opens."""
    least, most, still = v.REFRACTORY_MS
    if version < 0.7:
        return most
    return min(max(v.BLIND_ZONE_M / speed * 1000, least), most) if speed is not None and speed > 0.5 else still


class OnlineDetector(StatefulProcessor):
    """Events of one recording as its samples come in.

    State: the open event and the end of the last (a value), the samples of the noise window (a list). A timer `quiet_ms` of event time after
    the last sample takes the recording as ended: an event that is open then is given out and the state goes.
    """

    def __init__(self, version: float, mode: str, quiet_ms: int):
        self.version, self.quiet_ms = version, quiet_ms
        self.gated = version < 0.7 and "test" not in mode
        self.window_ms = v.RMS_MS if version >= 0.8 else v.QUANTILE_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.event = handle.getValueState("event", EVENT)
        self.recent = handle.getListState("recent", RECENT)

    def limit(self, ring: deque) -> float:
        if self.version >= 0.8:
            noise = math.sqrt(sum(a * a for _, a in ring) / len(ring))
        else:
            noise = at_quantile(sorted(a for _, a in ring), v.NOISE_QUANTILE)
        return max(v.MIN_THRESHOLD, v.NOISE_FACTOR * max(round(noise, 12), v.NOISE_FLOOR))  # without the last digits, as functions.scalar.threshold

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        t0, peak, closed_at, last, timer = self.event.get() if self.event.exists() else (None, 0.0, 0, None, None)
        d, ring, out = Detector(self.gated, t0, peak, closed_at), deque(tuple(x) for x in self.recent.get()), []
        batch = pd.concat(list(rows))
        batch["size"] = batch["hp"].abs()
        batch = batch.sort_values(["t_ms", "event_id", "size", "speed"])
        fresh = batch[batch["t_ms"] >= last] if last is not None else batch  # late beyond its batch
        fresh = fresh[fresh["size"].notna()]
        # samples of one time are all in the noise before the first of them is judged
        for t, peers in groupby(zip(fresh["t_ms"].tolist(), fresh["size"].tolist(), fresh["speed"].tolist()), itemgetter(0)):
            peers = [(size, None if speed is None or math.isnan(speed) else speed) for _, size, speed in peers]
            while ring and ring[0][0] < t - self.window_ms:
                ring.popleft()
            ring.extend((t, size) for size, _ in peers)
            thr = self.limit(ring)
            for size, speed in peers:
                out += [(key[0], x[1], x[2], x[3]) for x in d.push(t, size, thr, dead_time(speed, self.version), speed) if x[0] == "event"]
            last = t
        ends = int(batch["ts"].max().timestamp() * 1000) + self.quiet_ms
        if timer is None or ends > timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(ends)
            timer = ends
        self.event.update((d.t0, d.peak, d.closed_at, last, timer))
        self.recent.put(list(ring))
        yield pd.DataFrame(out, columns=["pack_id", "t0_ms", "duration_ms", "peak"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        t0, peak, _, last, _ = self.event.get()
        self.event.clear()
        self.recent.clear()
        yield pd.DataFrame([(key[0], t0, last - t0, peak)] if t0 is not None else [], columns=["pack_id", "t0_ms", "duration_ms", "peak"])

    def close(self) -> None:
        pass


def detect(stream: DataFrame, version: float = 0.8, mode: str = "ride", late: str = "10 minutes", quiet_ms: int = QUIET_MS) -> DataFrame:
    """Events of each pack, closed ones and those open when a recording falls silent.

    stream: pack_id, event_id, t_ms, hp, speed, ts (timestamp). Rows are put in time order inside a batch;
    those without a pack or a time are left out. The session needs spark.sql.streaming.stateStore.providerClass to be ROCKSDB.
    """
    keyed = stream.withWatermark("ts", late).filter("pack_id is not null and t_ms is not null").groupBy("pack_id")
    return keyed.transformWithStateInPandas(OnlineDetector(version, mode, quiet_ms), OUT, "append", "EventTime")


def windowed(stream: DataFrame, length: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return stream.withWatermark("ts", late).groupBy(w, "pack_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("hp")).alias("peak"))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "pack_id").agg(F.count(F.lit(1)).alias("n"))


def distinct_samples(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["pack_id", "event_id"])
