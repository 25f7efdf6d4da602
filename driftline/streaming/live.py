"""Live traces: each driver's observations and the match results that come back for them, with state that expires.

State lives in the state store: one small value and a map of recent ids for each driver. An event-time timer forgets drivers
that say nothing for a while; results that were asked for before a reset, or before the driver was forgotten, are refused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

INPUT = "user_id long, seq long, kind string, item long, at_s double, x double, asked long, outcome string"
OUTPUT = "user_id long, seq long, item long, at_s double, status string, asks boolean, generation long, moved_m double"
NOW = "last double, x double, buffered long, still long, moved double, matched double, generation long"

#: What a result may say, fixed values; the first two are matches.
OUTCOMES = ("MATCHED", "PARTIAL_MATCH", "NO_MATCH", "ENGINE_UNAVAILABLE")
#: Ids are remembered through the hour, of the driver's own time, after the one in which they came.
HOUR = 3600


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that start within keep their state in RocksDB, which maps, lists and timers need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LiveTrace(StatefulProcessor):
    """See follow()."""

    def __init__(self, ttl_s: float, gap_s: float, warm_up: int, still_m: float, every_s: float, every_m: float) -> None:
        self.ttl_s, self.gap_s, self.warm_up, self.still_m, self.every_s, self.every_m = ttl_s, gap_s, warm_up, still_m, every_s, every_m

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", NOW)
        self.seen = handle.getMapState("seen", "hour long, item long", "at double, x double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        out, now = [], self.now.get() if self.now.exists() else None
        for r in pd.concat(list(rows)).sort_values("seq", kind="stable").itertuples(index=False):
            at = r.at_s if r.at_s == r.at_s else None
            if now and at is not None and at - now[0] > self.ttl_s:
                out.append(self._forgotten(now))
                now = None
            if r.kind == "result":
                now, row = self._result(now, r)
            else:
                now, row = self._observation(now, r, at)
            out.append((int(r.seq), None if pd.isna(r.item) else int(r.item), at, *row))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if now:
            self.now.update(now)
            self.handle.registerTimer(int((now[0] + self.ttl_s) * 1000))
        else:
            self.now.clear()
        yield self._rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = self.now.get() if self.now.exists() else None
        row = [self._forgotten(now)] if now else []
        self.now.clear()
        yield self._rows(key, row)

    def close(self) -> None:
        pass

    def _rows(self, key: tuple, out: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame([(key[0], *row) for row in out], columns=["user_id", "seq", "item", "at_s", "status", "asks", "generation", "moved_m"])
        return frame.astype({"seq": "Int64", "item": "Int64", "generation": "Int64"})

    def _forgotten(self, now: tuple) -> tuple:
        self.seen.clear()
        return (None, None, now[0] + self.ttl_s, "EVICTED", False, now[6], now[4])

    def _result(self, now: tuple | None, r: object) -> tuple:
        if now is None or pd.isna(r.asked) or int(r.asked) != now[6]:
            return now, ("REFUSED", False, now and now[6], now and now[4])
        if r.outcome in OUTCOMES[:2]:
            now = (*now[:4], 0.0, float(r.at_s), now[6])
        return now, (r.outcome, False, now[6], now[4])

    def _observation(self, now: tuple | None, r: object, at: float | None) -> tuple:
        said = lambda status: (now, (status, False, now and now[6], now and now[4]))
        if at is None or not math.isfinite(at) or not math.isfinite(r.x):
            return said("INVALID_GPS")
        hour = at // HOUR
        if now:
            for h in {now[0] // HOUR, now[0] // HOUR - 1}:
                if self.seen.containsKey((int(h), int(r.item))):
                    return said("DUPLICATE" if tuple(self.seen.getValue((int(h), int(r.item)))) == (at, r.x) else "CONFLICT")
            if at < now[0]:
                return said("STALE_OBSERVATION")
            if hour > now[0] // HOUR:
                for old in [k for k in self.seen.keys() if k[0] < hour - 1]:
                    self.seen.removeKey(tuple(old))
        self.seen.updateValue((int(hour), int(r.item)), (at, float(r.x)))
        last, x, buffered, still, moved, matched, generation = now or (at, r.x, 0, 0, 0.0, None, int(r.seq))
        reset = at - last > self.gap_s
        if reset:  # what was moved is kept, the buffer and the match are not
            buffered, still, matched, generation = 0, 0, None, int(r.seq)
        elif buffered:
            step = abs(r.x - x)
            moved, still = moved + step, still + 1 if step < self.still_m else 0
        now = (at, float(r.x), buffered + 1, still, moved, matched, generation)
        if reset:
            return said("GAP_RESET")
        if now[2] < self.warm_up:
            return said("WARMING_UP")
        rests = still >= 3 and matched is not None
        asks = not rests and (moved >= self.every_m or matched is not None and at - matched >= self.every_s)
        return now, ("GPS_ACCEPTED", asks, generation, moved)


def follow(rows: DataFrame, ttl_s: float = 3600.0, late: str = "1 day", gap_s: float = 60.0, warm_up: int = 3, still_m: float = 5.0, every_s: float = 10.0, every_m: float = 50.0) -> DataFrame:
    """A status for each row of a stream (INPUT) of observations (kind gps) and match results (kind result), by driver and seq.

    gps: INVALID_GPS (no time or place; changes nothing), DUPLICATE and CONFLICT (an id that was there, with the same or another time or place),
    STALE_OBSERVATION (older than the last; equal is fine), GAP_RESET (more than gap_s after the last: buffer and match are
    cleared, what was moved stays), WARMING_UP (fewer than three since), else GPS_ACCEPTED; `asks` if a match is due: 10 s since
    the last match or 50 m moved, but not while a matched driver stands still.

    A generation is named by the seq of the observation that began it (the first, or one after a gap), and so never comes again.
    result: REFUSED if it was asked for in another generation or the driver is forgotten, else its outcome; MATCHED and
    PARTIAL_MATCH set the time of the last match (that of the result) and what was moved to zero.

    A driver without a row for more than ttl_s is forgotten: EVICTED, at the time that ended, once, whether the watermark (`late` behind) or
    the driver's own next row says so. Rows later than the watermark, and those before 1970, are lost. Start such a query within state_store().
    """
    rows = rows.select(*[c.split()[0] for c in INPUT.split(", ")]).where("user_id is not null and seq is not null").withColumn("at", F.timestamp_micros((F.col("at_s") * 1_000_000).cast("long"))).withWatermark("at", late)
    return rows.groupBy("user_id").transformWithStateInPandas(LiveTrace(ttl_s, gap_s, warm_up, still_m, every_s, every_m), OUTPUT, "Append", "EventTime")
