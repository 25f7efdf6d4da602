"""Streams: event-time windows, latest state, sessions, and a per-driver trace with its own lateness rule."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """New Parquet files of a folder, as a finite or endless stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(path)


def windowed(events: DataFrame, ts: str = "ts", size: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Counts and sums by tumbling window and type; rows later than the watermark are dropped."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(F.window(ts, size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", gap: str = "60 seconds", late: str = "1 hour") -> DataFrame:
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return rows.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), "n")


def latest_state(events: DataFrame, key: str = "user_id", ts: str = "ts", value: str = "value") -> DataFrame:
    """The value with the greatest time of each key; an older row that comes later changes nothing (update mode)."""
    return events.groupBy(key).agg(F.max(ts).alias(ts), F.max_by(value, F.struct(ts, value)).alias(value))


TRACE = "user_id long, event_id long, ts_s double, status string, gap_reset boolean, since_match_m double, generation long"
STATE = "last double, buffered long, stationary long, moved double, matched double, x double, recent array<long>, hashes array<long>, times array<double>, generation long"


def trace(events: DataFrame, gap_s: float = 60.0, warm_up: int = 3, still_m: float = 5.0, every_s: float = 10.0, every_m: float = 50.0, remember_s: float = 3600.0, forget_s: int | None = None, arrival: str | None = None) -> DataFrame:
    """A status for each observation (user_id, event_id, ts_s, x in metres) of a driver, in order of arrival: that of the column
    named, or, without one, that of the rows. Ids are remembered for remember_s seconds of the driver's own time; what is older
    than the last observation is STALE in any case.

    DUPLICATE (an id seen before), CONFLICT (an id seen before with another time or place; it changes nothing), STALE (older
    than the last; equal times are fine), WARM_UP (fewer than three since the last gap), STATIONARY (three short steps, once
    matched), MATCHED (10 s or 50 m since the last match), else WAITING. A gap of more than 60 s clears the buffer and the
    match but keeps the distance moved; it also raises the generation, so that results asked for before it can be told from
    newer ones. State is one small row for each driver, forgotten after forget_s seconds without observations if that is
    given. Such a query has a batch whenever time passes: a finite replay (availableNow) would not end with it.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, buffered, still, moved, matched, x0, recent, hashes, times, generation = state.get if state.exists else (None, 0, 0, 0.0, None, None, [], [], [], 0)
        seen, out = dict(zip(recent, zip(hashes, times, strict=True), strict=True)), []  # in order of arrival, and so of time
        if arrival:
            batches = iter([pd.concat(list(batches)).sort_values(arrival, kind="stable")])
        for rows in batches:
            for r in rows.itertuples(index=False):
                payload = hash((r.ts_s, r.x if r.x == r.x else None))  # numbers: the same in every process
                if r.event_id in seen:
                    out.append((key[0], r.event_id, r.ts_s, "DUPLICATE" if seen[r.event_id][0] == payload else "CONFLICT", False, moved, generation))
                    continue
                if last is not None and r.ts_s < last:
                    out.append((key[0], r.event_id, r.ts_s, "STALE", False, moved, generation))
                    continue
                seen[r.event_id] = (payload, r.ts_s)
                while seen[first := next(iter(seen))][1] < r.ts_s - remember_s:
                    del seen[first]
                gap = last is not None and r.ts_s - last > gap_s
                if gap:
                    buffered, still, matched, generation = 0, 0, None, generation + 1
                elif x0 is not None:
                    step = abs(r.x - x0)
                    moved, still = moved + step, still + 1 if step < still_m else 0
                last, x0, buffered = r.ts_s, r.x, buffered + 1
                if buffered < warm_up:
                    status = "WARM_UP"
                elif still >= 3 and matched is not None:
                    status = "STATIONARY"
                elif matched is None and moved >= every_m or matched is not None and (r.ts_s - matched >= every_s or moved >= every_m):
                    status, matched, moved = "MATCHED", r.ts_s, 0.0
                else:
                    status = "WAITING"
                out.append((key[0], r.event_id, r.ts_s, status, gap, moved, generation))
        state.update((last, buffered, still, moved, matched, x0, list(seen), [h for h, _ in seen.values()], [t for _, t in seen.values()], generation))
        if forget_s:
            state.setTimeoutDuration(forget_s * 1000)
        yield pd.DataFrame(out, columns=["user_id", "event_id", "ts_s", "status", "gap_reset", "since_match_m", "generation"])

    return events.select("user_id", "event_id", "ts_s", "x", *([arrival] if arrival else [])).groupBy("user_id").applyInPandasWithState(run, TRACE, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if forget_s else GroupStateTimeout.NoTimeout)


def ticks(spark: SparkSession, every_s: int = 30) -> DataFrame:
    """An endless stream of (at, tick): one row every so many seconds."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return rows.where(F.col("value") % every_s == 0).select(F.col("timestamp").alias("at"), F.floor(F.col("value") / every_s).alias("tick"))


def replay(rows: DataFrame, into: str, checkpoint: str) -> int:
    """Runs a finite stream as fast as it goes into Parquet, and returns how many rows have arrived there."""
    rows.writeStream.format("parquet").option("path", into).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.parquet(into).count()
