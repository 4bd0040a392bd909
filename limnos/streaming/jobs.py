"""Structured Streaming forms: alerts, resampling, sliding statistics, sessions, dedupe and stateful sums.

Every function takes a streaming (or batch) DataFrame and returns one, so the same plan is checked in
batch and run as a stream; callers pick source, sink, trigger and checkpoint location.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.operators.scan import between_resets, clamped_scan
from limnos.operators.screening import breaches


def _late(df: DataFrame, delay: str) -> DataFrame:
    return df.withWatermark("ts", delay) if df.isStreaming else df


def alerts(stream: DataFrame, standards: list[str] | None = None) -> DataFrame:
    """Stateless: every sample meets the broadcast limit table."""
    return breaches(stream, standards)


def alert_sink(write: Callable[[DataFrame, int], None]):
    """A ``foreachBatch`` handler that hands on only batches with alerts."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            write(batch, batch_id)
    return handle


def daily_mean(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    g = _late(stream, delay).groupBy(F.window("ts", "1 day"), "station_id", "parameter")
    return g.agg(F.avg("value").alias("value"), F.count("value").alias("n")).select(
        "station_id", "parameter", F.to_date("window.start").alias("date"), "value", "n")


def sliding_stats(stream: DataFrame, width: str = "7 days", slide: str = "1 day", delay: str = "2 days") -> DataFrame:
    g = _late(stream, delay).groupBy(F.window("ts", width, slide), "station_id", "parameter")
    return g.agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count("value").alias("n")).select(
        "station_id", "parameter", F.col("window.start").alias("start"), F.col("window.end").alias("end"), "mean", "std", "n")


def spell_sessions(stream: DataFrame, threshold: float, gap: str = "1 day", delay: str = "2 days") -> DataFrame:
    """Exceedance spells as session windows."""
    hot = _late(stream.where(F.col("value") > threshold), delay)
    return hot.groupBy(F.session_window("ts", gap), "station_id").agg(
        F.min("ts").alias("start"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"), F.max("value").alias("peak")).drop("session_window")


def closing_row(rows: DataFrame, ts: str = "ts", horizon: str = "400 days") -> DataFrame:
    """One row without values, ``horizon`` after the last of ``rows``: landed behind a stream's last file it moves the watermark past all
    open windows, sessions and buffers, which then come out. Its own key is null and its own window stays open."""
    last = rows.agg((F.max(ts) + F.expr(f"INTERVAL {horizon}")).alias(ts))
    return last.select(*[F.col(ts).cast(f.dataType).alias(ts) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields])


def dedupe(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """First arrival per (station, time, parameter) within the watermark."""
    key = ["station_id", "ts", "parameter"]
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key) if stream.isStreaming else stream.dropDuplicates(key)


def dedupe_last(stream: DataFrame, version: str = "seq", delay: str = "2 days") -> DataFrame:
    """The row with the highest ``version`` per (station, time, parameter), once the watermark has passed its time.

    Event time is part of the key, so the state of a key goes when its row comes out. In batch the same rows come out at once.
    """
    key = ["station_id", "ts", "parameter"]
    rest = [c for c in stream.columns if c not in key]
    g = _late(stream, delay).groupBy(*key).agg(F.max_by(F.struct(*rest), version).alias("_r"))
    return g.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def _alarms(v: np.ndarray, up: float, down: float, threshold: float, drift: float) -> tuple[list[tuple[int, str, float]], float, float]:
    """(place, side, sum) of every alarm of deviations ``v``, and both sums after the last of them."""
    state, out = [up, down], []

    def scan(at: int, to: int):
        ups, downs = clamped_scan(1.0, v[at:to] - drift, 0.0, np.inf, state[0]), clamped_scan(1.0, -v[at:to] - drift, 0.0, np.inf, state[1])
        high, low = ups > threshold, downs > threshold

        def accept(k: int) -> None:
            state[:] = float(ups[k]), float(downs[k])
            if high[k] or low[k]:
                out.append((at + k, "up" if high[k] else "down", max(state)))
                state[0 if high[k] else 1] = 0.0
        return high | low, accept

    between_resets(len(v), scan)
    return out, state[0], state[1]


def cusum(stream: DataFrame, target: float, threshold: float, drift: float = 0.0, delay: str = "2 days") -> DataFrame:
    """Two-sided sums per station against a fixed target, in event time: an alarm resets the sum that raised it.

    The state holds both sums and the rows that the watermark has not passed yet. Rows are added in order of time (then value) once the
    watermark has passed them, so the result does not depend on how batches are cut or on the order of arrival within ``delay``.
    """
    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        up, down, us, v = state.get if state.exists else (0.0, 0.0, [], [])
        parts = [(np.asarray(us, np.int64), np.asarray(v, float))]
        if not state.hasTimedOut:
            parts += [(f["us"].to_numpy(np.int64), f["value"].to_numpy(float)) for f in frames]
        us, v = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((v, us))
        us, v = us[order], v[order]
        n = int(np.searchsorted(us, state.getCurrentWatermarkMs() * 1000, "right"))
        hits, up, down = _alarms(v[:n] - target, up, down, threshold, drift)
        state.update((up, down, us[n:].tolist(), v[n:].tolist()))
        if n < len(us):
            state.setTimeoutTimestamp(int(us[n]) // 1000 + 1)
        yield pd.DataFrame([(key[0], int(us[i]), side, s) for i, side, s in hits], columns=["station_id", "us", "side", "statistic"])

    kind = dict(stream.dtypes)["station_id"]
    rows = _late(stream.where("value IS NOT NULL OR station_id IS NULL"), delay).select("station_id", "ts", F.unix_micros("ts").alias("us"), F.coalesce("value", F.lit(0.0)).alias("value"))
    out = rows.groupBy("station_id").applyInPandasWithState(
        step, f"station_id {kind}, us long, side string, statistic double", "up double, down double, us array<long>, v array<double>", "append", "EventTimeTimeout")
    return out.select("station_id", F.timestamp_micros("us").alias("ts"), "side", "statistic")
