"""Baseflow separation and recession analysis.

The digital filters feed each step's clipped result into the next, which no window expresses; they
are prefix scans of clamped steps over one daily-bounded series per group. The smoothed-minima method
and the recession runs are plain windows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limnos.operators.scan import clamped_scan
from limnos.operators.series import KEYS, by, interp_between, islands, numbered, per_series, whole


def _schema(df: DataFrame, keys: Sequence[str], rest: str) -> str:
    types = dict(df.dtypes)
    return ", ".join([f"{c} {types[c]}" for c in keys] + [rest])


def _quick_pass(q: np.ndarray, first: float, alpha: float) -> np.ndarray:
    rise = (1 + alpha) / 2 * np.diff(q)
    return np.concatenate(([first], clamped_scan(alpha, rise, np.minimum(q[1:], 0.0), q[1:], first)))


def lyne_hollick(df: DataFrame, alpha: float = 0.925, n_passes: int = 3, keys: Sequence[str] = KEYS) -> DataFrame:
    """Recursive quickflow filter, alternating direction; the first element of a pass keeps its value."""
    k = list(keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        q = pdf["value"].to_numpy(float)
        qf = np.zeros(len(q))
        for p in range(n_passes):
            step = 1 if p % 2 == 0 else -1
            qf = _quick_pass(q[::step], qf[::step][0], alpha)[::step]
        return pdf[k + ["date", "value"]].assign(baseflow=np.clip(q - qf, 0, q), quickflow=qf)

    return per_series(df.where("value IS NOT NULL").select(*k, "date", "value"), k, run,
                      _schema(df, k, "date date, value double, baseflow double, quickflow double"))


def lyne_hollick_bfi(df: DataFrame, alpha: float = 0.925, n_passes: int = 3, keys: Sequence[str] = KEYS) -> DataFrame:
    return bfi(lyne_hollick(df, alpha, n_passes, keys), keys)


def bfi(sep: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    tot = F.sum("value")
    return sep.groupBy(*keys).agg(F.when(tot > 0, F.sum("baseflow") / tot).otherwise(0.0).alias("bfi"))


def eckhardt(df: DataFrame, alpha: float = 0.98, bfi_max: float = 0.80, keys: Sequence[str] = KEYS) -> DataFrame:
    """Two-parameter recursive baseflow filter."""
    k = list(keys)
    a, b, c = (1 - bfi_max) * alpha, (1 - alpha) * bfi_max, 1 - alpha * bfi_max

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        q = pdf["value"].to_numpy(float)
        first = min(q[0], q[0] * bfi_max)
        bf = np.concatenate(([first], clamped_scan(a / c, b / c * q[1:], 0.0, np.maximum(q[1:], 0.0), first)))
        return pdf[k + ["date", "value"]].assign(baseflow=bf, quickflow=q - bf)

    return per_series(df.where("value IS NOT NULL").select(*k, "date", "value"), k, run,
                      _schema(df, k, "date date, value double, baseflow double, quickflow double"))


def smoothed_minima(df: DataFrame, block: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Block minima that undercut 1/0.9 of both neighbours, joined by straight lines and capped at the flow."""
    k = list(keys)
    s = numbered(df, k).withColumn("blk", F.floor((F.col("rn") - 1) / block))
    mins = s.groupBy(*k, "blk").agg(F.min(F.struct("value", "rn")).alias("m")).select(
        *k, "blk", F.col("m.value").alias("mv"), F.col("m.rn").alias("rn"))
    w = by(k, "blk")
    lo, hi = F.lag("mv").over(w), F.lead("mv").over(w)
    c = 0.9 * F.col("mv")
    turn = mins.withColumn("ok", F.coalesce(c < lo, F.lit(True)) & F.coalesce(c < hi, F.lit(True))).where("ok")
    s = s.join(turn.select(*k, "rn", F.col("mv").alias("tv")), [*k, "rn"], "left")
    pt = F.when(F.col("tv").isNotNull(), F.struct("rn", "tv"))
    o = by(k, "rn")
    s = (s.withColumn("a", F.last(pt, True).over(o.rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("b", F.last(pt, True).over(Window.partitionBy(*k).orderBy(F.desc("rn")).rowsBetween(Window.unboundedPreceding, 0)))
         .withColumn("floor", F.min("value").over(whole(k))))
    line = F.coalesce(interp_between(F.col("rn"), F.col("a.rn"), F.col("a.tv"), F.col("b.rn"), F.col("b.tv")), F.col("floor"))
    base = F.least(F.greatest(line, F.lit(0.0)), F.col("value"))
    return s.select(*k, "date", "value", base.alias("baseflow"), (F.col("value") - base).alias("quickflow"))


def recession_segments(df: DataFrame, min_length: int = 5, min_decline: float = 0.05, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of the recessions: a strict drop opens one, it lasts while flow does not rise.

    A maximal non-rising stretch can begin with ties; the recession then starts at the last value
    before the first strict drop.
    """
    k = list(keys)
    s = numbered(df, k)
    prev = F.lag("value").over(by(k))
    s = s.withColumn("st", F.sum(F.when(F.col("value") <= prev, 0).otherwise(1)).over(by(k).rowsBetween(
        Window.unboundedPreceding, 0))).withColumn("drop", F.col("value") < F.lag("value").over(by([*k, "st"])))
    w = whole([*k, "st"])
    s = s.withColumn("open", F.min(F.when(F.col("drop"), F.col("rn") - 1)).over(w)).where(F.col("rn") >= F.col("open"))
    s = (s.withColumn("len", F.count(F.lit(1)).over(w)).withColumn("q0", F.max_by("value", -F.col("rn")).over(w))
         .withColumn("q1", F.max_by("value", "rn").over(w)).withColumn("day", F.col("rn") - F.col("open")))
    decline = F.when(F.col("q0") > 0, (F.col("q0") - F.col("q1")) / F.col("q0")).otherwise(0.0)
    return s.where((F.col("len") >= min_length) & (decline >= min_decline)).select(
        *k, F.col("open").alias("segment"), "date", "value", "day", "q0", "len")


def segment_table(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return rows.groupBy(*keys, "segment").agg(F.min("date").alias("start"), F.max("date").alias("end"),
                                              F.count(F.lit(1)).alias("length"), F.max("q0").alias("q_start"),
                                              F.max_by("value", "day").alias("q_end"))


def master_recession(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Pooled log-linear decay of all recession rows."""
    ok = rows.where("q0 > 0 AND value > 0")
    y, x = F.log(F.col("value") / F.col("q0")), F.col("day").cast("double")
    fit = ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("b"), F.regr_r2(y, x).alias("r2"))
    fit = fit.where("n >= 3")
    return fit.select(*keys, "n", F.when(F.col("b") < 0, -1 / F.col("b")).otherwise(0.0).alias("k"),
                      F.when(F.col("b") < 0, -F.log(F.lit(2.0)) / F.col("b")).otherwise(0.0).alias("half_life"),
                      F.when(F.col("b") < 0, F.col("r2")).otherwise(0.0).alias("r2"))


def well_recessions(df: DataFrame, min_steps: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Strictly falling stretches of a level series: time constant per event."""
    k = list(keys)
    s = numbered(df, k)
    fall = F.col("value") < F.lag("value").over(by(k))
    s = s.withColumn("ev", F.sum(F.when(fall, 0).otherwise(1)).over(by(k).rowsBetween(Window.unboundedPreceding, 0)))
    w = whole([*k, "ev"])
    s = (s.withColumn("steps", F.count(F.lit(1)).over(w) - 1).withColumn("h0", F.max_by("value", -F.col("rn")).over(w))
         .withColumn("t", (F.col("rn") - F.min("rn").over(w)).cast("double")).where(F.col("steps") >= min_steps))
    return s.withColumn("y", F.when((F.col("h0") > 0) & (F.col("value") > 0), F.log(F.col("value") / F.col("h0")))).select(
        *k, "ev", "date", "t", "y", "steps")


def well_recession_constants(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean event constant and the constant of the pooled events."""
    k = list(keys)
    ev = rows.groupBy(*k, "ev").agg(F.regr_slope("y", "t").alias("b")).where("b < 0")
    ev = ev.groupBy(*k).agg(F.count(F.lit(1)).alias("n_events"), F.avg(-1 / F.col("b")).alias("mean_constant"))
    pooled = rows.groupBy(*k).agg(F.regr_slope("y", "t").alias("pb"))
    return ev.join(pooled, k).select(*k, "n_events", "mean_constant", F.when(F.col("pb") < 0, -1 / F.col("pb"))
                                     .otherwise(F.col("mean_constant")).alias("master_constant"))


__all__ = ["bfi", "eckhardt", "islands", "lyne_hollick", "lyne_hollick_bfi", "master_recession", "recession_segments",
           "segment_table", "smoothed_minima", "well_recession_constants", "well_recessions"]
