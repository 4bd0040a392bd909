"""Joins and set operations between observation, station and result tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.operators.series import KEYS, per_series


def with_stations(rows: DataFrame, stations: DataFrame, on: str = "station_id") -> DataFrame:
    """Left join to station attributes. No hint: the runtime broadcasts the station side when it is small."""
    return rows.join(stations, on, "left")


def merge_attributes(a: DataFrame, b: DataFrame, on: str, prefer: str) -> DataFrame:
    """Full outer join of two attribute tables, one shared column taken from ``a`` first."""
    j = a.withColumnRenamed(prefer, "_p").join(b.withColumnRenamed(prefer, "_s"), on, "full")
    return j.withColumn(prefer, F.coalesce("_p", "_s")).drop("_p", "_s")


def union_sources(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def scenario_change(scenarios: DataFrame, baseline: DataFrame, metric: str = "mean", keys: Sequence[str] = KEYS) -> DataFrame:
    """Scenario statistic against the baseline statistic of the same key."""
    fn = {"mean": F.avg("value"), "median": F.percentile("value", F.lit(0.5)), "std": F.stddev_samp("value"),
          "max": F.max("value"), "min": F.min("value")}[metric]
    a = scenarios.groupBy(*keys, "scenario").agg(fn.alias("scenario_value"))
    b = baseline.groupBy(*keys).agg(fn.alias("baseline_value"))
    chg = F.col("scenario_value") - F.col("baseline_value")
    return a.join(b, list(keys)).withColumn("absolute_change", chg).withColumn(
        "percent_change", F.when(F.col("baseline_value") != 0, chg / F.col("baseline_value") * 100))


def lag_correlation(df: DataFrame, keys: Sequence[str] = KEYS, x: str = "obs", y: str = "sim", max_lag: int = 365) -> DataFrame:
    """Correlation at lag 0 and the lag (up to a third of the series) where y leads x best.

    Each shift is one dot product on a daily-bounded series; only the best lag leaves the task.
    """
    k = list(keys)
    types = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        a, b = pdf[x].to_numpy(float), pdf[y].to_numpy(float)
        top = min(len(a) // 3, max_lag)
        best, at = -np.inf, 0
        with np.errstate(all="ignore"):
            base = float(np.corrcoef(a, b)[0, 1]) if len(a) > 2 else float("nan")
            for lag in range(top + 1):
                c = np.corrcoef(a[lag:], b[:len(b) - lag])[0, 1]
                if c > best:
                    best, at = c, lag
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in k}, "correlation": [base], "lag_days": [at], "lag_correlation": [float(best)]})

    schema = ", ".join([f"{c} {types[c]}" for c in k] + ["correlation double, lag_days long, lag_correlation double"])
    return per_series(df.select(*k, "date", x, y), k, run, schema)
