"""Flow-duration curves, low flows and hydrological signatures of daily-bounded series."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.functions.arith import ratio
from limnos.operators.series import KEYS, by, islands, numbered, whole
from limnos.session import cut

FDC_PERCENTILES = (5, 10, 25, 50, 75, 90, 95, 99)


def ranked_desc(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Position by falling value (ties in time order) and the series length, in one sort."""
    k = list(keys)
    order = Window.partitionBy(*k).orderBy(F.desc("value"), "date")
    return df.where("value IS NOT NULL").withColumn("rk", F.row_number().over(order)).withColumn(
        "n", F.count(F.lit(1)).over(whole(k)))


def duration_curve(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return ranked_desc(df, keys).select(*keys, "date", "value", "rk", (F.col("rk") / F.col("n") * 100).alias("exceedance"))


def duration_percentiles(df: DataFrame, percentiles: Sequence[int] = FDC_PERCENTILES, keys: Sequence[str] = KEYS) -> DataFrame:
    """Flow at each exceedance percentage: the value at position floor(p/100 n), clamped to the last."""
    r = ranked_desc(df, keys)
    pick = lambda p: F.max(F.when(F.col("rk") - 1 == F.least(F.floor(F.lit(p / 100) * F.col("n")), F.col("n") - 1), F.col("value")))
    return r.groupBy(*keys).agg(F.max("n").alias("n"), *[pick(p).alias(f"q{p}") for p in percentiles])


def flow_stats(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Q10/50/90/95 by the nearest plotting position i/(n+1), population spread and flashiness."""
    k = list(keys)
    r = ranked_desc(df, k).withColumn("x", F.col("rk") / (F.col("n") + 1) * 100)
    near = lambda p: F.min_by("value", F.struct(F.round(F.abs(F.col("x") - p), 9), F.col("rk")))
    q = r.groupBy(*k).agg(F.max("n").alias("n_observations"), F.avg("value").alias("mean_flow"),
                          F.stddev_pop("value").alias("std_flow"), *[near(p).alias(f"q{p}") for p in (10, 50, 90, 95)])
    return q.where("n_observations >= 3").join(flashiness(df, k), k)


def low_flow(df: DataFrame, n_day: int = 7, return_period: float = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """n-day low flow of a return period: yearly minima of full running means on the Weibull position 1/T."""
    k = list(keys)
    w = by(k).rowsBetween(-(n_day - 1), 0)
    run = df.withColumn("m", F.avg("value").over(w)).withColumn("c", F.count("value").over(w)).where(F.col("c") == n_day)
    mins = run.groupBy(*k, F.year("date").alias("year")).agg(F.min("m").alias("value"))
    order = Window.partitionBy(*k).orderBy("value", "year")
    pos = (mins.withColumn("rk", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(whole(k)))
           .withColumn("p", F.col("rk") / (F.col("n") + 1)).where("n >= 3"))
    t = 1.0 / return_period
    lo, hi = F.max(F.when(F.col("p") <= t, F.struct("p", "value"))), F.min(F.when(F.col("p") >= t, F.struct("p", "value")))
    ends = pos.groupBy(*k).agg(lo.alias("lo"), hi.alias("hi"), F.max("n").alias("n_years"))
    frac = (t - F.col("lo.p")) / (F.col("hi.p") - F.col("lo.p"))
    val = (F.when(F.col("lo").isNull(), F.col("hi.value")).when(F.col("hi").isNull(), F.col("lo.value"))
           .when(F.col("hi.p") == F.col("lo.p"), F.col("lo.value"))
           .otherwise(F.col("lo.value") + (F.col("hi.value") - F.col("lo.value")) * frac))
    return ends.select(*k, "n_years", val.alias("low_flow"))


def flashiness(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    d = F.abs(F.col("value") - F.lag("value").over(by(keys)))
    tot = F.sum("value")
    return df.where("value IS NOT NULL").withColumn("d", d).groupBy(*keys).agg(
        F.when(tot == 0, 0.0).otherwise(F.sum("d") / tot).alias("flashiness"))


def seasonality(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Resultant of the monthly means as vectors: concentration and its month."""
    k = list(keys)
    m = df.groupBy(*k, F.month("date").alias("m")).agg(F.avg("value").alias("w"))
    ang = 2 * math.pi * (F.col("m") - 1) / 12
    tot = F.sum("w")
    v = m.groupBy(*k).agg(tot.alias("tot"), ratio(F.sum(F.col("w") * F.cos(ang)), tot).alias("x"),
                          ratio(F.sum(F.col("w") * F.sin(ang)), tot).alias("y"))
    at = F.atan2("y", "x")
    at = F.when(at < 0, at + 2 * math.pi).otherwise(at)
    mon = F.bround(at * 12 / (2 * math.pi), 0).cast("long") + 1
    return v.select(*k, F.when(F.col("tot") == 0, 0.0).otherwise(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)).alias("seasonality"),
                    F.when(F.col("tot") == 0, 1).when(mon > 12, 1).otherwise(mon).cast("long").alias("peak_month"))


def fdc_slope(df: DataFrame, lower: float = 0.33, upper: float = 0.66, keys: Sequence[str] = KEYS) -> DataFrame:
    """Log slope of the duration curve between two exceedance levels of the positive flows."""
    r = ranked_desc(df.where("value > 0"), keys)
    at = lambda p: F.max(F.when(F.col("rk") - 1 == F.bround(F.lit(p) * (F.col("n") - 1), 0), F.col("value")))
    ends = r.groupBy(*keys).agg(at(lower).alias("a"), at(upper).alias("b"), F.max("n").alias("n"))
    s = (F.log("a") - F.log("b")) / (upper - lower)
    return ends.select(*keys, F.when((F.col("n") < 2) | (F.col("a") < F.col("b")), 0.0).otherwise(s).alias("fdc_slope"))


def elasticity(q: DataFrame, p: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Median over years of the relative flow departure per relative rain departure."""
    k = list(keys)
    yr = lambda d, name: d.groupBy(*k, F.year("date").alias("year")).agg(F.sum("value").alias(name))
    y = yr(q, "q").join(yr(p, "p"), [*k, "year"])
    w = whole(k)
    y = y.withColumn("qm", F.avg("q").over(w)).withColumn("pm", F.avg("p").over(w))
    y = y.withColumn("dp", F.col("p") - F.col("pm"))
    ratio = F.when((F.abs("dp") > 1e-12) & (F.col("qm") != 0) & (F.col("pm") != 0),
                   (F.col("q") - F.col("qm")) / F.col("qm") / (F.col("dp") / F.col("pm")))
    agg = y.withColumn("r", ratio).groupBy(*k).agg(F.count(F.lit(1)).alias("n_years"), F.count("r").alias("nv"),
                                                  F.percentile("r", F.lit(0.5)).alias("e"))
    return agg.where("n_years >= 2").select(*k, "n_years", F.when(F.col("nv") < 2, 0.0).otherwise(F.col("e")).alias("elasticity"))


def runoff_ratio(q: DataFrame, p: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    j = q.where("value IS NOT NULL").join(p.where("value IS NOT NULL").withColumnRenamed("value", "p"), [*keys, "date"])
    return j.groupBy(*keys).agg(F.when(F.sum("p") > 0, F.sum("value") / F.sum("p")).otherwise(0.0).alias("runoff_ratio"))


def mean_run_length(df: DataFrame, hit: Column, name: str, keys: Sequence[str] = KEYS) -> DataFrame:
    k = list(keys)
    runs = islands(df, hit, k).groupBy(*k, "run").agg(F.count(F.lit(1)).alias("len"))
    return runs.groupBy(*k).agg(F.avg("len").alias(name))


def recession_constant(df: DataFrame, min_length: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Median log-decay rate over the strictly falling stretches (a rise or a tie starts a new one)."""
    k = list(keys)
    s = numbered(df, k)
    up = F.when(F.col("value") < F.lag("value").over(by(k)), 0).otherwise(1)
    s = s.withColumn("up", up).withColumn("seg", F.sum("up").over(by(k).rowsBetween(Window.unboundedPreceding, 0)))
    fit = s.groupBy(*k, "seg").agg(F.count(F.lit(1)).alias("len"), F.min("value").alias("lo"),
                                   F.regr_slope(F.log(F.when(F.col("value") > 0, F.col("value"))), F.col("rn").cast("double")).alias("b"))
    good = fit.where((F.col("len") >= min_length) & (F.col("lo") > 0) & (F.col("b") < 0))
    return good.groupBy(*k).agg(F.percentile(-F.col("b"), F.lit(0.5)).alias("recession_k"))


def signatures(df: DataFrame, keys: Sequence[str] = KEYS, min_values: int = 365) -> DataFrame:
    """The signature table: one base aggregate, run lengths, monthly and recession parts joined by key."""
    from limnos.operators.baseflow import lyne_hollick_bfi

    k = list(keys)
    # ten parts read the daily series: it is materialised once, so its source is scanned once
    s = cut(df.where("value IS NOT NULL").select(*k, "date", "value"))
    pct = lambda p: F.percentile("value", F.lit(p))
    base = s.groupBy(*k).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_flow"), pct(0.5).alias("median_flow"),
        pct(0.05).alias("q5"), pct(0.95).alias("q95"), (pct(0.75) - pct(0.25)).alias("iqr"),
        F.stddev_pop("value").alias("sd")).where(F.col("n") >= min_values)
    s = s.join(base.select(*k, "median_flow", "n"), k)
    v, med = F.col("value"), F.col("median_flow")
    up = (v > F.lag("value").over(by(k))).cast("int")
    cnt = s.withColumn("up", up).groupBy(*k).agg(
        F.sum((v > 3 * med).cast("int")).alias("hi"), F.sum((v < 0.2 * med).cast("int")).alias("lo"),
        F.avg((v == 0).cast("double")).alias("zero_flow_fraction"), F.sum("up").alias("ups"))
    peaks = s.groupBy(*k, F.year("date").alias("y")).agg(F.max("value").alias("mx")).groupBy(*k).agg(F.avg("mx").alias("pk"))
    parts = [cnt, peaks, mean_run_length(s, v > med, "hd", k), mean_run_length(s, v < 0.2 * med, "ld", k),
             seasonality(s, k), flashiness(s, k), fdc_slope(s.drop("n"), keys=k), recession_constant(s.drop("n"), keys=k),
             lyne_hollick_bfi(s.select(*k, "date", "value"), keys=k, n_passes=1)]
    out = base
    for p in parts:
        out = out.join(p, k, "left")
    years = F.greatest(F.lit(1.0), F.col("n") / 365.25)
    m = F.col("mean_flow")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return out.select(
        *k, "mean_flow", "median_flow", "q5", "q95", F.when(F.col("q95") > 0, F.col("q5") / F.col("q95")).otherwise(
            float("inf")).alias("q5_q95_ratio"), F.when(m > 0, F.col("sd") / m).otherwise(0.0).alias("cv"), "iqr",
        (F.col("hi") / years).alias("high_flow_frequency"), z("hd").alias("high_flow_duration"),
        F.when(m > 0, F.col("pk") / m).otherwise(0.0).alias("q_peak_mean"), (F.col("lo") / years).alias("low_flow_frequency"),
        z("ld").alias("low_flow_duration"), F.col("bfi").alias("baseflow_index"), "zero_flow_fraction", "peak_month",
        F.col("seasonality").alias("seasonality_index"), (F.col("ups") / F.col("n")).alias("rising_limb_density"),
        F.col("flashiness").alias("flashiness_index"), z("recession_k").alias("mean_recession_constant"), "fdc_slope")
