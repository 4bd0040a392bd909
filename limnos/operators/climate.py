"""Climate indices, spells, standardised indices and bias correction of daily-bounded series."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from limnos.functions.arith import ratio
from limnos.functions.special import gammainc, norm_ppf
from limnos.operators.changepoint import avg_ranks
from limnos.operators.periods import annual_cycle, resample
from limnos.operators.scan import clamped_scan
from limnos.operators.series import KEYS, by, islands, numbered, per_series, whole


def aridity_class(index: Column, hyper: float = 0.03) -> Column:
    """Five classes; the two published sets differ only in the hyper-arid limit (0.03 or 0.05)."""
    return (F.when(index < hyper, "hyper-arid").when(index < 0.2, "arid").when(index < 0.5, "semi-arid")
            .when(index < 0.65, "dry sub-humid").when(index.isNotNull(), "humid"))


def drought_class(spi: Column) -> Column:
    return (F.when(spi.isNull() | F.isnan(spi), "unknown").when(spi >= 2.0, "extremely_wet").when(spi >= 1.5, "very_wet")
            .when(spi >= 1.0, "moderately_wet").when(spi > -1.0, "normal").when(spi > -1.5, "moderately_dry")
            .when(spi > -2.0, "severely_dry").otherwise("extremely_dry"))


def yearly_spells(df: DataFrame, hit: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """Longest run of ``hit`` per calendar year (runs break at the year end), with the mean and max over years."""
    k = list(keys)
    y = [*k, "year"]
    d = df.where("value IS NOT NULL").withColumn("year", F.year("date").cast("long"))
    runs = islands(d, hit, y).groupBy(*y, "run").agg(F.count(F.lit(1)).alias("len")).groupBy(*y).agg(F.max("len").alias("longest"))
    return d.select(*y).distinct().join(runs, y, "left").withColumn("longest", F.coalesce("longest", F.lit(0)))


def spell_summary(spells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return spells.groupBy(*keys).agg(F.max("longest").alias("max_run"), F.avg("longest").alias("mean_run"),
                                     F.count(F.lit(1)).alias("n_years"))


def runs_table(df: DataFrame, hit: Column, keys: Sequence[str] = KEYS, *extra: Column) -> DataFrame:
    """Start, end, length and any aggregate of each run of ``hit``."""
    return islands(df, hit, keys).groupBy(*keys, "run").agg(
        F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("duration"), *extra)


def with_percentile(df: DataFrame, p: float, keys: Sequence[str] = KEYS) -> DataFrame:
    q = df.groupBy(*keys).agg(F.percentile("value", F.lit(p)).alias("threshold"))
    return df.join(q, list(keys))


def heat_waves(df: DataFrame, percentile: float = 90, min_days: int = 3, keys: Sequence[str] = KEYS) -> DataFrame:
    d = with_percentile(df, percentile / 100, keys)
    peak = (F.max("value") - F.max("threshold")).alias("peak_intensity")
    return runs_table(d, F.col("value") > F.col("threshold"), keys, peak).where(F.col("duration") >= min_days).drop("run")


def drought_runs(df: DataFrame, percentile: float = 20, keys: Sequence[str] = KEYS) -> DataFrame:
    """Number, durations and deficits of the runs below a percentile."""
    d = with_percentile(df, percentile / 100, keys)
    runs = runs_table(d, F.col("value") < F.col("threshold"), keys, F.sum(F.col("threshold") - F.col("value")).alias("deficit"))
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_events"), F.avg("duration").alias("mean_duration"),
                                   F.max("duration").alias("max_duration"), F.avg("deficit").alias("mean_severity"),
                                   F.sum("deficit").alias("total_deficit"))


def wet_spells(df: DataFrame, threshold: float = 1.0, keys: Sequence[str] = KEYS) -> DataFrame:
    runs = runs_table(df, F.col("value") >= threshold, keys, F.avg("value").alias("intensity"))
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_spells"), F.avg("duration").alias("mean_duration"),
                                   F.max("duration").alias("max_duration"), F.avg("intensity").alias("mean_intensity"))


def index_events(df: DataFrame, threshold: float = -1.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Runs of a standardised index at or below the threshold: length, sum and minimum."""
    d = df.where("value IS NOT NULL")
    return runs_table(d, F.col("value") <= threshold, keys, F.sum("value").alias("severity"), F.min("value").alias("peak")).drop("run")


def concentration_index(monthly: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """100 sum(p^2) / (sum p)^2 over the first twelve months."""
    f = numbered(monthly, keys).where("n >= 12 AND rn <= 12")
    t = F.sum("value")
    return f.groupBy(*keys).agg(F.when(t == 0, 0.0).otherwise(F.sum(F.col("value") * F.col("value")) / (t * t) * 100).alias("pci"))


def sgi(monthly: DataFrame, min_per_month: int = 5, keys: Sequence[str] = KEYS) -> DataFrame:
    """Normal scores of the average ranks within each calendar month."""
    m = [*keys, "month"]
    d = monthly.where("value IS NOT NULL").withColumn("month", F.month("date").cast("long"))
    d = avg_ranks(d, m).withColumn("nm", F.count(F.lit(1)).over(whole(m)))
    d = d.withColumn("_p", (F.col("rank_avg") - 0.5) / F.col("nm"))
    return d.withColumn("sgi", F.when(F.col("nm") >= min_per_month, norm_ppf("_p"))).select(*keys, "date", "value", "sgi")


def _gamma_shape(s: float) -> float:
    """Maximum-likelihood gamma shape: root of ln a - digamma(a) = s by Newton steps."""
    if not s > 0:
        return float("nan")
    a = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(50):
        x, dig, tri = a, 0.0, 0.0
        while x < 12:
            dig -= 1 / x
            tri += 1 / (x * x)
            x += 1
        f = 1 / (x * x)
        dig += math.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))
        tri += 1 / x + f / 2 + f / x * (1 / 6 - f * (1 / 30 - f * (1 / 42 - f / 30)))
        step = (math.log(a) - dig - s) / (1 / a - tri)
        a = a - step if a > step else a / 2
        if abs(step) < 1e-14 * a:
            break
    return a


@F.pandas_udf(DoubleType())
def gamma_shape(s: pd.Series) -> pd.Series:
    return s.map(_gamma_shape)


def accumulate(monthly: DataFrame, scale: int, keys: Sequence[str] = KEYS) -> DataFrame:
    w = by(keys).rowsBetween(-(scale - 1), 0)
    return (monthly.withColumn("acc", F.sum("value").over(w)).withColumn("_c", F.count("value").over(w))
            .where(F.col("_c") == scale).drop("_c"))


def spi(monthly: DataFrame, scale: int = 3, min_per_group: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """Standardised precipitation index. Moments per calendar month are aggregates; only the gamma shape
    (one row per month) and its distribution function leave Catalyst, as Arrow batches."""
    m = [*keys, "month"]
    acc = accumulate(monthly, scale, keys).withColumn("month", F.month("date").cast("long"))
    pos = F.when(F.col("acc") > 0, F.col("acc"))
    fit = acc.groupBy(*m).agg(F.avg(pos).alias("mean"), F.avg(F.log(pos)).alias("mlog"), F.count(pos).alias("np"),
                              F.avg((F.col("acc") == 0).cast("double")).alias("q"))
    fit = fit.where(F.col("np") >= min_per_group).withColumn("shape", gamma_shape(F.log("mean") - F.col("mlog")))
    d = acc.join(fit, m, "left").withColumn("cdf", gammainc("shape", F.col("acc") * F.col("shape") / F.col("mean")))
    p = F.when(F.col("acc") == 0, F.col("q") / 2).otherwise(F.col("q") + (1 - F.col("q")) * F.col("cdf"))
    d = d.withColumn("_p", F.when(F.col("shape").isNotNull(), F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))))
    return d.withColumn("spi", norm_ppf("_p")).select(*keys, "date", "acc", "spi")


def spi_status(monthly: DataFrame, scales: Sequence[int] = (1, 3, 6, 12), min_per_group: int = 10,
               keys: Sequence[str] = KEYS) -> DataFrame:
    """Latest index per scale with its class, and the overall verdict from the three-month scale."""
    k = list(keys)
    parts = None
    for s in scales:
        one = spi(monthly, s, min_per_group, k).where("spi IS NOT NULL").groupBy(*k).agg(F.max_by("spi", "date").alias(f"spi_{s}"))
        parts = one if parts is None else parts.join(one, k, "full")
    x = F.col("spi_3")
    overall = (F.when(x <= -2.0, "EXTREME DROUGHT").when(x <= -1.5, "SEVERE DROUGHT").when(x <= -1.0, "MODERATE DROUGHT")
               .otherwise("NORMAL / WET"))
    return parts.select(*k, *[F.round(f"spi_{s}", 3).alias(f"spi_{s}") for s in scales],
                        *[drought_class(F.round(f"spi_{s}", 3)).alias(f"class_{s}") for s in scales], overall.alias("overall"))


def pdsi(df: DataFrame, awc: float = 100.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Simplified Palmer index from monthly ``precip`` and ``pet``: two clamped stores, departure z, autoregression, all as scans."""
    k = list(keys)
    types = dict(df.dtypes)
    top, low = awc / 3, awc - awc / 3

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        p, pe = pdf["precip"].to_numpy(float), pdf["pet"].to_numpy(float)
        # each store: the demand leaves it, then the rain fills it up
        upper = clamped_scan(1.0, p - pe, np.minimum(p, top), top, top)
        had = np.concatenate(([top], upper[:-1]))
        drawn = np.minimum(pe, had)
        over = p - np.minimum(p, top - (had - drawn))
        lower = clamped_scan(1.0, over - (pe - drawn), np.minimum(over, low), low, low)
        et = drawn + np.minimum(pe - drawn, np.concatenate(([low], lower[:-1])))
        share = np.where(pe > 0, et / np.where(pe > 0, pe, 1), 1.0)
        d = p - share.mean() * pe
        z = d / (d.std() + 1e-10)
        z[0] = 0.0  # the index starts at zero
        return pdf[[*k, "date"]].assign(pdsi=clamped_scan(0.897, z / 3, -np.inf, np.inf, 0.0))

    return per_series(df.select(*k, "date", "precip", "pet"), k, run,
                      ", ".join([f"{c} {types[c]}" for c in k] + ["date date, pdsi double"]))


def water_balance(precip: DataFrame, et: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    a = resample(precip, "month", "sum", keys).select(*keys, "date", F.col("value").alias("precipitation"))
    b = resample(et, "month", "sum", keys).select(*keys, "date", F.col("value").alias("et"))
    bal = F.col("precipitation") - F.col("et")
    return a.join(b, [*keys, "date"]).withColumn("water_balance", bal).withColumn(
        "surplus_deficit", F.when(bal >= 0, "surplus").otherwise("deficit"))


DAYS_A_MONTH = 30.44


def point_climate(precip: DataFrame, et: DataFrame, temp: DataFrame | None = None, min_days: int = 300, keys: Sequence[str] = KEYS) -> DataFrame:
    """Climate of each point from daily precipitation, reference evapotranspiration and, if given, temperature.

    Mean annual sums of years with at least ``min_days`` values and their ratio with its class, mean temperature, wettest day, twelve
    monthly sums (mean of all days of a calendar month times the mean length of a month) and the annual sums as (year, mm). A point
    without such a year keeps its row with nulls; months without values are null. Days are added up to months once, everything else
    reads those.
    """
    k = list(keys)
    parts = [("p", precip), ("e", et)] + ([("t", temp)] if temp is not None else [])
    d = parts[0][1].select(*k, "date", "value", F.lit("p").alias("kind"))
    for kind, other in parts[1:]:
        d = d.unionByName(other.select(*k, "date", "value", F.lit(kind).alias("kind")))
    # dealt by point alone, so that the sums below need no further shuffle than this one of months
    months = d.where("value IS NOT NULL").groupBy(*k, "kind", F.year("date").cast("long").alias("year"), F.month("date").alias("month")).agg(
        F.sum("value").alias("s"), F.count("value").alias("c"), F.max("value").alias("most"))
    of = lambda kind, x: F.when(F.col("kind") == kind, x)
    years = months.groupBy(*k, "kind", "year").agg(F.sum("s").alias("s"), F.sum("c").alias("c")).where(F.col("c") >= min_days).groupBy(*k).agg(
        F.avg(of("p", F.col("s"))).alias("p"), F.avg(of("e", F.col("s"))).alias("et0"),
        F.array_sort(F.collect_list(of("p", F.struct("year", F.col("s").alias("mm"))))).alias("annual_precipitation"))
    cycle = lambda kind: F.array(*[F.try_divide(F.sum(F.when((F.col("kind") == kind) & (F.col("month") == m), F.col("s"))),
                                               F.sum(F.when((F.col("kind") == kind) & (F.col("month") == m), F.col("c")))) * DAYS_A_MONTH for m in range(1, 13)])
    whole_record = months.groupBy(*k).agg(
        F.try_divide(F.sum(of("t", F.col("s"))), F.sum(of("t", F.col("c")))).alias("temperature_mean"), F.max(of("p", F.col("most"))).alias("wettest_day"),
        cycle("p").alias("monthly_precipitation"), cycle("e").alias("monthly_et0"))
    out = whole_record.join(years, k, "left")
    index = F.when(F.col("et0") != 0, F.col("p") / F.col("et0"))
    return out.select(*k, F.col("p").alias("precipitation_per_year"), F.col("et0").alias("et0_per_year"), index.alias("aridity_index"),
                      aridity_class(index, 0.05).alias("aridity_class"), "temperature_mean", "wettest_day", "monthly_precipitation", "monthly_et0",
                      F.coalesce("annual_precipitation", F.array().cast("array<struct<year: bigint, mm: double>>")).alias("annual_precipitation"))


def export_indices(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Climate indices of a large-sample export from daily ``precip``, ``pet`` and ``temp``."""
    k = list(keys)
    base = df.groupBy(*k).agg(F.avg("precip").alias("p_mean"), F.avg("pet").alias("pet_mean"), F.count(F.lit(1)).alias("n"))
    d = df.join(base.select(*k, "p_mean"), k).withColumn("value", F.col("precip"))
    hi, lo = F.col("precip") >= 5 * F.col("p_mean"), F.col("precip") < 1
    freq = d.groupBy(*k).agg(F.avg(hi.cast("double")).alias("high_prec_freq"), F.avg(lo.cast("double")).alias("low_prec_freq"))
    dur = lambda h, n: runs_table(d, h, k).groupBy(*k).agg(F.avg("duration").alias(n))
    m = df.groupBy(*k, F.month("date").alias("m")).agg(F.avg("precip").alias("p"), F.avg("pet").alias("e"), F.avg("temp").alias("t"))
    moist = F.when(F.col("p") > F.col("e"), 1 - F.col("e") / F.col("p")).when(F.col("p") < F.col("e"), F.col("p") / F.col("e") - 1).otherwise(0.0)
    mon = m.withColumn("x", moist).groupBy(*k).agg(
        F.avg("x").alias("moisture_index"), (F.max("x") - F.min("x")).alias("seasonality"),
        ratio(F.sum(F.when(F.col("t") < 0, F.col("p")).otherwise(0.0)), F.sum("p")).alias("frac_snow"))
    out = base.join(freq, k).join(dur(hi, "high_prec_dur"), k, "left").join(dur(lo, "low_prec_dur"), k, "left").join(mon, k)
    return out.select(*k, "p_mean", "pet_mean", ratio("pet_mean", "p_mean").alias("aridity"), "frac_snow", "moisture_index",
                      "seasonality", "high_prec_freq", F.coalesce("high_prec_dur", F.lit(0.0)).alias("high_prec_dur"),
                      "low_prec_freq", F.coalesce("low_prec_dur", F.lit(0.0)).alias("low_prec_dur"))


def seasonal_decompose(df: DataFrame, period: int = 12, keys: Sequence[str] = KEYS) -> DataFrame:
    """Centred moving average, mean by position in the period, and the rest."""
    k = list(keys)
    s = numbered(df, k).where(F.col("n") >= 2 * period)
    half, w = period // 2, by(k)
    if period % 2:
        f = w.rowsBetween(-half, half)
        tr = F.when(F.count("value").over(f) == period, F.avg("value").over(f))
    else:
        a, b = w.rowsBetween(-half, half - 1), w.rowsBetween(-half + 1, half)
        ok = (F.count("value").over(a) == period) & (F.count("value").over(b) == period)
        tr = F.when(ok, (F.avg("value").over(a) + F.avg("value").over(b)) / 2)
    s = s.withColumn("trend", tr).withColumn("phase", (F.col("rn") - 1) % period).withColumn("detrended", F.col("value") - F.col("trend"))
    ph = s.groupBy(*k, "phase").agg(F.coalesce(F.avg("detrended"), F.lit(0.0)).alias("sa"))
    ph = ph.withColumn("seasonal", F.col("sa") - F.avg("sa").over(whole(k))).drop("sa")
    s = s.join(ph, [*k, "phase"]).withColumn("residual", F.col("detrended") - F.col("seasonal"))
    return s.select(*k, "date", "value", "trend", "seasonal", "residual", "detrended")


def seasonal_strength(parts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    vd = F.var_pop("detrended")
    return parts.groupBy(*keys).agg(F.when(vd > 0, F.greatest(F.lit(0.0), 1 - F.var_pop("residual") / vd)).otherwise(0.0).alias("strength"))


# ── bias correction ─────────────────────────────────────────────────────────────


def delta_method(obs: DataFrame, hist: DataFrame, future: DataFrame, kind: str = "additive", keys: Sequence[str] = KEYS) -> DataFrame:
    k = list(keys)
    m = hist.groupBy(*k).agg(F.avg("value").alias("h")).join(future.groupBy(*k).agg(F.avg("value").alias("f")), k)
    if kind not in ("additive", "multiplicative"):
        raise ValueError(f"unknown kind {kind!r}")
    v = F.col("value") + (F.col("f") - F.col("h")) if kind == "additive" else F.when(F.col("h") != 0, F.col("value") * F.col("f") / F.col("h"))
    return obs.join(m, k).select(*k, "date", v.alias("value"))


def _grid(df: DataFrame, name: str, n: int, keys: Sequence[str]) -> DataFrame:
    probs = F.array(*[F.lit(i / n) for i in range(n + 1)])
    return df.groupBy(*keys).agg(F.percentile("value", probs).alias(name))


def interp_arrays(x: Column, xs: Column, ys: Column) -> Column:
    """Piecewise-linear lookup in two equally long arrays, flat at both ends."""
    i = F.size(F.filter(xs, lambda q: q <= x))
    x0, x1, y0, y1 = (F.get(a, j) for a, j in ((xs, i - 1), (xs, i), (ys, i - 1), (ys, i)))
    return F.when(i == 0, F.get(ys, F.lit(0))).when(i >= F.size(xs), F.get(ys, F.size(ys) - 1)).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))


def quantile_mapping(obs: DataFrame, hist: DataFrame, future: DataFrame, n: int = 100, keys: Sequence[str] = KEYS) -> DataFrame:
    """Empirical quantile mapping: two small quantile arrays per key, then a lookup per row."""
    k = list(keys)
    q = _grid(hist, "hq", n, k).join(_grid(obs, "oq", n, k), k)
    return future.join(q, k).select(*k, "date", interp_arrays(F.col("value"), F.col("hq"), F.col("oq")).alias("value"))


def _at(pos: Column, ys: Column, n: int) -> Column:
    j = F.least(F.floor(pos).cast("int"), F.lit(n - 1))
    return F.get(ys, j) + (F.get(ys, j + 1) - F.get(ys, j)) * (pos - j)


def quantile_delta_mapping(obs: DataFrame, hist: DataFrame, future: DataFrame, n: int = 100, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keeps the change of each quantile: position in the historical order from one running count over the union."""
    k = list(keys)
    q = _grid(hist, "hq", n, k).join(_grid(obs, "oq", n, k), k).join(hist.groupBy(*k).agg(F.count("value").alias("hn")), k)
    u = future.select(*k, "date", "value", F.lit(0).alias("h")).unionByName(hist.select(*k, "date", "value", F.lit(1).alias("h")))
    w = Window.partitionBy(*k).orderBy("value").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    below = F.sum("h").over(w) - F.sum("h").over(Window.partitionBy(*k, "value"))
    d = u.withColumn("below", below).where("h = 0").join(q, k)
    pos = F.col("below") / F.col("hn") * n
    return d.select(*k, "date", (_at(pos, F.col("oq"), n) + F.col("value") - _at(pos, F.col("hq"), n)).alias("value"))


def bias_correction(gcm: DataFrame, obs: DataFrame, method: str = "quantile_mapping", keys: Sequence[str] = KEYS) -> DataFrame:
    """First half of the model series as history, second half as future."""
    s = numbered(gcm, keys)
    half = F.floor(F.col("n") / 2)
    cut = lambda c: s.where(c).select(*keys, "date", "value")
    hist, future = cut(F.col("rn") <= half), cut(F.col("rn") > half)
    if method == "quantile_mapping":
        return quantile_mapping(obs, hist, future, keys=keys)
    if method == "quantile_delta_mapping":
        return quantile_delta_mapping(obs, hist, future, keys=keys)
    if method == "delta":
        return delta_method(obs, hist, future, keys=keys)
    raise ValueError(f"unknown method {method!r}")


def residual_bands(df: DataFrame, probs: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95), relative: bool = False,
                   eps: float = 1e-6, keys: Sequence[str] = KEYS) -> DataFrame:
    """Predictive bands: quantiles of the residuals added to the simulation, clipped at zero and sorted per row."""
    k, ps = list(keys), sorted(probs)
    res = (F.col("obs") - F.col("sim")) / (F.col("sim") + eps) if relative else F.col("obs") - F.col("sim")
    off = df.withColumn("_r", res).groupBy(*k).agg(F.percentile("_r", F.array(*[F.lit(p) for p in ps])).alias("off"))
    scale = F.col("sim") + eps if relative else F.lit(1.0)
    bands = F.array_sort(F.transform("off", lambda o: F.greatest(F.lit(0.0), F.col("sim") + o * scale)))
    d = df.join(off, k).withColumn("b", bands)
    return d.select(*k, "date", "obs", "sim", *[F.get("b", F.lit(i)).alias(f"q{int(round(p * 100))}") for i, p in enumerate(ps)])


def ensemble_stats(df: DataFrame, at: Sequence[str] = ("date",)) -> DataFrame:
    pct = lambda p: F.percentile("value", F.lit(p))
    return df.groupBy(*at).agg(F.avg("value").alias("mean"), pct(0.5).alias("median"), F.stddev_samp("value").alias("std"),
                               pct(0.1).alias("p10"), pct(0.9).alias("p90"), F.count("value").alias("n_models"))


def intensity_adjusted(intensity: Column, factor: Column) -> Column:
    return intensity * factor


def flood_risk(history: DataFrame, forecast: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Forecast peak against the 75 / 90 / 95 / 99 percent levels of the record."""
    k = list(keys)
    q = history.groupBy(*k).agg(F.percentile("value", F.array(*[F.lit(p) for p in (0.75, 0.9, 0.95, 0.99)])).alias("t"))
    pk = forecast.groupBy(*k).agg(F.max("value").alias("peak"))
    t = [F.get("t", F.lit(i)) for i in range(4)]
    x = F.col("peak")
    risk = F.when(x >= t[3], "EXTREME").when(x >= t[2], "HIGH").when(x >= t[1], "MODERATE").when(x >= t[0], "LOW").otherwise("NORMAL")
    return q.join(pk, k).select(*k, "peak", *[c.alias(f"threshold_{p}") for c, p in zip(t, (75, 90, 95, 99))], risk.alias("risk_level"))


def double_mass(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Running sum of each station beside the running sum of the mean over all stations."""
    ref = df.groupBy("date").agg(F.avg("value").alias("m"))
    up = Window.unboundedPreceding
    d = df.join(ref, "date")
    w = by(keys).rowsBetween(up, 0)
    return d.select(*keys, "date", F.sum("value").over(w).alias("cumulative"), F.sum("m").over(w).alias("reference"))


__all__ = [n for n in dir() if not n.startswith("_")] + ["annual_cycle"]
