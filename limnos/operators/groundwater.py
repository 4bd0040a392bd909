"""Wells, aquifer tests, recharge and storage anomalies."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.functions.arith import ratio
from limnos.functions.special import expint1
from limnos.operators.baseflow import lyne_hollick
from limnos.operators.series import KEYS, by, numbered, whole


def cooper_jacob(q: Column, t: Column, s: Column, r: Column, time: Column) -> Column:
    """Late-time drawdown (T as ``t``, storativity as ``s``)."""
    return q / (4 * math.pi * t) * F.log(2.25 * t * time / (r * r * s))


def theis(q: Column, t: Column, s: Column, r: Column, time: Column) -> Column:
    return q / (4 * math.pi * t) * expint1(r * r * s / (4 * t * time))


def recovery(q: Column, t: Column, pump_time: Column, time: Column) -> Column:
    return q / (4 * math.pi * t) * F.log(time / (time - pump_time))


def transmissivity(tests: DataFrame, q: Column, r: Column, keys: Sequence[str] = ("well",)) -> DataFrame:
    """Straight line of drawdown on ln t per test, solved for T and S."""
    fit = tests.withColumn("_q", q).withColumn("_r", r).groupBy(*keys).agg(
        F.regr_slope("drawdown", F.log("time")).alias("m"), F.regr_intercept("drawdown", F.log("time")).alias("c"),
        F.max("_q").alias("q"), F.max("_r").alias("r"), F.count(F.lit(1)).alias("n"))
    t = F.col("q") / (4 * math.pi * F.col("m"))
    return fit.where("m > 0").select(*keys, "n", t.alias("transmissivity"),
                                     (2.25 * t / (F.col("r") * F.col("r") * F.exp(F.col("c") / F.col("m")))).alias("storativity"))


def safe_yield(extraction: Column, recharge: Column) -> Column:
    share = ratio(extraction, recharge)
    return F.when(share <= 0.7, "sustainable").when(share <= 1.0, "at risk").when(share.isNotNull(), "unsustainable")


def chloride_recharge(precip: Column, cl_precip: Column, cl_well: Column) -> Column:
    return F.when((precip > 0) & (cl_precip > 0) & (cl_well > 0), precip * cl_precip / cl_well)


def years_spanned(keys: Sequence[str] = KEYS) -> Column:
    d = F.datediff(F.max("date"), F.min("date"))
    return F.when(d > 0, d / 365.25).otherwise(1.0)


def water_table_recharge(levels: DataFrame, specific_yield: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Specific yield times the summed rises per year, in mm."""
    if not 0 < specific_yield < 1:
        raise ValueError("specific yield must lie inside (0, 1)")
    d = levels.where("value IS NOT NULL").withColumn("rise", F.col("value") - F.lag("value").over(by(keys)))
    g = d.groupBy(*keys).agg(F.sum(F.greatest("rise", F.lit(0.0))).alias("total_rise"), years_spanned().alias("years"), F.count(F.lit(1)).alias("n"))
    return g.where("n >= 2").select(*keys, "total_rise", "years", (specific_yield * F.col("total_rise") / F.col("years") * 1000).alias("recharge_mm"))


def balance_recharge(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Yearly precipitation less evapotranspiration, runoff and storage change."""
    tot = F.sum(F.col("precip") - F.col("et") - F.col("runoff") - F.coalesce("delta_s", F.lit(0.0)))
    return df.groupBy(*keys).agg(tot.alias("total"), years_spanned().alias("years")).withColumn(
        "recharge_mm", F.col("total") / F.col("years"))


def baseflow_recharge(q: DataFrame, area_km2: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """Filtered baseflow volume per year over the catchment, in mm."""
    k = list(keys)
    d = lyne_hollick(q, keys=k).withColumn("step", F.datediff("date", F.lag("date").over(by(k))))
    g = d.groupBy(*k).agg(F.sum("baseflow").alias("b"), F.coalesce(F.percentile("step", F.lit(0.5)), F.lit(1.0)).alias("dt"),
                          years_spanned().alias("years"))
    return g.select(*k, (F.col("b") * F.col("dt") * 86400 / F.col("years") / (area_km2 * 1e6) * 1000).alias("recharge_mm"))


def storage_coefficient(levels: DataFrame, events: DataFrame, area_km2: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """Median specific yield over events (start, end, volume) with a plausible value."""
    k = list(keys)
    at = lambda c, n: levels.select(*k, F.col("date").alias(c), F.col("value").alias(n))
    e = events.join(at("start", "y0"), [*k, "start"]).join(at("end", "y1"), [*k, "end"])
    sy = F.col("volume") / (F.abs(F.col("y1") - F.col("y0")) * area_km2 * 1e6)
    return e.where("y1 <> y0").withColumn("sy", sy).where("sy > 0 AND sy < 1").groupBy(*k).agg(
        F.percentile("sy", F.lit(0.5)).alias("specific_yield"), F.count(F.lit(1)).alias("n_events"))


def hydrograph_stats(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.where("value IS NOT NULL").groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.percentile("value", F.lit(0.5)).alias("median"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"), (F.max("value") - F.min("value")).alias("range"),
        F.count(F.lit(1)).alias("count"))


def storage_anomaly(tws: DataFrame, soil: DataFrame, surface: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Total storage less soil moisture less surface water on common dates."""
    k = [*keys, "date"]
    j = tws.join(soil.withColumnRenamed("value", "soil"), k).join(surface.withColumnRenamed("value", "surface"), k)
    return j.select(*k, (F.col("value") - F.col("soil") - F.col("surface")).alias("value"))


def sigma_anomalies(df: DataFrame, sigma: float = 2.0, keys: Sequence[str] = KEYS) -> DataFrame:
    w = whole(keys)
    z = ratio(F.col("value") - F.avg("value").over(w), F.stddev_samp("value").over(w))
    return df.withColumn("z_score", z).where(F.abs("z_score") >= sigma).withColumn(
        "anomaly", F.when(F.col("z_score") < 0, "depletion").otherwise("surplus"))


def monthly_wells(df: DataFrame, sentinel: float = -999.0) -> DataFrame:
    """Monthly mean level of daily readings without sentinels, stamped on the fifteenth."""
    ok = df.where(F.col("value").isNotNull() & (F.col("value") > sentinel))
    return ok.groupBy("station_id", F.year("date").alias("y"), F.month("date").alias("m")).agg(
        F.avg("value").alias("value"), F.count(F.lit(1)).alias("n_days")).select(
        "station_id", F.make_date("y", "m", F.lit(15)).alias("date"), "value", "n_days")


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("math", "numbered")]
