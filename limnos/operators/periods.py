"""Calendar resampling, climatology and period summaries of daily-bounded series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.functions.arith import ratio
from limnos.operators.series import KEYS, whole

HOW = {"avg": F.avg, "sum": F.sum, "max": F.max, "min": F.min}


def fill_calendar(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every day between a series' first and last, null where nothing was observed."""
    span = df.groupBy(*keys).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = span.select(*keys, F.explode(F.sequence("a", "b")).alias("date"))
    return days.join(df, [*keys, "date"], "left")


def resample(df: DataFrame, unit: str, how: str = "avg", keys: Sequence[str] = KEYS, min_count: int = 0) -> DataFrame:
    """Monthly or yearly value; periods with fewer than ``min_count`` values become null."""
    agg = HOW[how]("value")
    out = df.groupBy(*keys, F.to_date(F.date_trunc(unit, "date")).alias("date")).agg(
        agg.alias("value"), F.count("value").alias("n_obs"))
    return out.withColumn("value", F.when(F.col("n_obs") >= min_count, F.col("value"))) if min_count else out


def annual_max(df: DataFrame, keys: Sequence[str] = KEYS, min_days: int = 0) -> DataFrame:
    """Block maxima per calendar year, optionally only of years with enough daily values."""
    out = df.groupBy(*keys, F.year("date").cast("long").alias("year")).agg(
        F.max("value").alias("value"), F.count("value").alias("n_days"))
    return out.where((F.col("n_days") >= min_days) & F.col("value").isNotNull())


def annual_cycle(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.groupBy(*keys, F.month("date").cast("long").alias("month")).agg(F.avg("value").alias("value"))


def monthly_climatology(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean per calendar month, annual mean of those, seasonal CV and driest-to-mean index."""
    m = annual_cycle(df, keys)
    mean, sd = F.avg("value"), F.stddev_samp("value")
    return m.groupBy(*keys).agg(mean.alias("annual_mean"),
                                F.when(mean != 0, sd / mean * 100).otherwise(0.0).alias("seasonal_cv"),
                                F.when(mean > 0, F.min("value") / mean).alias("baseflow_index"))


def time_slice(df: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Rows of a year range as a date-literal filter, so it reaches the scan."""
    return df.where(F.col("date").between(F.lit(f"{first_year}-01-01").cast("date"), F.lit(f"{last_year}-12-31").cast("date")))


def anomaly(df: DataFrame, first_year: int, last_year: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Departure from the mean over the baseline years."""
    base = F.avg(F.when(F.year("date").between(first_year, last_year), F.col("value"))).over(whole(keys))
    return df.withColumn("anomaly", F.col("value") - base)


def linear_trend(df: DataFrame, x: Column, keys: Sequence[str] = KEYS) -> DataFrame:
    """Least squares of value on ``x`` with the standard error of the slope in closed form."""
    rows = df.where("value IS NOT NULL").withColumn("_x", x.cast("double"))
    fit = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("value", "_x").alias("slope"),
        F.regr_intercept("value", "_x").alias("intercept"), F.regr_r2("value", "_x").alias("r2"),
        F.regr_sxx("value", "_x").alias("sxx"), F.regr_syy("value", "_x").alias("syy"))
    se = F.sqrt(ratio(F.greatest(F.lit(0.0), (1 - F.col("r2")) * F.col("syy")) / (F.col("n") - 2), F.col("sxx")))
    return fit.where("n >= 3").withColumn("slope_se", se).withColumn(
        "t_stat", F.when(F.col("slope_se") > 0, F.col("slope") / F.col("slope_se"))).drop("sxx", "syy")


def trend_significance(fit: DataFrame, confidence: float = 0.95) -> DataFrame:
    """p-value and confidence bounds of a ``linear_trend`` result (one row per key)."""
    from limnos.functions.special import t_ppf, t_two_sided

    dof = (F.col("n") - 2).cast("double")
    half = t_ppf(F.lit((1 + confidence) / 2), dof) * F.col("slope_se")
    return (fit.withColumn("p_value", t_two_sided(F.col("t_stat"), dof)).withColumn("_h", half)
            .withColumn("ci_low", F.col("slope") - F.col("_h")).withColumn("ci_high", F.col("slope") + F.col("_h")).drop("_h"))


def trailing(keys: Sequence[str], rows: int):
    return Window.partitionBy(*keys).orderBy("date").rowsBetween(-(rows - 1), 0)
