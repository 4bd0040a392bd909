"""The donor table: signatures in depth units for every station with enough record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.operators.flow import signatures
from limnos.operators.periods import annual_max

KEPT = ("baseflow_index", "fdc_slope", "high_flow_frequency", "low_flow_frequency", "zero_flow_fraction", "seasonality_index", "flashiness_index")


def station_signature_table(daily: DataFrame, catchments: DataFrame, min_years: float = 10.0, keys: Sequence[str] = ("station_id",)) -> DataFrame:
    """Stations with an area, ``min_years`` of span and five years of days; flows in mm per day.

    The 5 / 95 percent naming of the signature report is turned back here: q95 is the low flow.
    """
    k = list(keys)
    d = daily.where("value >= 0")
    years = F.datediff(F.max("date"), F.min("date")) / 365.25
    pct = lambda p: F.percentile("value", F.lit(p))
    base = d.groupBy(*k).agg(F.count(F.lit(1)).alias("n_days"), years.alias("n_years"), F.avg("value").alias("m"), pct(0.5).alias("q50"),
                             pct(0.05).alias("lo"), pct(0.95).alias("hi")).where((F.col("n_years") >= min_years) & (F.col("n_days") >= 365 * 5))
    base = base.join(catchments.where("area_km2 > 0"), k)
    am = annual_max(d, k, 292).groupBy(*k).agg(F.avg("value").alias("am"))
    sig = signatures(d, k).select(*k, *KEPT)
    mm = lambda c: F.col(c) * 86.4 / F.col("area_km2")
    return base.join(am, k, "left").join(sig, k).select(
        *k, "n_days", "n_years", mm("m").alias("q_mean_mm"), mm("q50").alias("q_median_mm"), mm("lo").alias("q95_mm"), mm("hi").alias("q05_mm"),
        mm("am").alias("q_annual_max_mm"), F.when(F.col("precipitation_mm_yr") > 0, mm("m") * 365.25 / F.col("precipitation_mm_yr")).alias("runoff_ratio"), *KEPT)
