"""Crop water, irrigation and soil-moisture accounting for many fields at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.functions import eto as E
from limnos.functions.dims import small_table
from limnos.operators.scan import between_resets, clamped_scan
from limnos.operators.series import per_series

# Crop, single coefficient (initial, mid, late), basal coefficient (initial, mid, late),
# stage lengths in days (initial, development, mid, late).
CROPS = (
    ("wheat_winter", 0.4, 1.15, 0.25, 0.15, 1.10, 0.25, 30, 140, 40, 30),
    ("maize", 0.3, 1.20, 0.60, 0.15, 1.15, 0.50, 20, 35, 40, 30),
    ("rice_paddy", 1.05, 1.20, 0.90, 1.00, 1.15, 0.70, 30, 30, 60, 30),
    ("soybean", 0.4, 1.15, 0.50, 0.15, 1.10, 0.30, 20, 30, 60, 25),
    ("cotton", 0.35, 1.15, 0.70, 0.15, 1.10, 0.50, 30, 50, 55, 45),
    ("sugarcane", 0.40, 1.25, 0.75, 0.15, 1.20, 0.70, 35, 60, 190, 120),
    ("tomato", 0.60, 1.15, 0.80, 0.15, 1.10, 0.70, 30, 40, 40, 25),
    ("potato", 0.50, 1.15, 0.75, 0.15, 1.10, 0.65, 25, 30, 45, 30),
    ("grape", 0.30, 0.85, 0.45, 0.15, 0.80, 0.40, 20, 40, 120, 60),
    ("citrus", 0.65, 0.60, 0.65, 0.60, 0.55, 0.60, 60, 90, 120, 95),
    ("olive", 0.65, 0.70, 0.65, 0.55, 0.65, 0.55, 30, 90, 60, 90),
    ("sunflower", 0.35, 1.05, 0.35, 0.15, 1.00, 0.30, 25, 35, 45, 25),
    ("barley", 0.30, 1.15, 0.25, 0.15, 1.10, 0.15, 15, 25, 50, 30),
    ("alfalfa", 0.40, 0.95, 0.90, 0.30, 0.90, 0.85, 10, 30, 25, 10),
    ("onion", 0.70, 1.05, 0.75, 0.15, 1.00, 0.70, 15, 25, 70, 40),
    ("cabbage", 0.70, 1.05, 0.95, 0.15, 1.00, 0.90, 20, 25, 60, 15),
    ("pepper", 0.60, 1.05, 0.90, 0.15, 1.00, 0.80, 25, 35, 40, 20),
    ("banana", 0.50, 1.10, 1.00, 0.15, 1.05, 0.90, 120, 60, 180, 5),
    ("coffee", 0.90, 0.95, 0.95, 0.85, 0.90, 0.90, 60, 90, 120, 60),
    ("tea", 0.95, 1.00, 1.00, 0.90, 0.95, 0.95, 60, 90, 120, 60),
    ("sorghum", 0.30, 1.05, 0.55, 0.15, 0.95, 0.35, 20, 35, 40, 30),
    ("groundnut", 0.40, 1.15, 0.60, 0.15, 1.10, 0.50, 25, 35, 45, 25),
    ("sugar_beet", 0.35, 1.20, 0.70, 0.15, 1.15, 0.50, 30, 45, 90, 15),
)
CROP_COLS = (["crop", "kc_ini", "kc_mid", "kc_late", "kcb_ini", "kcb_mid", "kcb_late", "l_ini", "l_dev", "l_mid", "l_late"],
             ["string"] + ["double"] * 10)


def crops(spark: SparkSession) -> DataFrame:
    return small_table(spark, CROPS, *CROP_COLS)


def crop_coefficients(spark: SparkSession) -> DataFrame:
    """(crop, stage, kc, kcb) rows."""
    st = [F.struct(F.lit(s).alias("stage"), F.col(f"kc_{c}").alias("kc"), F.col(f"kcb_{c}").alias("kcb"))
          for s, c in (("initial", "ini"), ("mid", "mid"), ("late", "late"))]
    return crops(spark).select("crop", F.explode(F.array(*st)).alias("s")).select("crop", "s.*")


def reference_et(weather: DataFrame) -> DataFrame:
    c = F.col
    et = E.penman_monteith(c("t_min"), c("t_max"), c("rh_min"), c("rh_max"), c("wind_speed"), c("solar_radiation"),
                           c("latitude"), c("elevation"), F.dayofyear("date"))
    return weather.select("station_id", "date", et.alias("eto"))


def effective_rain(p: Column, method: str = "usda") -> Column:
    if method == "usda":
        v = F.when(p < 250, F.greatest(p * (125 - 0.2 * p) / 125, F.lit(0.0))).otherwise(p * 0.1 + 100)
    elif method == "fao":
        v = F.when(p <= 5, 0.0).when(p <= 70, p * 0.8 - 5).otherwise(p * 0.6)
    elif method == "fixed_fraction":
        v = p * 0.7
    else:
        raise ValueError(f"unknown method {method!r}")
    return F.when(p <= 0, 0.0).otherwise(v)


def soil_evaporation(kcb: Column, kc_max: float = 1.2, few: float = 1.0, kr: float = 1.0) -> Column:
    return F.greatest(F.least(kr * (kc_max - kcb), F.lit(few * kc_max)), F.lit(0.0))


def _stage_value(day: Column, ini: str, mid: str, late: str) -> Column:
    c = F.col
    a, b = c("l_ini"), c("l_ini") + c("l_dev")
    m, e = b + c("l_mid"), b + c("l_mid") + c("l_late")
    return (F.when(day < a, c(ini)).when(day < b, c(ini) + (day - a) / c("l_dev") * (c(mid) - c(ini))).when(day < m, c(mid))
            .when(day < e, c(mid) + (day - m) / c("l_late") * (c(late) - c(mid))).otherwise(c(late)))


def crop_calendar(fields: DataFrame, et: DataFrame, dual: bool = False) -> DataFrame:
    """Every season day of every field: stage, coefficient, reference and crop evapotranspiration.

    A day without weather takes its station's mean.
    """
    f = fields.join(F.broadcast(crops(fields.sparkSession)), "crop")
    total = (F.col("l_ini") + F.col("l_dev") + F.col("l_mid") + F.col("l_late")).cast("int")
    d = f.withColumn("day", F.explode(F.sequence(F.lit(0), total - 1))).withColumn("date", F.date_add("planting_date", F.col("day")))
    mean = et.groupBy("station_id").agg(F.avg("eto").alias("_m"))
    d = d.join(et, ["station_id", "date"], "left").join(mean, "station_id", "left").withColumn("eto", F.coalesce("eto", "_m"))
    day = F.col("day")
    stage = (F.when(day < F.col("l_ini"), "initial").when(day < F.col("l_ini") + F.col("l_dev"), "development")
             .when(day < F.col("l_ini") + F.col("l_dev") + F.col("l_mid"), "mid").otherwise("late"))
    d = d.withColumn("stage", stage).withColumn("kc", _stage_value(day, "kc_ini", "kc_mid", "kc_late"))
    cols = ["field_id", "station_id", "crop", "date", "stage", F.round("kc", 3).alias("kc"), F.round("eto", 2).alias("eto")]
    if not dual:
        return d.select(*cols, F.round(F.col("kc") * F.col("eto"), 2).alias("etc"))
    d = d.withColumn("kcb", _stage_value(day, "kcb_ini", "kcb_mid", "kcb_late")).withColumn("ke", soil_evaporation(F.col("kcb")))
    return d.select(*cols, F.round("kcb", 3).alias("kcb"), F.round("ke", 3).alias("ke"),
                    F.round(F.col("kcb") + F.col("ke"), 3).alias("kc_dual"),
                    F.round((F.col("kcb") + F.col("ke")) * F.col("eto"), 2).alias("etc"))


def season_end(fields: DataFrame) -> DataFrame:
    f = fields.join(F.broadcast(crops(fields.sparkSession)), "crop")
    n = (F.col("l_ini") + F.col("l_dev") + F.col("l_mid") + F.col("l_late")).cast("int")
    return f.select("field_id", "crop", "planting_date", F.date_add("planting_date", n - 1).alias("season_end"))


def irrigation_schedule(calendar: DataFrame, precip: DataFrame, efficiency: float = 0.7) -> DataFrame:
    """Effective rain and net / gross irrigation need per field day; a day without rain data counts as dry."""
    d = calendar.join(precip.select("station_id", "date", F.col("value").alias("precip")), ["station_id", "date"], "left")
    d = d.withColumn("precip", F.coalesce("precip", F.lit(0.0)))
    eff = effective_rain(F.col("precip"))
    net = F.greatest(F.col("etc") - eff, F.lit(0.0))
    return (d.withColumn("effective_rain", F.round(eff, 2)).withColumn("net_irrigation", F.round(net, 2))
            .withColumn("gross_irrigation", F.round(net / efficiency if efficiency > 0 else net, 2)))


def soil_balance(df: DataFrame, taw: float, raw: float, start: float = 0.0, refill: bool = False, efficiency: float = 0.7,
                 keys: Sequence[str] = ("station_id",)) -> DataFrame:
    """Root-zone depletion bucket from daily ``etc`` and ``precip``; with ``refill`` it is irrigated back at the trigger.

    The store is cut off at both ends every day, which no window expresses: a prefix scan over one season or record, anew after each
    irrigation.
    """
    k = list(keys)
    types = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        etc, rain = pdf["etc"].to_numpy(float), pdf["precip"].fillna(0.0).to_numpy(float)
        n = len(etc)
        depletion, perc, irr, before = np.empty(n), np.zeros(n), np.zeros(n), [start]

        def scan(at: int, to: int):
            change = etc[at:to] - rain[at:to]
            # a depletion at the trigger is irrigated away before the day's change
            net = before[0] if refill and before[0] >= raw else 0.0
            dep = clamped_scan(1.0, change, 0.0, taw, before[0] - net)

            def accept(k: int) -> None:
                irr[at] = net / efficiency if efficiency > 0 else net
                depletion[at:at + k + 1] = dep[:k + 1]
                perc[at:at + k + 1] = np.maximum(0.0, -(np.concatenate(([before[0] - net], dep[:k])) + change[:k + 1]))
                before[0] = float(dep[k])
            return (dep >= raw) & refill, accept

        between_resets(n, scan)
        return pdf[[*k, "date"]].assign(soil_moisture=taw - depletion, depletion=depletion, deep_percolation=perc,
                                        irrigation=irr, irrigation_trigger=depletion >= raw)

    schema = ", ".join([f"{c} {types[c]}" for c in k] + [
        "date date, soil_moisture double, depletion double, deep_percolation double, irrigation double, irrigation_trigger boolean"])
    return per_series(df.select(*k, "date", "etc", "precip"), k, run, schema)


def irrigation_plan(schedule: DataFrame, taw: float, raw: float, efficiency: float = 0.7) -> DataFrame:
    """Season totals per field: schedule sums beside the applied irrigation of the balanced bucket."""
    bal = soil_balance(schedule, taw, raw, refill=True, efficiency=efficiency, keys=["field_id"])
    b = bal.groupBy("field_id").agg(F.sum(F.round("irrigation", 2)).alias("total_applied_irrigation"),
                                    F.sum(F.col("irrigation_trigger").cast("long")).alias("trigger_days"))
    tot = {"total_eto": "eto", "total_precipitation": "precip", "total_effective_rain": "effective_rain", "total_etc": "etc",
           "total_net_irrigation": "net_irrigation", "total_gross_irrigation": "gross_irrigation"}
    s = schedule.groupBy("field_id", "crop").agg(F.max("date").alias("season_end"), *[F.sum(c).alias(n) for n, c in tot.items()])
    return s.join(b, "field_id")
