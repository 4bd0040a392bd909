"""Archive bookkeeping: what to harvest next, run health and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pick_stations(catalog: DataFrame, manifest: DataFrame, variable: str, today: str, max_stations: int, refresh_days: int = 30, years: int = 40) -> DataFrame:
    """Stations never harvested first, then the stale ones; stations closed before the window are skipped."""
    now = F.lit(today).cast("date")
    cutoff, closed = F.date_sub(now, refresh_days), F.date_sub(now, int(years * 365.25))
    m = manifest.select("source", "station_id", F.to_date("harvested_at").alias("last"))
    c = catalog.where(F.array_contains("variables", variable)).where(F.col("period_end").isNull() | (F.col("period_end") >= closed))
    d = c.join(m, ["source", "station_id"], "left").where(F.col("last").isNull() | (F.col("last") < cutoff))
    return d.withColumn("fresh", F.col("last").isNull()).orderBy(F.desc("fresh"), "source", "station_id").limit(max_stations).drop("last")


def health(catalog: DataFrame, errors: DataFrame) -> DataFrame:
    """Stations, failures and state per source of a harvest run."""
    a = catalog.groupBy("source").agg(F.count(F.lit(1)).alias("n_stations"))
    b = errors.groupBy("source").agg(F.count(F.lit(1)).alias("n_failed"))
    d = a.join(b, "source", "full").select("source", F.coalesce("n_stations", F.lit(0)).alias("n_stations"), F.coalesce("n_failed", F.lit(0)).alias("n_failed"))
    return d.withColumn("ok", F.col("n_failed") == 0)


def merge_manifest(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Earlier rows of the same day stay unless their (source, variable) ran again."""
    day = current.agg(F.max(F.to_date("run_at")).alias("_d"))
    kept = previous.join(current.select("source", "variable").distinct(), ["source", "variable"], "left_anti")
    kept = kept.join(day, F.to_date("run_at") == F.col("_d"), "left_semi")
    return kept.unionByName(current)
