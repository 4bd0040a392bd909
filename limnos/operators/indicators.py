"""Country-year indicators and cube ratios."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_entities(df: DataFrame, entity: str, indicator: str, digits: int = 4) -> DataFrame:
    """Mean, spread and count per entity and indicator, ranked by mean within the indicator."""
    agg = df.where("value IS NOT NULL").groupBy(F.col(entity).alias("entity"), F.col(indicator).alias("indicator")).agg(
        F.round(F.avg("value"), digits).alias("mean"), F.round(F.stddev_samp("value"), digits).alias("std"),
        F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("indicator").orderBy(F.desc("mean"), "entity")
    return agg.withColumn("rank", F.row_number().over(order).cast("long"))


def ratio_benchmark(df: DataFrame, numerator: str, denominator: str, factor: float = 100.0, top: int | None = None,
                    latest_only: bool = True) -> DataFrame:
    """Ratio of two variables per country and year; the latest year of each country, highest first."""
    pick = lambda v: F.avg(F.when(F.col("variable") == v, F.col("value")))
    both = (df.where(F.col("variable").isin(numerator, denominator)).groupBy("country", "year")
            .agg(pick(numerator).alias("num"), pick(denominator).alias("den")).where("num IS NOT NULL AND den > 0"))
    out = both.withColumn("metric", F.col("num") / F.col("den") * factor)
    if latest_only:
        row = F.max_by(F.struct("year", "num", "den", "metric"), F.col("year"))
        out = out.groupBy("country").agg(row.alias("r")).select("country", "r.*")
    out = out.orderBy(F.desc("metric"), F.desc("year"), "country")
    return out.limit(top) if top else out


def join_cubes(cubes: dict[str, DataFrame], periods: Sequence[str] = ("date", "start_date", "end_date"),
               extra: Sequence[str] = ("bbox",)) -> DataFrame:
    """Inner join of cubes on whichever key columns every cube carries (one counting aggregate per cube)."""
    usable = []
    for df in cubes.values():
        present = [c for c in (*periods, *extra) if c in df.columns]
        counts = df.agg(*[F.count(c).alias(c) for c in present]).first().asDict() if present else {}
        usable.append({c for c in present if counts[c]})
    keys = [c for c in (*periods, *extra) if all(c in u for u in usable)]
    out = None
    for name, df in cubes.items():
        part = df.groupBy(*keys).agg(F.avg("value").alias(name)) if keys else df.agg(F.avg("value").alias(name))
        out = part if out is None else (out.join(part, keys) if keys else out.join(part, F.lit(True)))
    return out


def cube_productivity(joined: DataFrame, numerator: str, denominator: str, keys: Sequence[str]) -> DataFrame:
    """Ratio per key over its periods plus the ratio of sums."""
    n, d = F.col(numerator), F.col(denominator)
    return joined.where(d > 0).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_periods"), F.avg(n / d).alias("mean_ratio"), (F.sum(n) / F.sum(d)).alias("aggregate_ratio"))
