"""Approximate profiles from mergeable sketches: distinct counts and quantiles that are kept per day and added up for any longer span.

A day's sketch is a few kilobytes whatever the samples of the day, partial aggregates combine before the shuffle, and a span's
sketch is the merge of its days' sketches, so raw samples are read once. Distinct counts are HyperLogLog (a relative standard error of
1.04 / sqrt(2 ** LG) = 1.6 %, exact for few values), quantiles are KLL (rank error below ``RANK_ERROR`` with 99 % certainty, exact up to ``K`` values).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LG = 12
DISTINCT_ERROR = 1.04 / 2 ** (LG / 2)
K = 200
RANK_ERROR = 0.0133
QUANTILES = {"p05": 0.05, "p50": 0.5, "p95": 0.95}


def daily_sketches(df: DataFrame, keys: Sequence[str] = ("station_id",), ts: str = "ts", value: str = "value") -> DataFrame:
    """Keys, date, n, and the sketches ``distinct_values`` and ``values`` of a day's known values; a table to keep and to append to."""
    v = F.col(value).cast("double")
    known = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, F.to_date(ts).alias("date"), v.alias("_v"))
    return known.groupBy(*keys, "date").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg(F.xxhash64("_v"), F.lit(LG)).alias("distinct_values"),
                                            F.kll_sketch_agg_double("_v", F.lit(K)).alias("values"))


def merged(sketches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sketches of longer spans: one row per value of ``by``, which may hold expressions' names added to ``sketches``."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct_values").alias("distinct_values"), F.kll_merge_agg_double("values").alias("values"))


def estimates(sketches: DataFrame, by: Sequence[str], quantiles: dict[str, float] | None = None) -> DataFrame:
    """Columns ``by``, n (exact), n_distinct and the quantiles as the sketches give them."""
    q = QUANTILES if quantiles is None else quantiles
    return sketches.select(*by, "n", F.hll_sketch_estimate("distinct_values").alias("n_distinct"), *[F.kll_sketch_get_quantile_double("values", F.lit(p)).alias(c) for c, p in q.items()])


def approx_profile(df: DataFrame, keys: Sequence[str] = ("station_id",), ts: str = "ts", value: str = "value") -> DataFrame:
    """Keys, year, n, n_distinct and quantiles: days sketched once, merged by year."""
    days = daily_sketches(df, keys, ts, value)
    by = [*keys, "year"]
    return estimates(merged(days.withColumn("year", F.year("date").cast("long")), by), by)
