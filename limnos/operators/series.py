"""Shared sequence primitives.

Contract for the ordered operators: their input holds one row per key and day (``daily_series``
makes it so with a map-side combined aggregate). That bounds the history of a key by the calendar
-- a century is 36 525 rows -- however many raw samples the key has, so a ``Window`` or a grouped
fold over one key always fits one task. Operators over raw samples never gather a key: they go
through ``value_ranks`` / ``exact_quantiles``, which split each key into many value buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("station_id",)


def by(keys: Sequence[str], order: str = "date"):
    """Window over one key in time order."""
    return Window.partitionBy(*keys).orderBy(order)


def whole(keys: Sequence[str]):
    return Window.partitionBy(*keys)


def daily_series(df: DataFrame, keys: Sequence[str], ts: str, value: str, how: str = "avg") -> DataFrame:
    """One row per key and day. Partial aggregation runs before the shuffle, so hot keys stay cheap."""
    fn = {"avg": F.avg, "sum": F.sum, "max": F.max, "min": F.min}[how]
    return df.groupBy(*keys, F.to_date(ts).alias("date")).agg(fn(value).alias("value"))


def numbered(df: DataFrame, keys: Sequence[str] = KEYS, order: str = "date") -> DataFrame:
    """Adds ``rn`` (1-based position) and ``n`` (length) after nulls are dropped."""
    df = df.where(F.col("value").isNotNull())
    return df.withColumn("rn", F.row_number().over(by(keys, order))).withColumn(
        "n", F.count(F.lit(1)).over(whole(keys)))


def with_prev(df: DataFrame, keys: Sequence[str] = KEYS, col: str = "value", name: str = "prev",
              order: str = "date") -> DataFrame:
    return df.withColumn(name, F.lag(col).over(by(keys, order)))


def islands(df: DataFrame, hit: Column, keys: Sequence[str] = KEYS, order: str = "date",
            name: str = "run") -> DataFrame:
    """Numbers the maximal runs of consecutive rows where ``hit`` holds; rows outside runs are dropped."""
    w = by(keys, order)
    return (df.withColumn("_hit", F.coalesce(hit, F.lit(False)))
            .withColumn(name, F.sum(F.when(F.col("_hit"), 0).otherwise(1)).over(w.rowsBetween(
                Window.unboundedPreceding, 0)))
            .where("_hit").drop("_hit"))


def value_bucket(value: Column) -> Column:
    """Order-preserving bucket of a double: sign and binary magnitude at 4096 steps per octave."""
    mag = F.floor(F.log2(F.abs(value)) * 4096).cast("long") + F.lit(5_000_000)
    return F.when(value == 0, F.lit(0).cast("long")).when(value > 0, mag).otherwise(-mag)


def value_ranks(df: DataFrame, keys: Sequence[str], value: str = "value", weight: str | None = None) -> DataFrame:
    """Distinct values of each key with ``cnt``, ``n_less`` (rows strictly below) and ``n``.

    Ties collapse in a map-side combined count. The order of a key is then built from two levels:
    bucket totals per key, and positions inside one bucket. No task sees a whole key. With
    ``weight`` the rows are already counts and are ranked as that many equal rows.
    """
    keys = list(keys)
    counts = (df.where(F.col(value).isNotNull())
              .groupBy(*keys, value_bucket(F.col(value)).alias("_b"), F.col(value).alias("value"))
              .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("cnt")))
    totals = counts.groupBy(*keys, "_b").agg(F.sum("cnt").alias("_bn"))
    totals = (totals.withColumn("_base", F.sum("_bn").over(by(keys, "_b").rowsBetween(
                  Window.unboundedPreceding, 0)) - F.col("_bn"))
              .withColumn("n", F.sum("_bn").over(whole(keys))).drop("_bn"))
    inside = by([*keys, "_b"], "value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("_in", F.sum("cnt").over(inside) - F.col("cnt"))
    return (ranked.join(totals, [*keys, "_b"])
            .select(*keys, "value", "cnt", (F.col("_base") + F.col("_in")).alias("n_less"), "n"))


def avg_rank_expr() -> Column:
    """Average rank (1-based, ties share) of a ``value_ranks`` row."""
    return F.col("n_less") + (F.col("cnt") + 1) / 2


def quantile_aggs(probs: dict[str, float]) -> list[Column]:
    """Linear-interpolation quantiles as plain conditional maxima over ``value_ranks`` rows."""
    out = []
    for name, p in probs.items():
        h = F.lit(p) * (F.col("n") - 1)
        pick = lambda r: F.max(F.when((F.col("n_less") <= r) & (r < F.col("n_less") + F.col("cnt")), F.col("value")))  # noqa: E731,B023
        lo, hi, frac = pick(F.floor(h)), pick(F.ceil(h)), F.max(h - F.floor(h))
        out.append((lo + (hi - lo) * frac).alias(name))
    return out


def exact_quantiles(df: DataFrame, keys: Sequence[str], probs: dict[str, float], value: str = "value",
                    weight: str | None = None) -> DataFrame:
    """Exact quantiles per key for keys of any size (numpy's linear rule)."""
    return value_ranks(df, keys, value, weight).groupBy(*keys).agg(*quantile_aggs(probs))


def per_series(df: DataFrame, keys: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame],
               schema: str) -> DataFrame:
    """Runs a small fold over each key's daily-bounded history (sorted frames are up to ``fn``)."""
    return df.groupBy(*keys).applyInPandas(fn, schema)


def block_pairs(df: DataFrame, block_of: Column, n_blocks: int, kernel: Callable[[pd.DataFrame, int, int], pd.DataFrame],
                schema: str) -> DataFrame:
    """All-pairs work without emitting pairs.

    Rows are hashed into ``n_blocks`` blocks of bounded size; each unordered pair of blocks is one
    task whose numpy kernel returns only its reduced result (bin sums, local top-k).
    """
    tagged = df.withColumn("_blk", block_of)
    others = F.sequence(F.lit(0), F.lit(n_blocks - 1))
    spread = (tagged.withColumn("_other", F.explode(others))
              .withColumn("_bi", F.least("_blk", "_other")).withColumn("_bj", F.greatest("_blk", "_other"))
              .drop("_other"))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return kernel(pdf, int(key[0]), int(key[1]))

    return spread.groupBy("_bi", "_bj").applyInPandas(run, schema)


def blocks_for(df: DataFrame, rows_per_block: int = 4000) -> int:
    """Number of blocks so that no block grows with the table (one counting pass)."""
    return max(1, -(-df.count() // rows_per_block))


def interp_between(x: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Linear interpolation, flat outside the known range."""
    return (F.when(x0.isNull(), y1).when(x1.isNull(), y0).when(x1 == x0, y0)
            .otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0)))
