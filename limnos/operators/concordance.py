"""Kendall's tau of two columns for keys of any size.

Both columns are cut into at most some ``GRID`` buckets of a key by their ranks; a value that would fill a bucket alone gets one of its
own. Pairs of rows that differ in both buckets are counted on the table of bucket pairs, whatever the number of rows. Pairs inside an x bucket, and pairs
inside a y bucket from different x buckets, are counted bucket by bucket, so a key spreads over as many tasks as it has buckets. Rows in
the bucket of one single value tie there and need no count.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.functions.arith import ratio
from limnos.functions.special import norm_cdf
from limnos.operators.series import avg_rank_expr, value_ranks
from limnos.operators.trend import _slopes_at_most
from limnos.session import cut

ROWS = 20_000
GRID = 512


def bucketed(df: DataFrame, x: str, y: str, keys: Sequence[str], rows: int = ROWS, grid: int = GRID) -> DataFrame:
    """Rows with both values: keys, x, y, average ranks ``rx`` / ``ry``, buckets ``bx`` / ``by`` (odd ones hold one value) and ``n``."""
    k = list(keys)
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*k, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    span = F.when(F.col("n") <= rows, F.col("n") + 1).otherwise(F.greatest(F.lit(rows), F.ceil(F.col("n") / grid)))

    def side(c: str, *more: str) -> DataFrame:
        bucket = 2 * F.floor(F.col("n_less") / span) + (F.col("cnt") >= span).cast("long")
        return value_ranks(d, k, c).select(*k, F.col("value").alias(c), bucket.alias(f"b{c}"), avg_rank_expr().alias(f"r{c}"), *more)

    return cut(d.join(side("x", "n"), [*k, "x"]).join(side("y"), [*k, "y"]))


def _inside(rows: DataFrame, keys: Sequence[str], k: Sequence[str], first: str, second: str) -> DataFrame:
    """(key, s): score of the pairs inside groups of ``keys`` that differ in ``first``; a group is a bucket and fits a task."""
    types = dict(rows.dtypes)

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in k}, "s": [float(_concordance(pdf[first].to_numpy(), pdf[second].to_numpy()))]})

    return rows.select(*keys, first, second).groupBy(*keys).applyInPandas(score, ", ".join([*[f"{c} {types[c]}" for c in k], "s double"]))


def _concordance(x: np.ndarray, y: np.ndarray) -> int:
    """Rising minus falling pairs among those that differ in both."""
    x, y = (np.unique(v, return_inverse=True)[1] for v in (x, y))
    order = np.lexsort((y, x))
    x, v = x[order], y[order].astype(float)
    # rows that tie in x are ordered by y and count as rising
    inside = lambda c: int((c * (c - 1) // 2).sum())
    same_x, same = np.bincount(x), np.diff(np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (v[1:] != v[:-1]), [True]))))
    return _slopes_at_most(-v, 0.0) - _slopes_at_most(v, 0.0) - inside(same_x) + inside(same)


def _across(cells: pd.DataFrame) -> float:
    """Score of all pairs that differ in both buckets."""
    i, j = (np.unique(cells[c], return_inverse=True)[1] for c in ("bx", "by"))
    c = np.zeros((i.max() + 1, j.max() + 1))
    c[i, j] = cells["c"]
    above = np.cumsum(c, axis=0) - c  # smaller x bucket, same y bucket
    less = np.cumsum(above, axis=1) - above
    more = above.sum(1, keepdims=True) - less - above
    return float((c * (less - more)).sum())


def kendall_tau_b(df: DataFrame, x: str, y: str, keys: Sequence[str], rows: int = ROWS, grid: int = GRID) -> DataFrame:
    """Keys, n, score s and tau-b of every key; rows with a null on either side are left out, a key without spread has a null tau."""
    return tau_of(bucketed(df, x, y, keys, rows, grid), keys, rows).select(*keys, "n", "s", "tau")


def tau_of(r: DataFrame, keys: Sequence[str], rows: int = ROWS) -> DataFrame:
    """Score, tau-b and the tie-corrected normal p-value from ``bucketed`` rows."""
    k = list(keys)
    types = dict(r.dtypes)
    large = r.where(F.col("n") > rows)
    cells = large.groupBy(*k, "bx", "by").agg(F.count(F.lit(1)).cast("double").alias("c"))

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in k}, "s": [_across(pdf)]})

    grid = cells.groupBy(*k).applyInPandas(across, ", ".join([*[f"{c} {types[c]}" for c in k], "s double"]))  # at most (2 GRID + 2) ** 2 cells a key
    parts = _inside(r.where("bx % 2 = 0"), [*k, "bx"], k, "x", "y").unionByName(_inside(large.where("by % 2 = 0"), [*k, "by"], k, "bx", "y")).unionByName(grid)
    score = parts.groupBy(*k).agg(F.sum("s").alias("s"))
    t = F.col("t")

    def ties(c: str) -> DataFrame:
        g = r.groupBy(*k, c).agg(F.count(F.lit(1)).cast("double").alias("t"))
        return g.groupBy(*k).agg(F.sum("t").cast("long").alias("n"), F.sum(t * (t - 1) / 2).alias(f"t{c}"), F.sum(t * (t - 1) * (t - 2)).alias(f"u{c}"), F.sum(t * (t - 1) * (2 * t + 5)).alias(f"v{c}"))

    j = ties("x").join(ties("y").drop("n"), k).join(score, k, "left").fillna(0.0, ["s"])
    n = F.col("n").cast("double")
    pairs, m = n * (n - 1) / 2, n * (n - 1)
    j = j.withColumn("tau", ratio(F.col("s"), F.sqrt((pairs - F.col("tx")) * (pairs - F.col("ty")))))
    spread = (m * (2 * n + 5) - F.col("vx") - F.col("vy")) / 18 + F.when(n > 1, 2 * F.col("tx") * F.col("ty") / m).otherwise(0.0) + F.when(n > 2, F.col("ux") * F.col("uy") / (9 * m * (n - 2))).otherwise(0.0)
    j = j.withColumn("_z", F.when(spread > 0, -F.abs("s") / F.sqrt(spread)))
    return j.withColumn("p_value", 2 * norm_cdf("_z")).select(*k, "n", "s", "tau", "p_value")


def pair_dependence(pairs: DataFrame, keys: Sequence[str] = ("param1", "param2"), q: float = 0.1, least: int = 30, rows: int = ROWS, grid: int = GRID) -> DataFrame:
    """Kendall's tau with its p-value and the joint tail shares at level ``q`` of every pair of parameters with at least ``least`` rows.

    ``pairs`` holds the keys, x and y. Tails use average ranks over n + 1. The p-value is the normal one, corrected for ties in both columns.
    """
    k = list(keys)
    r = bucketed(pairs, "x", "y", k, rows, grid)
    u, v = F.col("rx") / (F.col("n") + 1), F.col("ry") / (F.col("n") + 1)
    up, low = (u > 1 - q) & (v > 1 - q), (u < q) & (v < q)
    tails = r.groupBy(*k).agg((F.avg(up.cast("double")) / q).alias("upper_tail_dep"), (F.avg(low.cast("double")) / q).alias("lower_tail_dep"))
    return tau_of(r, k, rows).where(F.col("n") >= least).join(tails, k).select(*k, "n", "tau", "p_value", "upper_tail_dep", "lower_tail_dep")
