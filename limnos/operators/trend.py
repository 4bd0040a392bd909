"""Monotonic trend tests on daily-bounded series.

Kendall's score counts sign(x_j - x_i) over all pairs of a series. Pairs are never formed: at every
power-of-two level a row meets only the running counts of its block, so the score costs n log n
rows and two sorts whatever the length.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.functions.arith import ratio
from limnos.functions.special import norm_cdf
from limnos.operators.series import KEYS, by, numbered, per_series, whole


def kendall_score(df: DataFrame, keys: Sequence[str] = KEYS, pos: str = "rn", n: str = "n", value: str = "value") -> DataFrame:
    """Concordant minus discordant pairs per key; ``pos`` numbers the rows from 1 in series order."""
    k = list(keys)
    i = F.col(pos) - 1
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col(n), F.lit(2)).cast("double"))).cast("int") - 1)
    lv = df.select(*k, i.alias("_i"), F.col(value).alias("_v"), F.explode(F.sequence(F.lit(0), depth)).alias("_l"))
    lv = lv.withColumn("_blk", F.expr("shiftright(_i, _l + 1)")).withColumn("_right", F.expr("shiftright(_i, _l) & 1"))
    left = F.when(F.col("_right") == 0, 1).otherwise(0)
    w = Window.partitionBy(*k, "_l", "_blk")
    le = F.sum(left).over(w.orderBy("_v").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ge = F.sum(left).over(w.orderBy(F.desc("_v")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    d = lv.withColumn("_d", F.when(F.col("_right") == 1, le - ge).otherwise(0))
    return d.groupBy(*k).agg(F.sum("_d").alias("s"))


def tie_sums(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    t = df.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("t"))
    c = F.col("t")
    return t.groupBy(*keys).agg(F.sum("t").alias("n"), F.sum(c * (c - 1) * (2 * c + 5)).alias("tie_sum"),
                                F.sum(c * (c - 1) / 2).alias("tie_pairs"))


_LEAF = 64
_BEFORE = np.triu(np.ones((_LEAF, _LEAF), bool), 1)


def _slopes_at_most(v: np.ndarray, s: float) -> int:
    """Pairs i < j with (v_j - v_i)/(j - i) <= s: inversions (with ties) of v - s i, by merging blocks."""
    pads = -len(v) % _LEAF
    a = np.concatenate((v - s * np.arange(len(v)), np.full(pads, np.inf)))
    leaves = a.reshape(-1, _LEAF)
    total = -pads * (pads - 1) // 2  # the pads are equal to each other only
    for at in range(0, len(leaves), 64):
        part = leaves[at:at + 64]
        total += int(((part[:, None, :] <= part[:, :, None]) & _BEFORE).sum())
    leaves.sort(axis=1)
    width, n = _LEAF, len(a)
    while width < n:
        for lo in range(0, n - width, 2 * width):
            left, right = a[lo:lo + width], a[lo + width:lo + 2 * width]
            total += int((len(left) - np.searchsorted(left, right, "left")).sum())
            a[lo:lo + 2 * width] = np.sort(a[lo:lo + 2 * width], kind="stable")
        width *= 2
    return total


def median_slope(v: np.ndarray) -> float:
    """Median pairwise slope, found by searching the slope value; the pairs are counted, never held."""
    n = len(v)
    if n < 2:
        return 0.0
    pairs = n * (n - 1) // 2

    def kth(rank: int) -> float:
        step = float(np.abs(np.diff(v)).max())
        lo, hi = -step, step
        for _ in range(200):
            mid = (lo + hi) / 2
            if mid in (lo, hi):
                break
            if _slopes_at_most(v, mid) >= rank:
                hi = mid
            else:
                lo = mid
        return hi if abs(hi) > 1e-14 * step else 0.0

    lower, upper = kth((pairs + 1) // 2), kth(pairs // 2 + 1)
    return float((lower + upper) / 2)


_SHORT = 64  # values of a series whose pairs are held, at most 2016


def median_slopes(v: np.ndarray) -> np.ndarray:
    """``median_slope`` of every row of a matrix of short series, from all their pairs."""
    m, n = v.shape
    if n < 2:
        return np.zeros(m)
    i, j = np.triu_indices(n, 1)
    out, at_once = np.zeros(m), max(1, 1_000_000 // len(i))
    middle = [(len(i) + 1) // 2 - 1, len(i) // 2]
    for at in range(0, m, at_once):
        x = v[at:at + at_once]
        step = np.abs(np.diff(x, axis=1)).max(axis=1)
        mid = np.partition((x[:, j] - x[:, i]) / (j - i), middle, axis=1)[:, middle]
        mid = np.where(np.abs(mid) > 1e-14 * step[:, None], mid, 0.0)
        out[at:at + at_once] = np.where(np.isfinite(step), (mid[:, 0] + mid[:, 1]) / 2, 0.0)
    return out


def sens_slope(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sen's slope per step and its intercept. Tasks take sorted rows batch by batch, many short series at once."""
    k = list(keys)
    types = dict(df.dtypes)

    def fit(t: pa.Table) -> pa.Table:
        v, first = t.column("value").to_numpy(), np.flatnonzero(t.column("_rn").to_numpy() == 1)
        size = np.diff(np.append(first, len(v)))
        slope, middle = np.zeros(len(first)), np.zeros(len(first))
        for n in np.unique(size):
            own = np.flatnonzero(size == n)
            if n <= _SHORT:
                x = v[first[own][:, None] + np.arange(n)]
                with np.errstate(invalid="ignore"):
                    slope[own], middle[own] = median_slopes(x), np.median(x, axis=1)
            else:
                for s in own:
                    x = v[first[s]:first[s] + n]
                    slope[s], middle[s] = median_slope(x), np.median(x)
        head = t.select(k).take(pa.array(first)).combine_chunks()
        fitted = {"slope": slope, "intercept": middle - (size - 1) / 2 * slope, "n_samples": size.astype(np.int64)}
        return pa.Table.from_arrays([*head.columns, *[pa.array(c) for c in fitted.values()]], names=[*k, *fitted]).combine_chunks()

    def task(batches):
        held: list[pa.RecordBatch] = []  # a series whose end has not come yet
        for batch in batches:
            first = np.flatnonzero(batch.column("_rn").to_numpy() == 1)
            if len(first):
                whole_series = [*held, batch.slice(0, first[-1])]
                held = [batch.slice(first[-1])]
                if sum(b.num_rows for b in whole_series):
                    yield from fit(pa.Table.from_batches(whole_series)).to_batches()
            else:
                held.append(batch)
        if sum(b.num_rows for b in held):
            yield from fit(pa.Table.from_batches(held)).to_batches()

    last = Window.partitionBy(*k).orderBy(F.col("date").asc_nulls_last())  # a row without a date comes last
    d = df.where("value IS NOT NULL").select(*k, F.col("value").cast("double").alias("value"), F.row_number().over(last).alias("_rn"))
    schema = ", ".join([f"{c} {types[c]}" for c in k] + ["slope double, intercept double, n_samples long"])
    return d.sortWithinPartitions(*k, "_rn").mapInArrow(task, schema)


def z_and_p(d: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Continuity-corrected z, two-sided p and the verdict from ``s`` and ``var_s``."""
    s = F.col("s")
    z = F.when(F.col("var_s") <= 0, 0.0).when(s > 0, (s - 1) / F.sqrt("var_s")).when(s < 0, (s + 1) / F.sqrt("var_s")).otherwise(0.0)
    d = d.withColumn("z", z).withColumn("_a", -F.abs("z")).withColumn("p_value", 2 * norm_cdf("_a")).drop("_a")
    return d.withColumn("trend", F.when((F.col("p_value") < alpha) & (F.col("z") > 0), "increasing")
                        .when((F.col("p_value") < alpha) & (F.col("z") < 0), "decreasing").otherwise("no trend"))


def mann_kendall(df: DataFrame, keys: Sequence[str] = KEYS, alpha: float = 0.05, min_n: int = 3, slope: bool = True) -> DataFrame:
    """Score, tie-corrected variance, z, p, tau and Sen's line per key."""
    k = list(keys)
    s = numbered(df, k).where(F.col("n") >= min_n)
    d = kendall_score(s, k).join(tie_sums(s, k), k)
    n = F.col("n").cast("double")
    d = d.withColumn("var_s", (n * (n - 1) * (2 * n + 5) - F.col("tie_sum")) / 18).withColumn("tau", F.col("s") / (n * (n - 1) / 2))
    d = z_and_p(d, alpha).select(*k, "n", "s", "var_s", "z", "p_value", "tau", "trend")
    return d.join(sens_slope(df, k).drop("n_samples"), k) if slope else d


def annual_trend(df: DataFrame, keys: Sequence[str] = KEYS, share: float = 0.8, min_years: int = 8) -> DataFrame:
    """Trend of the annual means over years with enough of the usual number of values."""
    k = list(keys)
    y = df.where("value IS NOT NULL").groupBy(*k, F.year("date").alias("year")).agg(
        F.avg("value").alias("value"), F.count(F.lit(1)).alias("c"))
    usual = y.groupBy(*k).agg(F.percentile("c", F.lit(0.5)).alias("usual"))
    y = y.join(usual, k).where(F.col("c") >= share * F.col("usual"))
    y = y.withColumn("ny", F.count(F.lit(1)).over(whole(k))).where(F.col("ny") >= min_years)
    return mann_kendall(y.select(*k, F.make_date("year", F.lit(1), F.lit(1)).alias("date"), "value"), k)


def lag1(df: DataFrame, keys: Sequence[str] = KEYS, col: str = "value") -> DataFrame:
    """Lag-one autocorrelation with the full-series mean and variance."""
    k = list(keys)
    m = F.avg(col).over(whole(k))
    d = df.withColumn("_c", F.col(col) - m)
    d = d.withColumn("_p", F.lag("_c").over(by(k)))
    return d.groupBy(*k).agg(ratio(F.sum(F.col("_c") * F.col("_p")), F.sum(F.col("_c") * F.col("_c"))).alias("r1"))


def _acf(x: np.ndarray) -> np.ndarray:
    c = x - x.mean()
    full = np.correlate(c, c, "full")[len(c) - 1:]
    return full / full[0] if full[0] else np.zeros(len(c))


def variance_inflation(df: DataFrame, method: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Factor on the score variance for serial correlation (monthly or annual series)."""
    k = list(keys)
    types = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf.sort_values("date")["value"].to_numpy(float)
        n = len(v)
        flat = v - median_slope(v) * np.arange(1, n + 1)
        lags = np.arange(1, n)
        if method == "hamed_rao":
            rho = _acf(pd.Series(flat.round(9)).rank().to_numpy())[1:]  # months that set the slope tie, whatever the last digit
            rho = np.where(np.abs(rho) > 1.959963984540054 / math.sqrt(n), rho, 0.0)
            f = 1 + 2 / (n * (n - 1) * (n - 2)) * float((((n - lags) * (n - lags - 1) * (n - lags - 2)) * rho).sum())
        else:
            f = 1 + 2 * float(((1 - lags / n) * _acf(flat)[1:]).sum())
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in k}, "factor": [f]})

    schema = ", ".join([f"{c} {types[c]}" for c in k] + ["factor double"])
    return per_series(df.where("value IS NOT NULL").select(*k, "date", "value"), k, run, schema)


def mann_kendall_modified(df: DataFrame, method: str, keys: Sequence[str] = KEYS, alpha: float = 0.05) -> DataFrame:
    """The serial-correlation variants: variance factors, pre-whitening and trend-free pre-whitening."""
    k = list(keys)
    if method in ("hamed_rao", "yue_wang"):
        base = mann_kendall(df, k, alpha)
        d = base.drop("z", "p_value", "trend").join(variance_inflation(df, method, k), k)
        return z_and_p(d.withColumn("var_s", F.col("var_s") * F.col("factor")).drop("factor"), alpha)
    line = sens_slope(df, k)
    s = numbered(df, k).drop("n")
    if method == "tfpw":
        s = s.join(line.select(*k, "slope"), k).withColumn("value", F.col("value") - F.col("slope") * F.col("rn"))
    elif method != "pre_whitening":
        raise ValueError(f"unknown variant {method!r}")
    w = s.join(lag1(s, k), k).withColumn("prev", F.lag("value").over(by(k)))
    v: Column = F.col("value") - F.col("r1") * F.col("prev")
    if method == "tfpw":
        v = v + F.col("slope") * (F.col("rn") - 1)
    w = w.where("prev IS NOT NULL").select(*k, "date", v.alias("value"))
    return mann_kendall(w, k, alpha, slope=False).join(line.select(*k, "slope", "intercept"), k)
