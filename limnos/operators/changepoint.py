"""Change points of daily-bounded series.

Rank statistics are windows over all keys at once. The recursions that reset on their own output
(two-sided sums, skip-ahead regimes, penalised partitions) are small grouped folds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limnos.operators.scan import between_resets, clamped_scan
from limnos.operators.series import KEYS, by, numbered, per_series, whole


def avg_ranks(df: DataFrame, keys: Sequence[str] = KEYS, value: str = "value") -> DataFrame:
    """Average ranks inside daily-bounded keys (ties share)."""
    w = Window.partitionBy(*keys).orderBy(value)
    ties = Window.partitionBy(*keys, value)
    return df.withColumn("rank_avg", F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2)


def pettitt(df: DataFrame, keys: Sequence[str] = KEYS, alpha: float | None = 0.05) -> DataFrame:
    """Pettitt's change point: U_t is a running sum of centred ranks, so one sort and one scan."""
    k = list(keys)
    s = avg_ranks(numbered(df, k), k).where(F.col("n") >= 4)
    run = by(k).rowsBetween(Window.unboundedPreceding, -1)
    # sums of centred values before a row; what lies after it is the total less these (a frame to the
    # end of the series would be recomputed for every row)
    s = s.withColumn("m", F.avg("value").over(whole(k))).withColumn("c", F.col("value") - F.col("m"))
    s = s.withColumn("u", F.abs(F.sum(2 * F.col("rank_avg") - F.col("n") - 1).over(run)))
    s = (s.withColumn("s1", F.sum("c").over(run)).withColumn("s2", F.sum(F.col("c") * F.col("c")).over(run))
         .withColumn("t1", F.sum("c").over(whole(k))).withColumn("t2", F.sum(F.col("c") * F.col("c")).over(whole(k))).where("rn > 1"))
    before, after = F.col("rn") - 1, F.col("n") - F.col("rn") + 1
    parts = (("before", before, F.col("s1"), F.col("s2")), ("after", after, F.col("t1") - F.col("s1"), F.col("t2") - F.col("s2")))
    for name, cnt, a, b in parts:
        s = s.withColumn(f"mean_{name}", F.col("m") + a / cnt).withColumn(
            f"variance_{name}", F.when(cnt > 1, (b - a * a / cnt) / (cnt - 1)).otherwise(0.0))
    best = s.groupBy(*k).agg(F.max_by(
        F.struct("rn", "date", "u", "n", "mean_before", "mean_after", "variance_before", "variance_after"),
        F.struct("u", -F.col("rn"))).alias("b")).select(*k, "b.*")
    n = F.col("n").cast("double")
    best = best.withColumn("p_value", F.least(F.lit(1.0), 2 * F.exp(-6 * F.col("u") * F.col("u") / (n * n * n + n * n))))
    best = best.select(*k, (F.col("rn") - 1).cast("long").alias("index"), F.col("date").alias("change_date"), F.col("u").alias("statistic"), "p_value",
                       "mean_before", "mean_after", "variance_before", "variance_after")
    return best if alpha is None else best.where(F.col("p_value") < alpha)


def segment_stats(df: DataFrame, points: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean and variance between change points: flags become running segment numbers, no range join."""
    k = list(keys)
    s = numbered(df, k).withColumn("i", (F.col("rn") - 1).cast("long"))
    p = points.select(*k, F.col("index").cast("long").alias("i")).distinct().withColumn("cp", F.lit(1))
    s = s.join(p, [*k, "i"], "left").withColumn("segment", F.coalesce(F.sum("cp").over(by(k).rowsBetween(
        Window.unboundedPreceding, 0)), F.lit(0)))
    return s.groupBy(*k, "segment").agg(F.min("i").alias("start"), (F.max("i") + 1).alias("end"), F.avg("value").alias("mean"),
                                        F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("variance"))


def _grouped(df: DataFrame, keys: Sequence[str], find, rest: str) -> DataFrame:
    """Runs ``find(values) -> rows`` per key on the time-ordered values and adds the dates."""
    k = list(keys)
    types = dict(df.dtypes)
    names = [c.split()[0] for c in rest.split(",")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        rows = find(pdf["value"].to_numpy(float))
        out = pd.DataFrame(rows, columns=names)
        for c in reversed(k):
            out.insert(0, c, pdf[c].iloc[0])
        out["change_date"] = pdf["date"].to_numpy()[out["index"].to_numpy(int)] if len(out) else None
        return out

    schema = ", ".join([f"{c} {types[c]}" for c in k] + [rest, "change_date date"])
    return per_series(df.where("value IS NOT NULL").select(*k, "date", "value"), k, run, schema)


def cusum(df: DataFrame, drift: float = 0.0, threshold_sd: float = 4.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Two-sided cumulative sums about the mean, reset after each alarm."""
    def find(v: np.ndarray) -> list[tuple]:
        target, limit = v.mean(), threshold_sd * (v.std(ddof=1) if len(v) > 1 else 1.0)
        x, hits, state = v - target, [], [0.0, 0.0]

        def scan(at: int, to: int):
            up, down = clamped_scan(1.0, x[at:to] - drift, 0.0, np.inf, state[0]), clamped_scan(1.0, -x[at:to] - drift, 0.0, np.inf, state[1])
            high, low = up > limit, down > limit

            def accept(k: int) -> None:
                state[:] = up[k], down[k]
                if high[k]:
                    hits.append((at + k, float(up[k])))
                    state[0] = 0.0
                elif low[k]:
                    hits.append((at + k, float(down[k])))
                    state[1] = 0.0
            return high | low, accept

        between_resets(len(v), scan)
        return hits

    return _grouped(df, keys, find, "index long, statistic double")


def regime_shifts(df: DataFrame, window: int = 30, threshold: float = 2.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Confirmed shifts of the running mean. Candidates are windows; the fold only skips confirmed regimes."""
    k = list(keys)
    pre, post = by(k).rowsBetween(-window, -1), by(k).rowsBetween(0, window - 1)
    s = numbered(df, k).withColumn("i", (F.col("rn") - 1).cast("long"))
    s = (s.withColumn("pm", F.avg("value").over(pre)).withColumn("ps", F.stddev_samp("value").over(pre))
         .withColumn("am", F.avg("value").over(post)).withColumn("av", F.var_samp("value").over(post)))
    cand = s.where((F.col("i") >= window) & (F.col("i") < F.col("n") - window) & (F.col("ps") >= 1e-12)
                   & (F.abs(F.col("value") - F.col("pm")) > threshold * F.col("ps"))
                   & (F.abs(F.col("am") - F.col("pm")) > threshold * F.col("ps")))
    lst = cand.groupBy(*k).agg(F.array_sort(F.collect_list(F.struct(
        "i", "date", (F.abs(F.col("am") - F.col("pm")) / F.col("ps")).alias("statistic"), F.col("pm").alias("mean_before"),
        F.col("am").alias("mean_after"), (F.col("ps") * F.col("ps")).alias("variance_before"), F.col("av").alias("variance_after")))).alias("c"))
    kept = F.aggregate("c", F.struct(F.lit(-window).cast("long").alias("last"), F.slice("c", 1, 0).alias("keep")),
                       lambda a, x: F.when(x["i"] >= a["last"] + window, F.struct(
                           x["i"].alias("last"), F.concat(a["keep"], F.array(x)).alias("keep"))).otherwise(a), lambda a: a["keep"])
    return lst.select(*k, F.explode(kept).alias("x")).select(*k, F.col("x.i").alias("index"), F.col("x.date").alias("change_date"),
                                                             "x.statistic", "x.mean_before", "x.mean_after", "x.variance_before", "x.variance_after")


def _rank_split(v: np.ndarray, lo: int) -> tuple[int, float, float] | None:
    """Split with the largest U of the first part, and its two-sided normal p (tie-corrected)."""
    n = len(v)
    if n < 2 * lo:
        return None
    r = pd.Series(v).rank().to_numpy()
    n1 = np.arange(lo, n - lo + 1)
    u = np.cumsum(r)[n1 - 1] - n1 * (n1 + 1) / 2
    j = int(np.argmax(u))
    a, b = int(n1[j]), n - int(n1[j])
    t = np.unique(v, return_counts=True)[1].astype(float)
    sd = math.sqrt(a * b / 12 * (n + 1 - (t ** 3 - t).sum() / (n * (n - 1))))
    p = 1.0 if sd == 0 else min(1.0, math.erfc((max(u[j], a * b - u[j]) - a * b / 2 - 0.5) / sd / math.sqrt(2)))
    return a, float(u[j]), p


def binary_segmentation(df: DataFrame, max_points: int = 5, min_length: int = 10, significance: float = 0.05,
                        keys: Sequence[str] = KEYS) -> DataFrame:
    """Depth-first splitting at the best significant rank split, at most ``max_points`` per key."""
    def find(v: np.ndarray) -> list[tuple]:
        found, stack = [], [(0, len(v))]
        while stack and len(found) < max_points:
            a, b = stack.pop()
            hit = _rank_split(v[a:b], min_length)
            if hit and hit[2] < significance:
                found.append((a + hit[0], hit[1], hit[2]))
                stack += [(a + hit[0], b), (a, a + hit[0])]
        return sorted(found)

    return _grouped(df, keys, find, "index long, statistic double, p_value double")


def pelt(df: DataFrame, penalty: float | None = None, min_length: int = 10, cost: str = "normal",
         keys: Sequence[str] = KEYS) -> DataFrame:
    """Penalised optimal partition; segment costs come from prefix sums, candidates are pruned as it goes."""
    if cost not in ("normal", "mean"):
        raise ValueError(f"unknown cost {cost!r}")

    def find(v: np.ndarray) -> list[tuple]:
        n = len(v)
        pen = (2 * math.log(n) if n > 1 else 1.0) if penalty is None else penalty
        v0 = v - v.mean()
        s1, s2 = np.concatenate([[0], np.cumsum(v0)]), np.concatenate([[0], np.cumsum(v0 * v0)])
        f = np.full(n + 1, np.inf)
        f[0] = -pen
        last = np.zeros(n + 1, dtype=int)
        cand = np.array([0])
        for t in range(min_length, n + 1):
            ready = t - cand >= min_length
            s = cand[ready]
            m = (t - s).astype(float)
            sse = np.maximum((s2[t] - s2[s]) - (s1[t] - s1[s]) ** 2 / m, 0.0)
            seg = m * np.log(np.where(sse / m > 0, sse / m, 1e-12)) if cost == "normal" else sse
            base = f[s] + seg
            total = base + pen
            best = np.minimum.accumulate(total) if len(total) else total
            if len(total):
                j = int(np.argmin(total))
                f[t], last[t] = total[j], s[j]
            cand = np.concatenate([np.sort(np.concatenate([s[base <= best], cand[~ready]])), [t]])
        out, pos = [], n
        while pos > 0:
            pos = int(last[pos])
            if pos > 0:
                out.append((pos, 0.0))
        return sorted(out)

    return _grouped(df, keys, find, "index long, statistic double")
