"""Stage-discharge ratings Q = a (h - h0)^b.

Gaugings collapse first to sums per (station, stage): stages are read to a fixed step, so the
collapsed table stays small however many gaugings a station has, and every fit -- all candidate
offsets and break points included -- is a weighted regression on it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.functions.arith import ratio
from limnos.functions.special import f_sf, t_ppf
from limnos.operators.series import KEYS, by, whole

SUMS = ("n", "q", "qq", "l", "ll")


def collapse(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts and sums of Q, Q^2, ln Q, (ln Q)^2 per stage."""
    q = F.col("discharge")
    return df.where("discharge > 0 AND stage IS NOT NULL").groupBy(*keys, "stage").agg(
        F.count(F.lit(1)).alias("n"), F.sum(q).alias("q"), F.sum(q * q).alias("qq"), F.sum(F.log(q)).alias("l"), F.sum(F.log(q) * F.log(q)).alias("ll"))


def _log_fit(h0: Column, n: str = "n", l: str = "l") -> tuple[Column, Column]:
    """Slope and intercept of ln Q on ln(h - h0) from collapsed sums."""
    x = F.when(F.col("stage") > h0, F.log(F.col("stage") - h0))
    w = F.when(x.isNotNull(), F.col(n))
    sw, sx, sxx = F.sum(w), F.sum(w * x), F.sum(w * x * x)
    sy, sxy = F.sum(F.when(x.isNotNull(), F.col(l))), F.sum(x * F.col(l))
    b = ratio(sw * sxy - sx * sy, sw * sxx - sx * sx)
    return b, (sy - b * sx) / sw


def power(h: Column, a: Column, b: Column, h0: Column) -> Column:
    return a * F.pow(F.greatest(h - h0, F.lit(0.0)), b)


def _sse() -> Column:
    p = power(F.col("stage"), F.col("a"), F.col("b"), F.col("h0"))
    return F.sum(F.col("qq") - 2 * p * F.col("q") + p * p * F.col("n"))


def fit(df: DataFrame, h0: float | None = None, candidates: int = 40, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rating per station with a given offset, or the offset of a grid below the lowest stage with the least squared error."""
    k = list(keys)
    c = collapse(df, k)
    if h0 is not None:
        g = c.withColumn("h0", F.lit(float(h0)))
    else:
        rng = c.groupBy(*k).agg(F.min("stage").alias("lo"), F.max("stage").alias("hi"))
        steps = F.transform(F.sequence(F.lit(1), F.lit(candidates)), lambda i: F.col("lo") - (F.col("hi") - F.col("lo")) * i * i / F.lit(candidates * candidates * 1.0))
        g = c.join(rng.select(*k, F.explode(steps).alias("h0")), k)
    b, ln_a = _log_fit(F.col("h0"))
    par = g.groupBy(*k, "h0").agg(b.alias("b"), ln_a.alias("ln_a"), F.sum(F.when(F.col("stage") > F.col("h0"), F.col("n"))).alias("m"))
    par = par.where("m >= 3").withColumn("a", F.exp("ln_a")).drop("ln_a", "m")
    err = g.join(par, [*k, "h0"]).groupBy(*k, "h0", "a", "b").agg(
        _sse().alias("sse"), F.sum("n").alias("n"), (F.sum("qq") - F.sum("q") * F.sum("q") / F.sum("n")).alias("sst"),
        F.sum(F.col("q") - power(F.col("stage"), F.col("a"), F.col("b"), F.col("h0")) * F.col("n")).alias("sr"),
        F.min("stage").alias("stage_min"), F.max("stage").alias("stage_max"))
    best = err.groupBy(*k).agg(F.min_by(F.struct(*[c for c in err.columns if c not in k]), F.struct("sse", "h0")).alias("r")).select(*k, "r.*")
    var2 = (F.col("sse") - F.col("sr") * F.col("sr") / F.col("n")) / F.greatest(F.col("n") - 2, F.lit(1))
    return best.select(*k, "a", "b", "h0", F.when(F.col("sst") > 0, 1 - F.col("sse") / F.col("sst")).alias("r_squared"),
                       F.sqrt(F.greatest(F.col("sse"), F.lit(0.0)) / F.col("n")).alias("rmse"), F.sqrt(var2).alias("resid_sd"), "n", "stage_min", "stage_max")


def predict(readings: DataFrame, segments: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Discharge of stage readings from a segment table; the first and last segment are open-ended.

    A station has a handful of segments, so they travel as one array on the key join and the right
    one is picked in place of a range join.
    """
    k = list(keys)
    seg = segments.groupBy(*k).agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "a", "b", "h0"))).alias("s"))
    h = F.col("stage")
    d = readings.join(seg, k)
    inside = F.filter("s", lambda x: (h >= x["lo"]) & (h < x["hi"]))
    pick = F.coalesce(F.get(inside, F.lit(0)), F.when(h < F.get("s", F.lit(0))["lo"], F.get("s", F.lit(0))), F.get("s", F.size("s") - 1))
    d = d.withColumn("g", pick)
    return d.withColumn("discharge_pred", power(h, F.col("g.a"), F.col("g.b"), F.col("g.h0"))).drop("s", "g")


def invert(flows: DataFrame, segments: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Stage of discharges: the first segment whose discharge range holds the value, ends open."""
    k = list(keys)
    seg = segments.groupBy(*k).agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "a", "b", "h0"))).alias("s"))
    q = F.col("discharge")
    lo = lambda x: power(x["lo"], x["a"], x["b"], x["h0"])
    hi = lambda x: power(x["hi"], x["a"], x["b"], x["h0"])
    d = flows.join(seg, k)
    first, last = F.get("s", F.lit(0)), F.get("s", F.size("s") - 1)
    inside = F.filter("s", lambda x: (q >= F.least(lo(x), hi(x))) & (q <= F.greatest(lo(x), hi(x))))
    pick = F.coalesce(F.when(q < F.least(lo(first), hi(first)), first), F.get(inside, F.lit(0)),
                      F.when(q > F.greatest(lo(last), hi(last)), last), first)
    d = d.withColumn("g", pick)
    return d.withColumn("stage_pred", F.pow(q / F.col("g.a"), 1 / F.col("g.b")) + F.col("g.h0")).drop("s", "g")


def fit_segmented(df: DataFrame, h0: float = 0.0, grid: int = 20, keys: Sequence[str] = KEYS) -> DataFrame:
    """Two segments split at the stage percentile (15..85) with the least total error, three gaugings per side."""
    k = list(keys)
    c = collapse(df, k)
    probs = F.array(*[F.lit(0.15 + 0.7 * i / (grid - 1)) for i in range(grid)])
    cand = c.groupBy(*k).agg(F.array_distinct(F.percentile("stage", probs, F.col("n"))).alias("bps"))
    g = c.join(cand.select(*k, F.explode("bps").alias("bp")), k).withColumn("seg", (F.col("stage") >= F.col("bp")).cast("int")).withColumn("h0", F.lit(float(h0)))
    b, ln_a = _log_fit(F.col("h0"))
    par = g.groupBy(*k, "bp", "seg").agg(b.alias("b"), ln_a.alias("la"), F.sum("n").alias("m"), F.min("stage").alias("lo"), F.max("stage").alias("hi"))
    par = par.where("m >= 3 AND b IS NOT NULL").withColumn("a", F.exp("la")).drop("la", "m")
    err = g.join(par.select(*k, "bp", "seg", "a", "b"), [*k, "bp", "seg"]).groupBy(*k, "bp", "seg").agg(_sse().alias("sse"), F.sum("n").alias("n"))
    tot = err.groupBy(*k, "bp").agg(F.sum("sse").alias("sse"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).where("parts = 2")
    best = tot.groupBy(*k).agg(F.min_by(F.struct("bp", "sse", "n"), F.struct("sse", "bp")).alias("r")).select(*k, "r.*")
    return best.join(par, [*k, "bp"]).select(
        *k, "seg", F.when(F.col("seg") == 0, F.col("lo")).otherwise(F.col("bp")).alias("lo"), F.when(F.col("seg") == 0, F.col("bp")).otherwise(F.col("hi")).alias("hi"),
        "a", "b", F.lit(float(h0)).alias("h0"), F.sqrt(F.col("sse") / F.col("n")).alias("rmse"))


def cross_validate(df: DataFrame, folds: int = 5, h0: float = 0.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """k-fold error. The training sums of a fold are the totals less the fold's own sums, so data is read once."""
    k = list(keys)
    f = F.pmod(F.xxhash64(*[c for c in df.columns]), F.lit(folds))
    parts = collapse(df.withColumn("fold", f), [*k, "fold"])
    total = parts.groupBy(*k, "stage").agg(*[F.sum(c).alias(f"t_{c}") for c in SUMS])
    grid = total.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))).join(parts, [*k, "stage", "fold"], "left")
    grid = grid.select(*k, "fold", "stage", F.lit(float(h0)).alias("h0"), *[F.coalesce(c, F.lit(0)).alias(c) for c in SUMS],
                       *[(F.col(f"t_{c}") - F.coalesce(c, F.lit(0))).alias(f"r_{c}") for c in SUMS])
    b, ln_a = _log_fit(F.col("h0"), "r_n", "r_l")
    par = grid.groupBy(*k, "fold").agg(b.alias("b"), ln_a.alias("la"), F.sum("r_n").alias("m")).where("m >= 5").withColumn("a", F.exp("la"))
    per = grid.join(par.select(*k, "fold", "a", "b"), [*k, "fold"]).groupBy(*k, "fold").agg(
        _sse().alias("sse"), F.sum("n").alias("n"), (F.sum("qq") - F.sum("q") * F.sum("q") / F.sum("n")).alias("sst"))
    per = per.where("n > 0").withColumn("rmse", F.sqrt(F.col("sse") / F.col("n"))).withColumn("r2", 1 - ratio("sse", "sst"))
    return per.groupBy(*k).agg(F.avg("rmse").alias("mean_rmse"), F.stddev_pop("rmse").alias("std_rmse"), F.avg("r2").alias("mean_r2"), F.count(F.lit(1)).alias("folds"))


def interval(readings: DataFrame, rating: DataFrame, confidence: float = 0.95, t_value: float | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """Prediction with residual-based bounds, floored at zero."""
    dof = F.greatest(F.col("n") - 3, F.lit(1)).cast("double")
    r = rating.withColumn("t", F.lit(t_value) if t_value else t_ppf(F.lit((1 + confidence) / 2), dof))
    d = readings.join(r.select(*keys, "a", "b", "h0", "resid_sd", "t"), list(keys))
    p = power(F.col("stage"), F.col("a"), F.col("b"), F.col("h0"))
    half = F.col("t") * F.col("resid_sd")
    return d.select(*readings.columns, p.alias("predicted"), F.greatest(p - half, F.lit(0.0)).alias("lower"), (p + half).alias("upper"))


def rating_shift(daily: DataFrame, window: int = 20, h0: float = 0.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Variance-ratio test of the residuals of successive half-overlapping windows of daily gaugings."""
    k, step = list(keys), max(window // 2, 1)
    d = daily.where("discharge > 0").withColumn("i", F.row_number().over(by(k)) - 1).withColumn("n", F.count(F.lit(1)).over(whole(k)))
    last = F.floor((F.col("n") - window) / step)
    wid = F.filter(F.array(F.floor(F.col("i") / step), F.floor(F.col("i") / step) - 1), lambda w: (w >= 0) & (w <= last))
    d = d.where(F.col("n") >= 2 * window).withColumn("w", F.explode(wid))
    x = F.log(F.when(F.col("stage") > h0, F.col("stage") - h0))
    par = d.groupBy(*k, "w").agg(F.regr_slope(F.log("discharge"), x).alias("b"), F.exp(F.regr_intercept(F.log("discharge"), x)).alias("a"))
    res = d.join(par, [*k, "w"]).withColumn("r", F.col("discharge") - power(F.col("stage"), F.col("a"), F.col("b"), F.lit(h0)))
    v = res.groupBy(*k, "w").agg(F.var_samp("r").alias("v"), F.max(F.when(F.col("i") == F.col("w") * step + window // 2, F.col("date"))).alias("date"))
    o = Window.partitionBy(*k).orderBy("w")
    v = v.withColumn("pv", F.lag("v").over(o)).where("pv > 0 AND v > 0")
    v = v.withColumn("f", F.greatest("v", "pv") / F.least("v", "pv")).withColumn("dof", F.lit(float(window - 1)))
    v = v.withColumn("p_value", 2 * f_sf("f", "dof", "dof"))
    return v.where("p_value < 0.05").select(*k, "date", (F.abs(F.col("v") - F.col("pv")) / F.col("pv")).alias("shift_magnitude"), "p_value")
