"""Goodness of fit of paired series and of probabilistic forecasts, for every key at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.functions.arith import correlation, ratio
from limnos.operators.series import avg_rank_expr, exact_quantiles, value_ranks


def finite(*cols: str) -> Column:
    ok = F.lit(True)
    for c in cols:
        x = F.col(c)
        ok = ok & x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return ok


def _nse(obs: Column, sim: Column) -> Column:
    """1 - residual over total sum of squares, from moments only (one pass)."""
    var = F.var_pop(obs)
    return F.when(var > 0, 1 - F.avg(F.pow(obs - sim, 2)) / var)


def fit_metrics(df: DataFrame, keys: Sequence[str] = ("station_id",), obs: str = "obs", sim: str = "sim",
                epsilon: float = 1e-6) -> DataFrame:
    """NSE, log-NSE, KGE, percent bias, RMSE, MAE and R2 in one map-side combined aggregate."""
    o, s = F.col(obs), F.col(sim)
    so, mo = F.stddev_pop(o), F.avg(o)
    kge = 1 - F.sqrt(F.pow(correlation(o, s) - 1, 2) + F.pow(F.stddev_pop(s) / so - 1, 2) + F.pow(F.avg(s) / mo - 1, 2))
    return df.where(finite(obs, sim)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), _nse(o, s).alias("nse"),
        _nse(F.log(o + epsilon), F.log(s + epsilon)).alias("log_nse"),
        F.when((F.count(F.lit(1)) >= 2) & (so > 0) & (mo != 0), kge).alias("kge"),
        F.when(F.sum(o) != 0, 100 * F.sum(s - o) / F.sum(o)).alias("pbias"),
        F.sqrt(F.avg(F.pow(o - s, 2))).alias("rmse"), F.avg(F.abs(o - s)).alias("mae")).withColumn("r2", F.col("nse"))


def pinball(obs: Column, pred: Column, q: Column) -> Column:
    e = obs - pred
    return F.greatest(q * e, (q - 1) * e)


def quantile_loss(df: DataFrame, quantile: float, keys: Sequence[str] = ("station_id",), obs="obs", pred="sim") -> DataFrame:
    if not 0 < quantile < 1:
        raise ValueError("quantile must lie inside (0, 1)")
    return df.where(finite(obs, pred)).groupBy(*keys).agg(
        F.avg(pinball(F.col(obs), F.col(pred), F.lit(quantile))).alias("pinball"))


def interval_coverage(df: DataFrame, keys: Sequence[str] = ("station_id",), obs="obs", lower="lower", upper="upper") -> DataFrame:
    """Share of observations inside the band and its mean width, plain and relative to the observed range."""
    o, lo, hi = F.col(obs), F.col(lower), F.col(upper)
    ok, band, seen = finite(obs, lower, upper), finite(lower, upper), finite(obs)
    span = F.max(F.when(seen, o)) - F.min(F.when(seen, o))
    return df.groupBy(*keys).agg(
        F.avg(F.when(ok, ((o >= lo) & (o <= hi)).cast("double"))).alias("picp"),
        F.avg(F.when(band, hi - lo)).alias("mpiw"),
        F.when(span > 0, F.avg(F.when(band, hi - lo)) / span).alias("mpiw_normalised"))


def crps_ensemble(df: DataFrame, keys: Sequence[str], at: str, obs: str = "obs", member: str = "sim") -> DataFrame:
    """Ensemble CRPS from long (key, time, member) rows.

    The members of one time step form a fixed-size array; sorted, their pair-distance sum is a
    weighted sum, so no member pairs are formed.
    """
    step = df.where(finite(obs)).groupBy(*keys, at).agg(F.first(obs).alias("y"), F.array_sort(F.collect_list(member)).alias("x"))
    m = F.size("x")
    near = F.aggregate("x", F.lit(0.0), lambda a, v: a + F.abs(v - F.col("y"))) / m
    spread = F.aggregate(F.transform("x", lambda v, i: v * (2 * i + 1 - m)), F.lit(0.0), lambda a, v: a + v) * 2
    return step.groupBy(*keys).agg(F.avg(near - spread / (2.0 * m * m)).alias("crps"))


def crps_quantiles(df: DataFrame, keys: Sequence[str], level: str = "q", obs: str = "obs", pred: str = "pred") -> DataFrame:
    """Twice the mean pinball loss over the quantile levels."""
    per = df.where(finite(obs, pred)).groupBy(*keys, level).agg(
        F.avg(pinball(F.col(obs), F.col(pred), F.col(level))).alias("loss"))
    return per.groupBy(*keys).agg((2 * F.avg("loss")).alias("crps"))


def two_sample_ks(df: DataFrame, keys: Sequence[str], a: str, b: str) -> DataFrame:
    """Largest distance between the empirical distributions of two columns.

    Both samples share one value-rank table; the rank of a value within the union minus its rank
    within each sample gives both distribution functions without gathering a key.
    """
    keys = list(keys)
    side = lambda c, w: df.where(F.col(c).isNotNull()).select(*keys, F.col(c).alias("value"), F.lit(w).alias("_w"))
    rows = side(a, 1).unionByName(side(b, 0))
    ranks = value_ranks(rows, keys).select(*keys, "value", "n_less", "cnt", "n")
    first = value_ranks(rows.where("_w = 1"), keys).select(
        *keys, "value", F.col("n_less").alias("a_less"), F.col("cnt").alias("a_cnt"), F.col("n").alias("na"))
    # within the union order, the number of a-rows at or below a value is the running sum of a_cnt
    joined = ranks.join(first.drop("a_less", "na"), [*keys, "value"], "left").join(
        first.groupBy(*keys).agg(F.max("na").alias("na")), keys).withColumn("a_cnt", F.coalesce("a_cnt", F.lit(0)))
    cum = running_total(joined, keys, "a_cnt")
    fa = ratio("below", "na")
    fb = ratio(F.col("n_less") + F.col("cnt") - F.col("below"), F.col("n") - F.col("na"))
    return cum.groupBy(*keys).agg(F.max(F.abs(fa - fb)).alias("ks"), F.max("na").alias("n_a"),
                                  F.max(F.col("n") - F.col("na")).alias("n_b"))


def running_total(df: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    """Running sum of ``amount`` in value order (inclusive), split into value buckets like the ranks."""
    from pyspark.sql import Window

    from limnos.operators.series import by, value_bucket
    d = df.withColumn("_b", value_bucket(F.col("value")))
    up = Window.unboundedPreceding
    base = d.groupBy(*keys, "_b").agg(F.sum(amount).alias("_s")).withColumn(
        "_base", F.sum("_s").over(by(keys, "_b").rowsBetween(up, 0)) - F.col("_s")).drop("_s")
    inner = F.sum(amount).over(by([*keys, "_b"], "value").rowsBetween(up, 0))
    return d.withColumn("_in", inner).join(base, [*keys, "_b"]).withColumn(
        "below", F.col("_base") + F.col("_in")).drop("_b", "_in", "_base")


def downscaling_skill(df: DataFrame, keys: Sequence[str] = ("station_id",), obs="obs", sim="sim") -> DataFrame:
    """RMSE, MAE, bias, correlation, KS distance and absolute percentile errors."""
    keys = list(keys)
    o, s = F.col(obs), F.col(sim)
    base = df.groupBy(*keys).agg(F.sqrt(F.avg(F.pow(s - o, 2))).alias("rmse"), F.avg(F.abs(s - o)).alias("mae"),
                                 F.avg(s - o).alias("bias"), correlation(o, s).alias("correlation"))
    probs = {f"p{p}": p / 100 for p in (5, 25, 50, 75, 95)}
    qo, qs = (exact_quantiles(df.select(*keys, F.col(c).alias("value")), keys, probs) for c in (obs, sim))
    errs = qo.alias("a").join(qs.alias("b"), keys).select(
        *keys, *[F.abs(F.col(f"b.{p}") - F.col(f"a.{p}")).alias(f"{p}_error") for p in probs])
    return base.join(two_sample_ks(df, keys, obs, sim).select(*keys, "ks"), keys).join(errs, keys)


def rank_test(df: DataFrame, keys: Sequence[str], first: Column) -> DataFrame:
    """Mann-Whitney U of the rows where ``first`` holds against the rest, with the tie-corrected normal p."""
    from limnos.functions.special import norm_cdf

    keys = list(keys)
    rows = df.withColumn("_f", first)
    ranks = value_ranks(rows, keys).withColumn("r", avg_rank_expr())
    part = rows.where("_f AND value IS NOT NULL").groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("_k"))
    r1 = part.join(ranks.select(*keys, "value", "r"), [*keys, "value"]).groupBy(*keys).agg(
        F.sum(F.col("r") * F.col("_k")).alias("r1"), F.sum("_k").alias("n1"))
    ties = ranks.groupBy(*keys).agg(F.max("n").alias("n"), F.sum(F.pow("cnt", 3) - F.col("cnt")).alias("ties"))
    d = r1.join(ties, keys)
    n, n1 = F.col("n"), F.col("n1")
    d = d.withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2)
    n2 = n - n1
    sd = F.sqrt(n1 * n2 / 12.0 * (n + 1 - ratio(F.col("ties"), n * (n - 1))))
    z = ratio(F.greatest(F.col("u"), n1 * n2 - F.col("u")) - n1 * n2 / 2.0 - 0.5, sd)
    d = d.withColumn("z", F.when(sd > 0, z)).withColumn("_mz", -F.col("z"))
    return d.withColumn("p_value", F.least(F.lit(1.0), 2 * norm_cdf("_mz"))).select(
        *keys, "n1", n2.alias("n2"), "u", "z", "p_value")
