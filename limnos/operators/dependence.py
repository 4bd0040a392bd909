"""Dependence between paired variables: pseudo-observations, tails, copulas, partial correlation."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from limnos.functions.arith import correlation, ratio
from limnos.functions.special import norm_ppf, t_two_sided
from limnos.operators.changepoint import avg_ranks
from limnos.operators.series import whole
from limnos.operators.concordance import kendall_tau_b


def column_pairs(wide: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(param1, param2, x, y) rows: a fixed number of column pairs per complete row."""
    cells = [F.struct(F.lit(a).alias("param1"), F.lit(b).alias("param2"), F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y"))
             for i, a in enumerate(names) for b in names[i + 1:]]
    return wide.select(*keep, F.explode(F.array(*cells)).alias("c")).select(*keep, "c.*")


def correlation_pairs(wide: DataFrame, names: Sequence[str], min_r: float = 0.3, alpha: float = 0.05, only_significant: bool = True) -> DataFrame:
    """Pearson r and p of every parameter pair in one aggregate, strongest first."""
    cells = [F.struct(F.lit(a).alias("param1"), F.lit(b).alias("param2"), correlation(F.col(f"`{a}`"), F.col(f"`{b}`")).alias("r"), F.count(F.lit(1)).alias("n"))
             for i, a in enumerate(names) for b in names[i + 1:]]
    d = wide.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    d = d.withColumn("t", F.col("r") * F.sqrt(ratio(F.col("n") - 2, 1 - F.col("r") * F.col("r"))))
    d = d.withColumn("p_value", t_two_sided("t", (F.col("n") - 2).cast("double"))).drop("t")
    return d.where((F.col("p_value") < alpha) & (F.abs("r") > min_r)).orderBy(F.desc(F.abs("r"))) if only_significant else d


def partial_correlations(wide: DataFrame, names: Sequence[str], alpha: float | None = 0.05) -> DataFrame:
    """Correlation of each pair given all other parameters.

    The table is reduced to its p × p correlation matrix in one distributed pass; only that matrix
    (p is the number of parameters) is inverted.
    """
    names = list(names)
    cells = [correlation(F.col(f"`{a}`"), F.col(f"`{b}`")).alias(f"c{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i < j]
    row = wide.agg(F.count(F.lit(1)).cast("double").alias("n"), *cells)

    def invert(frames):
        for pdf in frames:
            for r in pdf.to_dict("records"):
                m = np.eye(len(names))
                for i in range(len(names)):
                    for j in range(i + 1, len(names)):
                        m[i, j] = m[j, i] = r[f"c{i}_{j}"]
                q = np.linalg.pinv(m)
                yield pd.DataFrame([(names[i], names[j], -q[i, j] / math.sqrt(q[i, i] * q[j, j]), r["n"])
                                    for i in range(len(names)) for j in range(i + 1, len(names))], columns=["param1", "param2", "partial_corr", "n"])

    d = row.mapInPandas(invert, "param1 string, param2 string, partial_corr double, n double")
    dof = F.col("n") - 2
    d = d.withColumn("t", F.col("partial_corr") * F.sqrt(ratio(dof, 1 - F.col("partial_corr") * F.col("partial_corr")))).withColumn("p_value", t_two_sided("t", dof)).drop("t", "n")
    return d if alpha is None else d.where(F.col("p_value") < alpha)


def pseudo_observations(df: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Average ranks over n + 1, both margins (daily-bounded keys)."""
    k = list(keys)
    d = df.withColumn("n", F.count(F.lit(1)).over(whole(k)))
    for c, name in ((x, "u"), (y, "v")):
        d = avg_ranks(d, k, c).withColumn(name, F.col("rank_avg") / (F.col("n") + 1)).drop("rank_avg")
    return d


def tail_shares(po: DataFrame, keys: Sequence[str], q: float = 0.1) -> DataFrame:
    """Empirical joint upper and lower tail shares at level q."""
    up, lo = (F.col("u") > 1 - q) & (F.col("v") > 1 - q), (F.col("u") < q) & (F.col("v") < q)
    return po.groupBy(*keys).agg((F.avg(up.cast("double")) / q).alias("upper_tail_dep"), (F.avg(lo.cast("double")) / q).alias("lower_tail_dep"))


def _frank_theta(tau: float) -> float:
    """Frank parameter of a Kendall tau: bisection on its Debye-function relation."""
    if not abs(tau) < 1 or abs(tau) < 1e-8:
        return 1e-4

    def gap(th: float) -> float:
        t = np.linspace(0, th, 2001)[1:]
        f = np.concatenate([[1.0], t / np.expm1(t)])
        w = np.ones(2001)
        w[1:-1:2], w[2:-1:2] = 4, 2
        return 1 - 4 / th * (1 - (w * f).sum() * th / 2000 / 3 / th) - abs(tau)

    lo, hi = 1e-9, 30.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gap(mid) < 0 else (lo, mid)
    return math.copysign((lo + hi) / 2, tau)


@F.pandas_udf(DoubleType())
def frank_theta(tau: pd.Series) -> pd.Series:
    return tau.map(_frank_theta)


FAMILIES = ("gaussian", "clayton", "gumbel", "frank")


def copula_parameters(tau: DataFrame) -> DataFrame:
    """One row per key and family with its parameter from Kendall's tau."""
    t = F.col("tau")
    pos = F.greatest(t, F.lit(0.05))
    d = tau.withColumn("frank", frank_theta("tau"))
    th = {"gaussian": F.greatest(F.least(F.sin(math.pi * t / 2), F.lit(0.999)), F.lit(-0.999)),
          "clayton": F.greatest(F.when(pos < 1, 2 * pos / (1 - pos)).otherwise(20.0), F.lit(1e-4)),
          "gumbel": F.greatest(F.when(pos < 1, 1 / (1 - pos)).otherwise(20.0), F.lit(1.0)), "frank": F.col("frank")}
    rows = F.array(*[F.struct(F.lit(f).alias("family"), th[f].alias("theta")) for f in FAMILIES])
    return d.withColumn("f", F.explode(rows)).select(*[c for c in tau.columns], "f.family", "f.theta")


def log_density(u: Column, v: Column, family: Column, th: Column, zu: Column, zv: Column) -> Column:
    """Log copula density as one expression (``zu``, ``zv`` are the normal scores)."""
    det = 1 - th * th
    gauss = -0.5 * F.log(det) - (th * th * (zu * zu + zv * zv) - 2 * th * zu * zv) / (2 * det)
    clay = F.log(1 + th) - (1 + th) * F.log(u * v) - (2 + 1 / th) * F.log(F.pow(u, -th) + F.pow(v, -th) - 1)
    lu, lv = -F.log(u), -F.log(v)
    a = F.pow(lu, th) + F.pow(lv, th)
    ai = F.pow(a, 1 / th)
    gum = -ai - F.log(u * v) + (th - 1) * F.log(lu * lv) + (2 / th - 2) * F.log(a) + F.log(ai + th - 1)
    e = F.exp(-th) - 1
    den = e + (F.exp(-th * u) - 1) * (F.exp(-th * v) - 1)
    frank = F.log(-th * e * F.exp(-th * (u + v)) / (den * den))
    return F.when(family == "gaussian", gauss).when(family == "clayton", clay).when(family == "gumbel", gum).otherwise(frank)


def copula_fit(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Parameter, log-likelihood and AIC of four families per key, best first."""
    from pyspark.sql import Window

    k = list(keys)
    par = copula_parameters(kendall_tau_b(pairs, "x", "y", k).select(*k, "n", "tau"))
    po = pseudo_observations(pairs, k).withColumn("zu", norm_ppf("u")).withColumn("zv", norm_ppf("v")).select(*k, "u", "v", "zu", "zv")
    ld = log_density(*[F.col(c) for c in ("u", "v", "family", "theta", "zu", "zv")])
    ll = po.join(par, k).groupBy(*k, "family", "theta", "tau", "n").agg(F.sum(F.greatest(ld, F.lit(math.log(1e-300)))).alias("log_likelihood"))
    return ll.withColumn("aic", 2 - 2 * F.col("log_likelihood")).withColumn("place", F.row_number().over(Window.partitionBy(*k).orderBy("aic", "family")))


def joint_exceedance(fit: DataFrame, u: float, v: float) -> DataFrame:
    """Joint, either and conditional exceedance with the joint return period (closed-form families)."""
    th, a, b = F.col("theta"), F.lit(u), F.lit(v)
    clay = F.pow(F.greatest(F.pow(a, -th) + F.pow(b, -th) - 1, F.lit(0.0)), -1 / th)
    gum = F.exp(-F.pow(F.pow(-F.log(a), th) + F.pow(-F.log(b), th), 1 / th))
    frank = -F.log(1 + (F.exp(-th * a) - 1) * (F.exp(-th * b) - 1) / (F.exp(-th) - 1)) / th
    c = F.when(F.col("family") == "clayton", clay).when(F.col("family") == "gumbel", gum).when(F.col("family") == "frank", frank)
    both = F.greatest(1 - a - b + F.col("c"), F.lit(0.0))
    d = fit.where("family <> 'gaussian'").withColumn("c", c).withColumn("p_both", both).withColumn("p_either", 1 - F.col("c"))
    return d.withColumn("p_x_given_y", F.col("p_both") / (1 - v)).withColumn("return_period", F.when(F.col("p_both") > 1e-12, 1 / F.col("p_both"))).drop("c")


def tail_coefficients(fit: DataFrame) -> DataFrame:
    th = F.col("theta")
    lo = F.when((F.col("family") == "clayton") & (th > 0), F.pow(F.lit(2.0), -1 / th)).otherwise(0.0)
    up = F.when((F.col("family") == "gumbel") & (th >= 1), 2 - F.pow(F.lit(2.0), 1 / th)).otherwise(0.0)
    return fit.withColumn("lambda_lower", lo).withColumn("lambda_upper", up)
