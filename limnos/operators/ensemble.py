"""Combining model predictions: fixed, skill-based and adaptive weights; chain diagnostics; Bayesian regression."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limnos.operators.series import whole


def skill_weights(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Inverse-RMSE weights per model (rows: model, obs, sim)."""
    k = list(keys)
    r = df.groupBy(*k, "model").agg((1 / F.greatest(F.sqrt(F.avg(F.pow(F.col("obs") - F.col("sim"), 2))), F.lit(1e-10))).alias("inv"))
    if k:
        return r.select(*k, "model", (F.col("inv") / F.sum("inv").over(whole(k))).alias("weight"))
    total = F.broadcast(r.agg(F.sum("inv").alias("total")))  # one row
    return r.join(total, F.lit(True)).select("model", (F.col("inv") / F.col("total")).alias("weight"))


def combine(df: DataFrame, weights: DataFrame | None = None, at: Sequence[str] = ("date",), on: Sequence[str] = ("model",)) -> DataFrame:
    """Weighted mean per time step with bounds of 1.96 weighted sd; equal weights without a table."""
    a = list(at)
    d = df.join(weights, list(on)) if weights is not None else df.withColumn("weight", 1 / F.count(F.lit(1)).over(Window.partitionBy(*a)))
    w, s = F.col("weight"), F.col("sim")
    g = d.groupBy(*a).agg(F.sum(w * s).alias("mean"), F.sum(w).alias("tw"), F.sum(w * s * s).alias("m2"))
    var = F.col("m2") - 2 * F.col("mean") * F.col("mean") + F.col("mean") * F.col("mean") * F.col("tw")
    half = 1.96 * F.sqrt(F.greatest(var, F.lit(0.0)))
    return g.select(*a, "mean", (F.col("mean") - half).alias("lower"), (F.col("mean") + half).alias("upper"))


def adaptive(df: DataFrame, lookback: int = 30, decay: float = 0.95, keys: Sequence[str] = ()) -> DataFrame:
    """Weights per time step from exponentially decayed errors of the last ``lookback`` steps, the step included."""
    k = list(keys)
    w = Window.partitionBy(*k, "model").orderBy("date").rowsBetween(-(lookback - 1), 0)
    e = df.withColumn("e", F.collect_list(F.pow(F.col("obs") - F.col("sim"), 2)).over(w))
    pw = F.transform("e", lambda x, i: F.pow(F.lit(decay), F.size("e") - 1 - i))
    num = F.aggregate(F.zip_with("e", pw, lambda x, p: x * p), F.lit(0.0), lambda s, x: s + x)
    den = F.aggregate(pw, F.lit(0.0), lambda s, x: s + x)
    e = e.withColumn("inv", 1 / F.greatest(F.sqrt(num / den), F.lit(1e-10)))
    step = Window.partitionBy(*k, "date")
    e = e.withColumn("weight", F.col("inv") / F.sum("inv").over(step))
    return e.select(*k, "date", "model", "obs", "sim", "weight", F.sum(F.col("weight") * F.col("sim")).over(step).alias("combined"))


def chain_rhat(df: DataFrame) -> DataFrame:
    """Gelman-Rubin diagnostic per parameter over (chain, iter, param, value) rows cut to the shortest chain."""
    n = df.groupBy("param", "chain").agg(F.count(F.lit(1)).alias("c")).groupBy("param").agg(F.min("c").alias("n"), F.count(F.lit(1)).alias("m"))
    d = df.join(n, "param").where("iter < n").groupBy("param", "chain").agg(F.avg("value").alias("mu"), F.var_samp("value").alias("v"), F.max("n").alias("n"))
    g = d.groupBy("param").agg(F.avg("v").alias("w"), F.var_samp("mu").alias("bm"), F.max("n").alias("n"), F.count(F.lit(1)).alias("m")).where("n >= 2 AND m >= 2")
    r = F.sqrt(((F.col("n") - 1) / F.col("n") * F.col("w") + F.col("bm")) / F.col("w"))
    return g.select("param", "m", "n", F.when(F.col("w") < 1e-15, 1.0).otherwise(r).alias("r_hat"))


def cross_products(df: DataFrame, xs: Sequence[str], y: str, keys: Sequence[str]) -> DataFrame:
    """X'X, X'y, y'y and n per key as plain sums: everything a linear model needs, in one combined aggregate."""
    p = len(xs)
    aggs = [F.sum(F.col(xs[i]) * F.col(xs[j])).alias(f"xx_{i}_{j}") for i in range(p) for j in range(i, p)]
    aggs += [F.sum(F.col(c) * F.col(y)).alias(f"xy_{i}") for i, c in enumerate(xs)]
    return df.dropna(subset=[*xs, y]).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y) * F.col(y)).alias("yy"), *aggs)


def solve_rows(products: DataFrame, names: Sequence[str], keys: Sequence[str], penalty: Sequence[float], a0: float = 0.0, b0: float = 0.0) -> DataFrame:
    """Solves the penalised normal equations of each (already aggregated) row."""
    p, k, types = len(names), list(keys), dict(products.dtypes)
    pen = np.diag(np.asarray(penalty, float))

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.to_dict("records"):
                xx = np.array([[r[f"xx_{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
                xy = np.array([r[f"xy_{i}"] for i in range(p)])
                inv = np.linalg.inv(xx + pen)
                beta = inv @ xy
                b_n = b0 + 0.5 * (r["yy"] - beta @ (xx + pen) @ beta)
                s2 = max(b_n, 1e-12) / max(a0 + r["n"] / 2 - 1, 1e-12)
                rss = r["yy"] - 2 * beta @ xy + beta @ xx @ beta
                for i, nm in enumerate(names):
                    rows.append((*[r[c] for c in k], nm, float(beta[i]), float(np.sqrt(s2 * inv[i, i])), float(s2), int(r["n"]),
                                 float(np.sqrt(max(rss, 0) / max(r["n"] - p, 1)))))
            yield pd.DataFrame(rows, columns=[*k, "term", "estimate", "std", "sigma2", "n", "resid_sd"])

    return products.mapInPandas(run, ", ".join([f"{c} {types[c]}" for c in k] + ["term string, estimate double, std double, sigma2 double, n long, resid_sd double"]))


def bayes_regression(df: DataFrame, xs: Sequence[str], y: str, keys: Sequence[str], precision: float = 0.01, a0: float = 1.0, b0: float = 1.0) -> DataFrame:
    """Conjugate posterior mean and sd of the coefficients and the noise variance."""
    return solve_rows(cross_products(df, xs, y, keys), xs, keys, [precision] * len(xs), a0, b0)


def polynomial(df: DataFrame, x: str, degree: int) -> tuple[DataFrame, list[str]]:
    """Power columns x^0..x^degree."""
    names = [f"{x}_p{i}" for i in range(degree + 1)]
    return df.select("*", *[F.pow(F.col(x), F.lit(i)).alias(n) for i, n in enumerate(names)]), names
