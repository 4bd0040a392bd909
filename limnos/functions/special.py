"""Special functions Spark SQL lacks.

``norm_cdf_sql`` / ``norm_ppf_sql`` / ``gamma_fn`` stay inside Catalyst as rational forms. The
incomplete gamma and beta tails have no short closed form; they are Arrow-batched pandas UDFs that
are only applied to rows that are already aggregated (one per key).
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Coefficients of the Hart double-precision normal integral, highest power first.
HART_NUM = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
            112.079291497871, 221.213596169931, 220.206867912376)
HART_DEN = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
            296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
# Acklam's rational approximation of the normal quantile.
PPF_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
PPF_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00)
# Lanczos coefficients (g = 7, n = 9).
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313,
           -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-06,
           1.5056327351493116e-07)


def _num(value: float) -> str:
    return f"CAST({value!r} AS DOUBLE)"


def _horner(coeffs: tuple[float, ...], x: str) -> str:
    out = _num(coeffs[0])
    for c in coeffs[1:]:
        out = f"({out} * {x} + {_num(c)})"
    return out


def norm_cdf_sql(x: str) -> str:
    """SQL text of the standard normal CDF of the (numeric, already named) expression ``x``."""
    a = f"abs({x})"
    body = f"exp(-({x}) * ({x}) / 2)"
    small = f"{body} * {_horner(HART_NUM, a)} / {_horner(HART_DEN, a)}"
    far = f"{body} / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + {_num(0.65)}))))) / {_num(2.506628274631)}"
    tail = f"(CASE WHEN {a} > 37 THEN {_num(0.0)} WHEN {a} < {_num(7.07106781186547)} THEN {small} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def norm_ppf_sql(p: str) -> str:
    """SQL text of the standard normal quantile (relative error about 1e-9)."""
    lo, hi = _num(0.02425), _num(1 - 0.02425)
    q_lo, q_hi = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    mid, r = f"({p} - {_num(0.5)})", f"(({p} - {_num(0.5)}) * ({p} - {_num(0.5)}))"
    tail = lambda q: f"{_horner(PPF_C, q)} / ({_horner(PPF_D, q)} * {q} + 1)"
    return (f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN {p} < {lo} THEN {tail(q_lo)} "
            f"WHEN {p} > {hi} THEN -({tail(q_hi)}) "
            f"ELSE {_horner(PPF_A, r)} * {mid} / ({_horner(PPF_B, r)} * {r} + 1) END)")


def norm_cdf(col_name: str) -> Column:
    return F.expr(norm_cdf_sql(col_name))


def norm_ppf(col_name: str) -> Column:
    return F.expr(norm_ppf_sql(col_name))


def gamma_fn(x: Column) -> Column:
    """Gamma function for x > 0 (Lanczos)."""
    z = x - 1
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], start=1):
        series = series + F.lit(c) / (z + i)
    t = z + 7.5
    return F.lit(math.sqrt(2 * math.pi)) * F.pow(t, z + 0.5) * F.exp(-t) * series


def _gammainc(a: float, x: float) -> float:
    """Regularised lower incomplete gamma P(a, x): series below a + 1, continued fraction above."""
    if not (a > 0) or math.isnan(x):
        return float("nan")
    if x <= 0:
        return 0.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * front
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        step = d * c
        h *= step
        if abs(step - 1) < 1e-15:
            return 1 - front * h
    return float("nan")  # not converged: no value is better than a wrong one


def _gammainc_all(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``_gammainc`` of many pairs: all that have not converged take a step at once."""
    out = np.full(len(x), np.nan)
    known = (a > 0) & ~np.isnan(x)
    out[known & (x <= 0)] = 0.0
    at = np.flatnonzero(known & (x > 0) & np.isfinite(a) & np.isfinite(x))
    for i in np.flatnonzero(known & (x > 0) & ~(np.isfinite(a) & np.isfinite(x))):
        out[i] = _gammainc(float(a[i]), float(x[i]))
    shapes, each = np.unique(a[at], return_inverse=True)
    front = np.exp(-x[at] + a[at] * np.log(x[at]) - np.array([math.lgamma(s) for s in shapes])[each]) if len(at) else x[at]
    low = x[at] < a[at] + 1
    rows, v, n = at[low], x[at][low], a[at][low]
    scale, term = front[low], 1.0 / n
    total = term
    while len(rows):
        n = n + 1
        term = term * (v / n)
        total = total + term
        more = np.abs(term) > np.abs(total) * 1e-16
        out[rows[~more]] = (total * scale)[~more]
        rows, v, n, term, total, scale = (z[more] for z in (rows, v, n, term, total, scale))
    rows, k, scale = at[~low], a[at][~low], front[~low]
    b = x[rows] + 1 - k
    c, d = np.full(len(rows), 1e300), 1 / b
    h, i = d, 0
    while len(rows) and (i := i + 1) < 10_000:
        an = -i * (i - k)
        b = b + 2
        d, c = an * d + b, b + an / c
        d, c = 1 / np.where(d == 0, 1e-300, d), np.where(c == 0, 1e-300, c)
        step = d * c
        h = h * step
        more = ~(np.abs(step - 1) < 1e-15)
        out[rows[~more]] = (1 - scale * h)[~more]
        rows, k, scale, b, c, d, h = (z[more] for z in (rows, k, scale, b, c, d, h))
    return out


def _betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b) by its continued fraction."""
    if math.isnan(x) or a <= 0 or b <= 0:
        return float("nan")
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - _betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    f = d
    for m in range(1, 10_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or tiny)
            c = 1 + num / c or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            return front * f
    return float("nan")  # not converged


def _t_two_sided(t: float, df: float) -> float:
    return _betainc(df / 2, 0.5, df / (df + t * t)) if df > 0 and not math.isnan(t) else float("nan")


@lru_cache(maxsize=4096)
def _t_ppf(p: float, df: float) -> float:
    """Student t quantile by bisection on the upper tail."""
    if not (0 < p < 1) or not df > 0:
        return float("nan")
    if p == 0.5:
        return 0.0
    target, lo, hi = 2 * min(p, 1 - p), 0.0, 1.0
    while _t_two_sided(hi, df) > target:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        if _t_two_sided(mid, df) > target:
            lo = mid
        else:
            hi = mid
    return math.copysign((lo + hi) / 2, p - 0.5)


def _pearson3_ppf(p: float, skew: float) -> float:
    """Standardised Pearson III quantile (mean 0, sd 1) by inverting the gamma CDF."""
    from statistics import NormalDist

    if math.isnan(skew) or not 0 < p < 1:
        return float("nan")
    if abs(skew) < 1.6e-5:
        return NormalDist().inv_cdf(p)
    alpha = 4 / (skew * skew)
    q = p if skew > 0 else 1 - p
    lo, hi = 0.0, math.inf
    z = NormalDist().inv_cdf(q)
    x = alpha * max(1 - 1 / (9 * alpha) + z / (3 * math.sqrt(alpha)), 1e-3) ** 3
    for _ in range(100):
        gap = _gammainc(alpha, x) - q
        lo, hi = (x, hi) if gap < 0 else (lo, x)
        slope = math.exp((alpha - 1) * math.log(x) - x - math.lgamma(alpha))
        step = x - gap / slope if slope > 0 else -1.0
        new = step if lo < step < hi else ((lo + hi) / 2 if hi < math.inf else 2 * x)
        if abs(new - x) <= 1e-11 * x:
            break
        x = new
    return (x - alpha) * skew / 2


def _vector(fn, *series: pd.Series) -> pd.Series:
    arrays = [s.to_numpy(dtype=float) for s in series]
    return pd.Series([fn(*row) for row in zip(*arrays)], dtype=float)


@F.pandas_udf(DoubleType())
def gammainc(a: pd.Series, x: pd.Series) -> pd.Series:
    with np.errstate(all="ignore"):
        return pd.Series(_gammainc_all(a.to_numpy(dtype=float), x.to_numpy(dtype=float)), index=a.index)


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    return _vector(lambda v, k: 1 - _gammainc(k / 2, v / 2), x, df)


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return _vector(_t_two_sided, t, df)


@F.pandas_udf(DoubleType())
def t_ppf(p: pd.Series, df: pd.Series) -> pd.Series:
    return _vector(_t_ppf, p, df)


@F.pandas_udf(DoubleType())
def f_sf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _vector(lambda v, a, b: _betainc(b / 2, a / 2, b / (b + a * v)) if v >= 0 else float("nan"), f, d1, d2)


@F.pandas_udf(DoubleType())
def pearson3_ppf(p: pd.Series, skew: pd.Series) -> pd.Series:
    return _vector(_pearson3_ppf, p, skew)


def expint1(u: Column) -> Column:
    """Exponential integral E1 for u > 0: convergent series below 1, rational form above."""
    small = -F.log(u) + sum((F.lit(c) * F.pow(u, F.lit(i)) for i, c in enumerate(E1_SMALL)), F.lit(0.0))
    num = sum((F.lit(c) * F.pow(u, F.lit(3 - i)) for i, c in enumerate(E1_NUM)), F.pow(u, F.lit(4)))
    den = sum((F.lit(c) * F.pow(u, F.lit(3 - i)) for i, c in enumerate(E1_DEN)), F.pow(u, F.lit(4)))
    return F.when(u < 1, small).otherwise(F.exp(-u) / u * num / den)


# E1 below 1: -ln u - gamma - sum (-u)^k / (k k!), written as one polynomial in u.
E1_SMALL = (-0.5772156649015329,) + tuple((-1) ** (k + 1) / (k * math.factorial(k)) for k in range(1, 19))
# Rational form of u e^u E1(u) for u >= 1 (Abramowitz and Stegun 5.1.56).
E1_NUM = (8.5733287401, 18.0590169730, 8.6347608925, 0.2677737343)
E1_DEN = (9.5733223454, 25.6329561486, 21.0996530827, 3.9584969228)

__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "np")]
