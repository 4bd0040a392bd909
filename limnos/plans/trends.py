"""Queries for trend tests and change points."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.functions.special import norm_cdf_sql
from limnos.operators.concordance import kendall_tau_b
from limnos.operators import changepoint as C
from limnos.operators import trend as T
from limnos.operators.periods import resample
from limnos.operators.series import numbered
from limnos.plans.adapters import FLOW, LFLOW, OBS, flow, long_flow, obs
from limnos.plans.catalog import N, nudged, query

RN = "s AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY date) AS rn, count(*) OVER (PARTITION BY station_id) AS n FROM {src})"
PAIRS = ("p AS (SELECT a.station_id, sum(sign(b.value - a.value)) AS s, quantile_cont((b.value - a.value) / (b.rn - a.rn), 0.5) AS slope FROM s a JOIN s b ON a.station_id = b.station_id AND a.rn < b.rn GROUP BY 1), "
         "t AS (SELECT station_id, sum(c) AS n, sum(c * (c - 1) * (2 * c + 5)) AS ts FROM (SELECT station_id, value, count(*)::DOUBLE AS c FROM s GROUP BY 1, 2) GROUP BY 1), md AS (SELECT station_id, quantile_cont(value, 0.5) AS med FROM s GROUP BY 1), "
         "v AS (SELECT station_id, n, s, (n * (n - 1) * (2 * n + 5) - ts) / 18 AS var_s, slope, med - (n - 1) / 2 * slope AS intercept FROM p JOIN t USING (station_id) JOIN md USING (station_id)), "
         "z AS (SELECT *, CASE WHEN var_s <= 0 THEN 0 WHEN s > 0 THEN (s - 1) / sqrt(var_s) WHEN s < 0 THEN (s + 1) / sqrt(var_s) ELSE 0 END AS z FROM v)")
MK_COLS = f"station_id, CAST(n AS BIGINT) AS n, CAST(s AS BIGINT) AS s, {N('var_s')} AS var_s, {N('z')} AS z, {N('s / (n * (n - 1) / 2)')} AS tau, {N('slope')} AS slope, {N('intercept')} AS intercept"


def mk_out(d):
    return nudged(d, 6, "var_s", "z", "tau", "slope", "intercept").select("station_id", "n", "s", "var_s", "z", "tau", "slope", "intercept")


@query("mann_kendall", f"WITH {FLOW}, {RN.format(src='flow')}, {PAIRS} SELECT {MK_COLS}, CASE WHEN abs(z) > 1.959963984540054 THEN CASE WHEN z > 0 THEN 'increasing' ELSE 'decreasing' END ELSE 'no trend' END AS trend FROM z")
def mann_kendall(spark, sf):
    d = T.mann_kendall(flow(spark, sf))
    return nudged(d.drop("p_value"), 6, "var_s", "z", "tau", "slope", "intercept")




@query("mann_kendall_parameters", f"WITH {OBS}, d AS (SELECT station_id AS st, parameter AS pa, CAST(ts AS DATE) AS date, round(avg(value), 8) AS value FROM obs GROUP BY 1, 2, 3), flow AS (SELECT concat(st, '|', pa) AS station_id, date, value FROM d), "
       f"{RN.format(src='flow')}, {PAIRS} SELECT split_part(station_id, '|', 1)::BIGINT AS station_id, split_part(station_id, '|', 2) AS parameter, CAST(n AS BIGINT) AS n, CAST(s AS BIGINT) AS s, {N('z')} AS z, {N('slope')} AS slope FROM z WHERE n >= 10")
def mann_kendall_parameters(spark, sf):
    k = ["station_id", "parameter"]
    d = obs(spark, sf).groupBy(*k, F.to_date("ts").alias("date")).agg(F.round(F.avg("value"), 8).alias("value"))
    return nudged(T.mann_kendall(d, k, min_n=10), 6, "z", "slope").select(*k, "n", "s", "z", "slope")


@query("mann_kendall_p", f"WITH {FLOW}, {RN.format(src='flow')}, {PAIRS}, q AS (SELECT *, -abs(z) AS a FROM z), w AS (SELECT *, 2 * {norm_cdf_sql('a')} AS p FROM q) SELECT station_id, CAST(n AS BIGINT) AS n, CAST(s AS BIGINT) AS s, {N('z')} AS z, {N('p')} AS p_value, "
       "CASE WHEN p < 0.05 AND z > 0 THEN 'increasing' WHEN p < 0.05 AND z < 0 THEN 'decreasing' ELSE 'no trend' END AS trend FROM w")
def mann_kendall_p(spark, sf):
    d = T.mann_kendall(flow(spark, sf), slope=False).select("station_id", "n", "s", "z", "p_value", "trend")
    return nudged(d, 6, "z", "p_value")


@query("sens_slope", f"WITH {FLOW}, {RN.format(src='flow')}, {PAIRS} SELECT station_id, {N('slope')} AS slope, {N('intercept')} AS intercept, CAST(n AS BIGINT) AS n_samples FROM v")
def sens_slope(spark, sf):
    return nudged(T.sens_slope(flow(spark, sf)), 6, "slope", "intercept")


@query("join_self_pairs", f"WITH {FLOW}, {RN.format(src='flow')} SELECT a.station_id, CAST(sum(sign(b.value - a.value)) AS BIGINT) AS s FROM s a JOIN s b ON a.station_id = b.station_id AND a.rn < b.rn GROUP BY 1")
def join_self_pairs(spark, sf):
    return T.kendall_score(numbered(flow(spark, sf)), ["station_id"])


MONTHLY = FLOW + ", m AS (SELECT station_id, CAST(date_trunc('month', date) AS DATE) AS date, round(avg(value), 8) AS value FROM flow GROUP BY 1, 2)"


def monthly(spark, sf):
    return resample(flow(spark, sf), "month").select("station_id", "date", F.round("value", 8).alias("value"))


@query("kendall_monthly", f"WITH {MONTHLY}, {RN.format(src='m')}, p AS (SELECT a.station_id, sum(sign(b.value - a.value)) AS s FROM s a JOIN s b ON a.station_id = b.station_id AND a.rn < b.rn GROUP BY 1), "
       f"t AS (SELECT station_id, sum(c) AS n, sum(c * (c - 1) / 2) AS ty FROM (SELECT station_id, value, count(*)::DOUBLE AS c FROM s GROUP BY 1, 2) GROUP BY 1) SELECT station_id, CAST(n AS BIGINT) AS n, {N('s / sqrt((n * (n - 1) / 2) * (n * (n - 1) / 2 - ty))')} AS tau FROM p JOIN t USING (station_id) WHERE n >= 12")
def kendall_monthly(spark, sf):
    s = numbered(monthly(spark, sf)).where(F.col("n") >= 12)
    return nudged(kendall_tau_b(s.drop("n"), "rn", "value", ["station_id"]).select("station_id", "n", "tau"), 6, "tau")


@query("annual_trend", f"WITH {LFLOW}, y AS (SELECT station_id, year(date) AS y, avg(value) AS value, count(*) AS c FROM lflow GROUP BY 1, 2), yy AS (SELECT *, quantile_cont(c, 0.5) OVER (PARTITION BY station_id) AS u FROM y), yk AS (SELECT station_id, make_date(y, 1, 1) AS date, value, count(*) OVER (PARTITION BY station_id) AS ny FROM yy WHERE c >= 0.8::DOUBLE * u), "
       f"yf AS (SELECT station_id, date, value FROM yk WHERE ny >= 8), {RN.format(src='yf')}, {PAIRS} SELECT {MK_COLS} FROM z")
def annual_trend(spark, sf):
    return mk_out(T.annual_trend(long_flow(spark, sf)))


MK_OUT = (f"SELECT station_id, CAST(n AS BIGINT) AS n, CAST(s AS BIGINT) AS s, {N('var_s')} AS var_s, {N('z')} AS z, {N('p')} AS p_value, {N('s / (n * (n - 1) / 2)')} AS tau, {N('slope')} AS slope, {N('intercept')} AS intercept, "
          "CASE WHEN p < 0.05 AND z > 0 THEN 'increasing' WHEN p < 0.05 AND z < 0 THEN 'decreasing' ELSE 'no trend' END AS trend FROM w")
P_VALUE = f"q AS (SELECT *, -abs(z) AS a FROM {{src}}), w AS (SELECT *, 2 * {norm_cdf_sql('a')} AS p FROM q) "


def inflated_sql(y, factor):
    """Twin of the variance factors: autocorrelation of ``y`` (a function of the detrended value x) over all lags k."""
    return (f"WITH {MONTHLY}, {RN.format(src='m')}, {PAIRS}, fl AS (SELECT s.station_id, s.rn, s.n::DOUBLE AS n, s.value - v.slope * s.rn AS x FROM s JOIN v USING (station_id)), y AS (SELECT *, {y} AS y FROM fl), "
            "c AS (SELECT station_id, rn, n, y - avg(y) OVER (PARTITION BY station_id) AS c FROM y), d AS (SELECT station_id, sum(c * c) AS d FROM c GROUP BY 1), "
            "rho AS (SELECT a.station_id, a.n, (b.rn - a.rn)::DOUBLE AS k, sum(a.c * b.c) / any_value(d.d) AS rho FROM c a JOIN c b ON b.station_id = a.station_id AND b.rn > a.rn JOIN d ON d.station_id = a.station_id GROUP BY 1, 2, 3), "
            f"f AS (SELECT station_id, {factor} AS f FROM rho GROUP BY station_id, n), i AS (SELECT station_id, n, s, var_s * f AS var_s, slope, intercept FROM v JOIN f USING (station_id)), "
            "iz AS (SELECT *, CASE WHEN var_s <= 0 THEN 0 WHEN s > 0 THEN (s - 1) / sqrt(var_s) WHEN s < 0 THEN (s + 1) / sqrt(var_s) ELSE 0 END AS z FROM i), "
            + P_VALUE.format(src="iz") + MK_OUT)


def whitened_sql(x, back):
    """Twin of the whitened variants: ``x`` is whitened by its first autocorrelation, ``back`` is added again; the line is that of the values."""
    return (f"WITH {MONTHLY}, o AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY date) AS rn FROM m), "
            "l0 AS (SELECT a.station_id, quantile_cont((b.value - a.value) / (b.rn - a.rn), 0.5) AS line FROM o a JOIN o b ON a.station_id = b.station_id AND a.rn < b.rn GROUP BY 1), "
            "m0 AS (SELECT station_id, line, any_value(med) - (count(*) - 1) / 2 * line AS base FROM (SELECT station_id, quantile_cont(value, 0.5) OVER (PARTITION BY station_id) AS med FROM o) JOIN l0 USING (station_id) GROUP BY station_id, line), "
            f"x AS (SELECT station_id, date, rn, line, {x} AS x FROM o JOIN l0 USING (station_id)), c AS (SELECT *, x - avg(x) OVER (PARTITION BY station_id) AS c FROM x), "
            "l AS (SELECT *, lag(c) OVER u AS pc, lag(x) OVER u AS px FROM c WINDOW u AS (PARTITION BY station_id ORDER BY date)), r AS (SELECT station_id, sum(c * pc) / sum(c * c) AS r1 FROM l GROUP BY 1), "
            f"wv AS (SELECT station_id, date, round(x - r1 * px{back}, 9) AS value FROM l JOIN r USING (station_id) WHERE px IS NOT NULL), {RN.format(src='wv')}, {PAIRS}, zl AS (SELECT z.* REPLACE (line AS slope, base AS intercept) FROM z JOIN m0 USING (station_id)), "
            + P_VALUE.format(src="zl") + MK_OUT)


RANKED = "rank() OVER (PARTITION BY station_id ORDER BY round(x, 9)) + (count(*) OVER (PARTITION BY station_id, round(x, 9)) - 1) / 2.0::DOUBLE"
MODIFIED = {
    "hamed_rao": inflated_sql(RANKED, "1 + 2 / (n * (n - 1) * (n - 2)) * sum((n - k) * (n - k - 1) * (n - k - 2) * CASE WHEN abs(rho) > 1.959963984540054 / sqrt(n) THEN rho ELSE 0 END)"),
    "yue_wang": inflated_sql("x", "1 + 2 * sum((1 - k / n) * rho)"),
    "pre_whitening": whitened_sql("value", ""),
    "tfpw": whitened_sql("value - line * rn", " + line * (rn - 1)"),
}

for _m, _sql in MODIFIED.items():
    def _mk(spark, sf, method=_m):
        return nudged(T.mann_kendall_modified(monthly(spark, sf), method), 6, "var_s", "z", "p_value", "tau", "slope", "intercept")
    query(f"mk_modified_{_m}", _sql)(_mk)

WHITE = (f"WITH {MONTHLY}, {RN.format(src='m')}, c AS (SELECT *, value - avg(value) OVER (PARTITION BY station_id) AS c FROM s), l AS (SELECT *, lag(c) OVER w AS pc, lag(value) OVER w AS pv FROM c WINDOW w AS (PARTITION BY station_id ORDER BY date)), "
         "r AS (SELECT station_id, sum(c * pc) / sum(c * c) AS r1 FROM l GROUP BY 1), ")


@query("mk_prewhitened_score", WHITE + "wv AS (SELECT station_id, date, round(value - r1 * pv, 8) AS value FROM l JOIN r USING (station_id) WHERE pv IS NOT NULL), sv AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY date) AS rn FROM wv) "
       "SELECT a.station_id, CAST(sum(sign(b.value - a.value)) AS BIGINT) AS s FROM sv a JOIN sv b ON a.station_id = b.station_id AND a.rn < b.rn GROUP BY 1")
def mk_prewhitened_score(spark, sf):
    return T.mann_kendall_modified(monthly(spark, sf), "pre_whitening").select("station_id", "s")


@query("pettitt", f"WITH {FLOW}, r AS (SELECT *, rank() OVER (PARTITION BY station_id ORDER BY value) + (count(*) OVER (PARTITION BY station_id, value) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY station_id) AS n, row_number() OVER (PARTITION BY station_id ORDER BY date) AS rn FROM flow), "
       "u AS (SELECT *, abs(sum(2 * rk - n - 1) OVER (PARTITION BY station_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS u FROM r), b AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY u DESC, rn) AS k FROM u WHERE rn > 1) "
       f"SELECT b.station_id, b.rn - 1 AS index, b.date AS change_date, b.u AS statistic, {N('least(1, 2 * exp(-6 * b.u * b.u / (b.n::DOUBLE ** 3 + b.n::DOUBLE ** 2)))')} AS p_value, {N('(SELECT avg(f.value) FROM flow f WHERE f.station_id = b.station_id AND f.date < b.date)')} AS mean_before, "
       f"{N('(SELECT avg(f.value) FROM flow f WHERE f.station_id = b.station_id AND f.date >= b.date)')} AS mean_after, {N('(SELECT var_samp(f.value) FROM flow f WHERE f.station_id = b.station_id AND f.date < b.date)')} AS variance_before, "
       f"{N('(SELECT var_samp(f.value) FROM flow f WHERE f.station_id = b.station_id AND f.date >= b.date)')} AS variance_after FROM b WHERE k = 1")
def pettitt(spark, sf):
    return nudged(C.pettitt(flow(spark, sf), alpha=None), 6, "p_value", "mean_before", "mean_after", "variance_before", "variance_after")


CUS = (f"WITH RECURSIVE {FLOW}, s AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY date) AS rn, value - avg(value) OVER (PARTITION BY station_id) AS x, 4 * stddev_samp(value) OVER (PARTITION BY station_id) AS h FROM flow), "
       "c AS (SELECT station_id, rn, date, h, greatest(0, x) AS up, greatest(0, -x) AS dn FROM s WHERE rn = 1 UNION ALL SELECT s.station_id, s.rn, s.date, s.h, greatest(0, CASE WHEN c.up > c.h THEN 0 ELSE c.up END + s.x), greatest(0, CASE WHEN c.up <= c.h AND c.dn > c.h THEN 0 ELSE c.dn END - s.x) FROM c JOIN s ON s.station_id = c.station_id AND s.rn = c.rn + 1) ")


@query("cusum", CUS + f"SELECT station_id, date AS change_date, rn - 1 AS index, {N('CASE WHEN up > h THEN up ELSE dn END')} AS statistic FROM c WHERE up > h OR dn > h")
def cusum(spark, sf):
    return nudged(C.cusum(flow(spark, sf)), 6, "statistic")


@query("segment_stats", CUS + f", k AS (SELECT station_id, rn FROM c WHERE up > h OR dn > h), g AS (SELECT s.station_id, s.rn, s.value, coalesce(sum(CASE WHEN k.rn IS NOT NULL THEN 1 END) OVER (PARTITION BY s.station_id ORDER BY s.rn), 0) AS segment FROM s LEFT JOIN k USING (station_id, rn)) "
       f"SELECT station_id, CAST(segment AS BIGINT) AS segment, min(rn) - 1 AS start, max(rn) AS \"end\", {N('avg(value)')} AS mean, {N('coalesce(var_samp(value), 0)')} AS variance FROM g GROUP BY 1, 2")
def segment_stats(spark, sf):
    f = flow(spark, sf)
    return nudged(C.segment_stats(f, C.cusum(f)), 6, "mean", "variance")


@query("regime_shift", f"WITH RECURSIVE {FLOW}, s AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY station_id) AS n, avg(value) OVER pre AS pm, stddev_samp(value) OVER pre AS ps, avg(value) OVER post AS am FROM flow WINDOW pre AS (PARTITION BY station_id ORDER BY date ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), "
       "post AS (PARTITION BY station_id ORDER BY date ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING)), c AS (SELECT * FROM s WHERE i >= 30 AND i < n - 30 AND ps >= 1e-12 AND abs(value - pm) > 0.7::DOUBLE * ps AND abs(am - pm) > 0.7::DOUBLE * ps), r AS (SELECT station_id, min(i) AS i FROM c GROUP BY 1 UNION ALL "
       f"SELECT station_id, nx FROM (SELECT r.station_id, (SELECT min(c.i) FROM c WHERE c.station_id = r.station_id AND c.i >= r.i + 30) AS nx FROM r) WHERE nx IS NOT NULL) SELECT c.station_id, c.i AS index, c.date AS change_date, {N('abs(am - pm) / ps')} AS statistic, {N('pm')} AS mean_before, {N('am')} AS mean_after FROM r JOIN c USING (station_id, i)")
def regime_shift(spark, sf):
    d = C.regime_shifts(flow(spark, sf), threshold=0.7)
    return nudged(d.drop("variance_before", "variance_after"), 6, "statistic", "mean_before", "mean_after")


@query("binary_segmentation")
def binary_segmentation(spark, sf):
    return C.binary_segmentation(flow(spark, sf))


@query("binary_segmentation_first", f"WITH {FLOW}, r AS (SELECT *, rank() OVER (PARTITION BY station_id ORDER BY value) + (count(*) OVER (PARTITION BY station_id, value) - 1) / 2.0::DOUBLE AS rk, row_number() OVER (PARTITION BY station_id ORDER BY date) AS rn, count(*) OVER (PARTITION BY station_id) AS n FROM flow), "
       "u AS (SELECT station_id, rn, n, sum(rk) OVER (PARTITION BY station_id ORDER BY rn) - rn * (rn + 1) / 2 AS u FROM r), b AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY u DESC, rn) AS k FROM u WHERE rn BETWEEN 10 AND n - 10) SELECT station_id, rn AS index, u AS statistic FROM b WHERE k = 1")
def binary_segmentation_first(spark, sf):
    return C.binary_segmentation(flow(spark, sf), max_points=1, significance=1.1).select("station_id", "index", "statistic")


@query("pelt")
def pelt(spark, sf):
    return C.pelt(flow(spark, sf)).drop("statistic")


@query("avg_rank", f"WITH {FLOW} SELECT station_id, date, rank() OVER (PARTITION BY station_id ORDER BY value) + (count(*) OVER (PARTITION BY station_id, value) - 1) / 2.0::DOUBLE AS rank_avg FROM flow")
def avg_rank(spark, sf):
    return C.avg_ranks(flow(spark, sf)).drop("value")
