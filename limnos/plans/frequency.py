"""Queries for extreme values, ratings, dependence and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.functions.special import _t_ppf, norm_cdf_sql
from limnos.operators import dependence as D
from limnos.operators import ensemble as M
from limnos.operators import extremes as X
from limnos.operators import rating as R
from limnos.operators.periods import annual_max
from limnos.plans.adapters import FLOW, GAUGING, LFLOW, OBS, PAIRED, SFLOW, flow, gaugings, long_flow, obs, paired, supplier_flow
from limnos.plans.catalog import N, nudged, query

K = ["station_id"]
AM = SFLOW + ", am AS (SELECT station_id, year(date) AS year, max(value) AS value FROM sflow GROUP BY 1, 2)"


AML = LFLOW + ", am AS (SELECT station_id, year(date) AS year, max(value) AS value FROM lflow GROUP BY 1, 2)"


def am(spark, sf):
    return annual_max(supplier_flow(spark, sf)).drop("n_days")


def long_am(spark, sf):
    """Annual maxima over half a century."""
    return annual_max(long_flow(spark, sf)).drop("n_days")


def lmom_sql(src="am", key="station_id", name="lm"):
    return (f"{name}r AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY value, year) - 1 AS i, count(*) OVER (PARTITION BY {key}) AS n FROM {src}), "
            f"{name}b AS (SELECT {key}, max(n)::DOUBLE AS n, avg(value) AS b0, sum(value * i / (n - 1)) / max(n) AS b1, sum(value * i * (i - 1) / ((n - 1) * (n - 2))) / max(n) AS b2, sum(value * i * (i - 1) * (i - 2) / ((n - 1) * (n - 2) * (n - 3))) / max(n) AS b3 FROM {name}r WHERE n >= 4 GROUP BY {key}), "
            f"{name} AS (SELECT {key}, n, b0 AS l1, 2 * b1 - b0 AS l2, 6 * b2 - 6 * b1 + b0 AS l3, 20 * b3 - 30 * b2 + 12 * b1 - b0 AS l4, CASE WHEN abs(2 * b1 - b0) > 1e-15 THEN (6 * b2 - 6 * b1 + b0) / (2 * b1 - b0) ELSE 0 END AS t3, CASE WHEN abs(2 * b1 - b0) > 1e-15 THEN (20 * b3 - 30 * b2 + 12 * b1 - b0) / (2 * b1 - b0) ELSE 0 END AS t4 FROM {name}b)")


def gev_sql(src="lm", name="gv", keep="station_id, n"):
    return (f"{name}s AS (SELECT *, 7.8590::DOUBLE * (2 / (3 + t3) - ln(2) / ln(3)) + 2.9554::DOUBLE * (2 / (3 + t3) - ln(2) / ln(3)) ** 2 AS shape FROM {src}), "
            f"{name}a AS (SELECT *, CASE WHEN abs(shape) <= 1e-10 THEN l2 / ln(2) ELSE l2 * shape / (gamma(1 + shape) * (1 - 2 ** (-shape))) END AS scale FROM {name}s), "
            f"{name} AS (SELECT {keep}, shape, scale, CASE WHEN abs(shape) <= 1e-10 THEN l1 - scale * 0.5772156649::DOUBLE ELSE l1 - scale * (1 - gamma(1 + shape)) / shape END AS loc FROM {name}a)")


LEV = "CASE WHEN abs(shape) > 1e-10 THEN loc + scale * (1 - (-ln({p})) ** shape) / shape ELSE loc - scale * ln(-ln({p})) END"
RP = "(VALUES " + ", ".join(f"({t}::DOUBLE)" for t in X.RETURN_PERIODS) + ") r(return_period)"


@query("lmoments", f"WITH {AM}, {lmom_sql()} SELECT station_id, CAST(n AS BIGINT) AS n, {', '.join(f'{N(c)} AS {c}' for c in ('l1', 'l2', 'l3', 'l4', 't3', 't4'))} FROM lm")
def lmoments(spark, sf):
    return nudged(X.lmoments(am(spark, sf)), 6, "l1", "l2", "l3", "l4", "t3", "t4")


@query("gev_lmom", f"WITH {AM}, {lmom_sql()}, {gev_sql()} SELECT station_id, CAST(n AS BIGINT) AS n, {N('shape')} AS shape, {N('loc')} AS loc, {N('scale')} AS scale, return_period, {N(LEV.format(p='1 - 1 / return_period'), 5)} AS level FROM gv, {RP} WHERE n >= 5")
def gev_lmom(spark, sf):
    return nudged(nudged(X.gev_lmom(am(spark, sf)), 6, "shape", "loc", "scale"), 5, "level")


def drawn_sql(src, keys, reps):
    """Rows of ``src`` (with ``at``, 0-based, of ``n``) drawn with replacement by the digits of a hash."""
    key = ", ".join(f"q.{c}" for c in keys)
    return (f"dr AS (SELECT {key}, q.pos AS i, rep, CAST('0x' || substr(md5(concat_ws(':', {key.replace('q.station_id', 'q.station_id, 42', 1)}, rep, q.pos)), 1, 15) AS BIGINT) % q.n AS pos FROM {src} q, range({reps}) p(rep)), "
            f"bs AS (SELECT {', '.join(keys)}, rep, i AS year, value FROM dr JOIN {src} USING ({', '.join(keys)}, pos))")


@query("gev_bootstrap", f"WITH {AML}, v AS (SELECT station_id, value::DOUBLE AS value, row_number() OVER (PARTITION BY station_id ORDER BY year, value) - 1 AS pos, count(*) OVER (PARTITION BY station_id) AS n FROM am QUALIFY n >= 5), "
       f"{drawn_sql('v', K, 1000)}, {lmom_sql('bs', 'station_id, rep')}, {gev_sql(keep='station_id, rep')}, sp AS (SELECT station_id, rep, min(value) < max(value) AS spread FROM bs GROUP BY 1, 2), "
       f"lv AS (SELECT station_id, return_period, {LEV.format(p='1 - 1 / return_period')} AS level FROM gv JOIN sp USING (station_id, rep), {RP} WHERE spread AND scale > 0 AND abs(shape) <= 0.5), "
       "band AS (SELECT station_id, return_period, quantile_cont(level, 0.05) AS lo, quantile_cont(level, 0.95) AS hi, count(*) AS n_boot FROM lv WHERE level > 0 GROUP BY 1, 2), "
       f"{lmom_sql('am', name='pm')}, {gev_sql('pm', 'pg')}, held AS (SELECT * REPLACE (least(greatest(shape, -0.5), 0.5) AS shape) FROM pg) "
       f"SELECT station_id, return_period, {N(LEV.format(p='1 - 1 / return_period'), 5)} AS level, CASE WHEN n_boot > 10 THEN {N('lo', 5)} END AS ci_low, CASE WHEN n_boot > 10 THEN {N('hi', 5)} END AS ci_high, coalesce(n_boot, 0) AS n_boot "
       f"FROM held CROSS JOIN {RP} LEFT JOIN band USING (station_id, return_period) WHERE n >= 5")
def gev_bootstrap(spark, sf):
    return nudged(X.gev_bootstrap(long_am(spark, sf)), 5, "level", "ci_low", "ci_high")


@query("gumbel", f"WITH RECURSIVE {AM}, z AS (SELECT station_id, value - min(value) OVER w AS z, min(value) OVER w AS least FROM am WINDOW w AS (PARTITION BY station_id) QUALIFY count(*) OVER w >= 5), "
       "s AS (SELECT station_id, min(least) AS least, avg(z) AS mid, greatest(stddev_pop(z) / 1000, 1e-12) AS lo, greatest(stddev_pop(z) * 10, 1e-9) AS hi FROM z GROUP BY 1), "
       "r(station_id, k, pos, step) AS (SELECT station_id, 0, (lo + hi) / 2, (hi - lo) / 4 FROM s UNION ALL SELECT r.station_id, r.k + 1, "
       "any_value(r.pos) + CASE WHEN any_value(r.pos - s.mid) + sum(z * exp(-z / r.pos)) / sum(exp(-z / r.pos)) < 0 THEN any_value(r.step) ELSE -any_value(r.step) END, any_value(r.step) / 2 "
       "FROM r JOIN s ON s.station_id = r.station_id JOIN z ON z.station_id = r.station_id WHERE r.k < 60 GROUP BY r.station_id, r.k), "
       "g AS (SELECT z.station_id, any_value(pos) AS scale, any_value(least) - any_value(pos) * ln(avg(exp(-z / pos))) AS loc FROM r JOIN z USING (station_id) WHERE k = 60 GROUP BY 1) "
       f"SELECT station_id, {N('loc')} AS loc, {N('scale')} AS scale, return_period, {N('loc - scale * ln(-ln(1 - 1 / return_period))', 5)} AS level FROM g, {RP}")
def gumbel(spark, sf):
    return nudged(nudged(X.gumbel(am(spark, sf)), 6, "loc", "scale"), 5, "level")


FRACTIONS = "(VALUES " + ", ".join(f"({f!r}::DOUBLE)" for f in X.WEIBULL_BOUNDS) + ") t(f)"


@query("weibull_min", f"WITH RECURSIVE {LFLOW}, low AS (SELECT station_id, year(date) AS year, min(value) AS value FROM lflow GROUP BY 1, 2), e AS (SELECT station_id, min(value) AS lo, max(value) AS hi FROM low GROUP BY 1 HAVING count(*) >= 5), "
       f"b AS (SELECT station_id, f, lo - greatest(hi - lo, 1e-9) * f AS loc FROM e, {FRACTIONS}), y AS (SELECT station_id, f, ln(value - loc) AS y FROM low JOIN b USING (station_id)), "
       "s AS (SELECT station_id, f, max(y) AS top, avg(y) AS mid, sum(y) AS total, count(*) AS n FROM y GROUP BY 1, 2), z AS (SELECT station_id, f, y - top AS z FROM y JOIN s USING (station_id, f)), "
       "r(station_id, f, k, pos, step) AS (SELECT station_id, f, 0, 100.01::DOUBLE / 2, 99.99::DOUBLE / 4 FROM s UNION ALL SELECT r.station_id, r.f, r.k + 1, "
       "any_value(r.pos) + CASE WHEN sum(z * exp(r.pos * z)) / sum(exp(r.pos * z)) - 1 / any_value(r.pos) + any_value(s.top - s.mid) < 0 THEN any_value(r.step) ELSE -any_value(r.step) END, any_value(r.step) / 2 "
       "FROM r JOIN s ON s.station_id = r.station_id AND s.f = r.f JOIN z ON z.station_id = r.station_id AND z.f = r.f WHERE r.k < 60 GROUP BY r.station_id, r.f, r.k), "
       "g AS (SELECT station_id, f, any_value(pos) AS shape, ln(avg(exp(pos * z))) AS w FROM r JOIN z USING (station_id, f) WHERE k = 60 GROUP BY 1, 2), "
       "p AS (SELECT station_id, shape, loc, exp(top + w / shape) AS scale, n * (ln(shape) - shape * (top + w / shape)) + (shape - 1) * total - n AS ll FROM g JOIN s USING (station_id, f) JOIN b USING (station_id, f)), "
       "best AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY ll DESC, shape DESC) = 1) "
       f"SELECT station_id, {N('shape')} AS shape, {N('loc')} AS loc, {N('scale')} AS scale, return_period, {N('loc + scale * (-ln(1 - 1 / return_period)) ** (1 / shape)')} AS level FROM best, {RP}")
def weibull_min(spark, sf):
    f = long_flow(spark, sf).groupBy(*K, F.year("date").cast("long").alias("year")).agg(F.min("value").alias("value"))
    return nudged(X.weibull_low(f), 6, "shape", "loc", "scale", "level")


@query("lp3")
def lp3(spark, sf):
    return X.lp3(am(spark, sf))


@query("lp3_moments", f"WITH {AM}, y AS (SELECT station_id, log10(value) AS y FROM am WHERE value > 0), m AS (SELECT station_id, avg(y) AS mu, stddev_samp(y) AS s, count(*) AS n FROM y GROUP BY 1 HAVING count(*) >= 5), g AS (SELECT m.*, (SELECT sum((y - mu) ** 3) FROM y WHERE y.station_id = m.station_id) AS m3 FROM m), "
       f"k AS (SELECT *, CASE WHEN s > 0 THEN n * m3 / ((n - 1) * (n - 2) * s ** 3) ELSE 0 END AS sk FROM g), w AS (SELECT *, 0.302::DOUBLE / (6.0::DOUBLE / n * (1 + 1.5::DOUBLE * sk ** 2 + 0.3125::DOUBLE * sk ** 4) + 0.302) AS w FROM k) SELECT station_id, n, {N('mu')} AS mean_log, {N('s')} AS std_log, {N('w * sk + (1 - w) * 0.1')} AS skew FROM w")
def lp3_moments(spark, sf):
    return nudged(X.lp3_moments(am(spark, sf), regional_skew=0.1), 6, "mean_log", "std_log", "skew")


CAND = "[" + ", ".join(f"{(70 + 28 * i / 49) / 100!r}::DOUBLE" for i in range(50)) + "]"


@query("pot_threshold", f"WITH {FLOW}, q AS (SELECT station_id, quantile_cont(value, {CAND}) AS us, quantile_cont(value, 0.95) AS fb FROM flow GROUP BY 1), c AS (SELECT station_id, generate_subscripts(us, 1) AS j, unnest(us) AS u FROM q), e AS (SELECT c.station_id, c.j, c.u, avg(value - u) AS me, count(*) AS n FROM c JOIN flow f ON f.station_id = c.station_id AND f.value > c.u GROUP BY 1, 2, 3 HAVING count(*) >= 5), "
       "s AS (SELECT *, (lead(me) OVER w - me) / nullif(lead(u) OVER w - u, 0) AS sl FROM e WINDOW w AS (PARTITION BY station_id ORDER BY j)), d AS (SELECT *, abs(lead(sl) OVER (PARTITION BY station_id ORDER BY j) - sl) AS ch FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY ch, j) AS r FROM d WHERE ch IS NOT NULL) "
       f"SELECT q.station_id, {N('coalesce(k.u, fb)')} AS threshold FROM q LEFT JOIN k ON k.station_id = q.station_id AND r = 1")
def pot_threshold(spark, sf):
    return nudged(X.pot_threshold(flow(spark, sf)), 6, "threshold")


@query("pot_threshold_rules", f"WITH {FLOW} SELECT station_id, {N('quantile_cont(value, 0.95)')} AS p95, {N('avg(value) + 1.5 * stddev_samp(value)')} AS sqrt_rule FROM flow GROUP BY 1")
def pot_threshold_rules(spark, sf):
    f = flow(spark, sf)
    d = X.pot_threshold(f, method="percentile").withColumnRenamed("threshold", "p95").join(X.pot_threshold(f, method="sqrt_rule").withColumnRenamed("threshold", "sqrt_rule"), K)
    return nudged(d, 6, "p95", "sqrt_rule")


RATIOS = ("(VALUES " + ", ".join(f"({j}, {-f!r}::DOUBLE, 0::DOUBLE)" for j, f in enumerate(X.PARETO_BELOW)) + ", "
          + ", ".join(f"({j}, 0::DOUBLE, {f!r}::DOUBLE)" for j, f in enumerate(X.PARETO_ABOVE, len(X.PARETO_BELOW))) + ") q(j, below, above)")
FLAT = "abs({t}) * mean < 1e-7"
FALLS = ("CASE WHEN any_value(abs(r.pos) * s.mean) < 1e-7 THEN any_value(s.mean - s.sq / (2 * s.mean)) "
         "ELSE avg(y / (1 + r.pos * y)) * (1 / avg(ln(1 + r.pos * y)) + 1) - 1 / any_value(r.pos) END")


@query("gpd", f"WITH RECURSIVE {LFLOW}, th AS (SELECT station_id, quantile_cont(value, 0.95) AS threshold, count(*) AS total FROM lflow GROUP BY 1), "
       "y AS (SELECT station_id, value - threshold AS y FROM lflow JOIN th USING (station_id) WHERE value > threshold QUALIFY count(*) OVER (PARTITION BY station_id) >= 5), "
       "s AS (SELECT station_id, avg(y) AS mean, max(y) AS most, avg(y * y) AS sq, count(*) AS n FROM y GROUP BY 1), "
       f"grid AS (SELECT station_id, j, mean, below / most + above / mean AS t FROM s, {RATIOS}), k AS (SELECT station_id, j, t, any_value(mean) AS mean, avg(ln(1 + t * y)) AS k FROM grid JOIN y USING (station_id) GROUP BY ALL), "
       f"l AS (SELECT station_id, j, CASE WHEN {FLAT.format(t='t')} THEN -ln(mean) - 1 ELSE -ln(k / t) - k - 1 END AS ll FROM k), best AS (SELECT station_id, j FROM l QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY ll DESC, j) = 1), "
       "edge AS (SELECT b.station_id, min(t) AS lo, max(t) AS hi FROM best b JOIN grid g ON g.station_id = b.station_id AND g.j BETWEEN b.j - 1 AND b.j + 1 GROUP BY 1), "
       "r(station_id, i, pos, step) AS (SELECT station_id, 0, (lo + hi) / 2, (hi - lo) / 4 FROM edge UNION ALL "
       f"SELECT r.station_id, r.i + 1, any_value(r.pos) + CASE WHEN {FALLS} < 0 THEN any_value(r.step) ELSE -any_value(r.step) END, any_value(r.step) / 2 "
       "FROM r JOIN s ON s.station_id = r.station_id JOIN y ON y.station_id = r.station_id WHERE r.i < 60 GROUP BY r.station_id, r.i), "
       "f AS (SELECT station_id, any_value(pos) AS t, avg(ln(1 + pos * y)) AS k FROM r JOIN y USING (station_id) WHERE i = 60 GROUP BY 1), "
       f"g AS (SELECT station_id, n, CASE WHEN {FLAT.format(t='t')} THEN 0 ELSE k END AS shape, CASE WHEN {FLAT.format(t='t')} THEN mean ELSE k / t END AS scale FROM f JOIN s USING (station_id)) "
       f"SELECT station_id, {N('shape')} AS shape, {N('scale')} AS scale, n AS n_exceed, total, {N('threshold')} AS threshold, return_period, "
       f"{N('CASE WHEN abs(shape) < 1e-10 THEN threshold + scale * ln(return_period * n / total) ELSE threshold + scale / shape * ((return_period * n / total) ** shape - 1) END', 5)} AS level FROM g JOIN th USING (station_id), {RP}")
def gpd(spark, sf):
    f = long_flow(spark, sf)
    return nudged(nudged(X.gpd(f, X.pot_threshold(f, method="percentile")), 6, "shape", "scale", "threshold"), 5, "level")


REG = (f"{AM}, {lmom_sql()}, one AS (SELECT count(*) AS k, sum(n) AS tot, avg(t3) AS m3, avg(t4) AS m4, var_pop(t3) AS a, var_pop(t4) AS d, covar_pop(t3, t4) AS b, sum(n * l2 / l1) / sum(n) AS rl2, sum(n * t3) / sum(n) AS rt3, sum(n * t3 * t3) / sum(n) AS q3 FROM lm)")


@query("regional_ffa", f"WITH {REG} SELECT station_id, CAST(n AS BIGINT) AS n, {N('l1')} AS index_flood, {N('t3')} AS t3, {N('t4')} AS t4, {N('k * (d * (t3 - m3) ** 2 - 2 * b * (t3 - m3) * (t4 - m4) + a * (t4 - m4) ** 2) / (a * d - b * b) / 3')} AS discordancy FROM lm, one")
def regional_ffa(spark, sf):
    return nudged(X.regional(am(spark, sf))[0], 6, "index_flood", "t3", "t4", "discordancy")


@query("regional_growth", f"WITH {REG}, rg AS (SELECT k AS station_id, tot AS n, (q3 - rt3 * rt3) * sqrt(tot) AS h, 1.0::DOUBLE AS l1, rl2 AS l2, rt3 AS t3 FROM one), {gev_sql('rg', 'gv', 'h')} SELECT return_period, {N(LEV.format(p='1 - 1 / return_period'))} AS growth, {N('shape')} AS shape, {N('loc')} AS loc, {N('scale')} AS scale, {N('h')} AS heterogeneity FROM gv, {RP}")
def regional_growth(spark, sf):
    return nudged(X.regional(am(spark, sf))[1], 6, "growth", "shape", "loc", "scale", "heterogeneity")


@query("gof", f"WITH {AM}, {lmom_sql()}, {gev_sql()}, d AS (SELECT am.*, shape, loc, scale, row_number() OVER w AS i, count(*) OVER (PARTITION BY am.station_id) AS n FROM am JOIN (SELECT * EXCLUDE (n) FROM gv) g USING (station_id) WINDOW w AS (PARTITION BY am.station_id ORDER BY value, year)), "
       f"f AS (SELECT *, CASE WHEN 1 - shape * (value - loc) / scale > 0 THEN exp(-((1 - shape * (value - loc) / scale) ** (1 / shape))) WHEN shape > 0 THEN 1 ELSE 0 END AS f, {LEV.format(p='((i - 0.5) / n)')} AS q FROM d), fr AS (SELECT a.*, b.f AS fb FROM f a JOIN f b ON a.station_id = b.station_id AND b.i = a.n + 1 - a.i), "
       "g AS (SELECT station_id, max(n) AS n, -max(n) - sum((2 * i - 1) * (ln(least(greatest(f, 1e-15), 1 - 1e-15)) + ln(1 - least(greatest(fb, 1e-15), 1 - 1e-15)))) / max(n) AS ad, sum((f - (2 * i - 1) / (2.0::DOUBLE * n)) ** 2) + 1 / (12.0::DOUBLE * max(n)) AS cvm, corr(value, q) AS ppcc FROM fr GROUP BY 1), h AS (SELECT *, ad * (1 + 0.75::DOUBLE / n + 2.25::DOUBLE / (n * n)) AS a, cvm * (1 + 0.5::DOUBLE / n) AS c FROM g) "
       f"SELECT station_id, n, {N('ad')} AS ad, {N('least(greatest(CASE WHEN a >= 0.6 THEN exp(1.2937 - 5.709 * a + 0.0186 * a * a) WHEN a >= 0.34 THEN exp(0.9177 - 4.279 * a - 1.38 * a * a) WHEN a >= 0.2 THEN 1 - exp(-8.318 + 42.796 * a - 59.938 * a * a) ELSE 1 - exp(-13.436 + 101.14 * a - 223.73 * a * a) END, 0), 1)')} AS ad_p, {N('cvm')} AS cvm, "
       f"CASE WHEN c >= 0.461 THEN 0.01::DOUBLE WHEN c >= 0.347 THEN 0.025 WHEN c >= 0.274 THEN 0.05 WHEN c >= 0.175 THEN 0.10 WHEN c >= 0.116 THEN 0.25 ELSE 0.50 END AS cvm_p, {N('ppcc')} AS ppcc FROM h")
def gof(spark, sf):
    a = am(spark, sf)
    return nudged(X.goodness_of_fit(a, X.gev_parameters(X.lmoments(a))), 6, "ad", "ad_p", "cvm", "ppcc")


# t quantiles of the test by how many values are left
TQ = "(VALUES " + ", ".join(f"({m}, {_t_ppf(0.1 / m, max(m - 2, 1))!r}::DOUBLE)" for m in range(1, 121)) + ") q(m, t)"


@query("grubbs_beck", f"WITH {AM}, y AS (SELECT station_id, log10(greatest(value, 1e-30)) AS y, row_number() OVER (PARTITION BY station_id ORDER BY value, year) AS place, count(*) OVER (PARTITION BY station_id) AS n FROM am), "
       f"r AS (SELECT a.station_id, a.place, a.y, a.n, count(*) AS m, avg(b.y) AS mu, stddev_samp(b.y) AS sd FROM y a JOIN y b ON a.station_id = b.station_id AND b.place >= a.place GROUP BY 1, 2, 3, 4), "
       f"l AS (SELECT r.*, mu + t * sqrt(r.m - 1) / sqrt(greatest(r.m - 2 + t * t, 1e-15)) * coalesce(sd, 0) AS lim FROM r JOIN {TQ} ON q.m = r.m), "
       "f AS (SELECT *, bool_and(m >= 5 AND coalesce(sd, 0) >= 1e-15 AND y < lim AND place <= n // 2 - 1) OVER (PARTITION BY station_id ORDER BY place) AS low FROM l) "
       f"SELECT station_id, {N('CASE WHEN bool_or(low) THEN 10 ** arg_min(lim, place) FILTER (WHERE NOT low) ELSE 10 ** (min(y) - 1) END')} AS threshold, CAST(count(*) FILTER (WHERE low) AS BIGINT) AS n_low, max(n) AS n FROM f GROUP BY 1 HAVING max(n) >= 5")
def grubbs_beck(spark, sf):
    return nudged(X.grubbs_beck(am(spark, sf)), 6, "threshold")


for _name, _fn in (("ema_censored", X.ema_censored), ("fit_compare", X.fit_compare)):
    def _run(spark, sf, fn=_fn):
        return fn(am(spark, sf))
    query(_name)(_run)


@query("loo_cv", f"WITH {AML}, o AS (SELECT a.station_id, a.year AS without, a.value AS held, b.year, b.value FROM am a JOIN am b ON b.station_id = a.station_id AND b.year <> a.year), {lmom_sql('o', 'station_id, without, held')}, {gev_sql(keep='station_id, n, held')}, "
       f"e AS (SELECT station_id, {LEV.format(p='0.5::DOUBLE')} - held AS e FROM gv WHERE n >= 5) SELECT station_id, {N('sqrt(avg(e * e))')} AS rmse, {N('avg(e)')} AS bias, {N('avg(abs(e))')} AS mae, count(*) AS n FROM e GROUP BY 1")
def loo_cv(spark, sf):
    return nudged(X.leave_one_out(long_am(spark, sf)), 6, "rmse", "bias", "mae")


@query("coverage", f"WITH {AML}, f AS (SELECT station_id, year, value::DOUBLE AS value, (row_number() OVER (PARTITION BY station_id ORDER BY md5(concat_ws(':', station_id, 42, year)), year, value) - 1) % 10 AS part FROM am QUALIFY count(*) OVER (PARTITION BY station_id) >= 10), "
       "v AS (SELECT f.station_id, g.fold, value, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY f.station_id, g.fold) AS n FROM f JOIN range(10) g(fold) ON f.part <> g.fold WINDOW w AS (PARTITION BY f.station_id, g.fold ORDER BY year, value) QUALIFY n >= 4), "
       f"{drawn_sql('v', ['station_id', 'fold'], 200)}, {lmom_sql('bs', 'station_id, fold, rep')}, {gev_sql(keep='station_id, fold, rep')}, sp AS (SELECT station_id, fold, rep, min(value) AS least, max(value) AS most FROM bs GROUP BY 1, 2, 3), "
       f"m AS (SELECT station_id, fold, CASE WHEN least = most THEN least ELSE {LEV.format(p='0.5::DOUBLE')} END AS m FROM gv JOIN sp USING (station_id, fold, rep)), "
       "band AS (SELECT station_id, fold, quantile_cont(m, 0.05) AS lo, quantile_cont(m, 0.95) AS hi FROM m WHERE isfinite(m) GROUP BY 1, 2 HAVING count(*) >= 50) "
       f"SELECT f.station_id, {N('coalesce(avg(CASE WHEN lo IS NOT NULL THEN (value BETWEEN lo AND hi)::INT END), 0)')} AS coverage, count(lo) AS n_tested FROM f LEFT JOIN band ON band.station_id = f.station_id AND band.fold = f.part GROUP BY 1")
def coverage(spark, sf):
    return nudged(X.coverage(long_am(spark, sf)), 6, "coverage")


@query("return_shift", f"WITH {AM}, ha AS (SELECT * FROM am WHERE year <= 1999), fa AS (SELECT * FROM am WHERE year > 1996), {lmom_sql('ha', name='hl')}, {lmom_sql('fa', name='fl')}, {gev_sql('hl', 'hg')}, {gev_sql('fl', 'fg')}, a AS (SELECT station_id, return_period, {LEV.format(p='1 - 1 / return_period')} AS h FROM hg, {RP} WHERE n >= 4), b AS (SELECT station_id, return_period, {LEV.format(p='1 - 1 / return_period')} AS f FROM fg, {RP} WHERE n >= 5) "
       f"SELECT station_id, return_period, {N('h', 4)} AS hist_level, {N('f', 4)} AS future_level, {N('f / h', 4)} AS shift FROM a JOIN b USING (station_id, return_period) WHERE return_period <= 100 AND station_id IN (SELECT station_id FROM hg WHERE n >= 5)")
def return_shift(spark, sf):
    a = am(spark, sf)
    return nudged(X.return_shift(a.where("year <= 1999"), a.where("year > 1996")), 4, "hist_level", "future_level", "shift")


@query("empirical_return_period", f"WITH {AM} SELECT station_id, year, value, {N('(count(*) OVER (PARTITION BY station_id) + 1) / (count(*) OVER (PARTITION BY station_id) + 1 - row_number() OVER (PARTITION BY station_id ORDER BY value, year))::DOUBLE')} AS return_period FROM am")
def empirical_return_period(spark, sf):
    return nudged(X.empirical_periods(am(spark, sf)), 6, "return_period")


@query("plotting_positions", f"WITH {AM}, {lmom_sql()}, {gev_sql()}, p AS (SELECT am.*, shape, loc, scale, (row_number() OVER (PARTITION BY am.station_id ORDER BY value, year) - 0.4::DOUBLE) / (count(*) OVER (PARTITION BY am.station_id) + 0.2::DOUBLE) AS p FROM am JOIN gv USING (station_id)) SELECT station_id, year, value, {N('p')} AS p, {N(LEV.format(p='p'))} AS theoretical FROM p")
def plotting_positions(spark, sf):
    a = am(spark, sf)
    return nudged(X.qq_positions(a, X.gev_parameters(X.lmoments(a))), 6, "p", "theoretical")


# ── ratings ─────────────────────────────────────────────────────────────────────
RF = f"{GAUGING}, rf AS (SELECT station_id, regr_slope(ln(discharge), ln(stage)) AS b, exp(regr_intercept(ln(discharge), ln(stage))) AS a FROM gauging GROUP BY 1), rr AS (SELECT station_id, count(*) AS n, sqrt(avg((discharge - a * stage ** b) ** 2)) AS rmse, 1 - sum((discharge - a * stage ** b) ** 2) / (var_pop(discharge) * count(*)) AS r2, sqrt(var_pop(discharge - a * stage ** b) * count(*) / (count(*) - 2)) AS sd FROM gauging JOIN rf USING (station_id) GROUP BY 1)"


@query("rating_fit", f"WITH {RF} SELECT station_id, n, {N('a', 4)} AS a, {N('b')} AS b, {N('r2')} AS r_squared, {N('rmse', 4)} AS rmse FROM rf JOIN rr USING (station_id)")
def rating_fit(spark, sf):
    f = R.fit(gaugings(spark, sf), 0.0)
    return nudged(nudged(f.select(*K, "n", "a", "b", "r_squared", "rmse"), 4, "a", "rmse"), 6, "b", "r_squared")


@query("rating_fit_free")
def rating_fit_free(spark, sf):
    return R.fit(gaugings(spark, sf))


@query("rating_fit_segmented")
def rating_fit_segmented(spark, sf):
    return R.fit_segmented(gaugings(spark, sf))


@query("rating_cv")
def rating_cv(spark, sf):
    return R.cross_validate(gaugings(spark, sf))


@query("rating_interval", f"WITH {RF}, s AS (SELECT station_id, CAST(l_shipdate AS DATE) AS date, avg(l_quantity) AS stage FROM (SELECT l_suppkey % 10 AS station_id, * FROM lineitem) GROUP BY 1, 2) SELECT station_id, date, {N('a * stage ** b', 3)} AS predicted, {N('greatest(a * stage ** b - 1.96::DOUBLE * sd, 0)', 3)} AS lower, {N('a * stage ** b + 1.96::DOUBLE * sd', 3)} AS upper FROM s JOIN rf USING (station_id) JOIN rr USING (station_id)")
def rating_interval(spark, sf):
    g = gaugings(spark, sf)
    s = g.groupBy(*K, F.to_date("ts").alias("date")).agg(F.avg("stage").alias("stage"))
    return nudged(R.interval(s, R.fit(g, 0.0), t_value=1.96).drop("stage"), 3, "predicted", "lower", "upper")


@query("rating_shift")
def rating_shift(spark, sf):
    d = gaugings(spark, sf).groupBy(*K, F.to_date("ts").alias("date")).agg(F.avg("stage").alias("stage"), F.avg("discharge").alias("discharge"))
    return R.rating_shift(d)


SEG_ROWS = "(VALUES (0.0::DOUBLE, 20.0::DOUBLE, 1200.0::DOUBLE, 1.1::DOUBLE, 0.0::DOUBLE), (20.0, 40.0, 900.0, 1.2, 1.0), (40.0, 60.0, 700.0, 1.25, 2.0)) g(lo, hi, a, b, h0)"


def segments(spark, sf):
    """Three rating segments per station that occurs in the gaugings."""
    rows = spark.sql("SELECT * FROM VALUES (0D, 20D, 1200D, 1.1D, 0D), (20D, 40D, 900D, 1.2D, 1D), (40D, 60D, 700D, 1.25D, 2D) AS g(lo, hi, a, b, h0)")
    return gaugings(spark, sf).select("station_id").distinct().join(F.broadcast(rows), F.lit(True))


PICK = "CASE WHEN stage * 1.3 < 20 THEN 1200 * (stage * 1.3) ** 1.1 WHEN stage * 1.3 < 40 THEN 900 * (stage * 1.3 - 1) ** 1.2 ELSE 700 * (stage * 1.3 - 2) ** 1.25 END"


@query("rating_predict", f"WITH {GAUGING}, p AS (SELECT station_id, {PICK.replace('1.3', '1.3::DOUBLE')} AS q FROM gauging) SELECT station_id, count(*) AS n, {N('avg(q)', 4)} AS mean_q, {N('max(q)', 4)} AS max_q FROM p GROUP BY 1")
def rating_predict(spark, sf):
    g = gaugings(spark, sf).select(*K, (F.col("stage") * 1.3).alias("stage"))
    d = R.predict(g, segments(spark, sf)).groupBy(*K).agg(F.count(F.lit(1)).alias("n"), F.avg("discharge_pred").alias("mean_q"), F.max("discharge_pred").alias("max_q"))
    return nudged(d, 4, "mean_q", "max_q")


@query("rating_invert", f"WITH {GAUGING}, s AS (SELECT *, 1200 * 20.0::DOUBLE ** 1.1 AS h1, 900 * 19.0::DOUBLE ** 1.2 AS l2, 900 * 39.0::DOUBLE ** 1.2 AS h2, 700 * 38.0::DOUBLE ** 1.25 AS l3, 700 * 58.0::DOUBLE ** 1.25 AS h3 FROM gauging), p AS (SELECT station_id, CASE WHEN discharge < 0 OR discharge BETWEEN 0 AND h1 THEN (discharge / 1200) ** (1 / 1.1::DOUBLE) WHEN discharge BETWEEN l2 AND h2 THEN (discharge / 900) ** (1 / 1.2::DOUBLE) + 1 "
       f"WHEN discharge BETWEEN l3 AND h3 OR discharge > h3 THEN (discharge / 700) ** (1 / 1.25::DOUBLE) + 2 ELSE (discharge / 1200) ** (1 / 1.1::DOUBLE) END AS h FROM s) SELECT station_id, count(*) AS n, {N('avg(h)')} AS mean_stage, {N('max(h)')} AS max_stage FROM p GROUP BY 1")
def rating_invert(spark, sf):
    d = R.invert(gaugings(spark, sf).select(*K, "discharge"), segments(spark, sf))
    return nudged(d.groupBy(*K).agg(F.count(F.lit(1)).alias("n"), F.avg("stage_pred").alias("mean_stage"), F.max("stage_pred").alias("max_stage")), 6, "mean_stage", "max_stage")


# ── dependence ──────────────────────────────────────────────────────────────────
NAMES = ("click", "error", "purchase", "signup", "view")
WIDE = (f"""{OBS}, wd AS (SELECT station_id, CAST(ts AS DATE) AS date, {', '.join(f"avg(CASE WHEN parameter = '{n}' THEN value END) AS {n}" for n in NAMES)} FROM obs GROUP BY 1, 2), wc AS (SELECT * FROM wd WHERE {' AND '.join(f'{n} IS NOT NULL' for n in NAMES)})""")
PAIR_ROWS = ", pr AS (" + " UNION ALL ".join(f"SELECT '{a}' AS param1, '{b}' AS param2, station_id, date, round({a}, 8) AS x, round({b}, 8) AS y FROM wd WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for i, a in enumerate(NAMES) for b in NAMES[i + 1:]) + ")"


def wide(spark, sf):
    o = obs(spark, sf).withColumn("date", F.to_date("ts"))
    return o.groupBy(*K, "date").pivot("parameter", list(NAMES)).agg(F.avg("value"))


def pair_rows(spark, sf):
    d = D.column_pairs(wide(spark, sf), NAMES, ("station_id", "date")).dropna(subset=["x", "y"])
    return d.withColumn("x", F.round("x", 8)).withColumn("y", F.round("y", 8))


@query("corr_pairs", f"WITH {WIDE} " + " UNION ALL ".join(f"SELECT '{a}' AS param1, '{b}' AS param2, {N(f'corr({a}, {b})')} AS r, count(*) AS n FROM wd WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for i, a in enumerate(NAMES) for b in NAMES[i + 1:]))
def corr_pairs(spark, sf):
    p = pair_rows(spark, sf).groupBy("param1", "param2").agg(F.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n"))
    return nudged(p, 6, "r")


@query("corr_pairs_significant")
def corr_pairs_significant(spark, sf):
    return D.correlation_pairs(wide(spark, sf).dropna(), NAMES, only_significant=False)


@query("partial_corr_edges")
def partial_corr_edges(spark, sf):
    return D.partial_correlations(wide(spark, sf).dropna(), NAMES, alpha=None)


PO = f"{PAIRED}, po AS (SELECT station_id, date, (rank() OVER (PARTITION BY station_id ORDER BY obs) + (count(*) OVER (PARTITION BY station_id, obs) - 1) / 2.0::DOUBLE) / (count(*) OVER (PARTITION BY station_id) + 1) AS u, (rank() OVER (PARTITION BY station_id ORDER BY sim) + (count(*) OVER (PARTITION BY station_id, sim) - 1) / 2.0::DOUBLE) / (count(*) OVER (PARTITION BY station_id) + 1) AS v FROM paired)"


def xy(spark, sf):
    return paired(spark, sf).select(*K, "date", F.col("obs").alias("x"), F.col("sim").alias("y"))


@query("pseudo_obs", f"WITH {PO} SELECT station_id, date, {N('u')} AS u, {N('v')} AS v FROM po")
def pseudo_obs(spark, sf):
    return nudged(D.pseudo_observations(xy(spark, sf), K).select(*K, "date", "u", "v"), 6, "u", "v")


KT = ("n AS (SELECT {k}, count(*)::DOUBLE AS n FROM {s} GROUP BY ALL), sc AS (SELECT {ak}, sum(sign(b.x - a.x) * sign(b.y - a.y)) / 2 AS s FROM {s} a JOIN {s} b USING ({k}) GROUP BY ALL), tx AS (SELECT {k}, sum(c * (c - 1) / 2) AS tx FROM (SELECT {k}, x, count(*)::DOUBLE AS c FROM {s} GROUP BY ALL) GROUP BY ALL), "
      "ty AS (SELECT {k}, sum(c * (c - 1) / 2) AS ty FROM (SELECT {k}, y, count(*)::DOUBLE AS c FROM {s} GROUP BY ALL) GROUP BY ALL), kt AS (SELECT {k}, n, s / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)) AS tau FROM n JOIN sc USING ({k}) JOIN tx USING ({k}) JOIN ty USING ({k}))")


@query("kendall_pairs", f"WITH {WIDE}{PAIR_ROWS}, {KT.format(k='param1, param2', ak='param1, param2', s='pr')} SELECT param1, param2, CAST(n AS BIGINT) AS n, {N('tau')} AS tau FROM kt")
def kendall_pairs(spark, sf):
    from limnos.operators.concordance import kendall_tau_b
    d = kendall_tau_b(pair_rows(spark, sf), "x", "y", ["param1", "param2"])
    return nudged(d.select("param1", "param2", "n", "tau"), 6, "tau")


PD = ("pn AS (SELECT param1, param2, x, y, count(*) OVER p AS n, rank() OVER (p ORDER BY x) + (count(*) OVER (PARTITION BY param1, param2, x) - 1) / 2.0::DOUBLE AS rx, "
      "rank() OVER (p ORDER BY y) + (count(*) OVER (PARTITION BY param1, param2, y) - 1) / 2.0::DOUBLE AS ry FROM pr WINDOW p AS (PARTITION BY param1, param2)), "
      "tl AS (SELECT param1, param2, avg((rx / (n + 1) > 0.9 AND ry / (n + 1) > 0.9)::INT) / 0.1 AS up, avg((rx / (n + 1) < 0.1 AND ry / (n + 1) < 0.1)::INT) / 0.1 AS low FROM pn GROUP BY ALL), "
      "ts AS (SELECT param1, param2, sum(sign(b.x - a.x) * sign(b.y - a.y)) / 2 AS s FROM pr a JOIN pr b USING (param1, param2) GROUP BY ALL), "
      "tz AS (SELECT kt.param1 AS param1, kt.param2 AS param2, kt.n AS n, tau, -abs(s) / sqrt((kt.n * (kt.n - 1) * (2 * kt.n + 5) - vx - vy) / 18 + 2 * tx * ty / (kt.n * (kt.n - 1)) + ux * uy / (9 * kt.n * (kt.n - 1) * (kt.n - 2))) AS z FROM kt JOIN ts USING (param1, param2) "
      + " ".join(f"JOIN (SELECT param1, param2, sum(c * (c - 1) / 2) AS t{c}, sum(c * (c - 1) * (c - 2)) AS u{c}, sum(c * (c - 1) * (2 * c + 5)) AS v{c} FROM (SELECT param1, param2, {c}, count(*)::DOUBLE AS c FROM pr GROUP BY ALL) GROUP BY ALL) AS tie{c} USING (param1, param2)" for c in ("x", "y")) + ")")


@query("pair_dependence", f"WITH {WIDE}{PAIR_ROWS}, {KT.format(k='param1, param2', ak='param1, param2', s='pr')}, {PD} SELECT param1, param2, CAST(n AS BIGINT) AS n, {N('tau')} AS tau, {N(f'2 * {norm_cdf_sql('z')}')} AS p_value, {N('up')} AS upper_tail_dep, {N('low')} AS lower_tail_dep FROM tz JOIN tl USING (param1, param2) WHERE n >= 30")
def pair_dependence(spark, sf):
    from limnos.operators.concordance import pair_dependence as report
    return nudged(report(pair_rows(spark, sf)), 6, "tau", "p_value", "upper_tail_dep", "lower_tail_dep")


@query("tail_dep", f"WITH {PO} SELECT station_id, {N('avg((u > 0.9 AND v > 0.9)::INT) / 0.1')} AS upper_tail_dep, {N('avg((u < 0.1 AND v < 0.1)::INT) / 0.1')} AS lower_tail_dep FROM po GROUP BY 1")
def tail_dep(spark, sf):
    return nudged(D.tail_shares(D.pseudo_observations(xy(spark, sf), K), K), 6, "upper_tail_dep", "lower_tail_dep")


@query("copula_fit")
def copula_fit(spark, sf):
    return D.copula_fit(xy(spark, sf), K)


TH = f"WITH {PAIRED}, xy AS (SELECT station_id, obs AS x, sim AS y FROM paired), {KT.format(k='station_id', ak='station_id', s='xy')}, th AS (SELECT station_id, greatest(2 * greatest(tau, 0.05) / (1 - greatest(tau, 0.05)), 1e-4) AS cl, greatest(1 / (1 - greatest(tau, 0.05)), 1) AS gu FROM kt), "
JC = "fc AS (SELECT station_id, 'clayton' AS family, cl AS theta, greatest(0.9::DOUBLE ** (-cl) + 0.8::DOUBLE ** (-cl) - 1, 0) ** (-1 / cl) AS c FROM th UNION ALL SELECT station_id, 'gumbel', gu, exp(-(((-ln(0.9)) ** gu + (-ln(0.8)) ** gu) ** (1 / gu))) FROM th) "


def closed_forms(spark, sf):
    from limnos.operators.concordance import kendall_tau_b
    p = D.copula_parameters(kendall_tau_b(xy(spark, sf), "x", "y", K).select(*K, "tau"))
    return p.where("family IN ('clayton', 'gumbel')").drop("tau")


@query("joint_exceedance", TH + JC + f"SELECT station_id, family, {N('theta')} AS theta, {N('1 - 0.9 - 0.8 + c')} AS p_both, {N('1 - c')} AS p_either, {N('(1 - 0.9 - 0.8 + c) / (1 - 0.8::DOUBLE)')} AS p_x_given_y, {N('1 / (1 - 0.9 - 0.8 + c)', 4)} AS return_period FROM fc")
def joint_exceedance(spark, sf):
    d = D.joint_exceedance(closed_forms(spark, sf), 0.9, 0.8)
    return nudged(nudged(d, 6, "theta", "p_both", "p_either", "p_x_given_y"), 4, "return_period")


@query("tail_coeff", TH + f"z AS (SELECT 1) SELECT station_id, 'clayton' AS family, {N('2 ** (-1 / cl)')} AS lambda_lower, 0.0::DOUBLE AS lambda_upper FROM th UNION ALL SELECT station_id, 'gumbel', 0.0, {N('2 - 2 ** (1 / gu)')} FROM th")
def tail_coeff(spark, sf):
    return nudged(D.tail_coefficients(closed_forms(spark, sf)).drop("theta"), 6, "lambda_lower", "lambda_upper")


# ── ensembles ───────────────────────────────────────────────────────────────────
EN = f"{OBS}, ev AS (SELECT parameter AS model, CAST(ts AS DATE) AS date, avg(value) AS sim FROM obs GROUP BY 1, 2), en AS (SELECT model, date, sim, avg(sim) OVER (PARTITION BY date) * 1.05::DOUBLE AS obs FROM ev)"


def members(spark, sf):
    e = obs(spark, sf).groupBy(F.col("parameter").alias("model"), F.to_date("ts").alias("date")).agg(F.avg("value").alias("sim"))
    return e.join(e.groupBy("date").agg((F.avg("sim") * 1.05).alias("obs")), "date")


@query("ensemble_weighted", f"WITH {EN}, iv AS (SELECT model, 1 / sqrt(avg((obs - sim) ** 2)) AS i FROM en GROUP BY 1), w AS (SELECT model, i / sum(i) OVER () AS w FROM iv), c AS (SELECT date, sum(w * sim) AS m FROM en JOIN w USING (model) GROUP BY 1), v AS (SELECT en.date, max(m) AS m, sum(w * (sim - m) ** 2) AS v FROM en JOIN w USING (model) JOIN c USING (date) GROUP BY 1) "
       f"SELECT date, {N('m')} AS mean, {N('m - 1.96::DOUBLE * sqrt(v)', 5)} AS lower, {N('m + 1.96::DOUBLE * sqrt(v)', 5)} AS upper FROM v")
def ensemble_weighted(spark, sf):
    m = members(spark, sf)
    return nudged(nudged(M.combine(m, M.skill_weights(m)), 6, "mean"), 5, "lower", "upper")


@query("ensemble_equal", f"WITH {EN} SELECT date, {N('avg(sim)')} AS mean, {N('avg(sim) - 1.96::DOUBLE * stddev_pop(sim)', 5)} AS lower, {N('avg(sim) + 1.96::DOUBLE * stddev_pop(sim)', 5)} AS upper FROM en GROUP BY 1")
def ensemble_equal(spark, sf):
    return nudged(nudged(M.combine(members(spark, sf)), 6, "mean"), 5, "lower", "upper")


@query("ensemble_adaptive", f"WITH {EN}, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY date) AS rn FROM en), e AS (SELECT a.model, a.date, a.sim, sum((b.obs - b.sim) ** 2 * 0.95::DOUBLE ** (a.rn - b.rn)) / sum(0.95::DOUBLE ** (a.rn - b.rn)) AS e FROM r a JOIN r b ON a.model = b.model AND b.rn BETWEEN a.rn - 29 AND a.rn GROUP BY 1, 2, 3), "
       f"w AS (SELECT *, 1 / sqrt(e) / sum(1 / sqrt(e)) OVER (PARTITION BY date) AS w FROM e) SELECT model, date, {N('w')} AS weight, {N('sum(w * sim) OVER (PARTITION BY date)')} AS combined FROM w")
def ensemble_adaptive(spark, sf):
    return nudged(M.adaptive(members(spark, sf)).drop("obs", "sim"), 6, "weight", "combined")


@query("chain_rhat", f"WITH {PAIRED}, s AS (SELECT CAST(station_id % 2 AS VARCHAR) AS param, station_id AS chain, row_number() OVER (PARTITION BY station_id ORDER BY date) - 1 AS iter, obs AS value FROM paired), n AS (SELECT param, min(c) AS n FROM (SELECT param, chain, count(*) AS c FROM s GROUP BY 1, 2) GROUP BY 1), "
       f"d AS (SELECT s.param, chain, avg(value) AS mu, var_samp(value) AS v, max(n) AS n FROM s JOIN n USING (param) WHERE iter < n GROUP BY 1, 2) SELECT param, count(*) AS m, max(n) AS n, {N('sqrt(((max(n) - 1) / max(n)::DOUBLE * avg(v) + var_samp(mu)) / avg(v))')} AS r_hat FROM d GROUP BY 1")
def chain_rhat(spark, sf):
    from limnos.operators.series import numbered
    s = numbered(paired(spark, sf).select(*K, "date", F.col("obs").alias("value")))
    s = s.select((F.col("station_id") % 2).cast("string").alias("param"), F.col("station_id").alias("chain"), (F.col("rn") - 1).alias("iter"), "value")
    return nudged(M.chain_rhat(s), 6, "r_hat")


@query("bayes_linreg")
def bayes_linreg(spark, sf):
    d, names = M.polynomial(paired(spark, sf), "sim", 2)
    return M.bayes_regression(d, names, "obs", K)


@query("bayes_linreg_mean", f"WITH {PAIRED} SELECT station_id, {N('regr_intercept(obs, sim)', 3)} AS intercept, {N('regr_slope(obs, sim)', 3)} AS slope FROM paired GROUP BY 1")
def bayes_linreg_mean(spark, sf):
    d, names = M.polynomial(paired(spark, sf), "sim", 1)
    r = M.bayes_regression(d, names, "obs", K, precision=1e-9)
    pick = lambda t: F.max(F.when(F.col("term") == t, F.col("estimate")))
    return nudged(r.groupBy(*K).agg(pick(names[0]).alias("intercept"), pick(names[1]).alias("slope")), 3, "intercept", "slope")


