"""Queries over paired series: fit metrics, probabilistic scores, distribution distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.functions.special import norm_cdf_sql
from limnos.operators import metrics as M
from limnos.plans.adapters import FLOW, OBS, PAIRED, flow, obs, paired
from limnos.plans.catalog import N, R, nudged, query


def rounded(df, n, *cols):
    return df.select(*[F.round(c, n).alias(c) if c in cols else c for c in df.columns])


NSE = "1 - avg((obs - sim) * (obs - sim)) / var_pop(obs)"
LNSE = "1 - avg((ln(obs + 1e-6) - ln(sim + 1e-6)) ** 2) / var_pop(ln(obs + 1e-6))"
KGE = "1 - sqrt((corr(obs, sim) - 1) ** 2 + (stddev_pop(sim) / stddev_pop(obs) - 1) ** 2 + (avg(sim) / avg(obs) - 1) ** 2)"
METRICS = {"nse": NSE, "log_nse": LNSE, "kge": KGE, "pbias": "100 * sum(sim - obs) / sum(obs)",
           "rmse": "sqrt(avg((obs - sim) ** 2))", "r2": NSE, "mae": "avg(abs(obs - sim))"}


def _metric(name, sql):
    @query(f"metrics_{name}", f"WITH {PAIRED} SELECT station_id, count(*) AS n, {R(sql, 6)} AS {name} FROM paired GROUP BY 1")
    def run(spark, sf):
        return M.fit_metrics(paired(spark, sf)).select("station_id", "n", F.round(name, 6).alias(name))
    return run


for _n, _s in METRICS.items():
    _metric(_n, _s)

PIN = "greatest({q} * (obs - sim), ({q} - 1) * (obs - sim))"


@query("metrics_pinball", f"WITH {PAIRED} SELECT station_id, {R('avg(' + PIN.format(q='0.9') + ')', 6)} AS pinball FROM paired GROUP BY 1")
def metrics_pinball(spark, sf):
    return rounded(M.quantile_loss(paired(spark, sf), 0.9), 6, "pinball")


BAND = f"{PAIRED}, b AS (SELECT *, sim * 8 - 40 AS lower, sim * 8 + 60 AS upper FROM paired)"


def band(spark, sf):
    return paired(spark, sf).withColumn("lower", F.col("sim") * 8 - 40).withColumn("upper", F.col("sim") * 8 + 60)


@query("metrics_picp", f"WITH {BAND} SELECT station_id, {R('avg(CASE WHEN obs BETWEEN lower AND upper THEN 1.0::DOUBLE ELSE 0 END)', 6)} AS picp FROM b GROUP BY 1")
def metrics_picp(spark, sf):
    return rounded(M.interval_coverage(band(spark, sf)).select("station_id", "picp"), 6, "picp")


@query("metrics_mpiw", f"WITH {BAND} SELECT station_id, {R('avg(upper - lower)', 6)} AS mpiw, {R('avg(upper - lower) / (max(obs) - min(obs))', 6)} AS mpiw_normalised FROM b GROUP BY 1")
def metrics_mpiw(spark, sf):
    return rounded(M.interval_coverage(band(spark, sf)).drop("picp"), 6, "mpiw", "mpiw_normalised")


ENS = (f"{OBS}, ens AS (SELECT parameter AS model, CAST(ts AS DATE) AS date, avg(value) AS sim FROM obs GROUP BY 1, 2), "
       "truth AS (SELECT date, avg(sim) * 1.1 AS y FROM ens GROUP BY 1)")


def ensemble(spark, sf):
    """Daily means of the five parameters as a five-member ensemble."""
    e = obs(spark, sf).groupBy(F.col("parameter").alias("model"), F.to_date("ts").alias("date")).agg(F.avg("value").alias("sim"))
    y = e.groupBy("date").agg((F.avg("sim") * 1.1).alias("obs"))
    return e.join(y, "date").withColumn("k", F.lit("all"))


@query("metrics_crps_ens", f"""WITH {ENS}, a AS (SELECT date, avg(abs(sim - y)) AS near, count(*) AS m FROM ens JOIN truth USING (date) GROUP BY 1),
 b AS (SELECT e.date, sum(abs(e.sim - f.sim)) AS s FROM ens e JOIN ens f USING (date) GROUP BY 1) SELECT 'all' AS k, {R('avg(near - s / (2.0::DOUBLE * m * m))', 6)} AS crps FROM a JOIN b USING (date)""")
def metrics_crps_ens(spark, sf):
    return rounded(M.crps_ensemble(ensemble(spark, sf), ["k"], "date"), 6, "crps")


@query("metrics_crps_q", f"""WITH {PAIRED}, q AS (SELECT station_id, q, obs, sim * 4 + q * 40 AS sim FROM paired, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) t(q)), l AS (SELECT station_id, q, avg({PIN.format(q='q')}) AS loss FROM q GROUP BY 1, 2)
 SELECT station_id, {R('2 * avg(loss)', 6)} AS crps FROM l GROUP BY 1""")
def metrics_crps_q(spark, sf):
    p = paired(spark, sf).withColumn("q", F.explode(F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))).withColumn("pred", F.col("sim") * 4 + F.col("q") * 40)
    return rounded(M.crps_quantiles(p, ["station_id"]), 6, "crps")


PCT = ", ".join(R(f"abs(quantile_cont(sim, {p / 100}) - quantile_cont(obs, {p / 100}))", 6) + f" AS p{p}_error" for p in (5, 25, 50, 75, 95))
KS_SQL = """u AS (SELECT station_id, obs AS v, 1 AS w FROM {src} UNION ALL SELECT station_id, sim, 0 FROM {src}), uc AS (SELECT station_id, v, sum(w) AS a, count(*) - sum(w) AS b FROM u GROUP BY 1, 2),
 cs AS (SELECT station_id, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER p AS na, sum(b) OVER p AS nb FROM uc WINDOW w AS (PARTITION BY station_id ORDER BY v), p AS (PARTITION BY station_id)),
 ks AS (SELECT station_id, max(abs(ca / na::DOUBLE - cb / nb::DOUBLE)) AS ks FROM cs GROUP BY 1)"""


@query("downscale_eval", f"WITH {PAIRED}, {KS_SQL.format(src='paired')}, a AS (SELECT station_id, {R('sqrt(avg((sim - obs) ** 2))', 6)} AS rmse, {R('avg(abs(sim - obs))', 6)} AS mae, {R('avg(sim - obs)', 6)} AS bias, {R('corr(obs, sim)', 6)} AS correlation, {PCT} FROM paired GROUP BY 1) "
       f"SELECT a.*, {R('ks', 6)} AS ks FROM a JOIN ks USING (station_id)")
def downscale_eval(spark, sf):
    d = M.downscaling_skill(paired(spark, sf))
    return rounded(d, 6, *[c for c in d.columns if c != "station_id"])


@query("join_inner_align", f"WITH {PAIRED} SELECT station_id, date, obs, sim FROM paired")
def join_inner_align(spark, sf):
    p = paired(spark, sf)
    return p.where(M.finite("obs", "sim")).select("station_id", "date", "obs", "sim")


@query("mann_whitney", f"""WITH {FLOW}, r AS (SELECT station_id, date < DATE '1998-06-01' AS f, rank() OVER (PARTITION BY station_id ORDER BY value) + (count(*) OVER (PARTITION BY station_id, value) - 1) / 2.0::DOUBLE AS r FROM flow)
 SELECT station_id, CAST(sum(f::INT) AS BIGINT) AS n1, CAST(sum((NOT f)::INT) AS BIGINT) AS n2, {R('sum(CASE WHEN f THEN r END) - sum(f::INT) * (sum(f::INT) + 1) / 2.0::DOUBLE', 2)} AS u FROM r GROUP BY 1""")
def mann_whitney(spark, sf):
    d = M.rank_test(flow(spark, sf), ["station_id"], F.col("date") < "1998-06-01")
    return d.select("station_id", "n1", "n2", F.round("u", 2).alias("u"))


MZ_CDF = norm_cdf_sql("mz")
MWP = (f"{FLOW}, r AS (SELECT station_id, value, date < DATE '1998-06-01' AS f, rank() OVER (PARTITION BY station_id ORDER BY value) + (count(*) OVER (PARTITION BY station_id, value) - 1) / 2.0::DOUBLE AS r FROM flow), "
       "g AS (SELECT station_id, sum(f::INT)::DOUBLE AS n1, count(*)::DOUBLE AS n, sum(CASE WHEN f THEN r END) - sum(f::INT) * (sum(f::INT) + 1) / 2.0::DOUBLE AS u FROM r GROUP BY 1), t AS (SELECT station_id, sum(c ** 3 - c) AS ties FROM (SELECT station_id, value, count(*)::DOUBLE AS c FROM flow GROUP BY 1, 2) GROUP BY 1), "
       "h AS (SELECT *, n - n1 AS n2, -((greatest(u, n1 * (n - n1) - u) - n1 * (n - n1) / 2 - 0.5) / sqrt(n1 * (n - n1) / 12 * (n + 1 - ties / (n * (n - 1))))) AS mz FROM g JOIN t USING (station_id))")


@query("mann_whitney_p", f"WITH {MWP} SELECT station_id, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, {N('u', 2)} AS u, {N('-mz')} AS z, {N(f'least(1, 2 * {MZ_CDF})')} AS p_value FROM h")
def mann_whitney_p(spark, sf):
    d = M.rank_test(flow(spark, sf), ["station_id"], F.col("date") < "1998-06-01")
    return nudged(nudged(d, 2, "u"), 6, "z", "p_value")
