"""Queries over daily flow: duration curves, signatures, baseflow, recession."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.operators import baseflow as B
from limnos.operators import flow as H
from limnos.operators.periods import annual_max as block_max
from limnos.plans.adapters import FLOW, PRECIP, SFLOW, flow, precip, supplier_flow
from limnos.plans.catalog import N, R, nudged, query
from limnos.plans.pairs import rounded

PCTS = ", ".join(f"max(CASE WHEN rk - 1 = least(floor({p / 100}::DOUBLE * n), n - 1) THEN value END) AS q{p}" for p in H.FDC_PERCENTILES)
RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY value DESC, date) AS rk, count(*) OVER (PARTITION BY station_id) AS n FROM {src})"


@query("fdc", f"WITH {SFLOW}, {RANKED.format(src='sflow')} SELECT station_id, max(n) AS n, {PCTS} FROM r GROUP BY 1")
def fdc(spark, sf):
    return H.duration_percentiles(supplier_flow(spark, sf))


@query("fdc_curve", f"WITH {FLOW}, {RANKED.format(src='flow')} SELECT station_id, date, value, rk, {R('rk / n::DOUBLE * 100', 6)} AS exceedance FROM r")
def fdc_curve(spark, sf):
    return rounded(H.duration_curve(flow(spark, sf)).withColumn("rk", F.col("rk").cast("long")), 6, "exceedance")


@query("flow_stats", f"""WITH {FLOW}, {RANKED.format(src='flow')}, x AS (SELECT *, rk / (n + 1)::DOUBLE * 100 AS x FROM r), f AS (SELECT station_id, sum(abs(value - p)) / sum(value) AS fl FROM (SELECT *, lag(value) OVER (PARTITION BY station_id ORDER BY date) AS p FROM flow) GROUP BY 1)
 SELECT station_id, max(n) AS n_observations, {R('avg(value)', 6)} AS mean_flow, {R('stddev_pop(value)', 6)} AS std_flow, {', '.join(f'arg_min(value, round(abs(x - {p}), 9) * 1000000 + rk / 1e6) AS q{p}' for p in (10, 50, 90, 95))}, {R('max(fl)', 6)} AS flashiness FROM x JOIN f USING (station_id) GROUP BY 1""")
def flow_stats(spark, sf):
    return rounded(H.flow_stats(flow(spark, sf)), 6, "mean_flow", "std_flow", "flashiness")


@query("annual_max", f"WITH {SFLOW} SELECT station_id, year(date) AS year, max(value) AS value, count(value) AS n_days FROM sflow GROUP BY 1, 2")
def annual_max(spark, sf):
    return block_max(supplier_flow(spark, sf))


@query("annual_max_complete", f"WITH {FLOW} SELECT station_id, year(date) AS year, max(value) AS value, count(value) AS n_days FROM flow GROUP BY 1, 2 HAVING count(value) >= 292")
def annual_max_complete(spark, sf):
    return block_max(flow(spark, sf), min_days=292)


@query("low_flow_nq", f"""WITH {FLOW}, m AS (SELECT station_id, date, avg(value) OVER w AS m, count(value) OVER w AS c FROM flow WINDOW w AS (PARTITION BY station_id ORDER BY date ROWS 6 PRECEDING)), y AS (SELECT station_id, year(date) AS y, min(m) AS v FROM m WHERE c = 7 GROUP BY 1, 2),
 p AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY v, y) / (count(*) OVER (PARTITION BY station_id) + 1)::DOUBLE AS p, count(*) OVER (PARTITION BY station_id) AS n FROM y), e AS (SELECT station_id, max(n) AS n_years, max(CASE WHEN p <= 0.1 THEN p END) AS p0, min(CASE WHEN p >= 0.1 THEN p END) AS p1, max(CASE WHEN p <= 0.1 THEN v END) AS v0, min(CASE WHEN p >= 0.1 THEN v END) AS v1 FROM p WHERE n >= 3 GROUP BY 1)
 SELECT station_id, n_years, {R('CASE WHEN p0 IS NULL THEN v1 WHEN p1 IS NULL THEN v0 WHEN p0 = p1 THEN v0 ELSE v0 + (v1 - v0) * (0.1 - p0) / (p1 - p0) END', 6)} AS low_flow FROM e""")
def low_flow_nq(spark, sf):
    return rounded(H.low_flow(flow(spark, sf)), 6, "low_flow")


LAGGED = "lg AS (SELECT *, lag(value) OVER (PARTITION BY station_id ORDER BY date) AS p, row_number() OVER (PARTITION BY station_id ORDER BY date) AS rn, count(*) OVER (PARTITION BY station_id) AS n FROM flow)"
FLASH = "fl AS (SELECT station_id, sum(abs(value - p)) / sum(value) AS flashiness FROM lg GROUP BY 1)"
SEAS = ("sm AS (SELECT station_id, month(date) AS m, avg(value) AS w FROM flow GROUP BY 1, 2), sv AS (SELECT station_id, sum(w * cos(2 * pi() * (m - 1) / 12)) / sum(w) AS x, sum(w * sin(2 * pi() * (m - 1) / 12)) / sum(w) AS y FROM sm GROUP BY 1), "
        "se AS (SELECT station_id, sqrt(x * x + y * y) AS seasonality, CAST(round_even((CASE WHEN atan2(y, x) < 0 THEN atan2(y, x) + 2 * pi() ELSE atan2(y, x) END) * 12 / (2 * pi()), 0) AS BIGINT) % 12 + 1 AS peak_month FROM sv)")
SLOPE = (f"{RANKED.format(src='flow')}, fs AS (SELECT station_id, (ln(max(CASE WHEN rk - 1 = round_even(0.33::DOUBLE * (n - 1), 0) THEN value END)) - ln(max(CASE WHEN rk - 1 = round_even(0.66::DOUBLE * (n - 1), 0) THEN value END))) / (0.66::DOUBLE - 0.33) AS fdc_slope FROM r GROUP BY 1)")
RECK = ("sg AS (SELECT *, sum(CASE WHEN value < p THEN 0 ELSE 1 END) OVER (PARTITION BY station_id ORDER BY date) AS seg FROM lg), sf AS (SELECT station_id, seg, count(*) AS len, min(value) AS lo, regr_slope(ln(value), rn) AS b FROM sg GROUP BY 1, 2), "
        "rk AS (SELECT station_id, quantile_cont(-b, 0.5) AS recession_k FROM sf WHERE len >= 5 AND lo > 0 AND b < 0 GROUP BY 1)")


@query("flashiness", f"WITH {FLOW}, {LAGGED}, {FLASH} SELECT station_id, {R('flashiness', 6)} AS flashiness FROM fl")
def flashiness(spark, sf):
    return rounded(H.flashiness(flow(spark, sf)), 6, "flashiness")


@query("seasonality", f"WITH {FLOW}, {SEAS} SELECT station_id, {R('seasonality', 6)} AS seasonality, peak_month FROM se")
def seasonality(spark, sf):
    return rounded(H.seasonality(flow(spark, sf)), 6, "seasonality")


@query("fdc_slope", f"WITH {FLOW}, {SLOPE} SELECT station_id, {R('fdc_slope', 6)} AS fdc_slope FROM fs")
def fdc_slope(spark, sf):
    return rounded(H.fdc_slope(flow(spark, sf)), 6, "fdc_slope")


@query("elasticity", f"""WITH {FLOW}, {PRECIP}, y AS (SELECT * FROM (SELECT station_id, year(date) AS y, sum(value) AS q FROM flow GROUP BY 1, 2) JOIN (SELECT station_id, year(date) AS y, sum(value) AS p FROM precip GROUP BY 1, 2) USING (station_id, y)),
 m AS (SELECT *, avg(q) OVER (PARTITION BY station_id) AS qm, avg(p) OVER (PARTITION BY station_id) AS pm FROM y) SELECT station_id, count(*) AS n_years, {R('quantile_cont((q - qm) / qm / ((p - pm) / pm), 0.5)', 6)} AS elasticity FROM m GROUP BY 1 HAVING count(*) >= 2""")
def elasticity(spark, sf):
    return rounded(H.elasticity(flow(spark, sf), precip(spark, sf)), 6, "elasticity")


@query("runoff_ratio", f"WITH {FLOW}, {PRECIP} SELECT station_id, {R('sum(flow.value) / sum(precip.value)', 6)} AS runoff_ratio FROM flow JOIN precip USING (station_id, date) GROUP BY 1")
def runoff_ratio(spark, sf):
    return rounded(H.runoff_ratio(flow(spark, sf), precip(spark, sf)), 6, "runoff_ratio")


@query("recession_k", f"WITH {FLOW}, {LAGGED}, {RECK} SELECT station_id, {R('recession_k', 6)} AS recession_k FROM rk")
def recession_k(spark, sf):
    return rounded(H.recession_constant(flow(spark, sf)), 6, "recession_k")


SEGS = ("st AS (SELECT *, sum(CASE WHEN value <= p THEN 0 ELSE 1 END) OVER (PARTITION BY station_id ORDER BY date) AS st FROM lg), so AS (SELECT *, lag(value) OVER (PARTITION BY station_id, st ORDER BY date) AS pp FROM st), "
        "op AS (SELECT *, min(CASE WHEN value < pp THEN rn - 1 END) OVER (PARTITION BY station_id, st) AS open FROM so), rr AS (SELECT station_id, open AS segment, date, value, rn - open AS day, count(*) OVER w AS len, "
        "first_value(value) OVER (PARTITION BY station_id, st ORDER BY rn) AS q0, arg_max(value, rn) OVER w AS q1 FROM op WHERE rn >= open WINDOW w AS (PARTITION BY station_id, st)), rs AS (SELECT * FROM rr WHERE len >= 5 AND (q0 - q1) / q0 >= 0.05)")


@query("recession_segments", f"WITH {FLOW}, {LAGGED}, {SEGS} SELECT station_id, segment, min(date) AS start, max(date) AS \"end\", count(*) AS length, max(q0) AS q_start, max(q1) AS q_end FROM rs GROUP BY 1, 2")
def recession_segments(spark, sf):
    return B.segment_table(B.recession_segments(flow(spark, sf)))


@query("recession_master", f"WITH {FLOW}, {LAGGED}, {SEGS}, m AS (SELECT station_id, count(*) AS n, regr_slope(ln(value / q0), day) AS b, regr_r2(ln(value / q0), day) AS r2 FROM rs GROUP BY 1) SELECT station_id, n, {R('-1 / b', 6)} AS k, {R('-ln(2) / b', 6)} AS half_life, {R('r2', 6)} AS r2 FROM m WHERE n >= 3")
def recession_master(spark, sf):
    return rounded(B.master_recession(B.recession_segments(flow(spark, sf))), 6, "k", "half_life", "r2")


@query("well_recession", f"""WITH {FLOW}, {LAGGED}, ev AS (SELECT *, sum(CASE WHEN value < p THEN 0 ELSE 1 END) OVER (PARTITION BY station_id ORDER BY date) AS ev FROM lg), er AS (SELECT station_id, ev, rn - min(rn) OVER w AS t, ln(value / first_value(value) OVER (PARTITION BY station_id, ev ORDER BY rn)) AS y, count(*) OVER w - 1 AS steps FROM ev WINDOW w AS (PARTITION BY station_id, ev)),
 eb AS (SELECT station_id, ev, regr_slope(y, t) AS b FROM er WHERE steps >= 5 GROUP BY 1, 2), ea AS (SELECT station_id, count(*) AS n_events, avg(-1 / b) AS mc FROM eb WHERE b < 0 GROUP BY 1), ep AS (SELECT station_id, regr_slope(y, t) AS pb FROM er WHERE steps >= 5 GROUP BY 1)
 SELECT station_id, n_events, {R('mc', 6)} AS mean_constant, {R('CASE WHEN pb < 0 THEN -1 / pb ELSE mc END', 6)} AS master_constant FROM ea JOIN ep USING (station_id)""")
def well_recession(spark, sf):
    return rounded(B.well_recession_constants(B.well_recessions(flow(spark, sf))), 6, "mean_constant", "master_constant")


UKIH = ("nb AS (SELECT *, (rn - 1) // 5 AS blk FROM lg), mb AS (SELECT station_id, blk, min(value) AS mv, arg_min(rn, value * 1000000 + rn) AS rn FROM nb GROUP BY 1, 2), mn AS (SELECT *, lag(mv) OVER w AS lo, lead(mv) OVER w AS hi FROM mb WINDOW w AS (PARTITION BY station_id ORDER BY blk)), "
        "tp AS (SELECT station_id, rn, mv FROM mn WHERE coalesce(0.9::DOUBLE * mv < lo, true) AND coalesce(0.9::DOUBLE * mv < hi, true)), uj AS (SELECT nb.station_id, date, value, nb.rn, tp.rn AS trn, tp.mv FROM nb LEFT JOIN tp USING (station_id, rn)), "
        "ui AS (SELECT *, last_value(trn IGNORE NULLS) OVER a AS r0, last_value(mv IGNORE NULLS) OVER a AS v0, first_value(trn IGNORE NULLS) OVER b AS r1, first_value(mv IGNORE NULLS) OVER b AS v1 FROM uj WINDOW a AS (PARTITION BY station_id ORDER BY rn ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY station_id ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), "
        "uk AS (SELECT station_id, date, value, least(value, greatest(0, CASE WHEN r0 IS NULL THEN v1 WHEN r1 IS NULL THEN v0 WHEN r0 = r1 THEN v0 ELSE v0 + (v1 - v0) * (rn - r0) / (r1 - r0)::DOUBLE END)) AS bf FROM ui)")


@query("ukih", f"WITH {FLOW}, {LAGGED}, {UKIH} SELECT station_id, date, {R('bf', 6)} AS baseflow, {R('value - bf', 6)} AS quickflow FROM uk")
def ukih(spark, sf):
    return rounded(B.smoothed_minima(flow(spark, sf)).drop("value"), 6, "baseflow", "quickflow")


@query("ukih_bfi", f"WITH {FLOW}, {LAGGED}, {UKIH} SELECT station_id, {R('sum(bf) / sum(value)', 6)} AS bfi FROM uk GROUP BY 1")
def ukih_bfi(spark, sf):
    return rounded(B.bfi(B.smoothed_minima(flow(spark, sf))), 6, "bfi")


ECK = ("WITH RECURSIVE " + FLOW + ", " + LAGGED + ", ek AS (SELECT station_id, rn, date, value, least(value, value * 0.8::DOUBLE) AS bf FROM lg WHERE rn = 1 UNION ALL SELECT l.station_id, l.rn, l.date, l.value, "
       "greatest(least(((1 - 0.8::DOUBLE) * 0.98::DOUBLE * e.bf + (1 - 0.98::DOUBLE) * 0.8::DOUBLE * l.value) / (1 - 0.98::DOUBLE * 0.8::DOUBLE), l.value), 0) FROM ek e JOIN lg l ON l.station_id = e.station_id AND l.rn = e.rn + 1)")


@query("eckhardt", f"{ECK} SELECT station_id, date, {R('bf', 6)} AS baseflow FROM ek")
def eckhardt(spark, sf):
    return rounded(B.eckhardt(flow(spark, sf)).select("station_id", "date", "baseflow"), 6, "baseflow")


@query("eckhardt_bfi", f"{ECK} SELECT station_id, {R('sum(bf) / sum(value)', 6)} AS bfi FROM ek GROUP BY 1")
def eckhardt_bfi(spark, sf):
    return rounded(B.bfi(B.eckhardt(flow(spark, sf))), 6, "bfi")


def _pass(i, src, start, step, prev):
    """One filter pass as a recursive relation; the first element keeps what the earlier pass left."""
    return (f"p{i} AS (SELECT station_id, rn, date, value, {prev} AS qf, n FROM {src} s WHERE rn = {start} UNION ALL SELECT l.station_id, l.rn, l.date, l.value, "
            f"least(greatest(0, 0.925::DOUBLE * e.qf + ((1 + 0.925::DOUBLE) / 2) * (l.value - e.value)), l.value), e.n FROM p{i} e JOIN {src} l ON l.station_id = e.station_id AND l.rn = e.rn {step})")


LH1 = "WITH RECURSIVE " + FLOW + ", " + LAGGED + ", " + _pass(1, "lg", "1", "+ 1", "0.0::DOUBLE")
LH = LH1 + ", " + _pass(2, "p1", "n", "- 1", "s.qf") + ", " + _pass(3, "p2", "1", "+ 1", "s.qf")


@query("lyne_hollick", f"{LH} SELECT station_id, date, {N('greatest(0, value - qf)')} AS baseflow, {N('qf')} AS quickflow FROM p3")
def lyne_hollick(spark, sf):
    return nudged(B.lyne_hollick(flow(spark, sf)).drop("value"), 6, "baseflow", "quickflow")


@query("lyne_hollick_bfi", f"{LH} SELECT station_id, {R('sum(greatest(0, value - qf)) / sum(value)', 6)} AS bfi FROM p3 GROUP BY 1")
def lyne_hollick_bfi(spark, sf):
    return rounded(B.lyne_hollick_bfi(flow(spark, sf)), 6, "bfi")


def _runs(name, cond, out):
    return (f"{name}0 AS (SELECT lg.station_id, date, {cond} AS hit, sum(CASE WHEN {cond} THEN 0 ELSE 1 END) OVER (PARTITION BY lg.station_id ORDER BY date) AS run FROM lg JOIN sb USING (station_id)), "
            f"{name} AS (SELECT station_id, avg(c) AS {out} FROM (SELECT station_id, run, count(*) AS c FROM {name}0 WHERE hit GROUP BY 1, 2) GROUP BY 1)")


SIGS = ["mean_flow", "median_flow", "q5", "q95", "q5_q95_ratio", "cv", "iqr", "high_flow_frequency", "high_flow_duration", "q_peak_mean", "low_flow_frequency", "low_flow_duration", "baseflow_index", "zero_flow_fraction",
        "peak_month", "seasonality_index", "rising_limb_density", "flashiness_index", "mean_recession_constant", "fdc_slope"]
SIG_SQL = (LH1 + f""", sb AS (SELECT station_id, count(*) AS sn, avg(value) AS mean_flow, quantile_cont(value, 0.5) AS median_flow, quantile_cont(value, 0.05) AS q5, quantile_cont(value, 0.95) AS q95, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr, stddev_pop(value) AS sd FROM flow GROUP BY 1 HAVING count(*) >= 365),
 ct AS (SELECT station_id, sum(CASE WHEN value > 3 * median_flow THEN 1 ELSE 0 END) AS hi, sum(CASE WHEN value < 0.2::DOUBLE * median_flow THEN 1 ELSE 0 END) AS lo, avg(CASE WHEN value = 0 THEN 1.0::DOUBLE ELSE 0 END) AS zf, sum(CASE WHEN value > p THEN 1 ELSE 0 END) AS ups FROM lg JOIN sb USING (station_id) GROUP BY 1),
 pk AS (SELECT station_id, avg(mx) AS pk FROM (SELECT station_id, year(date) AS y, max(value) AS mx FROM flow GROUP BY 1, 2) GROUP BY 1), {_runs('hr', 'value > median_flow', 'hd')}, {_runs('lr', 'value < 0.2::DOUBLE * median_flow', 'ld')}, {SEAS}, {FLASH}, {SLOPE}, {RECK},
 bf AS (SELECT station_id, sum(greatest(0, value - qf)) / sum(value) AS bfi FROM p1 GROUP BY 1),
 sg2 AS (SELECT station_id, mean_flow, median_flow, q5, q95, CASE WHEN q95 > 0 THEN q5 / q95 ELSE 'inf'::DOUBLE END AS q5_q95_ratio, sd / mean_flow AS cv, iqr, hi / greatest(1, sn / 365.25::DOUBLE) AS high_flow_frequency, coalesce(hd, 0) AS high_flow_duration, pk / mean_flow AS q_peak_mean,
 lo / greatest(1, sn / 365.25::DOUBLE) AS low_flow_frequency, coalesce(ld, 0) AS low_flow_duration, bfi AS baseflow_index, zf AS zero_flow_fraction, peak_month, seasonality AS seasonality_index, ups / sn::DOUBLE AS rising_limb_density, flashiness AS flashiness_index, coalesce(recession_k, 0) AS mean_recession_constant, fdc_slope
 FROM sb JOIN ct USING (station_id) JOIN pk USING (station_id) LEFT JOIN hr USING (station_id) LEFT JOIN lr USING (station_id) JOIN se USING (station_id) JOIN fl USING (station_id) JOIN fs USING (station_id) LEFT JOIN rk USING (station_id) JOIN bf USING (station_id))""")


@query("signatures", SIG_SQL + " SELECT station_id, peak_month, " + ", ".join(f"{R(c, 6)} AS {c}" for c in SIGS if c != "peak_month") + " FROM sg2")
def signatures(spark, sf):
    return rounded(H.signatures(flow(spark, sf)), 6, *[c for c in SIGS if c != "peak_month"])
