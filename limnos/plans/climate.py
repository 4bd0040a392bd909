"""Queries for climate indices, spells and bias correction."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.functions.special import norm_ppf_sql
from limnos.operators import climate as C
from limnos.operators import periods as P
from limnos.plans.adapters import FLOW, OBS, PAIRED, PRECIP, RAIN, flow, long_flow, obs, paired, precip, rain
from limnos.plans.catalog import N, nudged, query
from limnos.plans.trends import MONTHLY, monthly

K = ["station_id"]


@query("aridity", f"WITH {FLOW}, {PRECIP}, a AS (SELECT station_id, (SELECT sum(value) FROM precip p WHERE p.station_id = f.station_id) / sum(f.value) * 5 AS x FROM flow f GROUP BY 1) SELECT station_id, {N('x')} AS aridity_index, "
       "CASE WHEN x < 0.03 THEN 'hyper-arid' WHEN x < 0.2 THEN 'arid' WHEN x < 0.5 THEN 'semi-arid' WHEN x < 0.65 THEN 'dry sub-humid' ELSE 'humid' END AS class_a, CASE WHEN x < 0.05 THEN 'hyper-arid' WHEN x < 0.2 THEN 'arid' WHEN x < 0.5 THEN 'semi-arid' WHEN x < 0.65 THEN 'dry sub-humid' ELSE 'humid' END AS class_b FROM a")
def aridity(spark, sf):
    q, p = (d.groupBy(*K).agg(F.sum("value").alias(n)) for d, n in ((flow(spark, sf), "q"), (precip(spark, sf), "p")))
    x = F.col("p") / F.col("q") * 5
    return nudged(p.join(q, K).select(*K, x.alias("aridity_index"), C.aridity_class(x).alias("class_a"), C.aridity_class(x, 0.05).alias("class_b")), 6, "aridity_index")


ZED = f"{MONTHLY}, z AS (SELECT station_id, date, (value - avg(value) OVER p) / stddev_samp(value) OVER p AS z FROM m WINDOW p AS (PARTITION BY station_id))"


def zed(spark, sf):
    from limnos.operators.quality import normalize
    return normalize(monthly(spark, sf), K).select(*K, "date", F.col("value_normalized").alias("z"))


@query("drought_class", f"WITH {ZED} SELECT station_id, date, CASE WHEN z IS NULL THEN 'unknown' WHEN z >= 2 THEN 'extremely_wet' WHEN z >= 1.5 THEN 'very_wet' WHEN z >= 1 THEN 'moderately_wet' WHEN z > -1 THEN 'normal' WHEN z > -1.5 THEN 'moderately_dry' WHEN z > -2 THEN 'severely_dry' ELSE 'extremely_dry' END AS drought_class FROM z")
def drought_class(spark, sf):
    return zed(spark, sf).select(*K, "date", C.drought_class(F.col("z")).alias("drought_class"))


@query("idf_adjust", f"WITH {PRECIP} SELECT station_id, year(date) AS year, {N('max(value) * 1.15::DOUBLE')} AS intensity FROM precip GROUP BY 1, 2")
def idf_adjust(spark, sf):
    am = P.annual_max(precip(spark, sf))
    return nudged(am.select(*K, "year", C.intensity_adjusted(F.col("value"), F.lit(1.15)).alias("intensity")), 6, "intensity")


def runs_sql(src, hit, part="station_id", extra=""):
    return (f"i AS (SELECT *, {hit} AS hit, sum(CASE WHEN {hit} THEN 0 ELSE 1 END) OVER (PARTITION BY {part} ORDER BY date) AS run FROM {src}), "
            f"rn AS (SELECT {part}, run, min(date) AS start, max(date) AS \"end\", count(*) AS duration{extra} FROM i WHERE hit GROUP BY {part}, run)")


for _name, _op, _sql in (("spells_dry", lambda v: v < 3, "value < 3"), ("spells_wet", lambda v: v >= 3, "value >= 3")):
    def _spell(spark, sf, op=_op):
        return C.yearly_spells(precip(spark, sf), op(F.col("value")))
    query(_name, f"WITH {PRECIP}, py AS (SELECT station_id, year(date) AS year, date, value FROM precip), {runs_sql('py', _sql, 'station_id, year')}, g AS (SELECT station_id, year, max(duration) AS longest FROM rn GROUP BY 1, 2) "
          "SELECT station_id, year, coalesce(longest, 0) AS longest FROM (SELECT DISTINCT station_id, year FROM py) LEFT JOIN g USING (station_id, year)")(_spell)


@query("spells_dry_summary", f"WITH {PRECIP}, py AS (SELECT station_id, year(date) AS year, date, value FROM precip), {runs_sql('py', 'value < 3', 'station_id, year')}, g AS (SELECT station_id, year, max(duration) AS longest FROM rn GROUP BY 1, 2), "
       f"h AS (SELECT station_id, year, coalesce(longest, 0) AS longest FROM (SELECT DISTINCT station_id, year FROM py) LEFT JOIN g USING (station_id, year)) SELECT station_id, max(longest) AS max_run, {N('avg(longest)')} AS mean_run, count(*) AS n_years FROM h GROUP BY 1")
def spells_dry_summary(spark, sf):
    return nudged(C.spell_summary(C.yearly_spells(precip(spark, sf), F.col("value") < 3)), 6, "mean_run")


TH = "t AS (SELECT *, quantile_cont(value, {p}) OVER (PARTITION BY station_id) AS threshold FROM {src})"


@query("heat_waves", f"WITH {PRECIP}, {TH.format(p=0.6, src='precip')}, {runs_sql('t', 'value > threshold', extra=', max(value) - max(threshold) AS peak')} SELECT station_id, start, \"end\", duration, {N('peak')} AS peak_intensity FROM rn WHERE duration >= 3")
def heat_waves(spark, sf):
    return nudged(C.heat_waves(precip(spark, sf), 60, 3), 6, "peak_intensity")


@query("drought_runs", f"WITH {FLOW}, {TH.format(p=0.2, src='flow')}, {runs_sql('t', 'value < threshold', extra=', sum(threshold - value) AS d')} SELECT station_id, count(*) AS n_events, {N('avg(duration)')} AS mean_duration, max(duration) AS max_duration, {N('avg(d)')} AS mean_severity, {N('sum(d)')} AS total_deficit FROM rn GROUP BY 1")
def drought_runs(spark, sf):
    return nudged(C.drought_runs(flow(spark, sf)), 6, "mean_duration", "mean_severity", "total_deficit")


@query("wet_spells", f"WITH {PRECIP}, {runs_sql('precip', 'value >= 3', extra=', avg(value) AS m')} SELECT station_id, count(*) AS n_spells, {N('avg(duration)')} AS mean_duration, max(duration) AS max_duration, {N('avg(m)')} AS mean_intensity FROM rn GROUP BY 1")
def wet_spells(spark, sf):
    return nudged(C.wet_spells(precip(spark, sf), 3.0), 6, "mean_duration", "mean_intensity")


@query("drought_events", f"WITH {ZED}, {runs_sql('z', 'z <= -0.5', extra=', sum(z) AS s, min(z) AS p')} SELECT station_id, start, \"end\", duration, {N('s')} AS severity, {N('p')} AS peak FROM rn")
def drought_events(spark, sf):
    return nudged(C.index_events(zed(spark, sf).withColumnRenamed("z", "value"), -0.5), 6, "severity", "peak")


@query("stream_spells", f"WITH {FLOW}, h AS (SELECT station_id, date, value FROM flow WHERE value > 200), g AS (SELECT *, CASE WHEN date - lag(date) OVER (PARTITION BY station_id ORDER BY date) <= 2 THEN 0 ELSE 1 END AS b FROM h), s AS (SELECT *, sum(b) OVER (PARTITION BY station_id ORDER BY date) AS sid FROM g) "
       "SELECT station_id, min(date) AS start, max(date) AS last, count(*) AS n, max(value) AS peak FROM s GROUP BY station_id, sid")
def stream_spells(spark, sf):
    from limnos.streaming.jobs import spell_sessions
    d = flow(spark, sf).select(*K, F.col("date").cast("timestamp").alias("ts"), "value")
    return spell_sessions(d, 200.0, "2 days 1 second").select(*K, F.to_date("start").alias("start"), F.to_date("last").alias("last"), "n", "peak")


PM = "pm AS (SELECT station_id, CAST(date_trunc('month', date) AS DATE) AS date, round(sum(value), 7) AS value FROM precip GROUP BY 1, 2)"


def monthly_precip(spark, sf):
    return P.resample(precip(spark, sf), "month", "sum").select(*K, "date", F.round("value", 7).alias("value"))


@query("pci", f"WITH {PRECIP}, {PM}, r AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY date) AS rn, count(*) OVER (PARTITION BY station_id) AS n FROM pm) SELECT station_id, {N('sum(value * value) / (sum(value) * sum(value)) * 100')} AS pci FROM r WHERE rn <= 12 AND n >= 12 GROUP BY 1")
def pci(spark, sf):
    return nudged(C.concentration_index(monthly_precip(spark, sf)), 6, "pci")


@query("sgi", f"WITH {MONTHLY}, r AS (SELECT station_id, date, rank() OVER (PARTITION BY station_id, month(date) ORDER BY value) + (count(*) OVER (PARTITION BY station_id, month(date), value) - 1) / 2.0::DOUBLE AS rk, count(*) OVER (PARTITION BY station_id, month(date)) AS n FROM m), p AS (SELECT *, (rk - 0.5) / n AS p FROM r) "
       f"SELECT station_id, date, CASE WHEN n >= 5 THEN {N(norm_ppf_sql('p'))} END AS sgi FROM p")
def sgi(spark, sf):
    return nudged(C.sgi(monthly(spark, sf)).drop("value"), 6, "sgi")


def long_months(spark, sf):
    return P.resample(long_flow(spark, sf), "month", "sum").select(*K, "date", "value")


@query("spi")
def spi(spark, sf):
    return C.spi(long_months(spark, sf), 3)


@query("spi_accumulated", f"WITH {PRECIP}, {PM}, a AS (SELECT station_id, date, sum(value) OVER w AS acc, count(value) OVER w AS c FROM pm WINDOW w AS (PARTITION BY station_id ORDER BY date ROWS 2 PRECEDING)) SELECT station_id, date, {N('acc')} AS acc FROM a WHERE c = 3")
def spi_accumulated(spark, sf):
    return nudged(C.accumulate(monthly_precip(spark, sf), 3).select(*K, "date", "acc"), 6, "acc")


@query("spi_status")
def spi_status(spark, sf):
    return C.spi_status(long_months(spark, sf))


UPPER, LOWER = "(100.0::DOUBLE / 3)", "(100.0::DOUBLE - 100.0::DOUBLE / 3)"
PALMER = (f"WITH RECURSIVE {MONTHLY}, {PRECIP}, {PM}, j AS (SELECT station_id, date, pm.value AS p, m.value AS pe, row_number() OVER (PARTITION BY station_id ORDER BY date) AS rn FROM pm JOIN m USING (station_id, date)), "
          f"b AS (SELECT DISTINCT station_id, 0::BIGINT AS rn, {UPPER} AS s, {LOWER} AS u, 0.0::DOUBLE AS et FROM j UNION ALL SELECT station_id, rn, s1 + fill, u1 + least(p - fill, {LOWER} - u1), et FROM (SELECT *, least(p, {UPPER} - s1) AS fill FROM "
          "(SELECT *, s - a AS s1, u - bb AS u1, a + bb AS et FROM (SELECT *, least(pe - a, u) AS bb FROM (SELECT j.station_id AS station_id, j.rn AS rn, p, pe, s, u, least(pe, s) AS a FROM b JOIN j ON j.station_id = b.station_id AND j.rn = b.rn + 1))))), "
          "sh AS (SELECT station_id, avg(CASE WHEN pe > 0 THEN et / pe ELSE 1 END) AS share FROM b JOIN j USING (station_id, rn) GROUP BY 1), "
          "z AS (SELECT station_id, date, rn, (p - share * pe) / (stddev_pop(p - share * pe) OVER (PARTITION BY station_id) + 1e-10) AS z FROM j JOIN sh USING (station_id)), "
          "x AS (SELECT station_id, date, rn, 0.0::DOUBLE AS x FROM z WHERE rn = 1 UNION ALL SELECT z.station_id, z.date, z.rn, 0.897::DOUBLE * x.x + z.z / 3 FROM x JOIN z ON z.station_id = x.station_id AND z.rn = x.rn + 1) ")


@query("pdsi_simplified", PALMER + f"SELECT station_id, date, {N('x', 5)} AS pdsi FROM x")
def pdsi_simplified(spark, sf):
    q = monthly(spark, sf).withColumnRenamed("value", "pet")
    return nudged(C.pdsi(monthly_precip(spark, sf).withColumnRenamed("value", "precip").join(q, [*K, "date"])), 5, "pdsi")


@query("water_balance_monthly", f"WITH {FLOW}, {PRECIP}, a AS (SELECT station_id, CAST(date_trunc('month', date) AS DATE) AS date, sum(value) * 10 AS p FROM precip GROUP BY 1, 2), b AS (SELECT station_id, CAST(date_trunc('month', date) AS DATE) AS date, sum(value) AS e FROM flow GROUP BY 1, 2) "
       f"SELECT station_id, date, {N('p')} AS precipitation, e AS et, {N('p - e')} AS water_balance, CASE WHEN p - e >= 0 THEN 'surplus' ELSE 'deficit' END AS surplus_deficit FROM a JOIN b USING (station_id, date)")
def water_balance_monthly(spark, sf):
    p = precip(spark, sf).withColumn("value", F.col("value") * 10)
    return nudged(C.water_balance(p, flow(spark, sf)), 6, "precipitation", "water_balance")


POINT = (f"WITH {FLOW}, {RAIN}, a AS (SELECT station_id, avg(s) AS p FROM (SELECT station_id, year(date) AS y, sum(value) AS s FROM rain GROUP BY 1, 2 HAVING count(value) >= 300) GROUP BY 1), "
         "b AS (SELECT station_id, avg(s) AS e FROM (SELECT station_id, year(date) AS y, sum(value) AS s FROM flow GROUP BY 1, 2 HAVING count(value) >= 300) GROUP BY 1), "
         "c AS (SELECT station_id, max(value) AS w FROM rain GROUP BY 1), t AS (SELECT station_id, avg(9 + value % 10) AS t FROM flow GROUP BY 1) ")


def climate_of_points(spark, sf):
    return C.point_climate(rain(spark, sf), flow(spark, sf), flow(spark, sf).withColumn("value", 9 + F.col("value") % 10))


@query("point_climate", POINT + f"SELECT station_id, {N('p')} AS precipitation_per_year, {N('e')} AS et0_per_year, {N('p / e')} AS aridity_index, CASE WHEN p / e < 0.05 THEN 'hyper-arid' WHEN p / e < 0.2 THEN 'arid' WHEN p / e < 0.5 THEN 'semi-arid' WHEN p / e < 0.65 THEN 'dry sub-humid' WHEN p / e >= 0.65 THEN 'humid' END AS aridity_class, "
       f"{N('t')} AS temperature_mean, {N('w')} AS wettest_day FROM c JOIN t USING (station_id) LEFT JOIN a USING (station_id) LEFT JOIN b USING (station_id)")
def point_climate(spark, sf):
    d = climate_of_points(spark, sf).drop("monthly_precipitation", "monthly_et0", "annual_precipitation")
    return nudged(d, 6, "precipitation_per_year", "et0_per_year", "aridity_index", "temperature_mean", "wettest_day")


@query("point_climate_monthly", f"WITH {FLOW}, {RAIN}, p AS (SELECT station_id, month(date) AS month, avg(value) * 30.44::DOUBLE AS p FROM rain GROUP BY 1, 2), e AS (SELECT station_id, month(date) AS month, avg(value) * 30.44::DOUBLE AS e FROM flow GROUP BY 1, 2) "
       f"SELECT station_id, month, {N('p')} AS precipitation, {N('e')} AS et0 FROM p JOIN e USING (station_id, month)")
def point_climate_monthly(spark, sf):
    z = F.arrays_zip(F.col("monthly_precipitation").alias("precipitation"), F.col("monthly_et0").alias("et0"))
    d = climate_of_points(spark, sf).select(*K, F.posexplode(z).alias("at", "m")).select(*K, (F.col("at") + 1).cast("long").alias("month"), "m.precipitation", "m.et0")
    return nudged(d, 6, "precipitation", "et0")


@query("point_climate_annual", f"WITH {RAIN} SELECT station_id, year(date) AS year, {N('sum(value)')} AS mm FROM rain GROUP BY 1, 2 HAVING count(value) >= 300")
def point_climate_annual(spark, sf):
    return nudged(climate_of_points(spark, sf).select(*K, F.explode("annual_precipitation").alias("y")).select(*K, "y.year", "y.mm"), 6, "mm")


CI = "ci AS (SELECT station_id, date, p.value AS precip, f.value / 30 AS pet, f.value / 20 - 4 AS temp FROM flow f JOIN precip p USING (station_id, date))"


@query("caravan_indices", f"WITH {FLOW}, {PRECIP}, {CI}, b AS (SELECT station_id, avg(precip) AS pm, avg(pet) AS em FROM ci GROUP BY 1), d AS (SELECT ci.*, pm, precip < 1 AS lo, precip >= 5 * pm AS hi FROM ci JOIN b USING (station_id)), "
       "lr AS (SELECT *, sum(CASE WHEN lo THEN 0 ELSE 1 END) OVER w AS lrun, sum(CASE WHEN hi THEN 0 ELSE 1 END) OVER w AS hrun FROM d WINDOW w AS (PARTITION BY station_id ORDER BY date)), ld AS (SELECT station_id, avg(c) AS ld FROM (SELECT station_id, lrun, count(*) AS c FROM lr WHERE lo GROUP BY 1, 2) GROUP BY 1), hd AS (SELECT station_id, avg(c) AS hd FROM (SELECT station_id, hrun, count(*) AS c FROM lr WHERE hi GROUP BY 1, 2) GROUP BY 1), "
       "fq AS (SELECT station_id, avg(hi::INT) AS hf, avg(lo::INT) AS lf FROM d GROUP BY 1), m AS (SELECT station_id, month(date) AS m, avg(precip) AS p, avg(pet) AS e, avg(temp) AS t FROM ci GROUP BY 1, 2), mx AS (SELECT *, CASE WHEN p > e THEN 1 - e / p WHEN p < e THEN p / e - 1 ELSE 0 END AS x FROM m), ms AS (SELECT station_id, avg(x) AS mo, max(x) - min(x) AS se, sum(CASE WHEN t < 0 THEN p ELSE 0 END) / sum(p) AS sn FROM mx GROUP BY 1) "
       f"SELECT station_id, {N('pm')} AS p_mean, {N('em')} AS pet_mean, {N('em / pm')} AS aridity, {N('sn')} AS frac_snow, {N('mo')} AS moisture_index, {N('se')} AS seasonality, {N('hf')} AS high_prec_freq, {N('coalesce(hd, 0)')} AS high_prec_dur, {N('lf')} AS low_prec_freq, {N('coalesce(ld, 0)')} AS low_prec_dur FROM b JOIN fq USING (station_id) JOIN ms USING (station_id) LEFT JOIN ld USING (station_id) LEFT JOIN hd USING (station_id)")
def caravan_indices(spark, sf):
    q = flow(spark, sf).select(*K, "date", (F.col("value") / 30).alias("pet"), (F.col("value") / 20 - 4).alias("temp"))
    d = C.export_indices(precip(spark, sf).withColumnRenamed("value", "precip").join(q, [*K, "date"]))
    return nudged(d, 6, *[c for c in d.columns if c != "station_id"])


@query("annual_cycle", f"WITH {FLOW} SELECT station_id, month(date) AS month, {N('avg(value)')} AS value FROM flow GROUP BY 1, 2")
def annual_cycle(spark, sf):
    return nudged(P.annual_cycle(flow(spark, sf)), 6, "value")


@query("monthly_climatology", f"WITH {FLOW}, m AS (SELECT station_id, month(date) AS m, avg(value) AS v FROM flow GROUP BY 1, 2) SELECT station_id, {N('avg(v)')} AS annual_mean, {N('stddev_samp(v) / avg(v) * 100')} AS seasonal_cv, {N('min(v) / avg(v)')} AS baseflow_index FROM m GROUP BY 1")
def monthly_climatology(spark, sf):
    return nudged(P.monthly_climatology(flow(spark, sf)), 6, "annual_mean", "seasonal_cv", "baseflow_index")


@query("time_slice", f"WITH {FLOW} SELECT station_id, date, value FROM flow WHERE year(date) BETWEEN 1996 AND 1998")
def time_slice(spark, sf):
    return P.time_slice(flow(spark, sf), 1996, 1998)


@query("anomaly_baseline", f"WITH {FLOW} SELECT station_id, date, {N('value - avg(CASE WHEN year(date) BETWEEN 1995 AND 1997 THEN value END) OVER (PARTITION BY station_id)')} AS anomaly FROM flow")
def anomaly_baseline(spark, sf):
    return nudged(P.anomaly(flow(spark, sf), 1995, 1997).drop("value"), 6, "anomaly")


@query("linear_trend", f"WITH {MONTHLY}, x AS (SELECT station_id, value, (date - min(date) OVER (PARTITION BY station_id)) / 365.25::DOUBLE AS x FROM m), f AS (SELECT station_id, count(*) AS n, regr_slope(value, x) AS b, regr_intercept(value, x) AS a, regr_r2(value, x) AS r2, regr_sxx(value, x) AS sxx, regr_syy(value, x) AS syy FROM x GROUP BY 1), "
       f"s AS (SELECT *, sqrt((1 - r2) * syy / (n - 2) / sxx) AS se FROM f) SELECT station_id, n, {N('b')} AS slope, {N('a')} AS intercept, {N('r2')} AS r2, {N('se')} AS slope_se, {N('b / se')} AS t_stat FROM s")
def linear_trend(spark, sf):
    m = monthly(spark, sf)
    m = m.join(m.groupBy(*K).agg(F.min("date").alias("d0")), K)
    return nudged(P.linear_trend(m, F.datediff("date", "d0") / 365.25), 6, "slope", "intercept", "r2", "slope_se", "t_stat")


@query("linear_trend_significance")
def linear_trend_significance(spark, sf):
    m = monthly(spark, sf)
    m = m.join(m.groupBy(*K).agg(F.min("date").alias("d0")), K)
    return P.trend_significance(P.linear_trend(m, F.datediff("date", "d0") / 365.25))


DECOMPOSED = (f"WITH {MONTHLY}, s AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY date) AS rn, avg(value) OVER a AS m1, avg(value) OVER b AS m2, count(value) OVER a AS c1, count(value) OVER b AS c2 FROM m WINDOW a AS (PARTITION BY station_id ORDER BY date ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING), b AS (PARTITION BY station_id ORDER BY date ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING)), "
              "t AS (SELECT *, CASE WHEN c1 = 12 AND c2 = 12 THEN (m1 + m2) / 2 END AS trend, (rn - 1) % 12 AS ph FROM s), g AS (SELECT station_id, ph, avg(value - trend) AS sa FROM t GROUP BY 1, 2), h AS (SELECT station_id, ph, sa - avg(sa) OVER (PARTITION BY station_id) AS seasonal FROM g) ")


@query("seasonal_decompose", DECOMPOSED + f"SELECT station_id, date, {N('trend')} AS trend, {N('seasonal')} AS seasonal, {N('value - trend - seasonal')} AS residual FROM t JOIN h USING (station_id, ph)")
def seasonal_decompose(spark, sf):
    return nudged(C.seasonal_decompose(monthly(spark, sf)).drop("value", "detrended"), 6, "trend", "seasonal", "residual")


@query("seasonal_strength", DECOMPOSED + f"SELECT station_id, {N('CASE WHEN var_pop(value - trend) > 0 THEN greatest(0, 1 - var_pop(value - trend - seasonal) / var_pop(value - trend)) ELSE 0 END')} AS strength FROM t JOIN h USING (station_id, ph) GROUP BY 1")
def seasonal_strength(spark, sf):
    return nudged(C.seasonal_strength(C.seasonal_decompose(monthly(spark, sf))), 6, "strength")


SPLIT = FLOW + ", " + PRECIP + ", hist AS (SELECT station_id, date, value FROM flow WHERE date < DATE '1998-06-01'), fut AS (SELECT station_id, date, value FROM flow WHERE date >= DATE '1998-06-01')"


def split(spark, sf):
    f = flow(spark, sf)
    return precip(spark, sf), f.where("date < DATE '1998-06-01'"), f.where("date >= DATE '1998-06-01'")


@query("delta_method", f"WITH {SPLIT}, m AS (SELECT station_id, (SELECT avg(value) FROM fut WHERE fut.station_id = hist.station_id) AS f, avg(value) AS h FROM hist GROUP BY 1) SELECT station_id, date, {N('value + (f - h)')} AS value FROM precip JOIN m USING (station_id)")
def delta_method(spark, sf):
    return nudged(C.delta_method(*split(spark, sf)), 6, "value")


@query("delta_method_multiplicative", f"WITH {SPLIT}, m AS (SELECT station_id, (SELECT avg(value) FROM fut WHERE fut.station_id = hist.station_id) AS f, avg(value) AS h FROM hist GROUP BY 1) SELECT station_id, date, {N('value * f / h')} AS value FROM precip JOIN m USING (station_id)")
def delta_method_multiplicative(spark, sf):
    return nudged(C.delta_method(*split(spark, sf), "multiplicative"), 6, "value")


LEVELS = "[" + ", ".join(f"{i / 100}::DOUBLE" for i in range(101)) + "]"
QQ = f"q AS (SELECT station_id, quantile_cont(value, {LEVELS}) AS hq, count(*) AS hn FROM {{h}} GROUP BY 1), oq AS (SELECT station_id, quantile_cont(value, {LEVELS}) AS oq FROM precip GROUP BY 1)"
QM = ("{qq}, x AS (SELECT f.station_id, f.date, f.value, hq, oq, len(list_filter(hq, lambda z: z <= f.value)) AS i FROM {f} f JOIN q USING (station_id) JOIN oq USING (station_id)), "
      "y AS (SELECT station_id, date, CASE WHEN i = 0 THEN oq[1] WHEN i >= 101 THEN oq[101] ELSE oq[i] + (oq[i + 1] - oq[i]) * (value - hq[i]) / (hq[i + 1] - hq[i]) END AS value FROM x)")
QDM = ("{qq}, b AS (SELECT f.station_id, f.date, f.value, count(h.value) AS below FROM {f} f LEFT JOIN {h} h ON h.station_id = f.station_id AND h.value < f.value GROUP BY 1, 2, 3), x AS (SELECT b.*, hq, oq, below / hn::DOUBLE * 100 AS pos, least(floor(below / hn::DOUBLE * 100), 99)::INT AS j FROM b JOIN q USING (station_id) JOIN oq USING (station_id)), "
       "y AS (SELECT station_id, date, (oq[j + 1] + (oq[j + 2] - oq[j + 1]) * (pos - j)) + value - (hq[j + 1] + (hq[j + 2] - hq[j + 1]) * (pos - j)) AS value FROM x)")


@query("quantile_mapping", f"WITH {SPLIT}, {QM.format(qq=QQ.format(h='hist'), f='fut')} SELECT station_id, date, {N('value')} AS value FROM y")
def quantile_mapping(spark, sf):
    return nudged(C.quantile_mapping(*split(spark, sf)), 6, "value")


@query("quantile_delta_mapping", f"WITH {SPLIT}, {QDM.format(qq=QQ.format(h='hist'), f='fut', h='hist')} SELECT station_id, date, {N('value')} AS value FROM y")
def quantile_delta_mapping(spark, sf):
    return nudged(C.quantile_delta_mapping(*split(spark, sf)), 6, "value")


HALF = FLOW + ", " + PRECIP + ", nn AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY date) AS rn, count(*) OVER (PARTITION BY station_id) AS n FROM flow), hist AS (SELECT station_id, date, value FROM nn WHERE rn <= n // 2), fut AS (SELECT station_id, date, value FROM nn WHERE rn > n // 2)"


@query("bias_correction", f"WITH {HALF}, {QM.format(qq=QQ.format(h='hist'), f='fut')} SELECT station_id, date, {N('value')} AS value FROM y")
def bias_correction(spark, sf):
    return nudged(C.bias_correction(flow(spark, sf), precip(spark, sf)), 6, "value")


@query("residual_bands", f"WITH {PAIRED}, o AS (SELECT station_id, quantile_cont(obs - sim, [0.05::DOUBLE, 0.5::DOUBLE, 0.95::DOUBLE]) AS q FROM paired GROUP BY 1), b AS (SELECT station_id, date, list_sort([greatest(0, sim + q[1]), greatest(0, sim + q[2]), greatest(0, sim + q[3])]) AS b FROM paired JOIN o USING (station_id)) "
       f"SELECT station_id, date, {N('b[1]')} AS q5, {N('b[2]')} AS q50, {N('b[3]')} AS q95 FROM b")
def residual_bands(spark, sf):
    return nudged(C.residual_bands(paired(spark, sf), (0.05, 0.5, 0.95)).drop("obs", "sim"), 6, "q5", "q50", "q95")


@query("ensemble_stats", f"WITH {OBS}, e AS (SELECT parameter, CAST(ts AS DATE) AS date, avg(value) AS v FROM obs GROUP BY 1, 2) SELECT date, {N('avg(v)')} AS mean, {N('quantile_cont(v, 0.5)')} AS median, {N('stddev_samp(v)')} AS std, {N('quantile_cont(v, 0.1)')} AS p10, {N('quantile_cont(v, 0.9)')} AS p90, count(v) AS n_models FROM e GROUP BY 1")
def ensemble_stats(spark, sf):
    e = obs(spark, sf).groupBy("parameter", F.to_date("ts").alias("date")).agg(F.avg("value").alias("value"))
    return nudged(C.ensemble_stats(e), 6, "mean", "median", "std", "p10", "p90")


@query("flood_risk_class", f"WITH {FLOW}, q AS (SELECT station_id, quantile_cont(value, [0.75::DOUBLE, 0.9::DOUBLE, 0.95::DOUBLE, 0.99::DOUBLE]) AS t FROM flow GROUP BY 1), p AS (SELECT station_id, max(value) AS peak FROM flow WHERE date >= DATE '2001-06-01' GROUP BY 1) "
       f"SELECT station_id, peak, {N('t[1]')} AS threshold_75, {N('t[2]')} AS threshold_90, {N('t[3]')} AS threshold_95, {N('t[4]')} AS threshold_99, CASE WHEN peak >= t[4] THEN 'EXTREME' WHEN peak >= t[3] THEN 'HIGH' WHEN peak >= t[2] THEN 'MODERATE' WHEN peak >= t[1] THEN 'LOW' ELSE 'NORMAL' END AS risk_level FROM q JOIN p USING (station_id)")
def flood_risk_class(spark, sf):
    f = flow(spark, sf)
    return nudged(C.flood_risk(f, f.where("date >= DATE '2001-06-01'")), 6, *[f"threshold_{p}" for p in (75, 90, 95, 99)])


@query("double_mass", f"WITH {FLOW}, r AS (SELECT date, avg(value) AS m FROM flow GROUP BY 1) SELECT station_id, date, sum(value) OVER w AS cumulative, {N('sum(m) OVER w')} AS reference FROM flow JOIN r USING (date) WINDOW w AS (PARTITION BY station_id ORDER BY date)")
def double_mass(spark, sf):
    return nudged(C.double_mass(flow(spark, sf)), 6, "reference")
