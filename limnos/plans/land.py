"""Queries for groundwater, crops and irrigation."""

from __future__ import annotations


from pyspark.sql import functions as F

from limnos.functions import eto as E
from limnos.functions.dims import values_sql
from limnos.operators import agri as A
from limnos.operators import groundwater as G
from limnos.operators.series import numbered
from limnos.plans.adapters import FLOW, PAIRED, PRECIP, SFLOW, WEATHER, flow, paired, precip, supplier_flow, table, weather
from limnos.plans.catalog import N, nudged, query
from limnos.plans.hydrology import LH
from limnos.plans.trends import MONTHLY, monthly

K = ["station_id"]
c = F.col
SVP = "(0.6108::DOUBLE * exp(17.27::DOUBLE * ({t}) / (({t}) + 237.3)))"
PRS = "(101.3::DOUBLE * pow((293.0::DOUBLE - 0.0065::DOUBLE * elevation) / 293.0, 5.26))"
GAM = f"(0.665e-3::DOUBLE * {PRS})"
TM = "((t_min + t_max) / 2)"
SLP = f"(4098 * {SVP.format(t=TM)} / pow({TM} + 237.3, 2))"
ANG = "(2 * pi() * dayofyear(date) / 365)"
RA_CTE = (f"w1 AS (SELECT *, 1 + 0.033::DOUBLE * cos({ANG}) AS dr, 0.409::DOUBLE * sin({ANG} - 1.39) AS de, radians(latitude) AS ph FROM weather), w2 AS (SELECT *, acos(-tan(ph) * tan(de)) AS ws FROM w1), "
          "w3 AS (SELECT *, 24 * 60 / pi() * 0.0820::DOUBLE * dr * (ws * sin(ph) * sin(de) + cos(ph) * cos(de) * sin(ws)) AS ra FROM w2), "
          f"w4 AS (SELECT *, (0.75::DOUBLE + 2e-5::DOUBLE * elevation) * ra AS rso, ({SVP.format(t='t_min')} * rh_max / 100 + {SVP.format(t='t_max')} * rh_min / 100) / 2 AS ea, ({SVP.format(t='t_min')} + {SVP.format(t='t_max')}) / 2 AS es FROM w3), "
          "w5 AS (SELECT *, 4.903e-9::DOUBLE * ((pow(t_max + 273.16, 4) + pow(t_min + 273.16, 4)) / 2) * (0.34::DOUBLE - 0.14::DOUBLE * sqrt(ea)) * (1.35::DOUBLE * CASE WHEN rso > 0 THEN least(solar_radiation / rso, 1) ELSE 0.5 END - 0.35) AS rnl, 0.77::DOUBLE * solar_radiation AS rns FROM w4), "
          f"w6 AS (SELECT *, greatest(0, (0.408::DOUBLE * {SLP} * (rns - rnl) + {GAM} * 900 / ({TM} + 273) * wind_speed * (es - ea)) / ({SLP} + {GAM} * (1 + 0.34::DOUBLE * wind_speed))) AS eto FROM w5)")
WX = f"{WEATHER}, {RA_CTE}"


def wx_parts():
    ra = E.extraterrestrial(c("latitude"), F.dayofyear("date"))
    rso = E.clear_sky(ra, c("elevation"))
    ea = E.vapour(c("t_min"), c("t_max"), c("rh_min"), c("rh_max"))
    return ra, rso, ea


PARTS = {
    "eto_svp": (lambda: E.svp(c("t_max")), SVP.format(t="t_max")),
    "eto_slope": (lambda: E.slope((c("t_min") + c("t_max")) / 2), SLP),
    "eto_pressure": (lambda: E.pressure(c("elevation") + c("t_min")), PRS.replace("elevation", "(elevation + t_min)")),
    "eto_gamma": (lambda: E.gamma(c("elevation")), GAM),
    "eto_ra": (lambda: wx_parts()[0], "ra"),
    "eto_rso": (lambda: wx_parts()[1], "rso"),
    "eto_rns": (lambda: E.net_shortwave(c("solar_radiation")), "rns"),
    "eto_rnl": (lambda: E.net_longwave(c("t_min"), c("t_max"), wx_parts()[2], c("solar_radiation"), wx_parts()[1]), "rnl"),
    "eto_rn": (lambda: E.net_radiation(c("t_min"), c("t_max"), wx_parts()[2], c("solar_radiation"), wx_parts()[1]), "rns - rnl"),
    "eto_penman_monteith": (lambda: E.penman_monteith(c("t_min"), c("t_max"), c("rh_min"), c("rh_max"), c("wind_speed"), c("solar_radiation"),
                                                      c("latitude"), c("elevation"), F.dayofyear("date")), "eto"),
    "eto_hargreaves": (lambda: E.hargreaves(c("t_min"), c("t_max"), wx_parts()[0]), f"0.0023::DOUBLE * ({TM} + 17.8) * sqrt(greatest(t_max - t_min, 0)) * ra * 0.408"),
}


def _part(name, make, sql):
    @query(name, f"WITH {WX} SELECT station_id, date, {N(sql)} AS {name} FROM w6")
    def run(spark, sf):
        return nudged(weather(spark, sf).select(*K, "date", make().alias(name)), 6, name)


for _n, (_m, _s) in PARTS.items():
    _part(_n, _m, _s)

EFF = "CASE WHEN {p} <= 0 THEN 0 WHEN {p} < 250 THEN greatest({p} * (125 - 0.2::DOUBLE * {p}) / 125, 0) ELSE {p} * 0.1 + 100 END"


@query("effective_rainfall", f"WITH {PRECIP}, x AS (SELECT station_id, date, value * 10 AS p FROM precip) SELECT station_id, date, {N(EFF.format(p='p'))} AS usda, {N('CASE WHEN p <= 0 THEN 0 WHEN p <= 5 THEN 0 WHEN p <= 70 THEN p * 0.8::DOUBLE - 5 ELSE p * 0.6 END')} AS fao, {N('CASE WHEN p <= 0 THEN 0 ELSE p * 0.7::DOUBLE END')} AS fixed FROM x")
def effective_rainfall(spark, sf):
    p = c("value") * 10
    return nudged(precip(spark, sf).select(*K, "date", *[A.effective_rain(p, m).alias(n) for m, n in (("usda", "usda"), ("fao", "fao"), ("fixed_fraction", "fixed"))]), 6, "usda", "fao", "fixed")


CROP = f"crops({', '.join(A.CROP_COLS[0])}) AS (VALUES {values_sql(A.CROPS, A.CROP_COLS[1])}), names AS (SELECT crop, row_number() OVER (ORDER BY crop) - 1 AS i FROM crops)"
FIELD = CROP + ", field AS (SELECT s_suppkey AS field_id, s_suppkey % 10 AS station_id, crop, CAST(DATE '1996-01-01' + CAST(s_suppkey % 90 AS INT) AS DATE) AS planting_date FROM supplier JOIN names ON s_suppkey % 23 = i)"


def fields(spark, sf):
    names = A.crops(spark).select("crop")
    arr = names.groupBy().agg(F.sort_array(F.collect_list("crop")).alias("names"))
    s = table(spark, sf, "supplier").join(F.broadcast(arr), F.lit(True))
    k = c("s_suppkey")
    return s.select(k.alias("field_id"), (k % 10).alias("station_id"), F.get("names", (k % 23).cast("int")).alias("crop"),
                    F.date_add(F.lit("1996-01-01").cast("date"), (k % 90).cast("int")).alias("planting_date"))


STAGED = f"{FIELD}, staged AS (SELECT field_id, station_id, planting_date, crop, unnest(['initial', 'mid', 'late']) AS stage, unnest([kc_ini, kc_mid, kc_late]) AS kc, unnest([kcb_ini, kcb_mid, kcb_late]) AS kcb FROM field JOIN crops USING (crop))"


def staged(spark, sf):
    return fields(spark, sf).join(F.broadcast(A.crop_coefficients(spark)), "crop")


@query("crop_kc", f"WITH {STAGED} SELECT field_id, crop, stage, kc, kcb FROM staged")
def crop_kc(spark, sf):
    return staged(spark, sf).select("field_id", "crop", "stage", "kc", "kcb")


@query("compute_ke", f"WITH {STAGED} SELECT field_id, stage, {N('greatest(least(0.8::DOUBLE * (1.2::DOUBLE - kcb), 0.5::DOUBLE * 1.2), 0)')} AS ke FROM staged")
def compute_ke(spark, sf):
    return nudged(staged(spark, sf).select("field_id", "stage", A.soil_evaporation(c("kcb"), 1.2, 0.5, 0.8).alias("ke")), 6, "ke")


@query("crop_et", f"WITH {WX}, {FIELD}, d AS (SELECT field_id, w6.date AS date, eto, date_diff('day', planting_date, w6.date) AS day, crops.* FROM field JOIN crops USING (crop) JOIN w6 USING (station_id)) "
       f"SELECT field_id, date, {N('CASE WHEN day < l_ini THEN kc_ini WHEN day < l_ini + l_dev + l_mid THEN kc_mid ELSE kc_late END * eto')} AS etc FROM d WHERE day BETWEEN 0 AND l_ini + l_dev + l_mid + l_late - 1")
def crop_et(spark, sf):
    """Reference evapotranspiration times the tabulated coefficient of the day's stage, over whole seasons."""
    f = fields(spark, sf).join(F.broadcast(A.crops(spark)), "crop")
    j = f.join(A.reference_et(weather(spark, sf)), "station_id").withColumn("day", F.datediff("date", "planting_date")).where((c("day") >= 0) & (c("day") < c("l_ini") + c("l_dev") + c("l_mid") + c("l_late")))
    kc = F.when(c("day") < c("l_ini"), c("kc_ini")).when(c("day") < c("l_ini") + c("l_dev") + c("l_mid"), c("kc_mid")).otherwise(c("kc_late"))
    return nudged(j.select("field_id", "date", (kc * c("eto")).alias("etc")), 6, "etc")


def _kc(i, m, la):
    return (f"CASE WHEN day < l_ini THEN {i} WHEN day < l_ini + l_dev THEN {i} + (day - l_ini) / l_dev * ({m} - {i}) WHEN day < l_ini + l_dev + l_mid THEN {m} "
            f"WHEN day < l_ini + l_dev + l_mid + l_late THEN {m} + (day - l_ini - l_dev - l_mid) / l_late * ({la} - {m}) ELSE {la} END")


CAL = (f"WITH {WX}, {FIELD}, et AS (SELECT station_id, date, eto FROM w6), em AS (SELECT station_id, avg(eto) AS m FROM et GROUP BY 1), fd AS (SELECT field_id, station_id, crop, crops.* EXCLUDE (crop), day, CAST(planting_date + CAST(day AS INT) AS DATE) AS date FROM field JOIN crops USING (crop), "
       f"LATERAL (SELECT unnest(range(CAST(l_ini + l_dev + l_mid + l_late AS BIGINT))) AS day)), fe AS (SELECT fd.*, coalesce(et.eto, m) AS eto, {_kc('kc_ini', 'kc_mid', 'kc_late')} AS kc, {_kc('kcb_ini', 'kcb_mid', 'kcb_late')} AS kcb FROM fd LEFT JOIN et USING (station_id, date) LEFT JOIN em USING (station_id)), "
       "cal AS (SELECT field_id, station_id, crop, date, CASE WHEN day < l_ini THEN 'initial' WHEN day < l_ini + l_dev THEN 'development' WHEN day < l_ini + l_dev + l_mid THEN 'mid' ELSE 'late' END AS stage, round(kc, 3) AS kc, round(eto, 2) AS eto, round(kc * eto, 2) AS etc, round(kcb, 3) AS kcb, "
       "round(greatest(1.2::DOUBLE - kcb, 0), 3) AS ke, round(kcb + greatest(1.2::DOUBLE - kcb, 0), 3) AS kc_dual, round((kcb + greatest(1.2::DOUBLE - kcb, 0)) * eto, 2) AS etc_dual FROM fe)")


@query("crop_calendar", f"{CAL} SELECT field_id, station_id, crop, date, stage, eto, etc FROM cal")
def crop_calendar(spark, sf):
    return A.crop_calendar(fields(spark, sf), A.reference_et(weather(spark, sf))).drop("kc")


@query("crop_calendar_dual", f"{CAL} SELECT field_id, date, stage, eto, etc_dual AS etc FROM cal")
def crop_calendar_dual(spark, sf):
    return A.crop_calendar(fields(spark, sf), A.reference_et(weather(spark, sf)), dual=True).select("field_id", "date", "stage", "eto", "etc")


@query("season_end", f"WITH {FIELD} SELECT field_id, crop, planting_date, CAST(planting_date + CAST(l_ini + l_dev + l_mid + l_late - 1 AS INT) AS DATE) AS season_end FROM field JOIN crops USING (crop)")
def season_end(spark, sf):
    return A.season_end(fields(spark, sf))


SCH = CAL + f", {PRECIP}, sc AS (SELECT cal.*, coalesce(p.value, 0) AS precip, round({EFF.format(p='coalesce(p.value, 0)')}, 2) AS effective_rain, round(greatest(etc - ({EFF.format(p='coalesce(p.value, 0)')}), 0), 2) AS net_irrigation, round(greatest(etc - ({EFF.format(p='coalesce(p.value, 0)')}), 0) / 0.7::DOUBLE, 2) AS gross_irrigation FROM cal LEFT JOIN precip p USING (station_id, date))"


def schedule(spark, sf):
    return A.irrigation_schedule(A.crop_calendar(fields(spark, sf), A.reference_et(weather(spark, sf))), precip(spark, sf))


@query("irrigation_schedule", f"{SCH} SELECT field_id, date, {N('etc', 4)} AS etc, {N('effective_rain', 4)} AS effective_rain, {N('net_irrigation', 4)} AS net_irrigation, {N('gross_irrigation', 4)} AS gross_irrigation FROM sc")
def irrigation_schedule(spark, sf):
    d = schedule(spark, sf).select("field_id", "date", "etc", "effective_rain", "net_irrigation", "gross_irrigation")
    return nudged(d, 4, "etc", "effective_rain", "net_irrigation", "gross_irrigation")


def bucket_sql(src, key, refill):
    net = "CASE WHEN b.dep >= 50 THEN b.dep ELSE 0 END" if refill else "0"
    step = f"b.dep - s.precip - ({net}) + s.etc"
    return (f"s AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY date) AS rn FROM {src}), bk AS (SELECT {key}, rn, date, least(greatest(0 - precip - 0 + etc, 0), 100.0::DOUBLE) AS dep, greatest(-(0 - precip + etc), 0) AS perc, 0.0::DOUBLE AS irr FROM s WHERE rn = 1 "
            f"UNION ALL SELECT s.{key}, s.rn, s.date, least(greatest({step}, 0), 100.0::DOUBLE), greatest(-({step}), 0), ({net}) / 0.7::DOUBLE FROM bk b JOIN s ON s.{key} = b.{key} AND s.rn = b.rn + 1)")


BAL = f"{WX}, {PRECIP}, bs AS (SELECT station_id, w6.date, eto AS etc, coalesce(p.value, 0) AS precip FROM w6 LEFT JOIN precip p USING (station_id, date))"


def balance_input(spark, sf):
    et = A.reference_et(weather(spark, sf)).withColumnRenamed("eto", "etc")
    return et.join(precip(spark, sf).withColumnRenamed("value", "precip"), [*K, "date"], "left").withColumn("precip", F.coalesce("precip", F.lit(0.0)))


@query("soil_balance", f"WITH RECURSIVE {BAL}, {bucket_sql('bs', 'station_id', False)} SELECT station_id, date, {N('100 - dep')} AS soil_moisture, {N('dep')} AS depletion, {N('perc')} AS deep_percolation, dep >= 50 AS irrigation_trigger FROM bk")
def soil_balance(spark, sf):
    return nudged(A.soil_balance(balance_input(spark, sf), 100.0, 50.0).drop("irrigation"), 6, "soil_moisture", "depletion", "deep_percolation")


@query("auto_irrigate", f"WITH RECURSIVE {BAL}, {bucket_sql('bs', 'station_id', True)} SELECT station_id, date, {N('dep')} AS depletion, {N('perc')} AS deep_percolation, {N('irr')} AS irrigation, dep >= 50 AS irrigation_trigger FROM bk")
def auto_irrigate(spark, sf):
    return nudged(A.soil_balance(balance_input(spark, sf), 100.0, 50.0, refill=True).drop("soil_moisture"), 6, "depletion", "deep_percolation", "irrigation")


@query("irrigation_plan", SCH.replace("WITH ", "WITH RECURSIVE ", 1) + f", {bucket_sql('sc', 'field_id', True)}, t AS (SELECT field_id, sum(round(irr, 2)) AS ai, sum(CASE WHEN dep >= 50 THEN 1 ELSE 0 END) AS td FROM bk GROUP BY 1) "
       f"SELECT field_id, crop, max(date) AS season_end, {N('sum(eto)', 4)} AS total_eto, {N('sum(precip)', 4)} AS total_precipitation, {N('sum(effective_rain)', 4)} AS total_effective_rain, {N('sum(etc)', 4)} AS total_etc, {N('sum(net_irrigation)', 4)} AS total_net_irrigation, {N('sum(gross_irrigation)', 4)} AS total_gross_irrigation, "
       f"{N('max(ai)', 4)} AS total_applied_irrigation, CAST(max(td) AS BIGINT) AS trigger_days FROM sc JOIN t USING (field_id) GROUP BY 1, 2")
def irrigation_plan(spark, sf):
    d = A.irrigation_plan(schedule(spark, sf), 100.0, 50.0)
    return nudged(d, 4, *[x for x in d.columns if x.startswith("total_")])


PUMP = SFLOW + ", pump AS (SELECT station_id AS well, row_number() OVER (PARTITION BY station_id ORDER BY date) AS i, value FROM sflow), wt AS (SELECT well, i::DOUBLE AS time, 500 + well % 7 * 50.0::DOUBLE AS q, 100 + well % 11 * 20.0::DOUBLE AS t, 0.0002::DOUBLE * (1 + well % 5) AS s, 30 + well % 3 * 10.0::DOUBLE AS r FROM pump)"


def pump(spark, sf):
    s = numbered(supplier_flow(spark, sf))
    w = c("station_id")
    return s.select(w.alias("well"), c("rn").cast("double").alias("time"), (500 + w % 7 * 50.0).alias("q"), (100 + w % 11 * 20.0).alias("t"),
                    (0.0002 * (1 + w % 5)).alias("s"), (30 + w % 3 * 10.0).alias("r"))


@query("cooper_jacob", f"WITH {PUMP} SELECT well, time, {N('q / (4 * pi() * t) * ln(2.25::DOUBLE * t * time / (r * r * s))')} AS drawdown FROM wt")
def cooper_jacob(spark, sf):
    return nudged(pump(spark, sf).select("well", "time", G.cooper_jacob(c("q"), c("t"), c("s"), c("r"), c("time")).alias("drawdown")), 6, "drawdown")


@query("theis_recovery", f"WITH {PUMP} SELECT well, time, {N('q / (4 * pi() * t) * ln((time + 2) / time)')} AS residual FROM wt")
def theis_recovery(spark, sf):
    return nudged(pump(spark, sf).select("well", "time", G.recovery(c("q"), c("t"), F.lit(2.0), c("time") + 2).alias("residual")), 6, "residual")


@query("theis_drawdown", f"WITH {PUMP}, u AS (SELECT *, r * r * s / (4 * t * time) AS u FROM wt), tm AS (SELECT well, time, q, t, u, sum(CASE WHEN k % 2 = 1 THEN 1.0::DOUBLE ELSE -1 END * pow(u, k) / (k * gamma(k + 1))) AS ser FROM u, range(1, 25) r(k) GROUP BY 1, 2, 3, 4, 5) "
       f"SELECT well, time, {N('q / (4 * pi() * t) * (-ln(u) - 0.5772156649015329::DOUBLE + ser)', 5)} AS drawdown FROM tm")
def theis_drawdown(spark, sf):
    return nudged(pump(spark, sf).select("well", "time", G.theis(c("q"), c("t"), c("s"), c("r"), c("time")).alias("drawdown")), 5, "drawdown")


@query("transmissivity_fit", f"WITH {PUMP}, d AS (SELECT wt.*, q / (4 * pi() * t) * ln(2.25::DOUBLE * t * time / (r * r * s)) * (1 + (time % 3 - 1) * 0.01::DOUBLE) AS dd FROM wt), f AS (SELECT well, count(*) AS n, regr_slope(dd, ln(time)) AS m, regr_intercept(dd, ln(time)) AS c, max(q) AS q, max(r) AS r FROM d GROUP BY 1) "
       f"SELECT well, n, {N('q / (4 * pi() * m)')} AS transmissivity, {N('2.25::DOUBLE * q / (4 * pi() * m) / (r * r * exp(c / m))', 8)} AS storativity FROM f WHERE m > 0")
def transmissivity_fit(spark, sf):
    d = pump(spark, sf)
    dd = G.cooper_jacob(c("q"), c("t"), c("s"), c("r"), c("time")) * (1 + (c("time") % 3 - 1) * 0.01)
    f = G.transmissivity(d.withColumn("drawdown", dd), c("q"), c("r"))
    return nudged(nudged(f, 6, "transmissivity"), 8, "storativity")


@query("safe_yield", f"WITH {FLOW}, {PRECIP}, a AS (SELECT station_id, sum(value) AS e FROM precip GROUP BY 1), b AS (SELECT station_id, sum(value) / 20 AS r FROM flow GROUP BY 1) SELECT station_id, {N('e / r')} AS ratio, CASE WHEN e / r <= 0.7 THEN 'sustainable' WHEN e / r <= 1 THEN 'at risk' ELSE 'unsustainable' END AS assessment FROM a JOIN b USING (station_id)")
def safe_yield(spark, sf):
    e, r = precip(spark, sf).groupBy(*K).agg(F.sum("value").alias("e")), flow(spark, sf).groupBy(*K).agg((F.sum("value") / 20).alias("r"))
    return nudged(e.join(r, K).select(*K, (c("e") / c("r")).alias("ratio"), G.safe_yield(c("e"), c("r")).alias("assessment")), 6, "ratio")


@query("chloride_balance", f"WITH {PRECIP} SELECT station_id, {N('sum(value) * (1.0::DOUBLE + station_id % 3) / (20.0::DOUBLE + station_id)')} AS recharge_mm FROM precip GROUP BY 1")
def chloride_balance(spark, sf):
    p = precip(spark, sf).groupBy(*K).agg(F.sum("value").alias("p"))
    return nudged(p.select(*K, G.chloride_recharge(c("p"), 1.0 + c("station_id") % 3, 20.0 + c("station_id")).alias("recharge_mm")), 6, "recharge_mm")


@query("recharge_wtf", f"WITH {FLOW}, d AS (SELECT *, value - lag(value) OVER (PARTITION BY station_id ORDER BY date) AS r FROM flow), g AS (SELECT station_id, sum(greatest(r, 0)) AS t, (max(date) - min(date)) / 365.25::DOUBLE AS y FROM d GROUP BY 1) SELECT station_id, {N('t')} AS total_rise, {N('y')} AS years, {N('0.15::DOUBLE * t / y * 1000')} AS recharge_mm FROM g")
def recharge_wtf(spark, sf):
    return nudged(G.water_table_recharge(flow(spark, sf), 0.15), 6, "total_rise", "years", "recharge_mm")


@query("recharge_swb", f"WITH {PAIRED}, g AS (SELECT station_id, sum(obs - sim * 3 - sim * 2) AS t, (max(date) - min(date)) / 365.25::DOUBLE AS y FROM paired GROUP BY 1) SELECT station_id, {N('t')} AS total, {N('y')} AS years, {N('t / y')} AS recharge_mm FROM g")
def recharge_swb(spark, sf):
    p = paired(spark, sf).select(*K, "date", c("obs").alias("precip"), (c("sim") * 3).alias("et"), (c("sim") * 2).alias("runoff"), F.lit(None).cast("double").alias("delta_s"))
    return nudged(G.balance_recharge(p), 6, "total", "years", "recharge_mm")


@query("recharge_baseflow", f"{LH}, d AS (SELECT *, greatest(0, value - qf) AS b, date - lag(date) OVER (PARTITION BY station_id ORDER BY date) AS st FROM p3), g AS (SELECT station_id, sum(b) AS b, quantile_cont(st, 0.5) AS dt, (max(date) - min(date)) / 365.25::DOUBLE AS y FROM d GROUP BY 1) SELECT station_id, {N('b * dt * 86400 / y / (250 * 1e6) * 1000', 4)} AS recharge_mm FROM g")
def recharge_baseflow(spark, sf):
    return nudged(G.baseflow_recharge(flow(spark, sf), F.lit(250.0)), 4, "recharge_mm")


EV = MONTHLY + ", ev AS (SELECT station_id, date AS start, lead(date) OVER (PARTITION BY station_id ORDER BY date) AS e, 1e5::DOUBLE * (1 + month(date)) AS volume FROM m)"


@query("storage_coefficient", f"WITH {EV}, x AS (SELECT ev.station_id, volume / (abs(b.value - a.value) * 2 * 1e6) AS sy FROM ev JOIN m a ON a.station_id = ev.station_id AND a.date = ev.start JOIN m b ON b.station_id = ev.station_id AND b.date = ev.e WHERE b.value <> a.value) SELECT station_id, {N('quantile_cont(sy, 0.5)')} AS specific_yield, count(*) AS n_events FROM x WHERE sy > 0 AND sy < 1 GROUP BY 1")
def storage_coefficient(spark, sf):
    from limnos.operators.series import by
    m = monthly(spark, sf)
    ev = m.select(*K, c("date").alias("start"), F.lead("date").over(by(K)).alias("end"), (1e5 * (1 + F.month("date"))).alias("volume"))
    return nudged(G.storage_coefficient(m, ev, 2.0), 6, "specific_yield")


@query("hydrograph_stats", f"WITH {FLOW} SELECT station_id, {N('avg(value)')} AS mean, {N('quantile_cont(value, 0.5)')} AS median, {N('stddev_samp(value)')} AS std, min(value) AS min, max(value) AS max, max(value) - min(value) AS range, count(*) AS count FROM flow GROUP BY 1")
def hydrograph_stats(spark, sf):
    return nudged(G.hydrograph_stats(flow(spark, sf)), 6, "mean", "median", "std")


GWS = PAIRED + ", gw AS (SELECT station_id, date, obs - sim * 2 - sim AS value FROM paired)"


def gws(spark, sf):
    p = precip(spark, sf)
    return G.storage_anomaly(flow(spark, sf), p.withColumn("value", c("value") * 2), p)


@query("fill_gws", f"WITH {GWS} SELECT station_id, {N('avg(value)')} AS mean_gws, {N('stddev_samp(value)')} AS std_gws, count(*) AS n FROM gw GROUP BY 1")
def fill_gws(spark, sf):
    return nudged(gws(spark, sf).groupBy(*K).agg(F.avg("value").alias("mean_gws"), F.stddev_samp("value").alias("std_gws"), F.count(F.lit(1)).alias("n")), 6, "mean_gws", "std_gws")


@query("sigma_anomalies", f"WITH {GWS}, z AS (SELECT *, (value - avg(value) OVER p) / stddev_samp(value) OVER p AS z FROM gw WINDOW p AS (PARTITION BY station_id)) SELECT station_id, date, {N('value')} AS value, {N('z')} AS z_score, CASE WHEN z < 0 THEN 'depletion' ELSE 'surplus' END AS anomaly FROM z WHERE abs(z) >= 2")
def sigma_anomalies(spark, sf):
    return nudged(G.sigma_anomalies(gws(spark, sf)), 6, "value", "z_score")


@query("src_gw_monthly", f"WITH {FLOW} SELECT station_id, make_date(year(date), month(date), 15) AS date, {N('avg(value)')} AS value, count(*) AS n_days FROM flow WHERE value <> 25 GROUP BY station_id, year(date), month(date)")
def src_gw_monthly(spark, sf):
    f = flow(spark, sf).withColumn("value", F.when(c("value") == 25, -9999.0).otherwise(c("value")))
    return nudged(G.monthly_wells(f), 6, "value")


@query("runoff_mm_day", f"WITH {FLOW} SELECT station_id, date, CASE WHEN station_id * 100 > 0 THEN {N('value * 86400::DOUBLE / (station_id * 100 * 1e6) * 1000')} END AS runoff_mm FROM flow")
def runoff_mm_day(spark, sf):
    from limnos.functions.hydro import runoff_mm
    return nudged(flow(spark, sf).select(*K, "date", runoff_mm(c("value"), c("station_id") * 100.0).alias("runoff_mm")), 6, "runoff_mm")


