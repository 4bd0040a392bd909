"""Queries over raw samples: quality, exploration, screening."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.functions import dims
from limnos.operators import explore as X
from limnos.operators import quality as Q
from limnos.operators import screening as S
from limnos.operators.series import daily_series
from limnos.plans.adapters import DEFECTS, FLOW, OBS, flow, obs, obs_defects
from limnos.plans.catalog import R, query

DRINKING = {"view": "nitrate", "signup": "pH", "click": "turbidity", "error": "dissolved_oxygen", "purchase": "e_coli"}
RIVER = {"view": "DO", "signup": "BOD5", "click": "SS", "error": "NH3-N", "purchase": "TP"}
STATUS = {"view": "Nitrate", "signup": "pH", "click": "BOD5", "error": "Dissolved oxygen", "purchase": "Phosphate"}
LAKE = {"view": "Chlorophyll-a", "signup": "TP", "click": "SS", "error": "TN", "purchase": "COD"}


def named(df, names):
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return df.withColumn("parameter", m[F.col("parameter")])


def named_sql(names):
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in names.items())
    return (f"obs AS (SELECT 'events' AS source, user_id AS station_id, CASE event_type {cases} END AS parameter, "
            "ts, value, event_id AS seq FROM events)")


def limits_sql(text, cols, name):
    return f"{name}({', '.join(cols[0])}) AS (VALUES {dims.values_sql(text, cols[1])})"


LIM = limits_sql(dims.THRESHOLDS, dims.THRESHOLD_COLS, "lim")
GUIDE = limits_sql(dims.GUIDELINES, dims.GUIDELINE_COLS, "guide")
EQS = limits_sql(dims.EQS, dims.EQS_COLS, "eqs")
FENCE = ("f AS (SELECT parameter, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(value) AS n "
         "FROM {src} GROUP BY 1)")
OUT = "(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1))"


@query("quality_dups", f"WITH {DEFECTS} SELECT count(*) AS n_records, count(*) - count(DISTINCT (station_id, ts, parameter)) AS n_duplicates FROM defects")
def quality_dups(spark, sf):
    return Q.duplicates(obs_defects(spark, sf))


@query("quality_nulls", f"WITH {DEFECTS} SELECT 'value' AS column_name, count(*) - count(value) AS n_null FROM defects "
       "UNION ALL SELECT 'unit', count(*) - count(unit) FROM defects UNION ALL SELECT 'ts', count(*) - count(ts) FROM defects")
def quality_nulls(spark, sf):
    return Q.null_counts(obs_defects(spark, sf), ["value", "unit", "ts"])


@query("quality_completeness", f"WITH {DEFECTS} SELECT count(*) AS n_records, count(*) - count(value) AS n_null, "
       f"{R('(1 - (count(*) - count(value)) / (count(*) * 5.0::DOUBLE)) * 100', 1)} AS completeness_pct FROM defects")
def quality_completeness(spark, sf):
    return Q.completeness(obs_defects(spark, sf), ["source", "station_id", "parameter", "ts", "value"])


@query("quality_outliers", f"WITH {DEFECTS}, {FENCE.format(src='defects')} SELECT parameter, count(*) AS n_outliers FROM defects JOIN f USING (parameter) "
       f"WHERE n >= 10 AND {OUT} GROUP BY 1")
def quality_outliers(spark, sf):
    return Q.outlier_counts(obs_defects(spark, sf))


@query("quality_units", f"WITH {DEFECTS} SELECT parameter, count(DISTINCT unit) AS n_units, string_agg(DISTINCT unit, ', ' ORDER BY unit) AS units "
       "FROM defects GROUP BY 1 HAVING count(DISTINCT unit) > 1")
def quality_units(spark, sf):
    return Q.mixed_units(obs_defects(spark, sf))


@query("temporal_gaps", f"""WITH {FLOW}, s AS (SELECT station_id, date, lag(date) OVER w AS p FROM flow WINDOW w AS (PARTITION BY station_id ORDER BY date)),
 d AS (SELECT *, date - p AS step, quantile_cont(date - p, 0.5) OVER (PARTITION BY station_id) AS med FROM s WHERE p IS NOT NULL),
 g AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY date) AS k FROM d WHERE med >= 1 AND step > 3 * med)
 SELECT station_id, p AS gap_start, step AS gap_days FROM g WHERE k <= 3 ORDER BY gap_days DESC, station_id, gap_start LIMIT 10""")
def temporal_gaps(spark, sf):
    return Q.temporal_gaps(flow(spark, sf).select("station_id", F.col("date").cast("timestamp").alias("ts")))


@query("quality_recommend", f"""WITH {DEFECTS}, {FENCE.format(src='defects')}, a AS (SELECT count(*) AS n, count(*) - count(DISTINCT (station_id, ts, parameter)) AS dups,
 count(*) - count(value) AS nulls FROM defects), o AS (SELECT count(*) AS c FROM defects JOIN f USING (parameter) WHERE f.n >= 10 AND {OUT}),
 u AS (SELECT count(*) AS m FROM (SELECT parameter FROM defects GROUP BY 1 HAVING count(DISTINCT unit) > 1))
 SELECT * FROM (SELECT 1 AS ord, CASE WHEN dups > 0 THEN 'remove_duplicates' END AS step FROM a UNION ALL
 SELECT 2, CASE WHEN nulls > n * 0.05 THEN 'fill_missing' END FROM a UNION ALL SELECT 3, CASE WHEN c > n * 0.01 THEN 'remove_outliers' END FROM a, o
 UNION ALL SELECT 4, CASE WHEN m > 0 THEN 'standardize_units' END FROM u UNION ALL SELECT 5, 'resample_daily') WHERE step IS NOT NULL""")
def quality_recommend(spark, sf):
    return Q.recommended_steps(obs_defects(spark, sf))


@query("quality_score", f"""WITH {DEFECTS}, a AS (SELECT count(*) AS n_records, count(*) - (SELECT count(*) FROM (SELECT DISTINCT station_id, parameter, ts, value, unit FROM defects)) AS n_duplicates,
 count(*) - count(value) AS n_null, datediff('second', min(ts), max(ts)) // 86400 AS days FROM defects)
 SELECT n_records, n_duplicates, n_null, CAST(greatest(0, round_even(100 - least(40.0, n_null * 100.0 / (n_records * 5)) - least(20.0, n_duplicates * 100.0 / n_records)
 - CASE WHEN days IS NULL OR days / 365.25 < 1.0 / 12 THEN 10 ELSE 0 END, 0)) AS BIGINT) AS quality_score FROM a""")
def quality_score(spark, sf):
    return Q.quality_score(obs_defects(spark, sf).select("station_id", "parameter", "ts", "value", "unit"))


@query("dedupe_first", f"WITH {DEFECTS} SELECT station_id, parameter, ts, value, seq, copy FROM (SELECT *, row_number() OVER "
       "(PARTITION BY station_id, ts, parameter ORDER BY seq * 2 + copy) AS k FROM defects) WHERE k = 1")
def dedupe_first(spark, sf):
    d = obs_defects(spark, sf).withColumn("o", F.col("seq") * 2 + F.col("copy"))
    return Q.dedupe(d, keep="first", order="o").select("station_id", "parameter", "ts", "value", "seq", "copy")


@query("dedupe_last", f"WITH {DEFECTS} SELECT station_id, parameter, ts, value, seq, copy FROM (SELECT *, row_number() OVER "
       "(PARTITION BY station_id, ts, parameter ORDER BY seq * 2 + copy DESC) AS k FROM defects) WHERE k = 1")
def dedupe_last(spark, sf):
    d = obs_defects(spark, sf).withColumn("o", F.col("seq") * 2 + F.col("copy"))
    return Q.dedupe(d, keep="last", order="o").select("station_id", "parameter", "ts", "value", "seq", "copy")


@query("fill_missing", f"WITH {DEFECTS}, m AS (SELECT station_id, parameter, quantile_cont(value, 0.5) AS med FROM defects GROUP BY 1, 2) "
       f"SELECT station_id, parameter, seq, copy, {R('coalesce(value, med)', 6)} AS value FROM defects JOIN m USING (station_id, parameter)")
def fill_missing(spark, sf):
    return Q.fill_missing(obs_defects(spark, sf)).select("station_id", "parameter", "seq", "copy", F.round("value", 6).alias("value"))


@query("remove_outliers", f"WITH {DEFECTS}, {FENCE.format(src='defects')} SELECT station_id, parameter, seq, copy, value FROM defects JOIN f USING (parameter) WHERE value IS NULL OR NOT {OUT}")
def remove_outliers(spark, sf):
    return Q.remove_outliers(obs_defects(spark, sf)).select("station_id", "parameter", "seq", "copy", "value")


@query("normalize", f"WITH {DEFECTS} SELECT station_id, parameter, seq, copy, {R('(value - avg(value) OVER (PARTITION BY parameter)) / stddev_samp(value) OVER (PARTITION BY parameter)', 6)} AS value_normalized FROM defects")
def normalize(spark, sf):
    return Q.normalize(obs_defects(spark, sf)).select("station_id", "parameter", "seq", "copy", F.round("value_normalized", 6).alias("value_normalized"))


@query("ingest_qa", f"""WITH {DEFECTS}, dd AS (SELECT station_id, ts, max_by(CASE WHEN seq % 333 = 0 THEN -9999.0::DOUBLE WHEN seq % 71 = 0 THEN -value ELSE value END, seq * 2 + copy) AS value, count(*) - 1 AS dup FROM defects WHERE seq % 10 <> 0 OR copy = 0 GROUP BY 1, 2),
 cl AS (SELECT * FROM dd WHERE value IS NOT NULL AND value <> -9999), md AS (SELECT station_id, quantile_cont(value, 0.5) AS med FROM cl GROUP BY 1),
 ma AS (SELECT station_id, quantile_cont(abs(value - med), 0.5) AS mad, count(*) AS n FROM cl JOIN md USING (station_id) GROUP BY 1),
 sp AS (SELECT station_id, sum(CASE WHEN n > 30 AND abs(value - med) / (1.4826 * CASE WHEN mad = 0 THEN 1e-9 ELSE mad END) > 12 THEN 1 ELSE 0 END) AS n_spikes FROM cl JOIN md USING (station_id) JOIN ma USING (station_id) GROUP BY 1),
 dy AS (SELECT station_id, CAST(ts AS DATE) AS date FROM cl GROUP BY 1, 2), st AS (SELECT *, date - lag(date) OVER (PARTITION BY station_id ORDER BY date) AS step FROM dy),
 gp AS (SELECT station_id, count(*) AS n_days, coalesce(max(CASE WHEN step > 30 THEN step - 1 END), 0) AS longest_gap, sum(CASE WHEN step > 30 THEN 1 ELSE 0 END) AS n_gaps FROM st GROUP BY 1),
 cv AS (SELECT station_id, count(*) AS n_values, CAST(min(ts) AS DATE) AS start, CAST(max(ts) AS DATE) AS "end", (epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000 + 1 AS n_days_span, sum(CASE WHEN value < 0 THEN 1 ELSE 0 END) AS n_negative FROM cl GROUP BY 1),
 dr AS (SELECT station_id, sum(dup) AS n_duplicates, sum(CASE WHEN value = -9999 THEN 1 ELSE 0 END) AS n_sentinels FROM dd GROUP BY 1)
 SELECT station_id, n_values, start, "end", n_days, n_days_span, {R('n_days * 100.0::DOUBLE / n_days_span', 1)} AS coverage_pct, CAST(n_duplicates AS BIGINT) AS n_duplicates, CAST(n_sentinels AS BIGINT) AS n_sentinels,
 CAST(n_negative AS BIGINT) AS n_negative, CAST(n_spikes AS BIGINT) AS n_spikes, CAST(n_gaps AS BIGINT) AS n_gaps, longest_gap,
 concat_ws(',', CASE WHEN n_negative > 0 AND n_sentinels = 0 THEN 'negatives' END, CASE WHEN n_spikes > 0 THEN 'spikes' END, CASE WHEN n_days * 100.0::DOUBLE / n_days_span < 80 THEN 'coverage' END) AS warnings
 FROM cv JOIN gp USING (station_id) JOIN dr USING (station_id) JOIN sp USING (station_id)""")
def ingest_qa(spark, sf):
    d = obs_defects(spark, sf).where("seq % 10 <> 0 OR copy = 0").withColumn("value", F.when(F.col("seq") % 333 == 0, -9999.0).when(F.col("seq") % 71 == 0, -F.col("value")).otherwise(F.col("value")))
    return Q.ingest_qa(d.withColumn("seq", F.col("seq") * 2 + F.col("copy")))


@query("ingest_gaps", """WITH s AS (SELECT DISTINCT l_suppkey AS station_id, CAST(l_shipdate AS DATE) AS date FROM lineitem), g AS (SELECT *, lag(date) OVER (PARTITION BY station_id ORDER BY date) AS gap_from FROM s),
 r AS (SELECT station_id, gap_from, date - gap_from - 1 AS days, row_number() OVER (PARTITION BY station_id ORDER BY date - gap_from DESC, gap_from) AS k FROM g WHERE date - gap_from > 30) SELECT station_id, gap_from, days FROM r WHERE k <= 20""")
def ingest_gaps(spark, sf):
    from limnos.plans.adapters import supplier_flow
    return Q.gap_list(supplier_flow(spark, sf).select("station_id", F.col("date").alias("ts"), "value"))


@query("ingest_yearly_coverage", f"""WITH {FLOW} SELECT station_id, year(date) AS year, count(*) AS n_days,
 {R("count(*) * 100.0::DOUBLE / (CASE WHEN year(date) % 4 = 0 THEN 366 ELSE 365 END)", 1)} AS coverage_pct FROM flow GROUP BY 1, 2""")
def ingest_yearly_coverage(spark, sf):
    return Q.yearly_coverage(flow(spark, sf).select("station_id", F.col("date").alias("ts"), "value"))


@query("quality_rollup", f"WITH {DEFECTS} SELECT source, station_id, parameter, count(*) AS n, count(value) AS n_values FROM defects GROUP BY ROLLUP (source, station_id, parameter)")
def quality_rollup(spark, sf):
    return Q.rollup_counts(obs_defects(spark, sf))


@query("resample_daily", f"WITH {OBS} SELECT station_id, parameter, CAST(ts AS DATE) AS date, {R('avg(value)', 6)} AS value FROM obs GROUP BY 1, 2, 3")
def resample_daily(spark, sf):
    return daily_series(obs(spark, sf), ["station_id", "parameter"], "ts", "value").withColumn("value", F.round("value", 6))


@query("resample_daily_gaps", f"""WITH {OBS}, d AS (SELECT station_id, parameter, CAST(ts AS DATE) AS date, {R('avg(value)', 6)} AS value FROM obs GROUP BY 1, 2, 3),
 s AS (SELECT station_id, parameter, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM d GROUP BY 1, 2) SELECT s.station_id, s.parameter, s.date, d.value FROM s LEFT JOIN d USING (station_id, parameter, date)""")
def resample_daily_gaps(spark, sf):
    from limnos.operators.periods import fill_calendar
    d = daily_series(obs(spark, sf), ["station_id", "parameter"], "ts", "value").withColumn("value", F.round("value", 6))
    return fill_calendar(d, ["station_id", "parameter"])


@query("eda_stats", f"""WITH {DEFECTS}, {FENCE.format(src='defects')} SELECT parameter, count(value) AS n_values, count(*) - count(value) AS n_missing, {R('avg(value)', 8)} AS mean, {R('stddev_samp(value)', 8)} AS std,
 {R('min(value)', 8)} AS min, {R('quantile_cont(value, 0.25)', 8)} AS q25, {R('quantile_cont(value, 0.5)', 8)} AS median, {R('quantile_cont(value, 0.75)', 8)} AS q75, {R('max(value)', 8)} AS max,
 CAST(sum(CASE WHEN {OUT} THEN 1 ELSE 0 END) AS BIGINT) AS n_outliers FROM defects JOIN f USING (parameter) GROUP BY 1""")
def eda_stats(spark, sf):
    return X.describe(obs_defects(spark, sf), digits=8)


@query("wq_summary", f"""WITH {OBS} SELECT parameter, count(value) AS n_records, {R('avg(value)', 8)} AS mean, {R('stddev_samp(value)', 8)} AS std, {R('min(value)', 8)} AS min, {R('quantile_cont(value, 0.25)', 8)} AS p25,
 {R('quantile_cont(value, 0.5)', 8)} AS median, {R('quantile_cont(value, 0.75)', 8)} AS p75, {R('max(value)', 8)} AS max FROM obs GROUP BY 1""")
def wq_summary(spark, sf):
    d = X.describe(obs(spark, sf), digits=8)
    return d.select("parameter", F.col("n_values").alias("n_records"), "mean", "std", "min", F.col("q25").alias("p25"), "median", F.col("q75").alias("p75"), "max")


@query("eda_profile", f"""WITH {OBS} SELECT count(*) AS n_records, count(DISTINCT station_id) AS n_stations, count(DISTINCT parameter) AS n_parameters, string_agg(DISTINCT source, ',' ORDER BY source) AS sources,
 string_agg(DISTINCT parameter, ',' ORDER BY parameter) AS parameters, {R("((epoch_us(max(ts)) - epoch_us(min(ts))) // 86400000000) / 365.25::DOUBLE", 1)} AS time_span_years FROM obs""")
def eda_profile(spark, sf):
    return X.profile(obs(spark, sf))


@query("profile_columns", f"""WITH {DEFECTS} SELECT count(*) AS n_records, 'ts' AS time_col, 'station_id' AS station_col, 'parameter' AS param_col, 'value' AS value_col, count(DISTINCT station_id) AS n_stations,
 min(ts) AS date_min, max(ts) AS date_max, {R('100.0::DOUBLE * (1 - (count(*) - count(value)) / (count(*) * 5.0::DOUBLE))')} AS completeness_pct FROM defects""")
def profile_columns(spark, sf):
    return X.profile_columns(obs_defects(spark, sf).select("station_id", "parameter", "ts", "value", "unit"))


@query("eda_corr", f"""WITH {OBS}, m AS (SELECT CAST(ts AS DATE) AS d, station_id, parameter, avg(value) AS v FROM obs GROUP BY 1, 2, 3)
 SELECT a.parameter AS param1, b.parameter AS param2, {R('corr(a.v, b.v)', 3)} AS r, count(*) AS n FROM m a JOIN m b ON a.d = b.d AND a.station_id = b.station_id AND a.parameter < b.parameter GROUP BY 1, 2""")
def eda_corr(spark, sf):
    o = obs(spark, sf).withColumn("d", F.to_date("ts"))
    return X.parameter_correlation(o, ("d", "station_id"))


@query("station_summary", f"""WITH {FLOW} SELECT station_id, count(value) AS n, min(date) AS start, max(date) AS "end", {R("(max(date) - min(date)) / 365.25::DOUBLE", 2)} AS years, {R('avg(value)')} AS mean, {R('quantile_cont(value, 0.5)')} AS median,
 min(value) AS min, max(value) AS max FROM flow GROUP BY 1""")
def station_summary(spark, sf):
    return X.station_summary(flow(spark, sf))


LOWER = "parameter = 'dissolved_oxygen'"
RATIO = f"CASE WHEN {LOWER} THEN CASE WHEN value <> 0 THEN limit_value / value ELSE 'inf'::DOUBLE END ELSE CASE WHEN limit_value <> 0 THEN value / limit_value ELSE 'inf'::DOUBLE END END"
HITS = (f"{named_sql(DRINKING)}, {LIM}, h AS (SELECT seq, station_id, parameter, value, standard, limit_value, {RATIO} AS ratio FROM obs JOIN lim USING (parameter) "
        f"WHERE CASE WHEN {LOWER} THEN value < limit_value ELSE value > limit_value END), hs AS (SELECT *, CASE WHEN ratio < 1 THEN 'info' WHEN ratio < 1.5 THEN 'warning' ELSE 'critical' END AS severity FROM h)")


@query("alerts_rows", f"WITH {HITS} SELECT seq, parameter, standard, limit_value, value, CASE WHEN isinf(ratio) THEN ratio ELSE {R('ratio', 6)} END AS ratio, severity FROM hs")
def alerts_rows(spark, sf):
    b = S.breaches(named(obs(spark, sf), DRINKING))
    return b.select("seq", "parameter", "standard", "limit_value", "value", F.when(F.col("ratio") == float("inf"), F.col("ratio")).otherwise(F.round("ratio", 6)).alias("ratio"), "severity")


@query("join_cross_threshold", f"WITH {HITS} SELECT parameter, standard, severity, count(*) AS n FROM hs GROUP BY 1, 2, 3")
def join_cross_threshold(spark, sf):
    return S.breaches(named(obs(spark, sf), DRINKING)).groupBy("parameter", "standard", "severity").agg(F.count(F.lit(1)).alias("n"))


@query("threshold_catalog", f"WITH {named_sql(DRINKING)}, {LIM} SELECT parameter, standard, limit_value, lim.unit, count(seq) AS n_samples FROM lim JOIN obs USING (parameter) WHERE standard = 'WHO' GROUP BY 1, 2, 3, 4")
def threshold_catalog(spark, sf):
    per = named(obs(spark, sf), DRINKING).groupBy("parameter").agg(F.count(F.lit(1)).alias("n_samples"))
    return dims.thresholds(spark, ["WHO"]).join(per, "parameter").select("parameter", "standard", "limit_value", "unit", "n_samples")


@query("alerts_report", f"WITH {HITS} SELECT CAST(coalesce(sum(CASE WHEN severity = 'critical' THEN 1 ELSE 0 END), 0) AS BIGINT) AS critical, CAST(coalesce(sum(CASE WHEN severity = 'warning' THEN 1 ELSE 0 END), 0) AS BIGINT) AS warning, "
       "CAST(coalesce(sum(CASE WHEN severity = 'info' THEN 1 ELSE 0 END), 0) AS BIGINT) AS info, count(DISTINCT seq) AS samples_with_alerts, (SELECT count(*) FROM obs) AS total_samples FROM hs")
def alerts_report(spark, sf):
    return S.alert_report(named(obs(spark, sf), DRINKING))


@query("alerts_top", f"WITH {HITS} SELECT seq, parameter, standard, limit_value, CASE WHEN isinf(hs.ratio) THEN hs.ratio ELSE {R('hs.ratio', 6)} END AS ratio FROM hs ORDER BY hs.ratio DESC, seq, standard, limit_value LIMIT 20")
def alerts_top(spark, sf):
    d = S.top_alerts(named(obs(spark, sf), DRINKING))
    return d.select("seq", "parameter", "standard", "limit_value", F.when(F.col("ratio") == float("inf"), F.col("ratio")).otherwise(F.round("ratio", 6)).alias("ratio"))


@query("who_screen", f"""WITH {named_sql(DRINKING)}, {GUIDE}, r AS (SELECT lower(obs.parameter) AS parameter, value FROM obs WHERE value IS NOT NULL), a AS (SELECT r.parameter, count(*) AS n, CAST(sum(CASE WHEN high IS NULL THEN CASE WHEN value < low THEN 1 ELSE 0 END
 WHEN low = 0 THEN CASE WHEN value > high THEN 1 ELSE 0 END WHEN value < low OR value > high THEN 1 ELSE 0 END) AS BIGINT) AS n_exceed FROM r JOIN guide USING (parameter) GROUP BY 1)
 SELECT *, {R('100.0::DOUBLE * n_exceed / n', 1)} AS pct, CASE WHEN round(100.0::DOUBLE * n_exceed / n, 1) > 10 THEN 'Alert' WHEN n_exceed > 0 THEN 'Warning' ELSE 'OK' END AS status FROM a""")
def who_screen(spark, sf):
    return S.guideline_screen(named(obs(spark, sf), DRINKING))


@query("who_exceedance", f"""WITH {named_sql(DRINKING)}, {GUIDE}, a AS (SELECT lower(obs.parameter) AS parameter, count(*) AS n_measurements, {R('avg(value)')} AS mean, {R('min(value)')} AS min, {R('max(value)')} AS max,
 CAST(sum(CASE WHEN value < low OR value > coalesce(high, 'inf'::DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS n_exceedances FROM obs JOIN guide ON lower(obs.parameter) = guide.parameter GROUP BY 1)
 SELECT *, {R('100.0::DOUBLE * n_exceedances / n_measurements', 1)} AS pct_exceedances, CASE WHEN n_exceedances > 0 THEN 'EXCEEDANCE' ELSE 'OK' END AS status FROM a""")
def who_exceedance(spark, sf):
    return S.guideline_exceedance(named(obs(spark, sf), DRINKING))


CLS = ("CASE WHEN kind = 'range' THEN CASE WHEN value BETWEEN good AND moderate THEN 'Good' ELSE 'Poor' END WHEN kind = 'lower' THEN CASE WHEN value <= good THEN 'Good' WHEN value <= moderate THEN 'Moderate' ELSE 'Poor' END "
       "ELSE CASE WHEN value >= good THEN 'Good' WHEN value >= moderate THEN 'Moderate' ELSE 'Poor' END END")


@query("wfd_classify", f"WITH {named_sql(STATUS)}, {EQS} SELECT seq, parameter, {CLS} AS status FROM obs JOIN eqs USING (parameter)")
def wfd_classify(spark, sf):
    return S.status_class(named(obs(spark, sf), STATUS)).select("seq", "parameter", "status")


@query("wfd_compliance", f"""WITH {named_sql(STATUS)}, {EQS}, a AS (SELECT parameter, count(*) AS n_samples, CAST(sum(CASE WHEN {CLS} = 'Good' THEN 1 ELSE 0 END) AS BIGINT) AS n_compliant FROM obs JOIN eqs USING (parameter) GROUP BY 1), p AS (SELECT *, n_compliant * 100.0::DOUBLE / n_samples AS x FROM a)
 SELECT parameter, n_samples, n_compliant, {R('x', 2)} AS compliance_pct, CASE WHEN x >= 95 THEN 'High' WHEN x >= 75 THEN 'Good' WHEN x >= 50 THEN 'Moderate' WHEN x >= 25 THEN 'Poor' ELSE 'Bad' END AS status_class FROM p""")
def wfd_compliance(spark, sf):
    return S.status_compliance(named(obs(spark, sf), STATUS))


PTS = ("CASE WHEN parameter = 'DO' THEN CASE WHEN value >= 6.5 THEN 1 WHEN value >= 4.6 THEN 3 WHEN value >= 2.0 THEN 6 ELSE 10 END WHEN parameter = 'BOD5' THEN CASE WHEN value <= 3.0 THEN 1 WHEN value <= 4.9 THEN 3 WHEN value <= 15.0 THEN 6 ELSE 10 END "
       "WHEN parameter = 'SS' THEN CASE WHEN value <= 20.0 THEN 1 WHEN value <= 49.9 THEN 3 WHEN value <= 100.0 THEN 6 ELSE 10 END WHEN parameter = 'NH3-N' THEN CASE WHEN value <= 0.5 THEN 1 WHEN value <= 0.99 THEN 3 WHEN value <= 3.0 THEN 6 ELSE 10 END END")


@query("rpi_score", f"WITH {named_sql(RIVER)} SELECT seq, parameter, CAST({PTS} AS BIGINT) AS points FROM obs WHERE parameter <> 'TP'")
def rpi_score(spark, sf):
    o = named(obs(spark, sf), RIVER).where("parameter <> 'TP'")
    return o.select("seq", "parameter", S.rpi_points(F.col("parameter"), F.col("value")).alias("points"))


RPI = (f"{named_sql(RIVER)}, l AS (SELECT station_id, CAST(ts AS DATE) AS date, parameter, max_by(value, seq) AS value FROM obs WHERE parameter <> 'TP' GROUP BY 1, 2, 3), "
       f"p AS (SELECT station_id, date, count(*) AS n_params, avg({PTS}) AS x FROM l GROUP BY 1, 2 HAVING count(*) >= 3), rpi AS (SELECT station_id, date, n_params, (round_even(x, 2) + 0.0) AS rpi, "
       "CASE WHEN x <= 2 THEN 'Non-polluted' WHEN x <= 3 THEN 'Lightly polluted' WHEN x <= 6 THEN 'Moderately polluted' ELSE 'Severely polluted' END AS category FROM p)")


@query("rpi_index", f"WITH {RPI} SELECT * FROM rpi")
def rpi_index(spark, sf):
    return S.rpi_index(named(obs(spark, sf), RIVER))


@query("rpi_categories", f"WITH {RPI} SELECT category, count(*) AS n FROM rpi GROUP BY 1")
def rpi_categories(spark, sf):
    return S.rpi_index(named(obs(spark, sf), RIVER)).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("trophic_tsi", f"""WITH {named_sql(LAKE)}, m AS (SELECT station_id, avg(CASE WHEN parameter = 'Chlorophyll-a' THEN value END) AS chl, avg(CASE WHEN parameter = 'TP' THEN value END) AS tp FROM obs GROUP BY 1),
 t AS (SELECT station_id, CASE WHEN chl > 0 THEN {R('9.81 * ln(chl) + 30.6', 2)} END AS tsi_chl, CASE WHEN tp > 0 THEN {R('14.42 * ln(tp) + 4.15', 2)} END AS tsi_tp FROM m), u AS (SELECT *, {R('CASE WHEN tsi_chl IS NULL THEN tsi_tp WHEN tsi_tp IS NULL THEN tsi_chl ELSE (tsi_chl + tsi_tp) / 2 END', 3)} AS tsi FROM t WHERE tsi_chl IS NOT NULL OR tsi_tp IS NOT NULL)
 SELECT *, CASE WHEN tsi < 30 THEN 'Oligotrophic' WHEN tsi < 50 THEN 'Mesotrophic' WHEN tsi < 70 THEN 'Eutrophic' ELSE 'Hypereutrophic' END AS state FROM u""")
def trophic_tsi(spark, sf):
    return S.trophic_state(named(obs(spark, sf), LAKE))


@query("sdg6_rank", f"""WITH {OBS}, a AS (SELECT station_id AS entity, parameter AS indicator, {R('avg(value)', 8)} AS mean, {R('stddev_samp(value)', 8)} AS std, count(value) AS n FROM obs GROUP BY 1, 2)
 SELECT *, row_number() OVER (PARTITION BY indicator ORDER BY mean DESC, entity) AS rank FROM a""")
def sdg6_rank(spark, sf):
    from limnos.operators.indicators import rank_entities
    return rank_entities(obs(spark, sf), "station_id", "parameter", digits=8)


@query("spatial_heterogeneity", f"""WITH {OBS}, st AS (SELECT parameter, station_id, count(*) AS c, avg(value) AS m FROM obs GROUP BY 1, 2), sp AS (SELECT parameter, count(*) AS n_stations, stddev_samp(m) AS sd, avg(m) AS mm, min(m) AS lo, max(m) AS hi FROM st GROUP BY 1),
 o3 AS (SELECT obs.parameter, obs.station_id, value, rank() OVER (PARTITION BY obs.parameter ORDER BY value) + (count(*) OVER (PARTITION BY obs.parameter, value) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY obs.parameter) AS n FROM obs JOIN st USING (parameter, station_id) WHERE c >= 3),
 ti AS (SELECT parameter, sum(k * k * k - k) AS ties FROM (SELECT parameter, value, count(*)::DOUBLE AS k FROM o3 GROUP BY 1, 2) GROUP BY 1), gs AS (SELECT parameter, station_id, sum(r) AS rs, count(*) AS c, max(n) AS n FROM o3 GROUP BY 1, 2),
 ss AS (SELECT parameter, sum(rs * rs / c) AS ss, count(*) AS g, max(n)::DOUBLE AS n FROM gs GROUP BY 1)
 SELECT parameter, n_stations, {R('sd / mm * 100', 2)} AS spatial_cv_pct, {R('(12 / (n * (n + 1)) * ss - 3 * (n + 1)) / (1 - ties / (n * n * n - n))')} AS kruskal_h, g - 1 AS dof, {R('lo', 8)} AS mean_min, {R('hi', 8)} AS mean_max FROM sp JOIN ss USING (parameter) JOIN ti USING (parameter) WHERE g >= 2""")
def spatial_heterogeneity(spark, sf):
    return S.spatial_heterogeneity(obs(spark, sf))


STDS = "CASE parameter WHEN 'BOD5' THEN 30.0 WHEN 'SS' THEN 30.0 WHEN 'NH3-N' THEN 10.0 WHEN 'TP' THEN 2.0 END"
BGS = "CASE parameter WHEN 'BOD5' THEN 3.5 WHEN 'SS' THEN 5.0 WHEN 'NH3-N' THEN 0.2 WHEN 'TP' THEN 0.02 ELSE 0 END"


@query("treatment_stats", f"""WITH {named_sql(RIVER)}, a AS (SELECT parameter, count(*) AS n, avg(value) AS m, stddev_pop(value) AS sp, stddev_samp(value) AS ssd, sum(CASE WHEN value <= {STDS} THEN 1 ELSE 0 END) AS ok, quantile_cont(value, 0.75) AS cin, quantile_cont(value, 0.25) AS cout FROM obs GROUP BY 1 HAVING count(*) >= 5),
 d AS (SELECT parameter, CAST(ts AS DATE) AS date, avg(value) AS value FROM obs GROUP BY 1, 2), dx AS (SELECT parameter, value, date - min(date) OVER (PARTITION BY parameter) AS x FROM d),
 t AS (SELECT parameter, regr_slope(value, x) AS slope, regr_intercept(value, x) AS icpt, max(x) AS xl FROM dx GROUP BY 1)
 SELECT parameter, n, {R('m')} AS mean, {R('sp')} AS std, {R('ssd / m * 100', 2)} AS cv_pct, CASE WHEN {STDS} IS NOT NULL THEN {R('ok * 100.0::DOUBLE / n', 2)} END AS compliance_pct, {R('CASE WHEN cin > 0 THEN (cin - cout) / cin * 100 ELSE 0 END', 2)} AS quartile_removal_pct,
 {R(f'CASE WHEN cin > {BGS} THEN -ln(greatest(0.01, (cout - {BGS}) / (cin - {BGS}))) ELSE 0 END')} AS k_rate, CASE WHEN icpt > 0 THEN {R('greatest(0, -slope * xl / icpt * 100)', 2)} END AS trend_removal_pct, {R('slope', 6)} AS trend_slope FROM a JOIN t USING (parameter)""")
def treatment_stats(spark, sf):
    return S.treatment_performance(named(obs(spark, sf), RIVER))


SAG = (f"{named_sql(RIVER)}, m AS (SELECT station_id, avg(CASE WHEN parameter = 'DO' THEN value / 20 END) AS dm, avg(CASE WHEN parameter = 'BOD5' THEN value END) AS bod, count(CASE WHEN parameter = 'DO' THEN 1 END) AS n1, count(CASE WHEN parameter = 'BOD5' THEN 1 END) AS n2 FROM obs GROUP BY 1), "
       "c AS (SELECT station_id, dm, bod, 9.0::DOUBLE - dm AS d0, CASE WHEN bod > 0 AND (0.5::DOUBLE / 0.3) * (1 - (9.0::DOUBLE - dm) * 0.2::DOUBLE / (0.3 * bod)) > 0 THEN greatest(0, ln((0.5::DOUBLE / 0.3) * (1 - (9.0::DOUBLE - dm) * 0.2::DOUBLE / (0.3 * bod))) / 0.2) ELSE 0 END AS tc FROM m WHERE n1 >= 5 AND n2 >= 5), "
       "e AS (SELECT *, 0.3::DOUBLE * bod / 0.2 * (exp(-0.3 * tc) - exp(-0.5 * tc)) + d0 * exp(-0.5 * tc) AS dc FROM c)")


@query("oxygen_sag", f"WITH {SAG} SELECT station_id, {R('dm')} AS do_mean, {R('bod')} AS bod_mean, {R('tc')} AS critical_time, {R('dc')} AS critical_deficit, {R('9 - dc')} AS critical_do FROM e")
def oxygen_sag(spark, sf):
    o = named(obs(spark, sf), RIVER)
    return S.oxygen_sag(o.withColumn("value", F.when(F.col("parameter") == "DO", F.col("value") / 20).otherwise(F.col("value"))))


@query("oxygen_profile", f"WITH {SAG} SELECT station_id, {R('i * 10.0::DOUBLE / 49')} AS t_days, {R('9 - (0.3::DOUBLE * round(bod, 4) / 0.2 * (exp(-0.3 * i * 10 / 49) - exp(-0.5 * i * 10 / 49)) + (9 - round(dm, 4)) * exp(-0.5 * i * 10 / 49))')} AS do_mg_l FROM e, range(50) t(i)")
def oxygen_profile(spark, sf):
    return S.oxygen_profile(oxygen_sag(spark, sf))


@query("approx_profile", f"WITH {OBS}, o AS (SELECT parameter, year(ts) AS year, round(value, 1) AS value FROM obs WHERE value IS NOT NULL) SELECT parameter, year, count(*) AS n, count(DISTINCT value) AS exact_distinct, true AS distinct_within, true AS p05_within, true AS p50_within, true AS p95_within FROM o GROUP BY 1, 2")
def approx_profile(spark, sf):
    """Merged sketches beside exact counts: estimates lie within four standard errors (distinct) and three times the rank error (quantiles)."""
    from limnos.operators import sketches as K

    o = obs(spark, sf).where("value IS NOT NULL").withColumn("value", F.round("value", 1))
    near = K.approx_profile(o, ("parameter",)).withColumnRenamed("n", "_n")
    rows = o.select("parameter", F.year("ts").cast("long").alias("year"), "value").join(near, ["parameter", "year"])
    share = [e for c in K.QUANTILES for e in (F.avg((F.col("value") < F.col(c)).cast("double")).alias(f"_lo_{c}"), F.avg((F.col("value") <= F.col(c)).cast("double")).alias(f"_hi_{c}"))]
    g = rows.groupBy("parameter", "year").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("exact_distinct"), F.first("n_distinct").alias("_d"), *share)
    slack = 3 * K.RANK_ERROR
    return g.select("parameter", "year", "n", "exact_distinct", (F.abs(F.col("_d") - F.col("exact_distinct")) <= F.greatest(F.lit(1.0), 4 * K.DISTINCT_ERROR * F.col("exact_distinct"))).alias("distinct_within"),
                    *[((F.col(f"_lo_{c}") <= p + slack) & (F.col(f"_hi_{c}") >= p - slack)).alias(f"{c}_within") for c, p in K.QUANTILES.items()])
