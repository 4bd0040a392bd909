"""Queries that land, read, write and stream: every one round-trips data derived from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from limnos.operators import learn as L
from limnos.plans.adapters import FLOW, INDICATOR, OBS, PRECIP, SFLOW, STATION, flow, indicators, obs, precip, stations, supplier_flow, table
from limnos.plans.catalog import N, nudged, query
from limnos.plans.frequency import NAMES, WIDE, wide
from limnos.plans.observations import DRINKING, HITS, RIVER, named
from limnos.plans.trends import monthly
from limnos.session import scratch_path
from limnos.sources import agencies as A
from limnos.sources import archive as H
from limnos.sources import readers as R
from limnos.sources import sinks as K
from limnos.streaming import jobs as S

ID = ["station_id"]


def landed(df: DataFrame, name: str, fmt: str = "csv", **options) -> str:
    """Writes ``df`` as a landed export in the shared scratch folder and returns its path."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.options(header=True, **options)
    if "part" in df.columns:
        writer = writer.partitionBy("part")
    getattr(writer, fmt)(path)
    return path


SERIES = "SELECT station_id, date, value FROM flow"


@query("src_table", f"WITH {FLOW} {SERIES}")
def src_table(spark, sf):
    path = landed(flow(spark, sf), "table", sep="\t")
    d = R.read_table(spark, path)
    return d.select(F.col("station_id").cast("long"), F.col("date").cast("date"), F.col("value").cast("double"))


@query("src_csv_json", f"WITH {FLOW}, {PRECIP} {SERIES} UNION ALL SELECT station_id, date, value FROM precip")
def src_csv_json(spark, sf):
    schema = "station_id LONG, date DATE, value DOUBLE"
    a = R.read_records(spark, landed(flow(spark, sf), "records"), "csv", schema)
    return a.unionByName(R.read_records(spark, landed(precip(spark, sf), "records", "json"), "json", schema))


@query("src_wide_daily", f"WITH {FLOW} SELECT CAST(station_id AS VARCHAR) AS station_id, date, value, 'gauge ' || station_id AS name FROM flow WHERE station_id < 6 AND date >= DATE '1997-01-01'")
def src_wide_daily(spark, sf):
    w = flow(spark, sf).groupBy("date").pivot("station_id", list(range(10))).agg(F.first("value"))
    d = spark.read.option("header", True).csv(landed(w, "wide"))
    att = flow(spark, sf).select(F.col("station_id").cast("string")).distinct().withColumn("name", F.concat(F.lit("gauge "), "station_id"))
    return R.wide_daily(d, att, [str(i) for i in range(6)], "1997-01-01")


@query("src_per_station_txt", f"WITH {FLOW} SELECT CAST(station_id AS VARCHAR) AS station_id, date, value FROM flow")
def src_per_station_txt(spark, sf):
    line = F.concat_ws("  ", F.year("date"), F.month("date"), F.dayofmonth("date"), F.col("value"))
    path = landed(flow(spark, sf).select(F.col("station_id").alias("part"), line.alias("value")), "station-text", "text")
    return R.per_station_text(spark, path, r"/part=([^/]+)/")


@query("src_header_txt", f"WITH {FLOW} SELECT CAST(station_id AS VARCHAR) AS station_id, 'River ' || station_id AS name, station_id + 0.5::DOUBLE AS latitude, station_id * 2.0::DOUBLE AS longitude, date, value FROM flow WHERE value <> 25")
def src_header_txt(spark, sf):
    s = F.col("station_id")
    row = F.concat(F.col("date").cast("string"), F.lit(";--:--; "), F.when(F.col("value") == 25, -999.0).otherwise(F.col("value")).cast("string"))
    g = flow(spark, sf).groupBy("station_id").agg(F.array_join(F.collect_list(row), "\n").alias("rows"))
    head = F.concat(F.lit("# GRDC-No.:  "), s, F.lit("\n# Station: River "), s, F.lit("\n# Latitude: "), s + 0.5, F.lit("\n# Longitude: "), s * 2.0, F.lit("\nYYYY-MM-DD;hh:mm; Value\n"))
    return R.header_text(spark, landed(g.select(s.alias("part"), F.concat(head, F.col("rows")).alias("value")), "header-text", "text"))


@query("src_param_files", f"WITH {OBS}, {STATION} SELECT CAST(o.station_id AS VARCHAR) AS station_id, CAST(ts AS DATE) AS date, parameter, value, country FROM obs o JOIN station s ON s.station_id = o.station_id WHERE country LIKE '%1%' AND CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def src_param_files(spark, sf):
    o = obs(spark, sf).select(F.col("station_id").cast("string"), F.col("ts").cast("string").alias("date"), F.col("value").cast("string"), "parameter")
    path = scratch_path(spark, "parameters")
    o.write.partitionBy("parameter").option("header", True).csv(path)
    st = stations(spark, sf).select(F.col("station_id").cast("string"), "country")
    return R.parameter_files(spark, path, st, "1", "2024-01-05", "2024-01-20").select("station_id", "date", "parameter", "value", "country")


@query("src_wqp", f"WITH {OBS} SELECT CAST(station_id AS VARCHAR) AS station_id, CASE WHEN seq % 3 = 0 THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END AS ts, parameter, value, 'mg/L' AS unit FROM obs WHERE seq % 11 <> 0")
def src_wqp(spark, sf):
    o = obs(spark, sf)
    raw = o.select(F.col("station_id").cast("string").alias("MonitoringLocationIdentifier"), F.date_format("ts", "yyyy-MM-dd").alias("ActivityStartDate"),
                   F.when(F.col("seq") % 3 != 0, F.date_format("ts", "HH:mm:ss")).otherwise("noon").alias("ActivityStartTime/Time"), F.col("parameter").alias("CharacteristicName"),
                   F.when(F.col("seq") % 11 == 0, "-").otherwise(F.col("value").cast("string")).alias("ResultMeasureValue"), F.lit("mg/L").alias("ResultMeasure/MeasureUnitCode"))
    return R.result_rows(spark.read.option("header", True).csv(landed(raw, "results")))


@query("src_json_arrays", f"WITH {WIDE}, u AS (" + " UNION ALL ".join(f"SELECT station_id, '{n}' AS parameter, date, round({n}, 6) AS value FROM wd" for n in NAMES) + ") SELECT station_id / 2.0::DOUBLE AS latitude, 120.0::DOUBLE AS longitude, parameter, 'mg/L' AS unit, CAST(date AS TIMESTAMP) AS ts, value FROM u WHERE value IS NOT NULL")
def src_json_arrays(spark, sf):
    w = wide(spark, sf)
    rows = w.groupBy("station_id").agg(F.array_sort(F.collect_list(F.struct(F.col("date").cast("string").alias("time"), *[F.round(n, 6).alias(n) for n in NAMES]))).alias("r"))
    daily = F.struct(F.col("r.time").alias("time"), *[F.col(f"r.{n}").alias(n) for n in NAMES])
    units = F.struct(*[F.lit("mg/L").alias(n) for n in NAMES])
    doc = rows.select(F.to_json(F.struct((F.col("station_id") / 2.0).alias("latitude"), F.lit(120.0).alias("longitude"), daily.alias("daily"), units.alias("daily_units"))).alias("value"))
    return R.parallel_arrays(spark.read.text(landed(doc, "arrays", "text")))


@query("src_indicator", f"WITH {INDICATOR} SELECT country, 'C' || country AS country_code, CAST(year AS INT) AS year, variable, value, unit FROM indicator")
def src_indicator(spark, sf):
    i = indicators(spark, sf)
    raw = i.select(F.col("country").alias("Area"), F.concat(F.lit("C"), "country").alias("Area Code"), F.col("year").alias("Year"), F.col("variable").alias("Element"), F.col("value").alias("Value"), F.col("unit").alias("Unit"))
    return R.indicator_rows(spark.read.option("header", True).csv(landed(raw, "indicator")))


@query("src_cube", f"WITH {FLOW} SELECT 'C' || station_id AS cube_code, date, printf('%.6f,23.500000,122.000000,24.000000', CAST(100 + station_id AS DOUBLE)) AS bbox, value, 'mm' AS unit FROM flow")
def src_cube(spark, sf):
    raw = flow(spark, sf).select(F.concat(F.lit("C"), "station_id").alias("cube_code"), "date", F.concat(F.lit("["), 100 + F.col("station_id"), F.lit(", 23.5, 122, 24.0]")).alias("bbox"), "value", F.lit("mm").alias("unit"))
    return R.cube_rows(spark.read.option("header", True).csv(landed(raw, "cube", quoteAll=True)))


@query("src_agency_maps", f"WITH {OBS}, o AS (SELECT *, date_trunc('second', ts) AS t FROM obs) SELECT 'usgs' AS source, CAST(station_id AS VARCHAR) AS station_id, parameter, t AS ts, value, 'mg/L' AS unit, station_id / 2.0::DOUBLE AS latitude FROM o UNION ALL SELECT 'france_hubeau', CAST(station_id AS VARCHAR), 'discharge', t, round(value / 1000, 9), 'm3/s', NULL FROM o "
       "UNION ALL SELECT 'india_wris', CAST(station_id AS VARCHAR), 'water_level', t, value, 'm', NULL FROM o UNION ALL SELECT 'taiwan_moenv', CAST(station_id AS VARCHAR), parameter, t, value, 'mg/L', station_id / 2.0::DOUBLE FROM o WHERE seq % 7 <> 0")
def src_agency_maps(spark, sf):
    o = obs(spark, sf)
    sid, t, v, lat = F.col("station_id").cast("string"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.col("value"), F.col("station_id") / 2.0
    raw = {
        "usgs": o.select(F.struct(sid.alias("monitoring_location_id"), t.alias("time"), v.cast("string").alias("value"), F.col("parameter").alias("parameter_code"), F.lit("mg/L").alias("unit_of_measure")).alias("properties"),
                         F.struct(F.array(F.lit(120.0), lat).alias("coordinates")).alias("geometry")),
        "france_hubeau": o.select(sid.alias("code_station"), F.concat(t, F.lit("Z")).alias("date_obs"), F.lit("Q").alias("grandeur_hydro"), v.alias("resultat_obs")),
        "india_wris": o.select(sid.alias("stationCode"), t.alias("dataTime"), v.cast("string").alias("dataValue"), F.lit("m").alias("unit"), F.lit("x").alias("stationName")),
        "taiwan_moenv": o.select(sid.alias("sitename"), F.date_format("ts", "yyyy-MM-dd").alias("sampledate"), F.date_format("ts", "HH:mm:ss").alias("sampletime"), F.when(F.col("seq") % 7 == 0, "ND").otherwise(v.cast("string")).alias("itemvalue"),
                                 F.col("parameter").alias("itemengabbreviation"), F.lit("x").alias("itemname"), F.lit("mg/L").alias("itemunit"), lat.cast("string").alias("twd97lat"), F.lit("120").alias("twd97lon"), F.lit("b").alias("basin"), F.lit("r").alias("river"), F.lit("c").alias("county")),
    }
    out = None
    for name, d in raw.items():
        part = A.normalise(spark.read.schema(d.schema).json(landed(d, name, "json")), name)
        out = part if out is None else out.unionByName(part)
    return out.select("source", "station_id", "parameter", "ts", F.round("value", 9).alias("value"), "unit", "latitude")


def daily_obs(spark, sf):
    """Daily parameter means with unit and location."""
    d = obs(spark, sf).groupBy("station_id", "parameter", F.to_date("ts").alias("date")).agg(F.round(F.avg("value"), 6).alias("value"))
    return d.withColumn("unit", F.lit("mg/L")).withColumn("latitude", F.col("station_id") / 2.0).withColumn("longitude", F.lit(120.0))


DO = f"{OBS}, dob AS (SELECT station_id, parameter, CAST(ts AS DATE) AS date, round(avg(value), 6) AS value FROM obs GROUP BY 1, 2, 3)"


@query("src_xml_series", f"WITH {DO} SELECT station_id, parameter, 'mg/L' AS unit, CAST(date AS TIMESTAMP) AS ts, value FROM dob")
def src_xml_series(spark, sf):
    path = scratch_path(spark, "waterml")
    K.write_waterml(daily_obs(spark, sf), path)
    schema = "station_id LONG, parameter STRING, unit STRING, latitude DOUBLE, longitude DOUBLE, point ARRAY<STRUCT<time: STRING, value: DOUBLE>>"
    return R.waterml_series(spark, path, schema).drop("latitude", "longitude")


@query("sink_waterml_group", f"WITH {DO} SELECT station_id, parameter, 'mg/L' AS unit, station_id / 2.0::DOUBLE AS latitude, count(*) AS n_points FROM dob GROUP BY 1, 2")
def sink_waterml_group(spark, sf):
    g = K.series_groups(daily_obs(spark, sf))
    return g.select("station_id", "parameter", "unit", "latitude", F.size("point").cast("long").alias("n_points"))


def bundle(spark, sf) -> str:
    d = flow(spark, sf).withColumn("variable", F.lit("discharge")).unionByName(precip(spark, sf).withColumn("variable", F.lit("precipitation")))
    path = scratch_path(spark, "bundle")
    K.write_bundle(d.withColumn("source", F.lit("tables")), path)
    return path


@query("src_bundle", f"WITH {FLOW} SELECT station_id, date, value FROM flow WHERE station_id IN (1, 4, 7)")
def src_bundle(spark, sf):
    return R.read_bundle(spark, bundle(spark, sf), "discharge", [1, 4, 7]).select("station_id", "date", "value")


@query("src_bundle_one", f"WITH {PRECIP} SELECT date, value FROM precip WHERE station_id = 4 ORDER BY date")
def src_bundle_one(spark, sf):
    return R.read_bundle(spark, bundle(spark, sf), "precipitation", [4]).select("date", "value").orderBy("date")


@query("sink_bundle", f"WITH {FLOW}, {PRECIP}, u AS (SELECT 'discharge' AS variable, * FROM flow UNION ALL SELECT 'precipitation', * FROM precip) SELECT variable, 'tables' AS source, count(DISTINCT station_id) AS n_stations, count(*) AS n_rows, min(date) AS first, max(date) AS last FROM u GROUP BY 1")
def sink_bundle(spark, sf):
    return K.bundle_info(spark.read.parquet(bundle(spark, sf)))


@query("sink_records", f"WITH {STATION} SELECT source, count(*) AS n FROM station WHERE station_id % 9 <> 0 GROUP BY 1")
def sink_records(spark, sf):
    s = stations(spark, sf).withColumn("latitude", F.when(F.col("station_id") % 9 != 0, F.col("latitude")))
    path = scratch_path(spark, "geojson")
    K.write_records(s, path, "geojson")
    back = spark.read.schema("type STRING, geometry STRUCT<type: STRING, coordinates: ARRAY<DOUBLE>>, properties STRUCT<source: STRING, station_id: LONG>").json(path)
    return back.where("size(geometry.coordinates) = 2").groupBy("properties.source").agg(F.count(F.lit(1)).alias("n"))


HEC = ("h AS (SELECT station_id, parameter, count(*) AS n, min(date) AS start, quantile_cont(st, 0.5) AS step FROM (SELECT *, date_diff('second', lag(date) OVER (PARTITION BY station_id, parameter ORDER BY date), date) AS st "
       "FROM {src}) GROUP BY 1, 2), p AS (SELECT station_id, parameter, n, CASE WHEN step <= 60 THEN '1MIN' WHEN step <= 300 THEN '5MIN' WHEN step <= 900 THEN '15MIN' WHEN step <= 3600 THEN '1HOUR' WHEN step <= 86400 THEN '1DAY' ELSE 'IR-YEAR' END AS time_step, start FROM h) "
       "SELECT '/UNKNOWN/' || station_id || '/' || parameter || '/' || upper(strftime(start, '%d%b%Y')) || '/' || time_step || '/OBS/' AS pathname, 'mg/L' AS unit, 'INST-VAL' AS type, n FROM p")


def _hec(spark, rows, time):
    path = scratch_path(spark, "hec")
    K.write_hec_csv(rows, path, time)
    return spark.read.option("header", True).csv(path).groupBy("pathname", "unit", "type").agg(F.count(F.lit(1)).alias("n"))


@query("sink_hec", f"WITH {DO}, {HEC.format(src='dob')}")
def sink_hec(spark, sf):
    return _hec(spark, daily_obs(spark, sf), "date")


@query("sink_hec_subdaily", f"WITH {OBS}, o AS (SELECT station_id, parameter, ts AS date FROM obs), {HEC.format(src='o')}")
def sink_hec_subdaily(spark, sf):
    return _hec(spark, obs(spark, sf).select("station_id", "parameter", "ts", "value", F.lit("mg/L").alias("unit")), "ts")


@query("sink_swmm", f"WITH {FLOW} SELECT printf('%-16s ', CAST(station_id AS VARCHAR)) || strftime(date, '%m/%d/%Y 00:00') || printf(' %12.4f', value) AS line FROM flow")
def sink_swmm(spark, sf):
    path = scratch_path(spark, "swmm")
    K.write_swmm(flow(spark, sf).select(*ID, F.col("date").cast("timestamp").alias("ts"), "value"), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


def export_rows(spark, sf):
    st = flow(spark, sf).select("station_id").distinct().withColumn("area_km2", 100.0 + F.col("station_id"))
    return K.large_sample_rows(flow(spark, sf), st, precip(spark, sf).withColumnRenamed("value", "total_precipitation_sum")), st


@query("sink_caravan", f"WITH {FLOW}, {PRECIP} SELECT 'obs_' || f.station_id AS gauge_id, f.date, {N('f.value * 86.4 / (100.0 + f.station_id)')} AS streamflow, p.value AS total_precipitation_sum FROM flow f LEFT JOIN precip p USING (station_id, date)")
def sink_caravan(spark, sf):
    rows, st = export_rows(spark, sf)
    path = scratch_path(spark, "export")
    K.write_large_sample(rows, st, path)
    return nudged(spark.read.parquet(f"{path}/timeseries"), 6, "streamflow")


@query("validate_export", f"WITH {FLOW}, g AS (SELECT 'obs_' || station_id AS gauge_id, date, date - lag(date) OVER (PARTITION BY station_id ORDER BY date) AS st FROM flow) SELECT DISTINCT gauge_id, 'uneven step' AS problem FROM g WHERE st <> 1 UNION ALL SELECT DISTINCT 'obs_' || (station_id + 100), 'no series' FROM flow")
def validate_export(spark, sf):
    rows, st = export_rows(spark, sf)
    ids = st.select(F.concat(F.lit("obs_"), "station_id").alias("gauge_id")).unionByName(st.select(F.concat(F.lit("obs_"), F.col("station_id") + 100).alias("gauge_id")))
    return K.check_large_sample(rows, ids)


# ── archive bookkeeping ─────────────────────────────────────────────────────────
MAN = "man AS (SELECT lower(r_name) AS source, s_suppkey AS station_id, DATE '2024-01-01' + CAST(s_suppkey % 60 AS INT) AS harvested FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_suppkey % 3 <> 0)"


def manifest(spark, sf):
    return stations(spark, sf).where("station_id % 3 <> 0").select("source", "station_id", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("station_id") % 60).cast("int")).alias("harvested_at"))


@query("harvest_pick", f"WITH {STATION}, {MAN} SELECT s.source, s.station_id, m.harvested IS NULL AS fresh FROM station s LEFT JOIN man m USING (source, station_id) WHERE list_contains(variables, 'level') AND (m.harvested IS NULL OR m.harvested < DATE '2024-02-01') ORDER BY fresh DESC, source, station_id LIMIT 20")
def harvest_pick(spark, sf):
    c = stations(spark, sf).withColumn("period_end", F.lit(None).cast("date"))
    return H.pick_stations(c, manifest(spark, sf), "level", "2024-03-02", 20).select("source", "station_id", "fresh")


@query("harvest_health", f"WITH {STATION}, {MAN} SELECT source, (SELECT count(*) FROM station s WHERE s.source = a.source) AS n_stations, (SELECT count(*) FROM man m WHERE m.source = a.source AND m.harvested < DATE '2024-01-11') AS n_failed, (SELECT count(*) FROM man m WHERE m.source = a.source AND m.harvested < DATE '2024-01-11') = 0 AS ok FROM (SELECT DISTINCT source FROM station) a")
def harvest_health(spark, sf):
    return H.health(stations(spark, sf), manifest(spark, sf).where("harvested_at < DATE '2024-01-11'"))


@query("manifest_merge", "WITH m AS (SELECT l_returnflag AS source, l_linestatus AS variable, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT source, variable, CASE WHEN source = 'A' THEN 'current' ELSE 'previous' END AS run, n FROM m")
def manifest_merge(spark, sf):
    m = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("variable")).agg(F.count(F.lit(1)).alias("n")).withColumn("run_at", F.lit("2024-05-01T00:00:00").cast("timestamp"))
    return H.merge_manifest(m.withColumn("run", F.lit("previous")), m.where("source = 'A'").withColumn("run", F.lit("current"))).select("source", "variable", "run", "n")


@query("ingest_map", f"WITH {FLOW} SELECT CAST(station_id AS VARCHAR) AS station_id, CAST(date AS TIMESTAMP) AS ts, CASE WHEN value <> 30 THEN {N('value * 0.028316846592', 8)} END AS value FROM flow")
def ingest_map(spark, sf):
    text = F.when(F.col("value") == 30, "-9999").otherwise(F.regexp_replace(F.format_string(" %.1f ", "value"), r"\.", ","))
    raw = flow(spark, sf).select("station_id", F.date_format("date", "MM/dd/yyyy").alias("datetime"), text.alias("flow_cfs"))
    d = R.apply_mapping(R.read_table(spark, landed(raw, "messy", sep="\t")), "datetime", "flow_cfs", 0.028316846592, ",", ("MM/dd/yyyy",), "station_id")
    return nudged(d.drop("was_sentinel"), 8, "value")


def messy_table(spark, sf):
    """A landed export of one station per supplier with a flag column, as text."""
    raw = supplier_flow(spark, sf).select(F.col("station_id").alias("site_no"), F.date_format("date", "MM/dd/yyyy").alias("datetime"), F.col("value").alias("flow_cfs"), F.lit("A").alias("qual_cd"))
    return R.read_table(spark, landed(raw, "guess", sep="\t"))


GUESS = f"WITH {SFLOW}, n AS (SELECT count(*) AS n_rows FROM sflow) "


@query("ingest_guess", GUESS + "SELECT c AS column_name, CASE WHEN c = 'datetime' THEN 1.0::DOUBLE ELSE 0 END AS date_share, CASE WHEN c IN ('site_no', 'flow_cfs') THEN 1.0::DOUBLE ELSE 0 END AS numeric_share, h AS hint, p AS place, n_rows, CASE WHEN c IN ('site_no', 'flow_cfs') THEN 1 + h END AS score "
       "FROM n, (VALUES ('site_no', 0.0::DOUBLE, 0), ('datetime', 0.0::DOUBLE, 1), ('flow_cfs', 0.2::DOUBLE, 2), ('qual_cd', -0.8::DOUBLE, 3)) v(c, h, p)")
def ingest_guess(spark, sf):
    return R.guess_mapping(messy_table(spark, sf)).drop("n_distinct")


@query("ingest_decision", GUESS + "SELECT 'datetime' AS date_column, 'flow_cfs' AS value_column, 'discharge' AS variable, 'm3/s' AS unit, 0.028316846592::DOUBLE AS to_si_factor, CASE WHEN (SELECT count(DISTINCT station_id) FROM sflow) <= greatest(1, n_rows // 20) THEN 'site_no' END AS station_column, 1.0::DOUBLE AS date_share, round(0.4::DOUBLE + 1.2::DOUBLE / 3, 8) AS confidence FROM n")
def ingest_decision(spark, sf):
    return R.decide_mapping(messy_table(spark, sf)).withColumn("confidence", F.round("confidence", 8))


# ── features and learning ───────────────────────────────────────────────────────
LAGS = ", ".join(f"lag(value, {n}) OVER w AS lag_{n}" for n in (1, 2, 3, 7))
ROLL = ", ".join(f"CASE WHEN count(value) OVER r{w} = {w} THEN avg(value) OVER r{w} END AS rolling_mean_{w}, CASE WHEN count(value) OVER r{w} = {w} THEN stddev_samp(value) OVER r{w} END AS rolling_std_{w}" for w in (7, 30))


@query("lag_features", f"WITH {FLOW}, f AS (SELECT station_id, date, value AS y, {LAGS}, {ROLL}, dayofyear(date) AS dayofyear, month(date) AS month, month(date) % 12 // 3 AS season FROM flow WINDOW w AS (PARTITION BY station_id ORDER BY date), r7 AS (PARTITION BY station_id ORDER BY date ROWS 6 PRECEDING), r30 AS (PARTITION BY station_id ORDER BY date ROWS 29 PRECEDING)) "
       f"SELECT station_id, date, y, lag_1, lag_2, lag_3, lag_7, {', '.join(f'{N(c)} AS {c}' for c in ('rolling_mean_7', 'rolling_std_7', 'rolling_mean_30', 'rolling_std_30'))}, dayofyear, month, season FROM f WHERE lag_7 IS NOT NULL AND rolling_mean_30 IS NOT NULL")
def lag_features(spark, sf):
    return nudged(L.lag_features(flow(spark, sf)), 6, "rolling_mean_7", "rolling_std_7", "rolling_mean_30", "rolling_std_30")


@query("lag_features_seasonal", f"WITH {FLOW}, f AS (SELECT station_id, date, value AS y, {', '.join(f'lag(value, {n}) OVER w AS lag_{n}' for n in (1, 2, 3, 7, 14, 30))}, sin(2 * pi() * dayofyear(date) / 365.25) AS doy_sin, cos(2 * pi() * dayofyear(date) / 365.25) AS doy_cos, avg(value) OVER r7 AS rolling_mean_7, avg(value) OVER r30 AS rolling_mean_30 FROM flow "
       f"WINDOW w AS (PARTITION BY station_id ORDER BY date), r7 AS (PARTITION BY station_id ORDER BY date ROWS 6 PRECEDING), r30 AS (PARTITION BY station_id ORDER BY date ROWS 29 PRECEDING)) SELECT station_id, date, y, lag_1, lag_2, lag_3, lag_7, lag_14, lag_30, {', '.join(f'{N(c)} AS {c}' for c in ('doy_sin', 'doy_cos', 'rolling_mean_7', 'rolling_mean_30'))} FROM f WHERE lag_30 IS NOT NULL")
def lag_features_seasonal(spark, sf):
    return nudged(L.seasonal_features(flow(spark, sf)), 6, "doy_sin", "doy_cos", "rolling_mean_7", "rolling_mean_30")


ANOM = ("lag_1", "lag_2", "rolling_mean_7")


@query("anomaly_scores", f"WITH {FLOW}, f AS (SELECT station_id, date, value AS y, lag(value, 1) OVER w AS lag_1, lag(value, 2) OVER w AS lag_2, lag(value, 7) OVER w AS lag_7, avg(value) OVER r7 AS rolling_mean_7, count(value) OVER r30 AS c30 FROM flow WINDOW w AS (PARTITION BY station_id ORDER BY date), r7 AS (PARTITION BY station_id ORDER BY date ROWS 6 PRECEDING), r30 AS (PARTITION BY station_id ORDER BY date ROWS 29 PRECEDING)), "
       "g AS (SELECT * FROM f WHERE lag_7 IS NOT NULL AND c30 = 30), m AS (SELECT station_id, " + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in ANOM) + " FROM g GROUP BY 1), d AS (SELECT g.station_id, date, y, " + ", ".join(f"abs({c} - m_{c}) AS {c}" for c in ANOM) + " FROM g JOIN m USING (station_id)), "
       "s AS (SELECT station_id, " + ", ".join(f"quantile_cont({c}, 0.5) AS s_{c}" for c in ANOM) + " FROM d GROUP BY 1), z AS (SELECT station_id, date, y, greatest(" + ", ".join(f"CASE WHEN s_{c} > 0 THEN {c} / (1.4826::DOUBLE * s_{c}) ELSE 0 END" for c in ANOM) + ") AS z FROM d JOIN s USING (station_id)) "
       f"SELECT station_id, date, y, {N('z')} AS anomaly_score, z > quantile_cont(z, 0.95) OVER (PARTITION BY station_id) AS is_anomaly FROM z")
def anomaly_scores(spark, sf):
    return nudged(L.anomaly_scores(L.lag_features(flow(spark, sf)), ANOM), 6, "anomaly_score")


FOREST = ("lag_1", "lag_2", "lag_3", "lag_7", "rolling_mean_7", "rolling_std_7", "rolling_mean_30", "rolling_std_30", "dayofyear", "month", "season")


@query("isolation_scores")
def isolation_scores(spark, sf):
    from limnos.operators.isolation import isolation_scores as score
    return score(L.lag_features(supplier_flow(spark, sf)), FOREST)


def complete(spark, sf):
    return wide(spark, sf).dropna()


def day_means(spark, sf):
    """Daily means of the five parameters over all stations."""
    o = obs(spark, sf).withColumn("hour", F.date_trunc("hour", "ts"))
    return o.groupBy("hour").pivot("parameter", list(NAMES)).agg(F.avg("value")).dropna()


@query("pca_kmeans")
def pca_kmeans(spark, sf):
    return L.pca_clusters(day_means(spark, sf), NAMES)


@query("rf_classify")
def rf_classify(spark, sf):
    return L.forest_classify(day_means(spark, sf), NAMES)


@query("gbt_regress")
def gbt_regress(spark, sf):
    train, test = L.holdout(day_means(spark, sf))
    return L.skill(L.regress(train, test, NAMES[1:], NAMES[0], "gbt"), NAMES[0])


@query("lag_forecast")
def lag_forecast(spark, sf):
    return L.skill(L.lag_forecast(monthly(spark, sf)), "y", ID)


@query("transfer_pool")
def transfer_pool(spark, sf):
    f = L.seasonal_features(flow(spark, sf))
    ids = f.select("station_id").distinct()
    donors = ids.select(F.col("station_id").alias("target"), F.explode(F.array(*[F.pmod(F.col("station_id") + i, F.lit(10)) for i in (1, 2, 3)])).alias("donor"))
    return L.transfer(f, donors)


@query("stacking")
def stacking(spark, sf):
    return L.stacking(L.lag_features(flow(spark, sf)), ["lag_1", "lag_2", "lag_7", "rolling_mean_7"], "y")


@query("monte_carlo_exceed")
def monte_carlo_exceed(spark, sf):
    return L.monte_carlo(named(obs(spark, sf), RIVER))


# ── streaming ───────────────────────────────────────────────────────────────────


def stream_source(spark: SparkSession, sf: str) -> DataFrame:
    """The event table as a file stream of observations."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(f"{sf}/events*.parquet")
    return e.select(F.col("user_id").alias("station_id"), F.col("event_type").alias("parameter"), F.col("ts").cast("timestamp").alias("ts"), "value", F.col("event_id").alias("seq"))


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over everything available into a fault-tolerant file sink and reads the result."""
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, f"{name}-ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def arriving(rows: DataFrame, name: str, parts: int = 3, rows_per_file: int = 200_000) -> DataFrame:
    """``rows`` as a file stream that arrives in ``parts`` stretches of time, one a batch, and ends with a closing row.

    Every batch has the same number of files, so that a task of the stream reads some ``rows_per_file`` rows whatever the table's size.
    """
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, f"{name}-in")
    lo, hi, n = rows.agg(F.min("ts"), F.max("ts"), F.count("ts")).first()
    files = max(1, -(-n // (parts * rows_per_file)))
    if lo is not None:
        part = F.least(F.lit(parts - 1), F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(lo))) / (F.unix_micros(F.lit(hi)) - F.unix_micros(F.lit(lo)) + 1) * parts))
        for i in range(parts):
            own = rows.where(part == i)
            (own.coalesce(1) if files == 1 else own.repartition(files)).write.mode("append").parquet(path)
            for _ in range((i + 1) * files - len(spark.read.schema(rows.schema).parquet(path).inputFiles())):
                rows.limit(0).coalesce(1).write.mode("append").parquet(path)  # a stretch of few rows fills up its batch
    S.closing_row(rows).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(path)


def observed(spark, sf):
    return obs(spark, sf).select("station_id", "parameter", "ts", "value", "seq")


@query("stream_alerts", f"WITH {HITS} SELECT seq, standard, severity FROM hs")
def stream_alerts(spark, sf):
    return drained(S.alerts(named(stream_source(spark, sf), DRINKING)).select("seq", "standard", "severity"), "alerts")


@query("stream_daily_mean", f"WITH {OBS} SELECT station_id, parameter, CAST(ts AS DATE) AS date, {N('avg(value)', 8)} AS value, count(value) AS n FROM obs GROUP BY 1, 2, 3")
def stream_daily_mean(spark, sf):
    return nudged(drained(S.daily_mean(arriving(observed(spark, sf), "daily")), "daily"), 8, "value")


@query("stream_sliding_stats", f"WITH {OBS}, w AS (SELECT station_id, parameter, CAST(CAST(ts AS DATE) - CAST(k AS INT) AS TIMESTAMP) AS start, value FROM obs, range(7) t(k)) SELECT station_id, parameter, start, start + INTERVAL 7 DAY AS \"end\", {N('avg(value)', 8)} AS mean, {N('stddev_samp(value)')} AS std, count(value) AS n FROM w GROUP BY 1, 2, 3")
def stream_sliding_stats(spark, sf):
    return nudged(nudged(drained(S.sliding_stats(arriving(observed(spark, sf), "sliding")), "sliding"), 8, "mean"), 6, "std")


@query("stream_dedupe_last", f"WITH {OBS}, twice AS (SELECT station_id, parameter, ts, value + c AS value, 2 * seq + c AS seq FROM obs, (SELECT 0 AS c UNION ALL SELECT 1) cc) SELECT station_id, ts, parameter, {N('arg_max(value, seq)', 4)} AS value, max(seq) AS seq FROM twice GROUP BY 1, 2, 3")
def stream_dedupe_last(spark, sf):
    rows = observed(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(0))))
    twice = rows.select("station_id", "parameter", "ts", (F.col("value") + F.col("copy")).alias("value"), (2 * F.col("seq") + F.col("copy")).alias("seq"))
    return nudged(drained(S.dedupe_last(arriving(twice, "last")), "last"), 4, "value")


@query("stream_dedupe", f"WITH {OBS} SELECT DISTINCT station_id, ts, parameter FROM obs")
def stream_dedupe(spark, sf):
    src = stream_source(spark, sf)
    twice = src.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    return drained(S.dedupe(twice), "dedupe").select("station_id", "ts", "parameter")


SUMS = (f"WITH RECURSIVE {OBS}, r AS (SELECT station_id, ts, value, row_number() OVER (PARTITION BY station_id ORDER BY ts, value) AS rn FROM obs WHERE value IS NOT NULL), "
        "c AS (SELECT station_id, ts, rn, greatest(0, value - 50) AS up, greatest(0, 50 - value) AS dn FROM r WHERE rn = 1 UNION ALL "
        "SELECT r.station_id, r.ts, r.rn, greatest(0, CASE WHEN up > 400 THEN 0 ELSE up END + value - 50), greatest(0, CASE WHEN up <= 400 AND dn > 400 THEN 0 ELSE dn END + 50 - value) FROM c JOIN r ON r.station_id = c.station_id AND r.rn = c.rn + 1) ")


@query("stream_cusum", SUMS + f"SELECT station_id, ts, CASE WHEN up > 400 THEN 'up' ELSE 'down' END AS side, {N('greatest(up, dn)', 6)} AS statistic FROM c WHERE up > 400 OR dn > 400")
def stream_cusum(spark, sf):
    return nudged(drained(S.cusum(arriving(observed(spark, sf), "cusum"), 50.0, 400.0), "cusum"), 6, "statistic")


@query("stream_spells_running", f"WITH {FLOW}, h AS (SELECT station_id, date, value FROM flow WHERE value > 200), g AS (SELECT *, CASE WHEN date - lag(date) OVER (PARTITION BY station_id ORDER BY date) <= 2 THEN 0 ELSE 1 END AS b FROM h), s AS (SELECT *, sum(b) OVER (PARTITION BY station_id ORDER BY date) AS sid FROM g) "
       "SELECT station_id, min(date) AS start, max(date) AS last, count(*) AS n, max(value) AS peak FROM s GROUP BY station_id, sid")
def stream_spells_running(spark, sf):
    rows = flow(spark, sf).select("station_id", F.col("date").cast("timestamp").alias("ts"), "value")
    closed = arriving(rows, "spells").withColumn("value", F.when(F.col("station_id").isNull(), 1e9).otherwise(F.col("value")))
    d = drained(S.spell_sessions(closed, 200.0, "2 days 1 second"), "spells")
    return d.select("station_id", F.to_date("start").alias("start"), F.to_date("last").alias("last"), "n", "peak")
