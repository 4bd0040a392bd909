"""Queries for joins, set operations, top-k and catalog search."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.operators import catalog as K
from limnos.operators import indicators as I
from limnos.operators import periods as P
from limnos.operators import relate as J
from limnos.plans.adapters import (FLOW, INDICATOR, OBS, PAIRED, PRECIP, SFLOW, STATION, flow, indicators, obs, paired,
                                   precip, stations, supplier_flow, table)
from limnos.plans.catalog import N, nudged, query


@query("join_equi", f"WITH {SFLOW}, {STATION} SELECT country, source, count(*) AS n, sum(value) AS total FROM sflow LEFT JOIN station USING (station_id) GROUP BY 1, 2")
def join_equi(spark, sf):
    j = J.with_stations(supplier_flow(spark, sf), stations(spark, sf).select("station_id", "country", "source"))
    return j.groupBy("country", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("join_outer_coalesce", "SELECT k AS station_id, coalesce(a.area, b.area) AS area, elev, price FROM (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS area, s_nationkey AS elev FROM supplier WHERE s_suppkey % 5 <> 0) a "
       "FULL JOIN (SELECT p_partkey AS k, p_retailprice AS area, p_size AS price FROM part WHERE p_partkey % 7 <> 0) b USING (k)")
def join_outer_coalesce(spark, sf):
    a = table(spark, sf, "supplier").where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("station_id"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_acctbal")).alias("area"), F.col("s_nationkey").alias("elev"))
    b = table(spark, sf, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("station_id"), F.col("p_retailprice").alias("area"), F.col("p_size").alias("price"))
    return J.merge_attributes(a, b, "station_id", "area")


IND2 = f"{INDICATOR}, w AS (SELECT country, year, avg(CASE WHEN variable = '1-URGENT' THEN value END) AS num, avg(CASE WHEN variable = '5-LOW' THEN value END) AS den FROM indicator GROUP BY 1, 2)"


@query("join_multi_cube", f"WITH {INDICATOR}, a AS (SELECT country, year, avg(value) AS urgent FROM indicator WHERE variable = '1-URGENT' GROUP BY 1, 2), b AS (SELECT country, year, avg(value) AS low FROM indicator WHERE variable = '5-LOW' GROUP BY 1, 2), "
       f"c AS (SELECT country, year, avg(value) AS high FROM indicator WHERE variable = '2-HIGH' GROUP BY 1, 2) SELECT country, year, {N('urgent', 4)} AS urgent, {N('low', 4)} AS low, {N('high', 4)} AS high FROM a JOIN b USING (country, year) JOIN c USING (country, year)")
def join_multi_cube(spark, sf):
    i = indicators(spark, sf)
    cubes = {n: i.where(F.col("variable") == v).drop("variable", "unit") for n, v in (("urgent", "1-URGENT"), ("low", "5-LOW"), ("high", "2-HIGH"))}
    return nudged(I.join_cubes(cubes, periods=("year", "date"), extra=("country", "bbox")), 4, "urgent", "low", "high")


@query("wapor_productivity", f"WITH {IND2} SELECT country, count(*) AS n_periods, {N('avg(num / den)')} AS mean_ratio, {N('sum(num) / sum(den)')} AS aggregate_ratio FROM w WHERE num IS NOT NULL AND den > 0 GROUP BY 1")
def wapor_productivity(spark, sf):
    i = indicators(spark, sf)
    cubes = {n: i.where(F.col("variable") == v).drop("variable", "unit") for n, v in (("num", "1-URGENT"), ("den", "5-LOW"))}
    return nudged(I.cube_productivity(I.join_cubes(cubes, periods=("year",), extra=("country",)), "num", "den", ["country"]), 6, "mean_ratio", "aggregate_ratio")


@query("aquastat_benchmark", f"WITH {IND2}, m AS (SELECT country, year, num / den * 100 AS metric FROM w WHERE num IS NOT NULL AND den > 0), r AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY year DESC) AS k FROM m) SELECT country, year, {N('metric')} AS metric FROM r WHERE k = 1 ORDER BY metric DESC, year DESC, country LIMIT 10")
def aquastat_benchmark(spark, sf):
    return nudged(I.ratio_benchmark(indicators(spark, sf), "1-URGENT", "5-LOW", top=10).select("country", "year", "metric"), 6, "metric")


@query("topk_group", f"WITH {INDICATOR}, r AS (SELECT *, row_number() OVER (PARTITION BY country, variable ORDER BY year DESC) AS k FROM indicator) SELECT country, variable, year, value FROM r WHERE k = 1")
def topk_group(spark, sf):
    latest = indicators(spark, sf).groupBy("country", "variable").agg(F.max_by(F.struct("year", "value"), "year").alias("r"))
    return latest.select("country", "variable", "r.*")


@query("sort_multi", f"WITH {INDICATOR} SELECT country, year, variable, value FROM indicator ORDER BY value DESC, year DESC, country, variable LIMIT 25")
def sort_multi(spark, sf):
    return indicators(spark, sf).drop("unit").orderBy(F.desc("value"), F.desc("year"), "country", "variable").limit(25)


@query("topk_global", f"WITH {SFLOW} SELECT station_id, date, value FROM sflow ORDER BY value, station_id, date LIMIT 50")
def topk_global(spark, sf):
    return supplier_flow(spark, sf).orderBy("value", "station_id", "date").limit(50)


@query("join_semi_variable", f"WITH {SFLOW}, {STATION} SELECT station_id, date, value FROM sflow WHERE station_id IN (SELECT station_id FROM station WHERE list_contains(variables, 'discharge'))")
def join_semi_variable(spark, sf):
    return supplier_flow(spark, sf).join(K.search(stations(spark, sf), variable="discharge").select("station_id"), "station_id", "left_semi")


@query("join_anti_exclude", f"WITH {STATION} SELECT station_id, country FROM station WHERE station_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def join_anti_exclude(spark, sf):
    out = table(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("station_id"))
    return stations(spark, sf).select("station_id", "country").join(out, "station_id", "left_anti")


@query("join_point_in_bbox", f"WITH {STATION}, box AS (SELECT n_nationkey AS box_id, CAST(n_nationkey * 14 - 180 AS DOUBLE) AS west, CAST(n_nationkey * 14 - 150 AS DOUBLE) AS east, CAST(n_nationkey % 5 * 30 - 80 AS DOUBLE) AS south, CAST(n_nationkey % 5 * 30 - 30 AS DOUBLE) AS north FROM nation) "
       "SELECT station_id, min(box_id) AS box_id FROM station JOIN box ON longitude BETWEEN west AND east AND latitude BETWEEN south AND north GROUP BY 1")
def join_point_in_bbox(spark, sf):
    k = F.col("n_nationkey")
    boxes = table(spark, sf, "nation").select(k.alias("box_id"), (k * 14 - 180).cast("double").alias("west"), (k * 14 - 150).cast("double").alias("east"), (k % 5 * 30 - 80).cast("double").alias("south"), (k % 5 * 30 - 30).cast("double").alias("north"))
    return K.assign_boxes(stations(spark, sf), boxes)


@query("join_lag_crosscorr", f"WITH {PAIRED}, s AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY date) AS rn, count(*) OVER (PARTITION BY station_id) AS n FROM paired), e AS (SELECT station_id, rn, obs, unnest(range(least(n // 3, 365) + 1)) AS k FROM s), f AS (SELECT station_id, k, obs, rn - k AS j FROM e WHERE rn > k), c AS (SELECT f.station_id, k, corr(f.obs, b.sim) AS c FROM f JOIN s b ON b.station_id = f.station_id AND b.rn = f.j GROUP BY 1, 2) "
       f"SELECT station_id, {N('max(CASE WHEN k = 0 THEN c END)')} AS correlation, arg_max(k, c) AS lag_days, {N('max(c)')} AS lag_correlation FROM c GROUP BY 1")
def join_lag_crosscorr(spark, sf):
    return nudged(J.lag_correlation(paired(spark, sf)), 6, "correlation", "lag_correlation")


@query("join_scenario", f"WITH {FLOW}, {PRECIP}, a AS (SELECT station_id, CASE WHEN year(date) < 1998 THEN 'early' ELSE 'late' END AS scenario, avg(value) AS scenario_value FROM precip GROUP BY 1, 2), b AS (SELECT station_id, avg(value) AS baseline_value FROM flow GROUP BY 1) "
       f"SELECT station_id, scenario, {N('scenario_value')} AS scenario_value, {N('baseline_value')} AS baseline_value, {N('scenario_value - baseline_value')} AS absolute_change, {N('(scenario_value - baseline_value) / baseline_value * 100')} AS percent_change FROM a JOIN b USING (station_id)")
def join_scenario(spark, sf):
    s = precip(spark, sf).withColumn("scenario", F.when(F.year("date") < 1998, "early").otherwise("late"))
    return nudged(J.scenario_change(s, flow(spark, sf)), 6, "scenario_value", "baseline_value", "absolute_change", "percent_change")


@query("union_all", f"WITH {FLOW}, {PRECIP} SELECT 'flow' AS source, station_id, date, value FROM flow UNION ALL SELECT 'precip', station_id, date, value FROM precip")
def union_all(spark, sf):
    return J.union_sources(flow(spark, sf).withColumn("source", F.lit("flow")), precip(spark, sf).withColumn("source", F.lit("precip")))


@query("union_mixed_schema", f"WITH {FLOW}, {OBS} SELECT station_id, NULL AS parameter, CAST(date AS TIMESTAMP) AS ts, value FROM flow UNION ALL SELECT station_id, parameter, ts, value FROM obs")
def union_mixed_schema(spark, sf):
    a = flow(spark, sf).select("station_id", F.col("date").cast("timestamp").alias("ts"), "value")
    return J.union_sources(a, obs(spark, sf).select("station_id", "parameter", "ts", "value"))


@query("intersect_keys", f"WITH {FLOW}, {PRECIP} SELECT station_id, date FROM flow INTERSECT SELECT station_id, date FROM precip")
def intersect_keys(spark, sf):
    return flow(spark, sf).select("station_id", "date").intersect(precip(spark, sf).select("station_id", "date"))


@query("except_keys", f"WITH {FLOW}, {PRECIP} SELECT station_id, date FROM flow EXCEPT SELECT station_id, date FROM precip")
def except_keys(spark, sf):
    return flow(spark, sf).join(precip(spark, sf), ["station_id", "date"], "left_anti").select("station_id", "date")


@query("stride_sample", f"WITH {FLOW}, r AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY date) - 1 AS rn, count(*) OVER (PARTITION BY station_id) AS n FROM flow) SELECT station_id, date, value FROM r WHERE rn % greatest(1, ceil(n / 500.0)::BIGINT) = 0")
def stride_sample(spark, sf):
    return K.stride_sample(flow(spark, sf), 500)


@query("even_stride_pick", f"WITH {STATION}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY station_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM station) SELECT source, station_id FROM r WHERE n <= 7 OR (r + 1) * 7 // n > r * 7 // n")
def even_stride_pick(spark, sf):
    return K.even_pick(stations(spark, sf), 7).select("source", "station_id")


@query("catalog_search", f"WITH {STATION} SELECT source, station_id, name, country FROM station WHERE longitude BETWEEN -120 AND 120 AND latitude BETWEEN -60 AND 60 AND list_contains(variables, 'level') AND source IN ('asia', 'europe', 'africa') AND (lower(name) LIKE '%supplier#%' OR CAST(station_id AS VARCHAR) LIKE '%supplier#%')")
def catalog_search(spark, sf):
    return K.search(stations(spark, sf), (-120, -60, 120, 60), "level", ["asia", "europe", "africa"], "Supplier#").select("source", "station_id", "name", "country")


@query("catalog_near", f"WITH {STATION} SELECT station_id, name, {N('(latitude - 25) ** 2 + (0.7::DOUBLE * (longitude - 121)) ** 2')} AS d2 FROM station ORDER BY (latitude - 25) ** 2 + (0.7::DOUBLE * (longitude - 121)) ** 2, station_id LIMIT 15")
def catalog_near(spark, sf):
    return nudged(K.near(stations(spark, sf), 25.0, 121.0, 15).select("station_id", "name", "d2"), 6, "d2")


HAV = "2 * {r} * asin(least(1, sqrt(sin(radians({a} - {c}) / 2) ** 2 + cos(radians({a})) * cos(radians({c})) * sin(radians({b} - {d}) / 2) ** 2)))"


@query("haversine_km", f"WITH {STATION} SELECT station_id, {N(HAV.format(r=6371.0088, a='latitude', b='longitude', c='25.0', d='121.0'), 4)} AS km FROM station")
def haversine_km(spark, sf):
    d = K.haversine(F.lit(25.0), F.lit(121.0), F.col("latitude"), F.col("longitude"))
    return nudged(stations(spark, sf).select("station_id", d.alias("km")), 4, "km")


@query("assign_area", "WITH b AS (SELECT p_partkey AS station_id, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size * 10.0::DOUBLE END AS agency_area, p_retailprice AS up_area FROM part) SELECT station_id, coalesce(agency_area, up_area) AS area_km2, CASE WHEN agency_area > 0 THEN 'agency' ELSE 'basin' END AS area_source, "
       "CASE WHEN coalesce(agency_area, up_area) < 0.5::DOUBLE * up_area THEN 'local' ELSE 'upstream' END AS attribute_scope FROM b")
def assign_area(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("station_id"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_size") * 10.0).alias("agency_area"), F.col("p_retailprice").alias("up_area"))
    return K.assign_area(p).drop("agency_area", "up_area")


@query("suggest_basins", f"WITH {STATION}, r AS (SELECT source, station_id, acctbal, row_number() OVER (PARTITION BY source ORDER BY acctbal DESC, station_id) AS turn FROM station WHERE list_contains(variables, 'discharge')) SELECT source, station_id, turn FROM r ORDER BY turn, source LIMIT 12")
def suggest_basins(spark, sf):
    d = K.search(stations(spark, sf), variable="discharge")
    return K.suggest(d, 12, [F.desc("acctbal"), F.col("station_id")]).select("source", "station_id", F.col("turn").cast("long").alias("turn"))


@query("sink_catalog", f"WITH {STATION} SELECT min(longitude) AS west, min(latitude) AS south, max(longitude) AS east, max(latitude) AS north, count(*) AS n_stations FROM station")
def sink_catalog(spark, sf):
    from limnos.session import scratch_path
    from limnos.sources.sinks import write_catalog
    path = scratch_path(spark, "catalog")
    write_catalog(stations(spark, sf), path)
    return K.bounds(spark.read.parquet(path))


@query("resample_monthly", f"WITH {FLOW} SELECT station_id, CAST(date_trunc('month', date) AS DATE) AS date, sum(value) AS value, count(value) AS n_obs FROM flow GROUP BY 1, 2")
def resample_monthly(spark, sf):
    return P.resample(flow(spark, sf), "month", "sum")


@query("resample_yearly", f"WITH {FLOW} SELECT station_id, CAST(date_trunc('year', date) AS DATE) AS date, CASE WHEN count(value) >= 300 THEN sum(value) END AS value, count(value) AS n_obs FROM flow GROUP BY 1, 2")
def resample_yearly(spark, sf):
    return P.resample(flow(spark, sf), "year", "sum", min_count=300)
