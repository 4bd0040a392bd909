"""Queries for river networks, grids, similarity and regionalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from limnos.operators import network as W
from limnos.operators import similarity as S
from limnos.plans.adapters import BASIN, CELL, SFLOW, STATION, basins, cells, flow, stations, supplier_flow, table
from limnos.plans.catalog import N, nudged, query
from limnos.plans.hydrology import SIG_SQL

TREE = f"WITH RECURSIVE {BASIN}, an AS (SELECT hybas_id AS v, hybas_id AS a FROM basin UNION ALL SELECT an.v, b.next_down FROM an JOIN basin b ON b.hybas_id = an.a WHERE b.next_down > 0)"


def tree(spark, sf):
    b = basins(spark, sf)
    return b, W.pointers(b, "hybas_id", "next_down")


@query("upstream_trace", f"{TREE} SELECT v AS hybas_id FROM an WHERE a = 5")
def upstream_trace(spark, sf):
    b, ptr = tree(spark, sf)
    outlet = b.where("hybas_id = 5").select(F.col("hybas_id").alias("v"))
    return W.members(W.cut(ptr), outlet).select(F.col("v").alias("hybas_id"))


@query("downstream_trace", f"{TREE} SELECT v AS start, a AS hybas_id FROM an WHERE v = (SELECT max(hybas_id) FROM basin)")
def downstream_trace(spark, sf):
    b, ptr = tree(spark, sf)
    _, jumps = W.prepare(ptr)
    return W.downstream_path(b.agg(F.max("hybas_id").alias("v")), jumps).select("start", F.col("v").alias("hybas_id"))


AWA = (f"{TREE}, aw AS (SELECT a AS v, count(*) AS n_sub_basins, sum(sub_area) AS area_km2, sum(CASE WHEN precip > -9999 THEN precip * sub_area END) / CASE WHEN sum(sub_area) > 0 THEN sum(sub_area) ELSE 1 END AS precip_mean, "
       "sum(CASE WHEN precip > -9999 THEN precip END) AS precip_sum, max(elev) AS elev_max FROM an JOIN basin ON hybas_id = an.v GROUP BY 1)")


def attrs(spark, sf):
    b, ptr = tree(spark, sf)
    _, jumps = W.prepare(ptr)
    return W.area_weighted(b.withColumnRenamed("hybas_id", "v"), jumps, ["precip"], ["precip"], ["elev"])


@query("area_weighted_attrs", f"{AWA} SELECT v, n_sub_basins, area_km2, {N('precip_mean')} AS precip_mean, {N('precip_sum', 4)} AS precip_sum, elev_max FROM aw")
def area_weighted_attrs(spark, sf):
    return nudged(nudged(attrs(spark, sf), 6, "precip_mean"), 4, "precip_sum")


@query("catchment_describe", f"{AWA} SELECT v AS hybas_id, next_down, sub_area, n_sub_basins, area_km2, {N('precip_mean')} AS precip_mean, elev_max FROM aw JOIN basin ON hybas_id = v")
def catchment_describe(spark, sf):
    b = basins(spark, sf).select("hybas_id", "next_down", "sub_area")
    d = b.join(attrs(spark, sf).withColumnRenamed("v", "hybas_id"), "hybas_id").drop("precip_sum")
    return nudged(d, 6, "precip_mean")


# The rolling part keys make a ramp; a parabola across it gives the grid valleys to drain.
HILL = f"{CELL}, hill AS (SELECT grid_id, row, col, elev % 7 + (col - 9) * (col - 9) * 0.5::DOUBLE + row * 0.01::DOUBLE AS elev FROM cell)"
NB = "nbr(code, ord, dr, dc) AS (VALUES (1, 0, 0, 1), (2, 1, 1, 1), (4, 2, 1, 0), (8, 3, 1, -1), (16, 4, 0, -1), (32, 5, -1, -1), (64, 6, -1, 0), (128, 7, -1, 1))"
D8 = (f"{HILL}, {NB}, dn AS (SELECT a.row, a.col, a.elev, code, ord, dr, dc, b.elev AS be, (a.elev - b.elev) / CASE WHEN dr = 0 OR dc = 0 THEN 1.0::DOUBLE ELSE sqrt(2) END AS dp FROM hill a, nbr JOIN hill b ON b.row = a.row + dr AND b.col = a.col + dc), "
      "bd AS (SELECT row, col, arg_min(code, -dp * 1e6 * 1e3 + ord) FILTER (WHERE dp > 0) AS best, min(ord) FILTER (WHERE be <= elev) AS fo FROM dn GROUP BY 1, 2), d8 AS (SELECT h.row, h.col, h.elev, CAST(coalesce(best, (SELECT code FROM nbr WHERE ord = fo), 0) AS BIGINT) AS direction FROM hill h JOIN bd USING (row, col))")


def hill(spark, sf):
    c = F.col
    return cells(spark, sf).withColumn("elev", c("elev") % 7 + (c("col") - 9) * (c("col") - 9) * 0.5 + c("row") * 0.01)


@query("d8_direction", f"WITH {D8} SELECT row, col, direction FROM d8")
def d8_direction(spark, sf):
    return W.d8_direction(hill(spark, sf)).select("row", "col", "direction")


def grid(spark, sf):
    """Directions, pointers, jump tables and accumulation of the test grid."""
    d = W.cut(W.d8_direction(hill(spark, sf)))
    ptr, jumps = W.prepare(W.grid_pointers(d))
    acc = W.flow_accumulation(ptr, jumps)
    cell = d.withColumn("v", W.cell_id(F.col("grid_id"), F.col("row"), F.col("col")))
    return cell, ptr, jumps, acc


def by_cell(cell, df, *cols):
    return cell.join(df, "v").select("row", "col", *cols)


GO = (f"WITH RECURSIVE {D8}, go AS (SELECT d8.row, d8.col, d8.row + dr AS r2, d8.col + dc AS c2 FROM d8 JOIN nbr ON code = direction), "
      "walk AS (SELECT row, col, row AS r, col AS c, 0 AS step FROM d8 UNION ALL SELECT w.row, w.col, g.r2, g.c2, step + 1 FROM walk w JOIN go g ON g.row = w.r AND g.col = w.c WHERE step < 400), acc AS (SELECT r AS row, c AS col, count(*) AS accumulation FROM walk GROUP BY 1, 2)")


@query("flow_accumulation", f"{GO} SELECT * FROM acc")
def flow_accumulation(spark, sf):
    cell, _, _, acc = grid(spark, sf)
    return by_cell(cell, acc, "accumulation")


@query("flow_streams", f"{GO} SELECT row, col FROM acc WHERE accumulation >= 20")
def flow_streams(spark, sf):
    cell, _, _, acc = grid(spark, sf)
    return by_cell(cell, acc.where("accumulation >= 20"))


POUR = "pour AS (SELECT row, col FROM acc ORDER BY accumulation DESC, row, col LIMIT 1)"


@query("watershed", f"{GO}, {POUR} SELECT w.row, w.col FROM walk w JOIN pour p ON w.r = p.row AND w.c = p.col")
def watershed(spark, sf):
    cell, ptr, _, acc = grid(spark, sf)
    pour = cell.join(acc, "v").orderBy(F.desc("accumulation"), "row", "col").limit(1).select("v")
    return by_cell(cell, W.members(ptr, W.cut(pour)))


PTS = "pt AS (SELECT s_suppkey AS point_id, s_suppkey * 37 % 100 AS row, s_suppkey * 7 % 20 AS col FROM supplier)"
SNAP = f"{PTS}, sn AS (SELECT point_id, a.row, a.col, accumulation, row_number() OVER (PARTITION BY point_id ORDER BY accumulation DESC, a.row, a.col) AS k FROM pt JOIN acc a ON a.row BETWEEN pt.row - 5 AND pt.row + 5 AND a.col BETWEEN pt.col - 5 AND pt.col + 5)"


def points(spark, sf):
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(k.alias("point_id"), F.lit("g").alias("grid_id"), (k * 37 % 100).alias("row"), (k * 7 % 20).alias("col"))


@query("watershed_snap", f"{GO}, {SNAP} SELECT point_id, row, col, accumulation FROM sn WHERE k = 1")
def watershed_snap(spark, sf):
    cell, _, _, acc = grid(spark, sf)
    return W.snap_points(points(spark, sf), cell.join(acc, "v")).drop("grid_id")


@query("stations_to_catchments", f"{GO}, {SNAP} SELECT point_id, row, col, {N('accumulation * 900 / 1e6')} AS area_km2 FROM sn WHERE k = 1")
def stations_to_catchments(spark, sf):
    cell, _, _, acc = grid(spark, sf)
    s = W.snap_points(points(spark, sf), cell.join(acc, "v"))
    return nudged(s.select("point_id", "row", "col", (F.col("accumulation") * 900 / 1e6).alias("area_km2")), 6, "area_km2")


SLOPE = ("sl AS (SELECT row, col, elev, degrees(atan(sqrt(gx * gx + gy * gy))) AS slope_deg FROM (SELECT row, col, elev, CASE WHEN w IS NULL AND e IS NULL THEN 0 WHEN w IS NULL THEN e - elev WHEN e IS NULL THEN elev - w ELSE (e - w) / 2 END / 30.0::DOUBLE AS gx, "
         "CASE WHEN n IS NULL AND s IS NULL THEN 0 WHEN n IS NULL THEN s - elev WHEN s IS NULL THEN elev - n ELSE (s - n) / 2 END / 30.0::DOUBLE AS gy FROM (SELECT *, lag(elev) OVER (PARTITION BY row ORDER BY col) AS w, lead(elev) OVER (PARTITION BY row ORDER BY col) AS e, lag(elev) OVER (PARTITION BY col ORDER BY row) AS n, lead(elev) OVER (PARTITION BY col ORDER BY row) AS s FROM hill)))")


@query("dem_slope", f"WITH {HILL}, {SLOPE} SELECT row, col, {N('slope_deg')} AS slope_deg FROM sl")
def dem_slope(spark, sf):
    return nudged(W.slope_degrees(hill(spark, sf), 30.0).drop("grid_id"), 6, "slope_deg")


@query("catchment_stats", f"{GO}, {SLOPE}, ends AS (SELECT row, col, arg_max(r, step) AS r, arg_max(c, step) AS c FROM walk GROUP BY 1, 2), m AS (SELECT concat_ws(':', 'g', e.r, e.c) AS outlet, sl.row, sl.col, sl.elev, slope_deg, accumulation FROM ends e JOIN sl USING (row, col) JOIN acc USING (row, col)) "
       f"SELECT outlet, count(*) AS n_cells, {N('count(*) * 900 / 1e6')} AS area_km2, {N('avg(elev)')} AS mean_elevation, {N('avg(slope_deg)')} AS mean_slope, {N('sum((accumulation >= 20)::INT) * 30 / 1000 / (count(*) * 900 / 1e6)')} AS stream_density, "
       f"{N('CASE WHEN count(*) < 2 THEN 1 WHEN max(row) = min(row) AND max(col) = min(col) THEN 1 ELSE 2 * sqrt(count(*) * 900 / pi()) / (sqrt((max(row) - min(row)) ** 2 + (max(col) - min(col)) ** 2) * 30) END')} AS elongation_ratio FROM m GROUP BY 1")
def catchment_stats(spark, sf):
    cell, ptr, _, acc = grid(spark, sf)
    member = W.members(ptr, ptr.where("j IS NULL").select("v"))
    c = cell.join(member, "v").join(acc, "v").join(W.slope_degrees(hill(spark, sf), 30.0), ["grid_id", "row", "col"])
    d = W.catchment_stats(c, ["outlet"], 30.0, 20)
    return nudged(d, 6, "area_km2", "mean_elevation", "mean_slope", "stream_density", "elongation_ratio")


@query("strahler")
def strahler(spark, sf):
    cell, ptr, _, acc = grid(spark, sf)
    stream = acc.where("accumulation >= 20").select("v")
    sp, jumps = W.prepare(W.pointers(ptr.join(stream, "v", "left_semi"), "v", "j"))
    return by_cell(cell, W.strahler(sp, jumps), "strahler")


@query("strahler_tree", f"WITH RECURSIVE {BASIN}, lv AS (SELECT hybas_id, floor(log2(hybas_id))::INT AS d FROM basin), o AS (SELECT hybas_id, (SELECT max(d) FROM lv) AS top, d FROM lv) "
       "SELECT hybas_id, CASE WHEN 2 * hybas_id > (SELECT max(hybas_id) FROM basin) THEN 1 WHEN 2 * hybas_id + 1 > (SELECT max(hybas_id) FROM basin) THEN 1 ELSE "
       "floor(log2(((SELECT max(hybas_id) FROM basin) + 1) / (hybas_id + 1)::DOUBLE))::BIGINT + 1 END AS strahler FROM basin")
def strahler_tree(spark, sf):
    _, ptr = tree(spark, sf)
    p, jumps = W.prepare(ptr)
    return W.strahler(p, jumps).withColumnRenamed("v", "hybas_id")


# ── similarity ──────────────────────────────────────────────────────────────────
FEATS = tuple(S.Feature(f"e{i}", None, w) for i, w in enumerate((1.5, 1.0, 1.0, 1.5, 0.7, 0.5)))
VEC = "vec AS (SELECT vec_id AS id, " + ", ".join(f"CASE WHEN vec_id % 17 = {i} THEN NULL ELSE embedding[{i + 1}]::DOUBLE END AS f{i}" for i in range(6)) + ", (vec_id * 37 % 180) - 89.5 AS lat, (vec_id * 91 % 360) - 179.5 AS lon, exp(embedding[21]::DOUBLE) AS flow_mm, abs(embedding[22]::DOUBLE) AS bfi, embedding[23]::DOUBLE AS slope FROM embeddings)"


def vectors(spark, sf):
    e, k = table(spark, sf, "embeddings"), F.col("vec_id")
    at = lambda i: F.get("embedding", F.lit(i)).cast("double")
    d = e.select(k.alias("id"), *[F.when(k % 17 != i, at(i)).alias(f"e{i}") for i in range(6)], ((k * 37 % 180) - 89.5).cast("double").alias("lat"), ((k * 91 % 360) - 179.5).cast("double").alias("lon"),
                 F.exp(at(20)).alias("flow_mm"), F.abs(at(21)).alias("bfi"), at(22).alias("slope"))
    return d


def feats(spark, sf):
    return S.feature_table(vectors(spark, sf), "id", FEATS, ("lat", "lon"))


def _sd(i):
    x, m = f"CASE WHEN t.f{i} IS NULL THEN 0 ELSE t.f{i} END", f"(n{i} - CASE WHEN t.f{i} IS NULL THEN 0 ELSE 1 END)"
    return f"sqrt((q{i} - ({x}) ** 2) / {m} - ((s{i} - ({x})) / {m}) ** 2)"


SUMS = "su AS (SELECT " + ", ".join(f"count(f{i}) AS n{i}, sum(f{i}) AS s{i}, sum(f{i} * f{i}) AS q{i}" for i in range(6)) + " FROM vec)"
TERM = " + ".join(f"CASE WHEN t.f{i} IS NULL THEN 0 ELSE (CASE WHEN d.f{i} IS NULL THEN 3 ELSE abs(d.f{i} - t.f{i}) / {_sd(i)} END * {f.weight}::DOUBLE) ** 2 END" for i, f in enumerate(FEATS))
WSUM = " + ".join(f"CASE WHEN t.f{i} IS NULL THEN 0 ELSE {f.weight ** 2!r}::DOUBLE END" for i, f in enumerate(FEATS))
KM = "2 * 6371.0088::DOUBLE * asin(least(1, sqrt(sin(radians(d.lat - t.lat) / 2) ** 2 + cos(radians(t.lat)) * cos(radians(d.lat)) * sin(radians(d.lon - t.lon) / 2) ** 2)))"
SIM = f"{VEC}, {SUMS}, sp AS (SELECT t.id AS target, d.id AS donor, sqrt(({TERM}) / ({WSUM})) AS attr, {KM} AS km FROM vec t, vec d, su WHERE t.id <> d.id)"


def top_sql(expr, k=10):
    return f"tk AS (SELECT target, donor, {expr} AS score, row_number() OVER (PARTITION BY target ORDER BY {expr}, donor) AS place FROM sp QUALIFY place <= {k})"


for _m, _e in (("similarity", "attr"), ("proximity", "km"), ("combined", "sqrt(attr ** 2 + (km / 500) ** 2)")):
    def _sim(spark, sf, method=_m):
        f = feats(spark, sf)
        d = S.similar(f, f, FEATS, 10, method).withColumn("place", F.col("place").cast("long"))
        return nudged(d, 6, "score")
    query("similar_basins" if _m == "similarity" else f"similar_basins_{_m}", f"WITH {SIM}, {top_sql(_e)} SELECT target, donor, {N('score')} AS score, place FROM tk")(_sim)


LONG = "lv AS (SELECT id, 'flow_mm' AS signature, flow_mm AS value FROM vec UNION ALL SELECT id, 'bfi', bfi FROM vec UNION ALL SELECT id, 'slope', slope FROM vec)"
Y = "CASE WHEN signature = 'flow_mm' THEN ln(greatest(value, 1e-3)) ELSE value END"
BACK = "CASE WHEN signature = 'flow_mm' THEN exp({e}) WHEN signature = 'bfi' THEN least(greatest({e}, 0), 1) ELSE {e} END"
KNN = f"{SIM}, {top_sql('attr')}, {LONG}, kn AS (SELECT target, signature, sum({Y} / (score + 0.05)) / sum(1 / (score + 0.05)) AS m, sum(({Y}) ** 2 / (score + 0.05)) / sum(1 / (score + 0.05)) AS m2, min(value) AS lo, max(value) AS hi, count(*) AS n FROM tk JOIN lv ON lv.id = donor GROUP BY 1, 2), ke AS (SELECT *, sqrt(greatest(m2 - m * m, 0)) AS sd, {BACK.format(e='m')} AS est FROM kn)"
BOUNDS = {"bfi": (0.0, 1.0)}


def signature_values(spark, sf):
    return vectors(spark, sf).unpivot(["id"], ["flow_mm", "bfi", "slope"], "signature", "value")


def knn(spark, sf):
    f = feats(spark, sf)
    return S.knn_estimates(S.similar(f, f, FEATS, 10), signature_values(spark, sf), ["flow_mm"], BOUNDS)


@query("regionalize_knn", f"WITH {KNN} SELECT target, signature, {N('est')} AS estimate, {N(BACK.format(e='(m - sd)'), 5)} AS low, {N(BACK.format(e='(m + sd)'), 5)} AS high, {N('lo')} AS donor_min, {N('hi')} AS donor_max, n AS n_donors FROM ke")
def regionalize_knn(spark, sf):
    return nudged(nudged(knn(spark, sf), 6, "estimate", "donor_min", "donor_max"), 5, "low", "high")


@query("loo_skill", f"WITH {KNN}, jj AS (SELECT ke.signature AS signature, value, est FROM ke JOIN lv ON lv.id = ke.target AND lv.signature = ke.signature), j AS (SELECT *, {Y} AS o, {Y.replace('value', 'est')} AS s FROM jj) "
       f"SELECT signature, count(*) AS n, {N('1 - avg((s - o) ** 2) / var_pop(o)')} AS nse, {N('corr(o, s) ** 2')} AS r2, {N('quantile_cont(CASE WHEN abs(value) > 1e-9 THEN abs(est - value) / abs(value) END, 0.5)')} AS median_ape FROM j GROUP BY 1")
def loo_skill(spark, sf):
    return nudged(S.loo_skill(knn(spark, sf), signature_values(spark, sf), ["flow_mm"]), 6, "nse", "r2", "median_ape")


@query("regionalize_ridge")
def regionalize_ridge(spark, sf):
    f = feats(spark, sf)
    return S.ridge_estimates(f, f, signature_values(spark, sf), len(FEATS), ["flow_mm"], bounds=BOUNDS)


SIG3 = ("flow_mm", "bfi", "slope")
SD = f"{VEC}, sp AS (SELECT t.id AS target, d.id AS donor, sqrt(" + " + ".join(f"coalesce({2.0 if c == 'bfi' else 1.0}::DOUBLE * ((t.{c} - d.{c}) / nullif((abs(t.{c}) + abs(d.{c})) / 2, 0)) ** 2, 0)" for c in SIG3) + ") AS s FROM vec t, vec d WHERE t.id <> d.id)"


def sig_top(spark, sf, **kw):
    v = vectors(spark, sf).select("id", *SIG3)
    return S.signature_distance(v, v, SIG3, weights={"bfi": 2.0}, **kw).withColumn("place", F.col("place").cast("long"))


@query("signature_similarity", f"WITH {SD}, {top_sql('s', 5)} SELECT target, donor, {N('score')} AS score, place FROM tk")
def signature_similarity(spark, sf):
    return nudged(sig_top(spark, sf, k=5), 6, "score")


@query("signature_differences", f"WITH {VEC}, a AS (SELECT id, 'flow_mm' AS signature, flow_mm AS x, flow_mm * 1.1 + bfi AS y FROM vec UNION ALL SELECT id, 'bfi', bfi, bfi * 0.9 + 0.01 FROM vec) SELECT id, signature, {N('abs(x - y) / CASE WHEN abs(x) > 0 THEN abs(x) ELSE 1 END * 100', 5)} AS percent_difference FROM a")
def signature_differences(spark, sf):
    v = vectors(spark, sf)
    b = v.select("id", (F.col("flow_mm") * 1.1 + F.col("bfi")).alias("flow_mm"), (F.col("bfi") * 0.9 + 0.01).alias("bfi"))
    return nudged(S.percent_differences(v.select("id", "flow_mm", "bfi"), b, ["flow_mm", "bfi"]), 5, "percent_difference")


@query("donor_topk", f"WITH {SD}, {top_sql('s', 3)}, f AS (SELECT * FROM tk WHERE score <= 1.0) SELECT target, count(*) AS n_donors, {N('avg(e.flow_mm)')} AS pooled_flow, {N('max(score)')} AS worst FROM f JOIN vec e ON e.id = donor GROUP BY 1")
def donor_topk(spark, sf):
    top = sig_top(spark, sf, k=3, max_distance=1.0)
    pool = top.join(vectors(spark, sf).select(F.col("id").alias("donor"), "flow_mm"), "donor")
    return nudged(pool.groupBy("target").agg(F.count(F.lit(1)).alias("n_donors"), F.avg("flow_mm").alias("pooled_flow"), F.max("score").alias("worst")), 6, "pooled_flow", "worst")


@query("join_spatial_weight", f"WITH {STATION}, i AS (SELECT station_id, 1 / (2 * 6371.0::DOUBLE * asin(least(1, sqrt(sin(radians(25.0 - latitude) / 2) ** 2 + cos(radians(latitude)) * cos(radians(25.0)) * sin(radians(121.0 - longitude) / 2) ** 2))) + 1e-6) AS i FROM station) SELECT station_id, {N('i / sum(i) OVER ()', 8)} AS weight FROM i")
def join_spatial_weight(spark, sf):
    return nudged(S.proximity_weights(stations(spark, sf).select("station_id", "latitude", "longitude"), 25.0, 121.0).select("station_id", "weight"), 8, "weight")


# catchment attributes made from embeddings: scale, offset and whether only the size of a component counts
ATTRS = {"area_km2": (900.0, 1.0, True), "elevation_m": (800.0, 600.0, False), "slope_deg": (9.0, 0.0, True), "precipitation_mm_yr": (700.0, 900.0, False), "aridity_index": (1.5, 0.1, True),
         "temperature_c": (9.0, 11.0, False), "snow_cover_pct": (30.0, 0.0, True), "forest_pct": (50.0, 0.0, True), "cropland_pct": (45.0, 0.0, True), "urban_pct": (12.0, 0.0, True),
         "clay_pct": (30.0, 5.0, True), "sand_pct": (40.0, 5.0, True), "population_density": (300.0, 0.0, True), "degree_of_regulation_pct": (25.0, 0.0, True)}
CATCH = "ca AS (SELECT vec_id AS id, 'archive' || (vec_id % 3) AS source, vec_id % 2 = 0 AS flow, (vec_id * 37 % 180) - 89.5::DOUBLE AS latitude, (vec_id * 91 % 360) - 179.5::DOUBLE AS longitude, " + ", ".join(
    f"CASE WHEN vec_id % 17 <> {i} THEN round({k}::DOUBLE * {'abs' if a else ''}(embedding[{i + 1}]::DOUBLE) + {o}::DOUBLE, 6) END AS {c}" for i, (c, (k, o, a)) in enumerate(ATTRS.items())) + " FROM embeddings)"


def catchments(spark, sf):
    k, e = F.col("vec_id"), lambda i, a: (F.abs if a else lambda x: x)(F.get("embedding", F.lit(i)).cast("double"))
    return table(spark, sf, "embeddings").select(
        k.alias("id"), F.concat(F.lit("archive"), (k % 3).cast("string")).alias("source"), F.when(k % 2 == 0, F.array(F.lit("level"), F.lit("discharge"))).otherwise(F.array(F.lit("level"))).alias("variables"),
        ((k * 37 % 180) - 89.5).cast("double").alias("latitude"), ((k * 91 % 360) - 179.5).cast("double").alias("longitude"),
        *[F.when(k % 17 != i, F.round(scale * e(i, size) + off, 6)).alias(c) for i, (c, (scale, off, size)) in enumerate(ATTRS.items())])


def _how(f, c):
    return {"log10": f"CASE WHEN {c} IS NOT NULL THEN log10(greatest({c}, 1e-3)) END", "log1p": f"CASE WHEN {c} IS NOT NULL THEN ln(1 + greatest({c}, 0)) END", None: c}[f.transform]


NF = len(S.CATCHMENT_FEATURES)
CTR = f"{CATCH}, cf AS (SELECT id, source, flow, latitude AS lat, longitude AS lon, {', '.join(f'{_how(f, f.column)} AS f{i}' for i, f in enumerate(S.CATCHMENT_FEATURES))} FROM ca), cd AS (SELECT * FROM cf WHERE flow AND source <> 'archive1'), "
CSU = "cs AS (SELECT " + ", ".join(f"count(f{i}) AS n{i}, avg(f{i}) AS m{i}, coalesce(var_pop(f{i}), 0) * count(f{i}) AS q{i}" for i in range(NF)) + " FROM cd), "
CSD = "ct AS (SELECT cf.*, " + ", ".join(f"CASE WHEN flow AND source <> 'archive1' AND f{i} IS NOT NULL THEN sqrt(greatest((q{i} - (f{i} - m{i}) ** 2) / (n{i} - 1) - ((f{i} - m{i}) / (n{i} - 1)) ** 2, 0)) ELSE sqrt(q{i} / n{i}) END AS sd{i}" for i in range(NF)) + " FROM cf, cs), "
CTERM = " + ".join(f"CASE WHEN t.f{i} IS NULL THEN 0 ELSE (CASE WHEN d.f{i} IS NULL THEN 3 ELSE abs(d.f{i} - t.f{i}) / sd{i} END * {f.weight}::DOUBLE) ** 2 END" for i, f in enumerate(S.CATCHMENT_FEATURES))
CWSUM = " + ".join(f"CASE WHEN t.f{i} IS NULL THEN 0 ELSE {f.weight ** 2!r}::DOUBLE END" for i, f in enumerate(S.CATCHMENT_FEATURES))
CTOP = CTR + CSU + CSD + (f"cp AS (SELECT t.id AS target, d.id AS donor, sqrt(({CTERM}) / ({CWSUM})) AS attr, {KM} AS km FROM ct t, cd d WHERE t.id <> d.id), ck AS (SELECT *, sqrt(attr ** 2 + (km / 500) ** 2) AS score, "
                          "row_number() OVER (PARTITION BY target ORDER BY sqrt(attr ** 2 + (km / 500) ** 2), donor) AS place FROM cp QUALIFY place <= 10)")


def catchment_ranking(spark, sf):
    c = catchments(spark, sf)
    return S.similar_basins(c, c, method="combined", sources=["archive0", "archive2"])


@query("similar_catchments", f"WITH {CTOP} SELECT target, donor, {N('score')} AS score, place, {N('attr')} AS similarity_distance, {N('km', 4)} AS distance_km FROM ck")
def similar_catchments(spark, sf):
    d = catchment_ranking(spark, sf)[0].withColumn("place", F.col("place").cast("long"))
    return nudged(nudged(d, 6, "score", "similarity_distance"), 4, "distance_km")


@query("similar_catchment_deltas", f"WITH {CTOP}, lo AS (UNPIVOT (SELECT id, {', '.join(ATTRS)} FROM ca) ON {', '.join(ATTRS)} INTO NAME feature VALUE value) "
       f"SELECT target, donor, a.feature AS feature, {N('a.value', 3)} AS station, {N('b.value', 3)} AS own FROM ck JOIN lo a ON a.id = donor JOIN lo b ON b.id = target AND b.feature = a.feature")
def similar_catchment_deltas(spark, sf):
    return catchment_ranking(spark, sf)[1]


SITE = "site AS (SELECT c_custkey AS station_id, (c_custkey * 53 % 17999)::DOUBLE / 100 - 89.995 AS latitude, (c_custkey * 97 % 36000)::DOUBLE / 100 - 180 AS longitude FROM customer)"


def sites(spark, sf):
    """Places without gauges, one per customer, on both sides of the dateline and up to the poles."""
    c = F.col("c_custkey")
    return table(spark, sf, "customer").select(c.alias("station_id"), ((c * 53 % 17999).cast("double") / 100 - 89.995).alias("latitude"), ((c * 97 % 36000).cast("double") / 100 - 180).alias("longitude"))


@query("spatial_weights", f"WITH {STATION}, {SITE}, km AS (SELECT s.station_id AS target, d.station_id AS donor, 2 * 6371.0::DOUBLE * asin(least(1, sqrt(sin(radians(d.latitude - s.latitude) / 2) ** 2 + cos(radians(s.latitude)) * cos(radians(d.latitude)) * sin(radians(d.longitude - s.longitude) / 2) ** 2))) AS km FROM site s, station d), "
       f"near AS (SELECT * FROM km QUALIFY row_number() OVER (PARTITION BY target ORDER BY round(km, 6), donor) <= 5) SELECT target, donor, {N('km', 5)} AS km, {N('(1 / (km + 1e-6)) / sum(1 / (km + 1e-6)) OVER (PARTITION BY target)', 6)} AS weight FROM near")
def spatial_weights(spark, sf):
    from limnos.operators.nearest import spatial_weights as weigh
    return nudged(nudged(weigh(sites(spark, sf), stations(spark, sf), 5), 5, "km"), 6, "weight")


STV = f"{SFLOW}, {STATION}, sv AS (SELECT station_id, latitude AS lat, longitude AS lon, avg(value) AS value FROM sflow JOIN station USING (station_id) GROUP BY 1, 2, 3), vp AS (SELECT sqrt((a.lat - b.lat) ** 2 + (a.lon - b.lon) ** 2) AS d, (a.value - b.value) ** 2 AS g FROM sv a JOIN sv b ON a.station_id < b.station_id), h AS (SELECT max(d) / 2 AS half, (SELECT least(15, count(*)) FROM sv) AS nb FROM vp), vb AS (SELECT ceil(d / (half / nb))::BIGINT - 1 AS bin, g, half, nb FROM vp, h WHERE d > 0 AND d <= half)"


def station_values(spark, sf):
    m = supplier_flow(spark, sf).groupBy("station_id").agg(F.avg("value").alias("value"))
    return m.join(stations(spark, sf).select("station_id", F.col("latitude").alias("lat"), F.col("longitude").alias("lon")), "station_id")


@query("variogram", f"WITH {STV} SELECT bin, {N('(bin + 0.5) * max(half) / max(nb)')} AS bin_center, count(*) AS pairs, {N('avg(g) / 2')} AS gamma FROM vb GROUP BY 1")
def variogram(spark, sf):
    return nudged(S.variogram(station_values(spark, sf), rows_per_block=40), 6, "bin_center", "gamma")


@query("variogram_model", f"WITH {STV}, g AS (SELECT bin, avg(g) / 2 AS gamma, max(half) AS half FROM vb GROUP BY 1) SELECT count(*) AS n_stations, {N('var_pop(value)')} AS sill, {N('(SELECT arg_min(gamma, bin) FROM g)')} AS nugget, {N('(SELECT max(half) * 0.6 FROM g)')} AS range FROM sv")
def variogram_model(spark, sf):
    s = station_values(spark, sf)
    return nudged(S.variogram_model(s, S.variogram(s)), 6, "sill", "nugget", "range")


@query("join_station_pairs", f"WITH {STV} SELECT bin, count(*) AS pairs FROM vb GROUP BY 1")
def join_station_pairs(spark, sf):
    return S.variogram(station_values(spark, sf)).select("bin", "pairs")


STS = ["baseflow_index", "fdc_slope", "high_flow_frequency", "low_flow_frequency", "zero_flow_fraction", "seasonality_index", "flashiness_index"]


@query("station_signature_table", SIG_SQL + f", ar AS (SELECT station_id, 100.0::DOUBLE + station_id * 10 AS area FROM sg2), mm AS (SELECT station_id, count(*) AS n_days, (max(date) - min(date)) / 365.25::DOUBLE AS yrs, avg(value) * 86.4 / max(area) AS qm, quantile_cont(value, 0.5) * 86.4 / max(area) AS q50, quantile_cont(value, 0.05) * 86.4 / max(area) AS q95, quantile_cont(value, 0.95) * 86.4 / max(area) AS q05 FROM flow JOIN ar USING (station_id) GROUP BY 1), "
       "ax AS (SELECT station_id, avg(mx) AS mx FROM (SELECT station_id, year(date) AS y, max(value) AS mx FROM flow GROUP BY 1, 2 HAVING count(value) >= 292) GROUP BY 1) "
       f"SELECT station_id, n_days, {N('yrs', 1)} AS n_years, {N('qm')} AS q_mean_mm, {N('q50')} AS q_median_mm, {N('mm.q95')} AS q95_mm, {N('q05')} AS q05_mm, {N('mx * 86.4 / area')} AS q_annual_max_mm, {N('qm * 365.25 / 900')} AS runoff_ratio, {', '.join(f'{N(c)} AS {c}' for c in STS)} FROM mm JOIN ar USING (station_id) JOIN ax USING (station_id) JOIN sg2 USING (station_id) WHERE yrs >= 5 AND n_days >= 1825")
def station_signature_table(spark, sf):
    from limnos.operators.regional import station_signature_table as build
    f = flow(spark, sf)
    catch = f.select("station_id").distinct().select("station_id", (100.0 + F.col("station_id") * 10).alias("area_km2"), F.lit(900.0).alias("precipitation_mm_yr"))
    d = build(f, catch, min_years=5.0)
    return nudged(nudged(d, 6, *[c for c in d.columns if c not in ("station_id", "n_days", "n_years")]), 1, "n_years")


