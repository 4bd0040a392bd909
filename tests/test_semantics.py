"""Hand-computed frames for the rules that are easy to get wrong, and invariants of the checked-by-rows operators."""

import datetime as dt
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from limnos import api
from limnos.functions import dims, special
from limnos.operators import baseflow, changepoint, climate, extremes, flow, groundwater, metrics, network, quality, screening, series, similarity, trend
from limnos.sources import readers
from limnos.streaming import jobs

D0 = dt.date(2000, 1, 1)


def daily(spark, values, station="a"):
    return spark.createDataFrame([(station, D0 + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)], "station_id string, date date, value double")


def one(df):
    return df.first().asDict()


# ── special functions ───────────────────────────────────────────────────────────


def test_normal_functions(spark):
    xs = [-8.5, -3.0, -1.2, 0.0, 0.4, 2.7, 6.0]
    d = spark.createDataFrame([(x,) for x in xs], "x double").withColumn("p", special.norm_cdf("x")).withColumn("q", special.norm_ppf("p"))
    for r in d.collect():
        assert math.isclose(r.p, 0.5 * math.erfc(-r.x / math.sqrt(2)), rel_tol=1e-9 if abs(r.x) < 7 else 1e-6)
        if abs(r.x) < 4:
            assert abs(r.q - r.x) < 1e-6


def test_gamma_and_tails(spark):
    d = spark.createDataFrame([(0.5,), (1.3,), (4.0,), (7.7,)], "x double")
    for r in d.select("x", special.gamma_fn(F.col("x")).alias("g")).collect():
        assert math.isclose(r.g, math.gamma(r.x), rel_tol=1e-12)
    r = one(spark.range(1).select(special.t_two_sided(F.lit(2.0), F.lit(10.0)).alias("t"), special.t_ppf(F.lit(0.975), F.lit(10.0)).alias("q"),
                                  special.chi2_sf(F.lit(3.84), F.lit(1.0)).alias("c"), special.f_sf(F.lit(4.0), F.lit(2.0), F.lit(10.0)).alias("f"),
                                  special.gammainc(F.lit(2.5), F.lit(3.0)).alias("gi"), special.pearson3_ppf(F.lit(0.99), F.lit(0.0)).alias("p3")))
    assert abs(r["t"] - 0.0733880) < 1e-6 and abs(r["q"] - 2.2281389) < 1e-6 and abs(r["c"] - 0.0500435) < 1e-6
    assert abs(r["f"] - 0.0529221) < 1e-4 and abs(r["gi"] - 0.6937810816778) < 1e-9 and abs(r["p3"] - NormalDist().inv_cdf(0.99)) < 1e-9


def test_exponential_integral_is_continuous(spark):
    d = spark.createDataFrame([(0.01,), (0.5,), (0.999999,), (1.000001,), (3.0,)], "u double").select("u", special.expint1(F.col("u")).alias("e"))
    want = {0.01: 4.03792958, 0.5: 0.55977360, 3.0: 0.01304838}
    got = {r.u: r.e for r in d.collect()}
    for u, e in want.items():
        assert abs(got[u] - e) < 1e-6
    assert abs(got[0.999999] - got[1.000001]) < 1e-6


# ── ranks and quantiles over skewed keys ────────────────────────────────────────


def test_exact_quantiles_match_numpy_on_a_hot_key(spark):
    rng = np.random.default_rng(1)
    hot = np.round(rng.lognormal(1, 2, 6000), 2) * np.where(rng.random(6000) < 0.2, -1, 1)
    rows = [("hot", float(v)) for v in hot] + [("cold", 3.0), ("cold", 5.0), ("zero", 0.0)]
    q = series.exact_quantiles(spark.createDataFrame(rows, "k string, value double"), ["k"], {"a": 0.25, "b": 0.5, "c": 0.9})
    got = {r.k: (r.a, r.b, r.c) for r in q.collect()}
    assert np.allclose(got["hot"], np.quantile(hot, [0.25, 0.5, 0.9]), atol=1e-12)
    assert np.allclose(got["cold"], (3.5, 4.0, 4.8)) and got["zero"] == (0.0, 0.0, 0.0)


def test_value_ranks_share_ties(spark):
    d = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 2.0, -5.0)], "k string, value double")
    r = {x.value: x.r for x in series.value_ranks(d, ["k"]).select("value", series.avg_rank_expr().alias("r")).collect()}
    assert r == {-5.0: 1.0, 1.0: 2.0, 2.0: 3.5}


def test_ks_and_rank_test(spark):
    d = spark.createDataFrame([("k", float(i), float(i + 4)) for i in range(8)], "k string, a double, b double")
    assert one(metrics.two_sample_ks(d, ["k"], "a", "b"))["ks"] == 0.5
    x = spark.createDataFrame([("k", v, v < 3) for v in (1.0, 2.0, 3.0, 4.0)], "k string, value double, f boolean")
    r = one(metrics.rank_test(x, ["k"], F.col("f")))
    assert (r["u"], r["n1"], r["n2"]) == (0.0, 2, 2)


# ── screening and quality ───────────────────────────────────────────────────────


def test_low_ph_limit_counts_as_upper_limit_unless_strict(spark):
    d = spark.createDataFrame([("pH", 7.0, 1)], "parameter string, value double, seq long")
    assert screening.breaches(d, ["WHO"]).count() == 1
    assert screening.breaches(d, ["WHO"], strict_bounds=True).count() == 0


def test_zero_limit_is_critical_and_negative_oxygen_is_info(spark):
    d = spark.createDataFrame([("e_coli", 1.0, 1), ("dissolved_oxygen", -1.0, 2)], "parameter string, value double, seq long")
    sev = {r.parameter: (r.severity, r.ratio) for r in screening.breaches(d, ["WHO"]).collect()}
    assert sev["e_coli"] == ("critical", float("inf")) and sev["dissolved_oxygen"][0] == "info"
    r = one(screening.alert_report(d, ["WHO"]))
    assert (r["critical"], r["warning"], r["info"], r["samples_with_alerts"], r["total_samples"]) == (1, 0, 1, 2, 2)


def test_threshold_listing(spark):
    assert [r[0] for r in dims.threshold_standards(spark).collect()] == ["EPA", "EU_WFD", "WHO"]
    assert dims.thresholds(spark, ["EPA"], "fluoride").count() == 2
    assert dims.threshold_parameters(spark, "WHO").count() == 17


def test_gaps_use_three_median_steps_in_time_order(spark):
    days = [0, 1, 2, 12, 13, 30, 31, 70, 71, 120, 121]
    d = spark.createDataFrame([("s", dt.datetime(2020, 1, 1) + dt.timedelta(days=x)) for x in days], "station_id string, ts timestamp")
    got = [(r.gap_start, r.gap_days) for r in quality.temporal_gaps(d).collect()]
    base = dt.date(2020, 1, 1)
    assert got == [(base + dt.timedelta(days=31), 39), (base + dt.timedelta(days=13), 17), (base + dt.timedelta(days=2), 10)]
    sub = spark.createDataFrame([("s", dt.datetime(2020, 1, 1) + dt.timedelta(hours=6 * i + (240 if i > 20 else 0))) for i in range(40)], "station_id string, ts timestamp")
    assert quality.temporal_gaps(sub).count() == 0


def test_keep_first_and_last(spark):
    d = spark.createDataFrame([("s", 1, "p", 10.0, 0), ("s", 1, "p", 20.0, 1)], "station_id string, ts int, parameter string, value double, seq int")
    assert one(quality.dedupe(d, keep="first"))["value"] == 10.0 and one(quality.dedupe(d, keep="last"))["value"] == 20.0


def test_mapping_drops_sentinels_before_scaling(spark):
    d = spark.createDataFrame([("01/02/2020", "1.234,5"), ("01/03/2020", " -9999 "), ("bad", "3")], "t string, v string")
    rows = readers.apply_mapping(d, "t", "v", 2.0, ",", ("MM/dd/yyyy",)).orderBy("ts").collect()
    assert [r.value for r in rows] == [2469.0, None] and rows[1].was_sentinel


def test_table_reader_sniffs_and_skips_comments(spark, tmp_path):
    (tmp_path / "x.txt").write_text("# note; with; semicolons\nsite_no\tvalue\nA1\t3.5\nA2\t4\n")
    d = readers.read_table(spark, str(tmp_path / "x.txt"))
    assert d.columns == ["site_no", "value"] and d.count() == 2


# ── flow ────────────────────────────────────────────────────────────────────────


def test_recessions_strict_start_and_flat_continuation(spark):
    d = daily(spark, [5, 5, 5, 4, 4, 3, 2, 2, 6, 1])
    seg = baseflow.segment_table(baseflow.recession_segments(d, 5)).collect()
    assert len(seg) == 1 and seg[0].start == D0 + dt.timedelta(days=2) and seg[0].length == 6


def test_well_recession_needs_strict_falls(spark):
    d = daily(spark, [9, 8, 7, 6, 5, 4, 4, 3, 2, 1])
    r = one(baseflow.well_recession_constants(baseflow.well_recessions(d, 5)))
    assert r["n_events"] == 1 and r["mean_constant"] > 0


def test_baseflow_stays_between_zero_and_flow(spark):
    rng = np.random.default_rng(3)
    d = daily(spark, rng.gamma(2, 5, 400))
    for method in ("lyne_hollick", "eckhardt", "ukih"):
        bad = api.separate_baseflow(d, method).where("baseflow < -1e-12 OR baseflow > value + 1e-12").count()
        assert bad == 0


def test_fdc_floor_index(spark):
    r = one(flow.duration_percentiles(daily(spark, range(1, 11)), (10, 50, 99)))
    assert (r["q10"], r["q50"], r["q99"]) == (9.0, 5.0, 1.0)


def test_yearly_spells_break_at_year_end_but_runs_do_not(spark):
    days = [dt.date(1999, 12, 29) + dt.timedelta(days=i) for i in range(6)]
    d = spark.createDataFrame([("a", x, 0.0) for x in days], "station_id string, date date, value double")
    assert sorted(r.longest for r in climate.yearly_spells(d, F.col("value") < 1).collect()) == [3, 3]
    assert one(climate.runs_table(d, F.col("value") < 1))["duration"] == 6


# ── trend, change points ────────────────────────────────────────────────────────


@pytest.mark.parametrize("n", [3, 7, 16, 33, 100])
def test_kendall_score_equals_pairs(spark, n):
    v = np.random.default_rng(n).integers(0, 9, n).astype(float)
    want = int(sum(np.sign(v[j] - v[i]) for i in range(n) for j in range(i + 1, n)))
    assert one(trend.kendall_score(series.numbered(daily(spark, v)), ["station_id"]))["s"] == want



def test_mann_kendall_of_a_line(spark):
    r = one(trend.mann_kendall(daily(spark, [2 * i + 1 for i in range(12)])))
    assert r["s"] == 66 and abs(r["slope"] - 2) < 1e-12 and abs(r["intercept"] - 1) < 1e-12 and r["trend"] == "increasing"


def test_pettitt_finds_a_step(spark):
    r = one(changepoint.pettitt(daily(spark, [1, 2, 1, 2, 1, 2, 9, 8, 9, 8, 9, 8])))
    assert r["index"] == 6 and r["statistic"] == 36.0


def test_pelt_and_segmentation_find_a_step(spark):
    """The segmentation maximises the rank statistic of the first part, so it looks for falls."""
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(8, 1, 60), rng.normal(0, 1, 60)])
    for m in ("pelt", "binary_segmentation"):
        idx = [r["index"] for r in api.change_points(daily(spark, v), m).collect()]
        assert any(abs(i - 60) <= 2 for i in idx)


# ── extremes ────────────────────────────────────────────────────────────────────


def annual(spark, values):
    return spark.createDataFrame([("a", 1950 + i, float(v)) for i, v in enumerate(values)], "station_id string, year long, value double")


def test_lmoments_of_one_to_four(spark):
    r = one(extremes.lmoments(annual(spark, [4, 1, 3, 2])))
    assert abs(r["l1"] - 2.5) < 1e-12 and abs(r["l2"] - 5 / 6) < 1e-12 and abs(r["t3"]) < 1e-12


def test_levels_rise_with_the_period(spark):
    x = annual(spark, np.random.default_rng(2).gumbel(100, 30, 40).round(3))
    for m in ("gev_lmom", "gumbel", "lp3", "ema"):
        lv = [r.level for r in api.flood_frequency(x, m).orderBy("return_period").collect()]
        assert all(a < b for a, b in zip(lv, lv[1:]))
    ci = extremes.gev_bootstrap(x, n_boot=100).collect()
    assert all(r.ci_low <= r.ci_high for r in ci)


def test_gumbel_likelihood_recovers_parameters(spark):
    x = annual(spark, np.random.default_rng(7).gumbel(50, 10, 400))
    r = one(extremes.gumbel(x))
    assert abs(r["loc"] - 50) < 2 and abs(r["scale"] - 10) < 1.5


def test_low_outlier_is_found(spark):
    v = list(np.random.default_rng(4).normal(100, 10, 25)) + [2.0]
    assert one(extremes.grubbs_beck(annual(spark, v)))["n_low"] == 1


# ── metrics ─────────────────────────────────────────────────────────────────────


def test_perfect_fit_and_constant_observations(spark):
    d = spark.createDataFrame([("a", 1.0, 1.0), ("a", 3.0, 3.0), ("b", 2.0, 1.0), ("b", 2.0, 3.0), ("a", float("nan"), 1.0)], "station_id string, obs double, sim double")
    r = {x.station_id: x for x in metrics.fit_metrics(d).collect()}
    assert r["a"].nse == 1.0 and r["a"].n == 2 and abs(r["a"].kge - 1) < 1e-12 and r["b"].nse is None and r["b"].kge is None


def test_single_member_crps_is_absolute_error(spark):
    d = spark.createDataFrame([("k", 1, 3.0, 5.0), ("k", 2, 1.0, 0.5)], "k string, t int, obs double, sim double")
    assert abs(one(metrics.crps_ensemble(d, ["k"], "t"))["crps"] - 1.25) < 1e-12


# ── networks and similarity ─────────────────────────────────────────────────────


def test_network_sums_paths_and_orders(spark):
    e = spark.createDataFrame([(1, 3), (2, 3), (3, 5), (4, 5), (5, 6), (6, None)], "v long, j long")
    ptr, jumps = network.prepare(network.pointers(e, "v", "j"))
    acc = {r.v: r.accumulation for r in network.flow_accumulation(ptr, jumps).collect()}
    assert acc == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 6}
    start = spark.createDataFrame([(1,)], "v long")
    assert sorted((r.step, r.v) for r in network.downstream_path(start, jumps).collect()) == [(0, 1), (1, 3), (2, 5), (3, 6)]
    assert {r.v: r.strahler for r in network.strahler(ptr, jumps).collect()} == {1: 1, 2: 1, 3: 2, 4: 1, 5: 2, 6: 2}
    out = spark.createDataFrame([(3,), (6,)], "v long")
    assert {r.v: r.outlet for r in network.members(ptr, out).collect()} == {1: 3, 2: 3, 3: 3, 4: 6, 5: 6, 6: 6}


def test_flat_cells_do_not_loop(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (4, 1)], "v long, j long")
    ptr, jumps = network.prepare(network.pointers(e, "v", "j"))
    acc = {r.v: r.accumulation for r in network.flow_accumulation(ptr, jumps).collect()}
    assert acc[4] == 1 and acc[1] == 2 and acc[2] == 3 and acc[3] == 1


def test_block_size_does_not_change_results(spark):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"station_id": range(60), "lat": rng.random(60) * 10, "lon": rng.random(60) * 10, "value": rng.random(60)})
    d = spark.createDataFrame(pdf)
    a = [tuple(round(x, 9) for x in r) for r in similarity.variogram(d, rows_per_block=1000).orderBy("bin").collect()]
    b = [tuple(round(x, 9) for x in r) for r in similarity.variogram(d, rows_per_block=13).orderBy("bin").collect()]
    assert a == b
    f = spark.createDataFrame(pdf.rename(columns={"station_id": "id", "lat": "f0", "lon": "f1"})[["id", "f0", "f1"]])
    t = similarity.block_topk(f, f, 4, lambda x, y: np.abs(x["f0"].to_numpy()[:, None] - y["f0"].to_numpy()[None, :]), lambda x, b: similarity._gap(x["f0"].to_numpy(), b, "f0"), ["f0"], 1000)
    u = similarity.block_topk(f, f, 4, lambda x, y: np.abs(x["f0"].to_numpy()[:, None] - y["f0"].to_numpy()[None, :]), lambda x, b: similarity._gap(x["f0"].to_numpy(), b, "f0"), ["f0"], 17)
    assert sorted(map(tuple, t.collect())) == sorted(map(tuple, u.collect()))


# ── climate, groundwater ────────────────────────────────────────────────────────


def test_spi_is_centred_and_zero_share_is_kept(spark):
    rng = np.random.default_rng(11)
    rows = [("a", dt.date(1970 + i // 12, i % 12 + 1, 1), float(v)) for i, v in enumerate(np.where(rng.random(480) < 0.1, 0, rng.gamma(2, 30, 480)))]
    m = spark.createDataFrame(rows, "station_id string, date date, value double")
    r = one(climate.spi(m, 1).agg(F.avg("spi").alias("m"), F.stddev("spi").alias("s"), F.count("spi").alias("n")))
    assert r["n"] == 480 and abs(r["m"]) < 0.15 and 0.8 < r["s"] < 1.2


def test_quantile_mapping_of_identical_series_is_identity(spark):
    d = daily(spark, np.random.default_rng(1).random(200))
    j = climate.quantile_mapping(d, d, d).alias("a").join(d.alias("b"), ["station_id", "date"]).select((F.col("a.value") - F.col("b.value")).alias("e"))
    assert one(j.agg(F.max(F.abs("e")).alias("e")))["e"] < 1e-9


def test_transmissivity_round_trip(spark):
    t = spark.createDataFrame([("w", float(i)) for i in range(1, 40)], "well string, time double")
    dd = groundwater.cooper_jacob(F.lit(500.0), F.lit(120.0), F.lit(3e-4), F.lit(30.0), F.col("time"))
    r = one(groundwater.transmissivity(t.withColumn("drawdown", dd), F.lit(500.0), F.lit(30.0)))
    assert abs(r["transmissivity"] - 120) < 1e-6 and abs(r["storativity"] - 3e-4) < 1e-9


# ── streaming twins ─────────────────────────────────────────────────────────────


def test_stream_plans_equal_batch_plans(spark, tmp_path):
    rows = [("s", "p", dt.datetime(2020, 1, 1) + dt.timedelta(hours=7 * i), float(i)) for i in range(80)]
    d = spark.createDataFrame(rows, "station_id string, parameter string, ts timestamp, value double")
    d.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    q = jobs.daily_mean(src).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.date, r.value, r.n) for r in spark.read.parquet(out).collect()}
    batch = {(r.date, r.value, r.n) for r in jobs.daily_mean(d).collect()}
    assert got and got <= batch and len(batch - got) <= 3


def test_alert_sink_skips_empty_batches(spark):
    seen = []
    handle = jobs.alert_sink(lambda df, i: seen.append(i))
    d = spark.range(1)
    handle(d, 1)
    handle(d.limit(0), 2)
    assert seen == [1]


# ── one method at every size ────────────────────────────────────────────────────
def test_median_slope_takes_one_path_at_all_lengths():
    from limnos.operators.trend import median_slope
    r = np.random.default_rng(1)
    for n in (2, 3, 63, 64, 65, 2999, 3001):
        for v in (r.standard_normal(n), r.integers(0, 4, n).astype(float), np.full(n, 7.0)):
            i, j = np.triu_indices(n, 1)
            assert abs(median_slope(v) - np.median((v[j] - v[i]) / (j - i))) < 1e-12


def test_networks_know_no_largest_order_and_cut_cycles(spark):
    import inspect
    from limnos.operators import network
    assert "max_order" not in inspect.signature(network.strahler).parameters
    ptr = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 3), (5, 6), (6, None)], "v long, j long")
    got = {(r.v, r.outlet) for r in network.members(ptr, spark.createDataFrame([(6,)], "v long")).collect()}
    assert got == {(5, 6), (6, 6)}


def test_area_weighted_attribute_without_data_is_null(spark):
    from limnos.operators import network
    t = spark.createDataFrame([(1, 2, 4.0, -9999.0), (2, None, 6.0, -9999.0), (3, None, 5.0, 8.0)], "v long, j long, sub_area double, rain double")
    p, jumps = network.prepare(t.select("v", "j"))
    out = {r.v: (r.rain_mean, r.rain_sum) for r in network.area_weighted(t, jumps, ["rain"], ["rain"]).collect()}
    assert out == {1: (None, None), 2: (None, None), 3: (8.0, 8.0)}


def test_delimiter_counts_all_lines(spark, tmp_path):
    from limnos.sources import readers
    (tmp_path / "t.txt").write_text("# a,b,c,d,e,f,g\n" + "x\n" * 80 + "a;b;c\n" * 5)
    assert readers.sniff_delimiter(spark, str(tmp_path / "t.txt")) == ";"
    (tmp_path / "m.json").write_text('{"data": [\n {"a": 1},\n {"a": 2}\n]}')
    assert sorted(r.a for r in readers.read_table(spark, str(tmp_path / "m.json"), "json", multi_line=True).collect()) == [1, 2]


def test_feature_floor_and_spread_of_large_values(spark):
    from limnos.operators import similarity as sim
    f = [sim.Feature("a", None, 1.0)]
    d = sim.feature_table(spark.createDataFrame([(i, 1e9 + i) for i in range(5)], "k long, a double"), "k", f)
    near = {r.target: r.donor for r in sim.similar(d, d, f, 1).collect()}
    assert near[0] == 1 and near[4] == 3
    score = sim.similar(d, d, f, 1).where("target = 0").first().score
    assert abs(score - 1 / np.std([1, 2, 3, 4])) < 1e-6
    tiny = spark.createDataFrame([(1, 1e-5)], "k long, a double")
    assert sim.feature_table(tiny, "k", [sim.Feature("a", "log10", 1.0)]).first().f0 == -3.0


def test_ridge_estimates_stay_in_physical_bounds(spark):
    from limnos.operators import similarity as sim
    f = [sim.Feature("a", None, 1.0)]
    d = sim.feature_table(spark.createDataFrame([(i, float(i)) for i in range(40)], "k long, a double"), "k", f)
    v = spark.createDataFrame([(i, "bfi", 0.1 * i - 1) for i in range(40)], "id long, signature string, value double")
    out = sim.ridge_estimates(d, d, v, 1, bounds={"bfi": (0.0, 1.0)}).collect()
    assert out and all(0 <= x <= 1 for r in out for x in (r.estimate, r.low, r.high))


def test_regional_skew_draws_the_censored_fit(spark):
    v = list(np.exp(np.random.default_rng(4).normal(3, 0.5, 30))) + [0.0, 0.0]
    a = annual(spark, v)
    far = lambda g: extremes.ema_censored(a, periods=[100.0], regional_skew=g).first().level
    own = extremes.ema_censored(a, periods=[100.0]).first()
    assert own.n_censored == 2 and far(-2.0) < own.level < far(2.0)


def test_transfer_never_sees_the_late_half(spark):
    import datetime as dt
    from limnos.operators import learn
    r = np.random.default_rng(2)
    rows = []
    for s in (1, 2):
        for i in range(200):
            x = float(r.normal())
            rows.append((s, dt.date(2000, 1, 1) + dt.timedelta(i), x, (2 * x if i < 100 else -2 * x)))  # the relation turns where the late half begins
    f = spark.createDataFrame(rows, "station_id long, date date, lag_1 double, y double")
    out = learn.transfer(f, spark.createDataFrame([(1, 2), (2, 1), (1, 1)], "target long, donor long")).collect()
    assert len(out) == 2 and all(x.r2 < -1 for x in out)


def test_exchange_path_has_start_and_median_step(spark):
    import datetime as dt
    from limnos.sources import sinks
    t0 = dt.datetime(2020, 3, 5)
    rows = [("a", "q", t0 + dt.timedelta(minutes=15 * i), 1.0) for i in range(5)] + [("b", "q", t0, 1.0)] + [("c", "q", t0 + dt.timedelta(days=d), 1.0) for d in (0, 1, 2, 40)]
    out = {r.station_id: r.pathname for r in sinks.hec_records(spark.createDataFrame(rows, "station_id string, parameter string, ts timestamp, value double"), "ts").collect()}
    assert out == {"a": "/UNKNOWN/a/q/05MAR2020/15MIN/OBS/", "b": "/UNKNOWN/b/q/05MAR2020/IR-YEAR/OBS/", "c": "/UNKNOWN/c/q/05MAR2020/1DAY/OBS/"}
