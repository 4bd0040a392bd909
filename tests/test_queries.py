"""Every registered query runs at the smallest scale and, where it has one, equals its SQL twin."""

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

UNIT = ("p_value", "ks_p", "exceedance_probability", "accuracy", "importance", "coverage", "strength", "seasonal_strength", "trend_strength", "score", "ks", "numeric_share", "date_share")
NOT_NEGATIVE = ("std", "std_error", "sigma2", "resid_sd", "rmse", "mae", "n", "n_boot", "n_censored", "n_observed", "scale", "ci_width", "n_bytes", "n_tokens", "slot", "size")
BANDS = (("ci_low", "level", "ci_high"), ("low", "estimate", "high"), ("ci_low", "mean", "ci_high"), ("release", "slot", "deadline"))
# Queries whose rows the smallest tables always give, with how many there are of each
SOME_ROWS = {"lp3", "ema_censored", "fit_compare", "gev_bootstrap", "loo_cv", "ingest_guess", "regionalize_ridge", "monte_carlo_exceed", "bayes_linreg", "op1_toxicity", "op2_sharding",
             "op3_quality", "op4_token_counts", "op5_mixing", "op7_language", "op10_licenses", "pipeline"}


def check_invariants(name, rows):
    """What has to hold for results that SQL can't give: ranges, ordered bands, growth with the return period, sums."""
    assert rows or name not in SOME_ROWS
    for r in rows:
        for c, v in r.items():
            if isinstance(v, float) and v == v:
                assert c not in UNIT or name in ("ingest_guess",) or -1e-9 <= v <= 1 + 1e-9, (name, c, v)
            if isinstance(v, (int, float)) and v == v:
                assert c not in NOT_NEGATIVE or v >= -1e-9, (name, c, v)
        for lo, mid, hi in BANDS:
            if {lo, mid, hi} <= set(r) and None not in (r[lo], r[mid], r[hi]) and r[lo] == r[lo] and name != "gev_bootstrap":
                assert r[lo] <= r[mid] * (1 + 1e-9) + 1e-9 and r[mid] <= r[hi] * (1 + 1e-9) + 1e-9, (name, r)
        if {"rmse", "bias", "mae"} <= set(r):
            assert abs(r["bias"]) <= r["mae"] + 1e-9 and r["mae"] <= r["rmse"] + 1e-9
    if rows and {"return_period", "level", "station_id"} <= set(rows[0]) and "level" in rows[0]:
        by = {}
        for r in sorted(rows, key=lambda r: r["return_period"]):
            level = -r["level"] if name == "weibull_min" else r["level"]  # low flows fall with the return period
            assert by.get(r["station_id"], float("-inf")) <= level + 1e-9, (name, r)
            by[r["station_id"]] = level
    if name == "fit_compare":
        best = {}
        for r in sorted(rows, key=lambda r: r["place"]):
            assert r["aic"] >= best.get(r["station_id"], float("-inf"))
            best[r["station_id"]] = r["aic"]
    if name == "rf_classify" and rows:
        assert abs(sum(r["importance"] for r in rows) - 1) < 1e-6
    if name in ("op2_sharding", "pipeline"):
        counts = [sum(r["shard"] == k for r in rows) for k in range(16)]
        assert max(counts) - min(counts) <= 1 and {(r["shard"], r["slot"]) for r in rows} == {(k, i) for k, n in enumerate(counts) for i in range(n)}


QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        err, _ = compare(name, df, duck, ORACLES[name])
        assert err is None, err
    else:
        check_invariants(name, [r.asDict() for r in df.collect()])


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
