"""Prefix scans of clamped recursions against plain loops, and the operators that use them."""

import datetime as dt

import numpy as np
import pytest

from limnos.operators import agri, baseflow, changepoint, climate
from limnos.operators.scan import between_resets, clamped_scan


def by_loop(a, b, lo, hi, x):
    out = []
    for s, t, low, high in zip(np.broadcast_to(a, len(b)), b, np.broadcast_to(lo, len(b)), np.broadcast_to(hi, len(b))):
        x = min(max(s * x + t, low), high)
        out.append(x)
    return np.array(out)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 100, 1001])
def test_scan_equals_loop(n):
    r = np.random.default_rng(n)
    a, b = r.uniform(0.2, 1.1, n), r.normal(size=n)
    lo = r.uniform(-1, 0, n)
    hi = lo + r.uniform(0, 2, n)
    np.testing.assert_allclose(clamped_scan(a, b, lo, hi, 0.3), by_loop(a, b, lo, hi, 0.3), atol=1e-12)
    np.testing.assert_allclose(clamped_scan(1.0, b, 0.0, np.inf, 0.0), by_loop(1.0, b, 0.0, np.inf, 0.0), atol=1e-11)
    np.testing.assert_allclose(clamped_scan(0.9, b, -np.inf, np.inf, 5.0), by_loop(0.9, b, -np.inf, np.inf, 5.0), atol=1e-11)


def test_resets_cover_every_row_once():
    seen, jump = [], {5, 6, 70, 400}

    def scan(at, to):
        return np.array([i in jump for i in range(at, to)]), lambda k: seen.extend(range(at, at + k + 1))

    between_resets(1000, scan)
    assert seen == list(range(1000))


def daily(spark, columns, n, seed=3):
    r = np.random.default_rng(seed)
    rows = []
    for key in ("a", "b"):
        values = [r.gamma(0.6, 8.0, n) for _ in columns]
        rows += [(key, dt.date(2001, 1, 1) + dt.timedelta(days=i), *[float(v[i]) for v in values]) for i in range(n)]
    return spark.createDataFrame(rows, "station_id string, date date, " + ", ".join(f"{c} double" for c in columns)), rows


def per_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_filters(spark):
    df, rows = daily(spark, ["value"], 300)
    lh = {(r["station_id"], r["date"]): r for r in baseflow.lyne_hollick(df).collect()}
    ek = {(r["station_id"], r["date"]): r for r in baseflow.eckhardt(df).collect()}
    for key, own in per_key(rows).items():
        q = [r[2] for r in own]
        qf = [0.0] * len(q)
        for p in range(3):
            order = range(1, len(q)) if p % 2 == 0 else range(len(q) - 2, -1, -1)
            back = -1 if p % 2 == 0 else 1
            for i in order:
                qf[i] = min(max(0.0, 0.925 * qf[i + back] + (1 + 0.925) / 2 * (q[i] - q[i + back])), q[i])
        b = min(q[0], q[0] * 0.8)
        for i, r in enumerate(own):
            if i:
                b = max(min((0.2 * 0.98 * b + 0.02 * 0.8 * q[i]) / (1 - 0.98 * 0.8), q[i]), 0.0)
            assert lh[key, r[1]]["quickflow"] == pytest.approx(qf[i], abs=1e-9)
            assert ek[key, r[1]]["baseflow"] == pytest.approx(b, abs=1e-9)


@pytest.mark.parametrize("refill", [False, True])
def test_soil_balance(spark, refill):
    df, rows = daily(spark, ["etc", "precip"], 250)
    got = {(r["station_id"], r["date"]): r for r in agri.soil_balance(df, 60.0, 20.0, 5.0, refill).collect()}
    for key, own in per_key(rows).items():
        dep = 5.0
        for _, day, etc, rain in own:
            net = dep if refill and dep >= 20.0 else 0.0
            raw = dep - net - rain + etc
            dep = min(max(raw, 0.0), 60.0)
            r = got[key, day]
            assert r["depletion"] == pytest.approx(dep, abs=1e-9) and r["irrigation"] == pytest.approx(net / 0.7, abs=1e-9)
            assert r["deep_percolation"] == pytest.approx(max(0.0, -raw), abs=1e-9) and r["irrigation_trigger"] == (dep >= 20.0)


def test_cusum_resets(spark):
    df, rows = daily(spark, ["value"], 400)
    got = sorted((r["station_id"], r["index"], round(r["statistic"], 8)) for r in changepoint.cusum(df, 0.1, 2.0).collect())
    want = []
    for key, own in per_key(rows).items():
        v = np.array([r[2] for r in own])
        limit, up, down = 2.0 * v.std(ddof=1), 0.0, 0.0
        for i, x in enumerate(v - v.mean()):
            up, down = max(0.0, up + x - 0.1), max(0.0, down - x - 0.1)
            if up > limit:
                want.append((key, i, round(up, 8)))
                up = 0.0
            elif down > limit:
                want.append((key, i, round(down, 8)))
                down = 0.0
    assert got == sorted(want) and len(want) > 4


def test_palmer_index(spark):
    df, rows = daily(spark, ["precip", "pet"], 200)
    got = {(r["station_id"], r["date"]): r["pdsi"] for r in climate.pdsi(df, 30.0).collect()}
    for key, own in per_key(rows).items():
        p, pe = np.array([r[2] for r in own]), np.array([r[3] for r in own])
        s, u, et = 10.0, 20.0, []
        for rain, want in zip(p, pe):
            a = min(want, s)
            b = min(want - a, u)
            et.append(a + b)
            s, u = s - a, u - b
            fill = min(rain, 10.0 - s)
            s, u = s + fill, u + min(rain - fill, 20.0 - u)
        d = p - (np.array(et) / pe).mean() * pe
        z, x = d / (d.std() + 1e-10), 0.0
        for i, r in enumerate(own):
            x = 0.897 * x + z[i] / 3 if i else 0.0
            assert got[key, r[1]] == pytest.approx(x, abs=1e-8)
