"""Variogram by blocks against all pairs, with clusters whose pairs come from sums alone."""

import math
import random

import numpy as np
import pytest

from limnos.operators import similarity as S


def stations(spark, n):
    r, rows = random.Random(3), []
    for i in range(n):
        lat, lon = [(0, 0), (10, 3), (4, 40), (-30, 20)][i % 4]
        spread = 0.05 if i % 5 else 6.0
        rows.append((i, lat + r.gauss(0, spread), lon + r.gauss(0, spread), 1e4 + r.gauss(0, 3) + lat))
    rows += [(n + k, *rows[0][1:]) for k in range(2)]  # equal places are in no bin
    return spark.createDataFrame(rows, "station_id long, lat double, lon double, value double"), rows


def by_force(rows, bins):
    x, v = np.array([r[1:3] for r in rows]), np.array([r[3] for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    edges = np.linspace(0, d.max() / 2, bins + 1)
    out = {}
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            b = int(np.searchsorted(edges, d[i, j], "left")) - 1
            if 0 <= b < bins:
                c, s = out.get(b, (0, 0.0))
                out[b] = c + 1, s + (v[i] - v[j]) ** 2
    return {b: (c, s / c / 2) for b, (c, s) in out.items()}, d.max() / 2


@pytest.mark.parametrize("size", [10_000, 60, 12])
def test_variogram_by_force(spark, size):
    df, rows = stations(spark, 300)
    want, half = by_force(rows, 15)
    got = {r["bin"]: r for r in S.variogram(df, 15, size).collect()}
    assert {b: r["pairs"] for b, r in got.items()} == {b: c for b, (c, _) in want.items()}
    for b, r in got.items():
        assert r["gamma"] == pytest.approx(want[b][1], rel=1e-7) and r["bin_center"] == pytest.approx((b + 0.5) * half / 15, rel=1e-12)


def test_hull_and_farthest():
    r = np.random.default_rng(2)
    for n in (1, 2, 3, 50, 400):
        p = r.normal(size=(n, 2))
        d = math.sqrt(((p[:, None] - p[None]) ** 2).sum(2).max())
        assert S._farthest(p) == pytest.approx(d, rel=1e-12) and len(S.hull(p)) <= n
    assert S._farthest(np.array([[0.0, 0], [1, 1], [2, 2], [3, 3]])) == pytest.approx(math.sqrt(18))


def test_no_and_one_station(spark):
    df, _ = stations(spark, 4)
    assert S.variogram(df.limit(0)).collect() == [] and S.variogram(df.limit(1)).collect() == []
