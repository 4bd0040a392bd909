"""Cell search against all distances: clusters, dateline, poles, equal places, few donors."""

import math
import random

import pytest

from limnos.operators import nearest as G


def km(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def places(seed, n, first=0):
    r, out = random.Random(seed), []
    for i in range(n):
        kind = r.random()
        if kind < 0.5:  # a crowded town
            out.append((48.0 + r.gauss(0, 0.02), 11.0 + r.gauss(0, 0.02)))
        elif kind < 0.6:
            out.append((r.uniform(-5, 5), r.choice([-1, 1]) * r.uniform(179.5, 180)))
        elif kind < 0.65:
            out.append((r.choice([-90.0, 90.0, 89.9]), r.uniform(-180, 180)))
        elif kind < 0.7:
            out.append((10.0, 20.0))  # many at one place
        else:
            out.append((r.uniform(-90, 90), r.uniform(-180, 180)))
    return [(first + i, lat, lon) for i, (lat, lon) in enumerate(out)]


KIND = "station_id long, latitude double, longitude double"


@pytest.mark.parametrize("k,leaf,skip", [(3, 4, False), (7, 32, False), (2, 1, True), (1, 2, False)])
def test_nearest_by_force(spark, k, leaf, skip, monkeypatch):
    monkeypatch.setattr(G, "LEAF", leaf)
    donors, targets = places(1, 300), places(2, 60) if not skip else places(1, 60)
    df = spark.createDataFrame(donors + [(900, None, 3.0)], KIND)
    got = {}
    for r in G.nearest(spark.createDataFrame(targets + [(901, 1.0, None)], KIND), df, k, skip_self=skip).collect():
        got.setdefault(r["target"], {})[r["place"]] = r["donor"]
    assert set(got) == {t[0] for t in targets}
    for t in targets:
        want = sorted((round(km(t, d), 6), d[0]) for d in donors if not (skip and d[0] == t[0]))[:k]
        assert [got[t[0]][i + 1] for i in range(k)] == [d for _, d in want]


def test_few_donors_and_weights(spark):
    targets, donors = spark.createDataFrame([(1, 0.0, 179.9), (2, 45.0, 0.0)], KIND), spark.createDataFrame([(7, 0.0, -179.9), (8, 45.0, 0.0)], KIND)
    got = {(r["target"], r["donor"]): r for r in G.spatial_weights(targets, donors, 5).collect()}
    assert len(got) == 4 and got[1, 7]["km"] == pytest.approx(22.239, abs=1e-2)
    for t in (1, 2):
        assert got[t, 7]["weight"] + got[t, 8]["weight"] == pytest.approx(1)
    assert got[2, 8]["weight"] > 0.999999
    assert G.nearest(targets, donors.limit(0), 3).count() == 0
