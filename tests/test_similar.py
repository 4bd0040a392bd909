"""Block pruning against all pairs: clusters, missing values, equal donors, every method."""

import math
import random

import numpy as np
import pandas as pd
import pytest

from limnos.operators import similarity as S

FEATS = (S.Feature("a", None, 1.5), S.Feature("b", "log1p", 1.0), S.Feature("c", "log10", 0.7))


def catchments(spark, n=240):
    r, rows = random.Random(8), []
    for i in range(n):
        mid = [(0, 5, 100), (40, 1, 3), (-30, 80, 9000)][i % 3]
        v = [m + r.gauss(0, 1) if i % 10 else float(m) for m in mid]  # every tenth is one of three equal ones
        rows.append((i, *[x if r.random() > 0.06 else None for x in v], r.uniform(-89, 89) if i % 29 else None, r.uniform(-180, 180)))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, lat double, lon double"), rows


def scores_by_force(rows, method):
    how = [lambda x: x, lambda x: math.log1p(max(x, 0)), lambda x: math.log10(max(x, 1e-3))]
    f = {r[0]: [None if v is None else h(v) for h, v in zip(how, r[1:4])] for r in rows}
    out = {}
    for t in rows:
        sd = []
        for i in range(3):
            x = [v[i] for d, v in f.items() if d != t[0] and v[i] is not None]
            sd.append(np.std(x) or 1.0)
        for d in rows:
            if d[0] == t[0]:
                continue
            acc = tot = 0.0
            for i, ft in enumerate(FEATS):
                if f[t[0]][i] is not None:
                    z = 3.0 if f[d[0]][i] is None else abs(f[d[0]][i] - f[t[0]][i]) / sd[i]
                    acc, tot = acc + (z * ft.weight) ** 2, tot + ft.weight ** 2
            attr = math.sqrt(acc / max(tot, 1e-9))
            if None in (t[4], d[4]):
                km = 1e9
            else:
                p, q = math.radians(t[4]), math.radians(d[4])
                h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d[5] - t[5]) / 2) ** 2
                km = 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))
            out[t[0], d[0]] = {"similarity": attr, "proximity": km, "combined": math.hypot(attr, km / 500)}[method]
    return out


@pytest.mark.parametrize("method", ["similarity", "proximity", "combined"])
def test_pruned_search_by_force(spark, method):
    df, rows = catchments(spark)
    table = S.feature_table(df, "id", FEATS, ["lat", "lon"])
    force = scores_by_force(rows, method)
    for size in (10_000, 25):
        got = {}
        for r in S.similar(table, table, FEATS, 6, method, size).collect():
            got.setdefault(r["target"], []).append((r["place"], r["score"], r["donor"]))
        assert set(got) == {r[0] for r in rows}
        for t, own in got.items():
            want = sorted(v for (a, _), v in force.items() if a == t)[:6]
            own = sorted(own)
            np.testing.assert_allclose([s for _, s, _ in own], want, rtol=1e-7, atol=1e-7)
            assert len({d for *_, d in own}) == 6
            for _, s, d in own:
                assert force[t, d] == pytest.approx(s, rel=1e-7, abs=1e-7)


def test_pruned_signatures(spark):
    df, rows = catchments(spark)
    d = df.select("id", "a", "b", "c")
    one = {(r["target"], r["place"]): round(r["score"], 9) for r in S.signature_distance(d, d, ["a", "b", "c"], 5).collect()}
    many = {(r["target"], r["place"]): round(r["score"], 9) for r in S.signature_distance(d, d, ["a", "b", "c"], 5, rows_per_block=20).collect()}
    assert one == many and len(one) == 5 * len(rows)


def test_splits_part_clusters(spark):
    """Blocks are of similar size, rows in one block share a cluster."""
    df, rows = catchments(spark, 300)
    known = df.fillna(0.0, ["a", "b", "c"])
    splits = S.Splits.of(known.select("a", "b", "c").toPandas(), ["a", "b", "c"], 8)
    got = known.select("id", splits.place(known).alias("block")).collect()
    sizes = [sum(r["block"] == b for r in got) for b in range(8)]
    assert sum(sizes) == 300 and max(sizes) <= 80
    pure = sum(len({r["id"] % 3 for r in got if r["block"] == b}) <= 2 for b in range(8))
    assert pure >= 6


def test_ranking_with_filters(spark):
    rows = [(i, f"s{i % 2}", ["discharge"] if i % 3 else ["level"], float(i), 0.0, 10.0 * i, 1.0, 2.0) for i in range(12)]
    st = spark.createDataFrame(rows, "id long, source string, variables array<string>, latitude double, longitude double, a double, b double, c double")
    ranked, deltas = S.similar_basins(st, st, FEATS, 3, "similarity", sources=["s1"])
    allowed = {i for i in range(12) if i % 2 == 1 and i % 3}
    got = ranked.collect()
    assert {r["donor"] for r in got} <= allowed and all(r["target"] != r["donor"] for r in got) and len(got) == 36
    assert all(r["distance_km"] is None and r["similarity_distance"] == r["score"] for r in got)
    first = {(r["donor"], r["target"], r["feature"]): (r["station"], r["own"]) for r in deltas.collect()}
    assert all(first[r["donor"], r["target"], "a"] == (10.0 * r["donor"], 10.0 * r["target"]) for r in got) and len(first) == 108


def test_blocks_are_cut_along_what_decides_the_score(spark, monkeypatch):
    """Places around the globe outweigh many attributes: most blocks are too far away to be met."""
    rng = np.random.default_rng(8)
    n, names = 2000, [f"e{i}" for i in range(8)]
    pdf = pd.DataFrame(rng.normal(size=(n, 8)), columns=names)
    u = rng.normal(size=(n, 3))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    pdf = pdf.assign(id=np.arange(n), lat=np.degrees(np.arcsin(u[:, 2])), lon=np.degrees(np.arctan2(u[:, 1], u[:, 0])))
    compared, real = spark.sparkContext.accumulator(0), S.block_topk

    def counted(targets, donors, k, distance, *rest, **more):
        def count(a, b):
            compared.add(len(a) * len(b))
            return distance(a, b)
        return real(targets, donors, k, count, *rest, **more)

    monkeypatch.setattr(S, "block_topk", counted)
    features = [S.Feature(c) for c in names]
    t = S.feature_table(spark.createDataFrame(pdf), "id", features, ("lat", "lon"))
    top = S.similar(t, t, features, 3, "combined", rows_per_block=50)
    assert top.count() == 3 * n
    assert compared.value < 0.35 * n * n
