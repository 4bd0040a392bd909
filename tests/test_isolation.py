"""Isolation forest: the Catalyst walk against a plain one, tree shape, planted points."""

import datetime as dt

import numpy as np
import pytest

from limnos.operators.isolation import forests, grow_trees, isolation_scores, path_lengths, usual_path

NAMES = ["a", "b", "c"]


def table(spark, planted=True, n=600):
    r = np.random.default_rng(1)
    rows = []
    for key in ("p", "q"):
        x = r.normal(size=(n, 3))
        if planted and n > 501:
            x[7], x[300], x[501] = (9, -9, 9), (-8, 8, 8), (10, 10, -9)
        rows += [(key, dt.date(2000, 1, 1) + dt.timedelta(days=i), float(x[i].sum()), *[float(v) for v in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "station_id string, date date, y double, a double, b double, c double")


def walk(tree, x):
    """Path of a row by comparisons alone."""
    slot, inner = 0, len(tree["feature"])
    while slot < inner:
        slot = 2 * slot + 1 + (x[tree["feature"][slot]] > tree["split"][slot])
    return tree["path"][slot - inner]


def test_paths_equal_a_plain_walk(spark):
    df = table(spark)
    forest = forests(df, NAMES, trees=7, sample=64)
    held = {r["station_id"]: r["forest"] for r in forest.collect()}
    assert {len(f) for f in held.values()} == {7} and {len(t["path"]) for f in held.values() for t in f} == {64}
    rows = {(r["station_id"], r["date"]): [r[c] for c in NAMES] for r in df.collect()}
    got = path_lengths(df, forest, NAMES, ["y"]).collect()
    assert len(got) == len(rows)
    for r in got:
        want = np.mean([walk(t, rows[r["station_id"], r["date"]]) for t in held[r["station_id"]]])
        assert r["path"] == pytest.approx(want, abs=1e-12)


def test_tree_keeps_every_row():
    """Rows that end in a slot are as many as its path length says, and equal rows are never parted."""
    r = np.random.default_rng(5)
    x = np.repeat(r.integers(0, 4, (40, 2)), 3, axis=0).astype(float)
    feature, split, path = grow_trees(np.tile(x, (2, 1)), np.repeat([0, 1], len(x)), 2, 7, r)
    for k in range(2):
        slots = {}
        for row in x:
            slot = 0
            while slot < 127:
                slot = 2 * slot + 1 + (row[feature[k, slot]] > split[k, slot])
            slots.setdefault(slot - 127, []).append(row)
        for end, rows in slots.items():
            assert len(rows) % 3 == 0  # a tree parts all but equal rows, or ends at its height
            depth = path[k, end] - usual_path(len(rows))
            assert depth == pytest.approx(round(depth)) and 0 < depth <= 7
    assert usual_path(1) == 0 and usual_path(2) == 1 and usual_path(256) == pytest.approx(10.244, abs=1e-3)


def test_isolated_points_rank_first(spark):
    got = isolation_scores(table(spark), NAMES, contamination=0.01).collect()
    for key in ("p", "q"):
        own = sorted((r for r in got if r["station_id"] == key), key=lambda r: -r["anomaly_score"])
        first = {(r["date"] - dt.date(2000, 1, 1)).days for r in own[:3]}
        assert first == {7, 300, 501}
        assert sum(r["is_anomaly"] for r in own) == 6 and all(r["is_anomaly"] for r in own[:6])
        assert all(0 < r["anomaly_score"] < 1 for r in own)


def test_repeatable_and_small_keys(spark):
    df = table(spark, n=40).limit(41)
    one = sorted(map(tuple, isolation_scores(df, NAMES, trees=5).collect()))
    assert one == sorted(map(tuple, isolation_scores(df.repartition(3), NAMES, trees=5).collect())) and len(one) == 41
    assert isolation_scores(df.limit(0), NAMES, trees=5).count() == 0


def test_forest_of_a_key_is_walked_where_it_grows(spark):
    """Paths as of forests that are written, trees walked all at once or one by one."""
    from limnos.operators.isolation import forest_paths, walk, walk_all

    rng = np.random.default_rng(3)
    rows = [(k, i, float(rng.normal()), float(rng.integers(0, 5)), 1.0) for k, n in (("a", 90), ("b", 7), ("c", 1)) for i in range(n)] + [(None, i, 2.0, 2.0, 0.0) for i in range(3)]
    df = spark.createDataFrame(rows, "station_id string, date int, p double, q double, y double")
    one = path_lengths(df, forests(df, ["p", "q"], 12, 32), ["p", "q"], ["y"])
    other = forest_paths(df, ["p", "q"], ["y"], 12, 32)
    order = lambda d: sorted(map(str, d.collect()))
    assert other.columns == one.columns and order(other.where("station_id is not null")) == order(one.where("station_id is not null"))
    assert other.count() == len(rows)
    x = rng.normal(size=(70, 2))
    f, s, p = grow_trees(np.tile(x, (5, 1)), np.repeat(np.arange(5), 70), 5, 4, rng)
    trees = [{"feature": a, "split": b, "path": c} for a, b, c in zip(f, s, p)]
    assert walk(trees, x).tolist() == walk_all(f, s, p, x).tolist()
