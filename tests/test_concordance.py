"""Bucketed Kendall counts against all pairs, with ties, a hot value and keys of very different size."""

import math
import random

import numpy as np
import pytest

from limnos.operators.concordance import bucketed, kendall_tau_b, pair_dependence


def pairs_table(spark):
    r, rows = random.Random(4), []
    for key, n in (("a", 400), ("b", 90), ("c", 8), ("d", 1), ("e", 30)):
        for _ in range(n):
            x = 0.0 if r.random() < 0.35 else r.choice([r.gauss(0, 1), float(r.randint(-3, 3))])
            y = 5.0 if key == "e" or r.random() < 0.3 else x * 0.4 + r.gauss(0, 1) if r.random() < 0.7 else float(r.randint(0, 2))
            rows.append((key, x, y))
    rows += [("a", None, 1.0), ("a", 1.0, None)]
    return spark.createDataFrame(rows, "key string, x double, y double"), [r for r in rows if None not in r]


def by_force(own):
    sign = lambda d: (d > 0) - (d < 0)
    s = sum(sign(a[1] - b[1]) * sign(a[2] - b[2]) for i, a in enumerate(own) for b in own[:i])
    n, out = len(own), {}
    for c in (1, 2):
        counts = [sum(r[c] == v for r in own) for v in {r[c] for r in own}]
        out[c] = [sum(t * (t - 1) / 2 for t in counts), sum(t * (t - 1) * (t - 2) for t in counts), sum(t * (t - 1) * (2 * t + 5) for t in counts)]
    (tx, ux, vx), (ty, uy, vy) = out[1], out[2]
    n0 = n * (n - 1) / 2
    free = (n0 - tx) * (n0 - ty)
    var = (n * (n - 1) * (2 * n + 5) - vx - vy) / 18 + (2 * tx * ty / (n * (n - 1)) if n > 1 else 0) + (ux * uy / (9 * n * (n - 1) * (n - 2)) if n > 2 else 0)
    return s, s / math.sqrt(free) if free else None, math.erfc(abs(s) / math.sqrt(var) / math.sqrt(2)) if var > 0 else None


@pytest.mark.parametrize("rows,grid", [(10_000, 512), (20, 8), (5, 40), (60, 2)])
def test_tau_by_force(spark, rows, grid):
    df, plain = pairs_table(spark)
    got = {r["key"]: r for r in kendall_tau_b(df, "x", "y", ["key"], rows, grid).collect()}
    assert set(got) == set("abcde")
    for key, r in got.items():
        own = [p for p in plain if p[0] == key]
        s, tau, _ = by_force(own)
        assert r["n"] == len(own) and r["s"] == s
        assert r["tau"] is None and tau is None or r["tau"] == pytest.approx(tau, abs=1e-12)


def test_no_task_holds_a_key(spark):
    df, _ = pairs_table(spark)
    b = bucketed(df, "x", "y", ["key"], 20, 16).where("key = 'a'")
    sizes = {r["bx"]: r["count"] for r in b.groupBy("bx").count().collect()}
    assert max(n for k, n in sizes.items() if k % 2 == 0) <= 2 * 25 and sum(sizes.values()) == 400
    assert any(k % 2 for k in sizes)  # the hot value has a bucket of its own


def test_dependence_report(spark):
    df, plain = pairs_table(spark)
    got = {r["key"]: r for r in pair_dependence(df, ["key"], rows=20, grid=8).collect()}
    assert set(got) == {"a", "b", "e"}
    for key in ("a", "b"):
        own = [p for p in plain if p[0] == key]
        _, tau, p = by_force(own)
        rank = lambda c, v: (sum(q[c] < v for q in own) + (sum(q[c] == v for q in own) + 1) / 2) / (len(own) + 1)  # noqa: B023,E731
        up = sum(rank(1, q[1]) > 0.9 and rank(2, q[2]) > 0.9 for q in own) / len(own) / 0.1
        low = sum(rank(1, q[1]) < 0.1 and rank(2, q[2]) < 0.1 for q in own) / len(own) / 0.1
        r = got[key]
        assert (r["tau"], r["upper_tail_dep"], r["lower_tail_dep"]) == pytest.approx((tau, up, low), abs=1e-12)
        assert r["p_value"] == pytest.approx(p, rel=1e-6, abs=1e-12)
    assert got["e"]["tau"] is None and got["e"]["p_value"] is None


def test_score_of_a_bucket_against_all_pairs():
    from limnos.operators.concordance import _concordance

    rng = np.random.default_rng(4)
    for n in (1, 2, 65, 300):
        x, y = rng.integers(0, 9, n) / 4 - 1, rng.normal(size=n).round(1)
        y[: n // 5] = np.inf
        sign = lambda v: np.sign(np.subtract.outer(np.unique(v, return_inverse=True)[1], np.unique(v, return_inverse=True)[1]))
        assert _concordance(x, y) == int((sign(x) * sign(y)).sum()) // 2


def test_no_bucket_is_spread_over_levels(spark):
    """Rows are counted inside their buckets; copies of them for every level of a merge would fill a task."""
    rows = spark.createDataFrame([("k", float(i % 50), float(i * 7 % 61)) for i in range(400)], "k string, x double, y double")
    plan = kendall_tau_b(rows, "x", "y", ["k"], rows=40, grid=8)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan
