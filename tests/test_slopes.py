"""Sen's slope of many short series at once, beside long ones."""

import datetime as dt

import numpy as np

from limnos.operators import trend as T


def all_pairs(v):
    i, j = np.triu_indices(len(v), 1)
    return float(np.median((v[j] - v[i]) / (j - i))) if len(v) > 1 else 0.0


def test_short_series_at_once_as_one_by_one():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 17, 64):
        v = np.concatenate([rng.normal(50, 20, (40, n)), rng.integers(0, 3, (40, n)).astype(float), np.ones((1, n))])
        np.testing.assert_allclose(T.median_slopes(v), [all_pairs(x) for x in v], rtol=1e-12, atol=1e-12)
        np.testing.assert_allclose(T.median_slopes(v), [T.median_slope(x) for x in v], rtol=1e-9, atol=1e-9)
    odd = np.array([[1.0, np.inf, 2.0], [1.0, np.nan, 2.0]])
    assert T.median_slopes(odd).tolist() == [T.median_slope(x) for x in odd] == [0.0, 0.0]


def test_series_meet_batch_ends_and_null_keys(spark):
    """Series longer and shorter than an Arrow batch; a null key is a key; null values are left out."""
    rng = np.random.default_rng(6)
    series = {None: 30, "a": 1, "b": 2, "c": 63, "d": 64, "e": 65, "f": 400, **{f"s{i}": 12 for i in range(40)}}
    day = lambda i: dt.date(2000, 1, 1) + dt.timedelta(days=i)
    values = {k: np.round(rng.normal(5, 2, n), 2) for k, n in series.items()}
    rows = [(k, day(i), float(v)) for k, s in values.items() for i, v in enumerate(s)] + [("a", day(500), None), ("none", day(0), None)]
    rng.shuffle(rows)
    df = spark.createDataFrame([tuple(r) for r in rows], "station_id string, date date, value double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        out = {r["station_id"]: r for r in T.sens_slope(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert set(out) == set(series)
    for k, v in values.items():
        slope = all_pairs(v)
        np.testing.assert_allclose([out[k]["slope"], out[k]["intercept"]], [slope, np.median(v) - (len(v) - 1) / 2 * slope], atol=1e-9)
        assert out[k]["n_samples"] == len(v)


def test_a_row_without_a_date_comes_last(spark):
    rows = [("a", dt.date(2000, 1, 1), 1.0), ("a", dt.date(2000, 1, 2), 2.0), ("a", dt.date(2000, 1, 3), 3.0), ("a", None, 10.0)]
    out = T.sens_slope(spark.createDataFrame(rows, "station_id string, date date, value double")).first()
    assert out["slope"] == all_pairs(np.array([1.0, 2.0, 3.0, 10.0]))
