"""Daily sketches merged by year against exact counts and ranks."""

import datetime as dt
import random

from limnos.operators import sketches as K


def test_merged_days_equal_one_pass_within_bounds(spark):
    r, rows = random.Random(2), []
    for i in range(30_000):
        v = round(r.gammavariate(2, 30), 1)
        rows.append((i % 2, dt.datetime(2020 + i % 3 // 2, 1 + i % 12, 1 + i % 28, 5), v))
    rows += [(0, dt.datetime(2020, 1, 1), None), (0, dt.datetime(2020, 1, 1), float("nan")), (9, dt.datetime(2022, 1, 1), 4.0)]
    df = spark.createDataFrame(rows, "station_id int, ts timestamp, value double")
    got = {(r["station_id"], r["year"]): r for r in K.approx_profile(df).collect()}
    assert set(got) == {(0, 2020), (1, 2020), (0, 2021), (1, 2021), (9, 2022)}
    for (key, year), g in got.items():
        own = [v for k, t, v in rows if k == key and t.year == year and v is not None and v == v]
        assert g["n"] == len(own)
        assert abs(g["n_distinct"] - len(set(own))) <= max(1, 4 * K.DISTINCT_ERROR * len(set(own)))
        for c, p in K.QUANTILES.items():
            below, upto = sum(v < g[c] for v in own) / len(own), sum(v <= g[c] for v in own) / len(own)
            assert below <= p + 3 * K.RANK_ERROR and upto >= p - 3 * K.RANK_ERROR


def test_few_values_are_exact_and_empty_stays_empty(spark):
    df = spark.createDataFrame([(1, dt.datetime(2020, 1, d), float(d)) for d in range(1, 30)], "station_id int, ts timestamp, value double")
    days = K.daily_sketches(df)
    assert days.count() == 29
    one = K.estimates(K.merged(days, ["station_id"]), ["station_id"]).first()
    assert (one["n"], one["n_distinct"], one["p50"]) == (29, 29, 15.0)
    assert K.approx_profile(df.limit(0)).count() == 0
