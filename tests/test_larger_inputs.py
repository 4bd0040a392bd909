"""Steps whose tasks stay small when the tables grow."""

import datetime as dt
import math

from pyspark.sql import functions as F

from limnos.operators import network as W
from limnos.plans import loading
from limnos.streaming import jobs


def test_higher_orders_read_only_what_is_left_of_the_network(spark, monkeypatch):
    n, read, real = 511, [], W.downstream_closure

    def closure(seeds, tables):
        read.append(sum(t.count() for t in tables))
        return real(seeds, tables)

    monkeypatch.setattr(W, "downstream_closure", closure)
    edges = spark.range(1, n + 1).select("id", F.floor(F.col("id") / 2).cast("long").alias("down"))
    ptr, tables = W.prepare(W.pointers(edges, "id", "down"))
    out = {r["v"]: r["strahler"] for r in W.strahler(ptr, tables).collect()}
    assert out == {v: 9 - int(math.log2(v)) for v in range(1, n + 1)}
    assert len(read) == 8 and sum(read) < 3.5 * read[0]


def test_a_batch_of_a_stream_is_dealt_over_files_and_loses_no_row(spark):
    """Few rows in the middle stretch: empty files keep the batches apart, so no row comes late."""
    at = lambda day, s: dt.datetime(2024, 1, 1) + dt.timedelta(days=day, seconds=s)
    rows = [(1, "p", at(day, s), float(s % 7), 0) for day, n in ((0, 90), (3, 80), (14, 1), (26, 70), (29, 60)) for s in range(n)]
    df = spark.createDataFrame(rows, "station_id long, parameter string, ts timestamp, value double, seq long")
    source = loading.arriving(df, "dealt", rows_per_file=20)
    out = loading.drained(jobs.daily_mean(source), "dealt")
    assert sorted(r["n"] for r in out.collect()) == [1, 60, 70, 80, 90]
    assert sorted(map(str, out.select("date", "value", "n").collect())) == sorted(map(str, jobs.daily_mean(df).select("date", "value", "n").collect()))
