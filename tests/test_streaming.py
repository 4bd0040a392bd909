"""Streams give the rows of the batch, whatever the batch cuts and the order of arrival within the watermark's delay."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from limnos.session import scratch_path
from limnos.streaming import jobs as S

KIND = "station_id long, parameter string, ts timestamp, value double, seq long"
START = dt.datetime(2024, 1, 1)


def samples(n=240):
    r = random.Random(6)
    return [(i % 3, "q", START + dt.timedelta(minutes=37 * (i // 3)), float(r.randint(0, 100)), i) for i in range(n)]


def stream(spark, batches):
    """A file stream of the given batches in that order, and a closing row."""
    path = scratch_path(spark, "in")
    for rows in batches:
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(path)
    every = spark.createDataFrame([r for b in batches for r in b], KIND)
    S.closing_row(every).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(df):
    spark, out = df.sparkSession, scratch_path(df.sparkSession, "out")
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "ckpt")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out), q.recentProgress


def cusum_by_force(rows, target, limit):
    out, state = [], {}
    for key, _, ts, v, _ in sorted(rows, key=lambda r: (r[2], r[3])):
        up, down = state.get(key, (0.0, 0.0))
        up, down = max(0.0, up + v - target), max(0.0, down + target - v)
        if up > limit or down > limit:
            out.append((key, ts, "up" if up > limit else "down", max(up, down)))
            up, down = (0.0, down) if up > limit else (up, 0.0)
        state[key] = (up, down)
    return sorted(out)


@pytest.mark.parametrize("cuts,shuffled", [(1, False), (4, False), (6, True)])
def test_cusum_does_not_depend_on_batches(spark, cuts, shuffled):
    rows = samples()
    arrival = list(rows)
    if shuffled:  # rows change places within a day, less than the delay
        r = random.Random(1)
        arrival.sort(key=lambda x: x[2] + dt.timedelta(hours=r.uniform(0, 20)))
    step = -(-len(rows) // cuts)
    got, _ = drained(S.cusum(stream(spark, [arrival[i:i + step] for i in range(0, len(rows), step)]), 50.0, 120.0))
    assert sorted(map(tuple, got.collect())) == cusum_by_force(rows, 50.0, 120.0)


def test_newest_duplicate_wins_and_state_empties(spark):
    rows = samples(90)
    newer = [(k, p, ts, v + 1000, seq + 500) for k, p, ts, v, seq in rows[::2]]
    got, progress = drained(S.dedupe_last(stream(spark, [newer[:20] + rows[:40], rows[40:] + newer[20:]])))
    want = {(k, ts): v for k, _, ts, v, _ in rows} | {(k, ts): v for k, _, ts, v, _ in newer}
    assert {(r["station_id"], r["ts"]): r["value"] for r in got.collect()} == want and got.count() == len(rows)
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 1  # the closing row alone
    batch = S.dedupe_last(spark.createDataFrame(rows + newer, KIND))
    assert sorted(map(tuple, batch.collect())) == sorted(map(tuple, got.collect()))


def test_windows_and_sessions_equal_batch(spark):
    rows = samples()
    plain = spark.createDataFrame(rows, KIND)
    parts = [rows[:100], rows[100:]]
    for job in (S.daily_mean, S.sliding_stats):
        got, _ = drained(job(stream(spark, parts)))
        near = lambda rows: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)
        assert near(got.collect()) == near(job(plain).collect())
    hot = stream(spark, parts).withColumn("value", F.when(F.col("station_id").isNull(), 1e9).otherwise(F.col("value")))
    got, _ = drained(S.spell_sessions(hot, 60.0, "40 minutes"))
    assert sorted(map(str, got.collect())) == sorted(map(str, S.spell_sessions(plain, 60.0, "40 minutes").collect())) and got.count() > 10
