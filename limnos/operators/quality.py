"""Assessment and cleaning of raw observation tables (any number of samples per station)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.functions.dims import SENTINELS
from limnos.operators.series import by, exact_quantiles, quantile_aggs, value_ranks, whole

ROW_KEY = ("station_id", "ts", "parameter")


def duplicates(df: DataFrame, key: Sequence[str] = ROW_KEY) -> DataFrame:
    """Rows beyond the first per key: counted from map-side combined group sizes."""
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("c"))
    return sizes.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_records"),
                     F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n_duplicates"))


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row per column with its null count; one pass, one row through the shuffle."""
    cols = list(cols or df.columns)
    wide = df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])
    return wide.unpivot([], cols, "column_name", "n_null")


def completeness(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or df.columns)
    nulls = sum((F.sum(F.col(c).isNull().cast("long")) for c in cols), F.lit(0))
    cells = F.count(F.lit(1)) * len(cols)
    return df.agg(F.count(F.lit(1)).alias("n_records"), nulls.alias("n_null"),
                  F.round((1 - nulls / cells) * 100, 1).alias("completeness_pct"))


def iqr_fences(df: DataFrame, keys: Sequence[str] = ("parameter",)) -> DataFrame:
    q = exact_quantiles(df, keys, {"q1": 0.25, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    return q.select(*keys, (F.col("q1") - 1.5 * iqr).alias("lo"), (F.col("q3") + 1.5 * iqr).alias("hi"))


def outlier_counts(df: DataFrame, keys: Sequence[str] = ("parameter",), min_n: int = 10) -> DataFrame:
    """Inter-quartile outliers per parameter, straight from the value-count table."""
    ranked = value_ranks(df, keys)
    fences = iqr_fences(df, keys)
    out = (F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))
    return (ranked.where(F.col("n") >= min_n).join(fences, list(keys))
            .groupBy(*keys).agg(F.sum(F.when(out, F.col("cnt")).otherwise(0)).alias("n_outliers"))
            .where("n_outliers > 0"))


def remove_outliers(df: DataFrame, keys: Sequence[str] = ("parameter",)) -> DataFrame:
    inside = F.col("value").isNull() | F.col("lo").isNull() | F.col("value").between(F.col("lo"), F.col("hi"))
    return df.join(iqr_fences(df, keys), list(keys), "left").where(inside).drop("lo", "hi")


def mixed_units(df: DataFrame) -> DataFrame:
    units = df.where("unit IS NOT NULL").groupBy("parameter", "unit").agg(F.lit(1).alias("x"))
    return (units.groupBy("parameter").agg(F.count("x").alias("n_units"),
                                           F.array_join(F.sort_array(F.collect_set("unit")), ", ").alias("units"))
            .where("n_units > 1"))


def temporal_gaps(df: DataFrame, top_per_station: int = 3, top: int = 10, factor: float = 3.0) -> DataFrame:
    """Gaps longer than ``factor`` median steps; the first few per station, then the longest overall.

    Steps inside one calendar day are under a day and can only matter through their number (they
    push the median below the one-day floor), so a station is reduced to its days first.
    """
    t = F.unix_micros("ts")
    in_day = Window.partitionBy("station_id", "date").orderBy("t")
    steps = (df.where("ts IS NOT NULL").select("station_id", t.alias("t"), F.to_date("ts").alias("date"))
             .withColumn("inner", F.col("t") - F.lag("t").over(in_day)))
    days = steps.groupBy("station_id", "date").agg(
        F.min("t").alias("first"), F.max("t").alias("last"), F.count(F.lit(1)).alias("c"),
        F.coalesce(F.max("inner"), F.lit(0)).alias("inner"))
    w, k = by(["station_id"]), whole(["station_id"])
    days = (days.withColumn("prev", F.lag("last").over(w)).withColumn("step", F.col("first") - F.col("prev"))
            .withColumn("n", F.sum("c").over(k)).withColumn("n_days", F.count(F.lit(1)).over(k))
            .withColumn("inner_max", F.max("inner").over(k)).where("step IS NOT NULL AND n >= 3"))
    order = Window.partitionBy("station_id").orderBy("step", "date")
    hidden = F.col("n") - F.col("n_days")
    days = days.withColumn("r", F.row_number().over(order) + hidden)
    n_steps = F.col("n") - 1
    lo_r, hi_r = F.floor((n_steps + 1) / 2), F.floor(n_steps / 2) + 1
    at = lambda r: F.coalesce(F.max(F.when(F.col("r") == r, F.col("step"))).over(k), F.col("inner_max"))
    days = days.withColumn("median", (at(lo_r) + at(hi_r)) / 2)
    day_us = 86_400_000_000
    gaps = days.where((F.col("median") >= day_us) & (F.col("step") > factor * F.col("median")))
    gaps = gaps.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top_per_station)
    return (gaps.select("station_id", F.to_date(F.timestamp_micros("prev")).alias("gap_start"),
                        F.floor(F.col("step") / day_us).cast("long").alias("gap_days"))
            .orderBy(F.desc("gap_days"), "station_id", "gap_start").limit(top))


def dedupe(df: DataFrame, key: Sequence[str] = ROW_KEY, keep: str = "first", order: str = "seq") -> DataFrame:
    """Keep the first or last row per key by an ingest sequence; combines before the shuffle."""
    row = F.struct(*[F.col(c) for c in df.columns])
    pick = {"first": F.min_by, "last": F.max_by}[keep](row, F.col(order))
    return df.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)]).agg(pick.alias("_r")).select("_r.*")


def fill_missing(df: DataFrame, keys: Sequence[str] = ("station_id", "parameter")) -> DataFrame:
    med = exact_quantiles(df, keys, {"med": 0.5})
    return df.join(med, list(keys), "left").withColumn("value", F.coalesce("value", "med")).drop("med")


def normalize(df: DataFrame, keys: Sequence[str] = ("parameter",)) -> DataFrame:
    st = df.groupBy(*keys).agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    z = F.when(F.col("_s") > 0, (F.col("value") - F.col("_m")) / F.col("_s")).otherwise(0.0)
    return df.join(st, list(keys)).withColumn("value_normalized", z).drop("_m", "_s")


def recommended_steps(df: DataFrame, key: Sequence[str] = ROW_KEY) -> DataFrame:
    """The cleaning steps the assessment asks for, one row each."""
    nulls = null_counts(df).agg(F.max("n_null").alias("max_null"))
    outliers = outlier_counts(df).agg(F.coalesce(F.sum("n_outliers"), F.lit(0)).alias("n_out"))
    units = mixed_units(df).agg(F.count(F.lit(1)).alias("n_mixed"))
    one = duplicates(df, key)
    for part in (nulls, outliers, units):  # single-row summaries glued side by side
        one = one.join(F.broadcast(part), F.lit(True))
    n = F.col("n_records")
    rules = [("remove_duplicates", F.col("n_duplicates") > 0), ("fill_missing", F.col("max_null") > n * 0.05),
             ("remove_outliers", F.col("n_out") > n * 0.01), ("standardize_units", F.col("n_mixed") > 0),
             ("resample_daily", F.lit(True))]
    steps = F.array(*[F.struct(F.lit(i).alias("ord"), F.when(c, s).alias("step")) for i, (s, c) in enumerate(rules, 1)])
    return one.select(F.explode(steps).alias("e")).select("e.*").where("step IS NOT NULL")


def quality_score(df: DataFrame, time_col: str = "ts") -> DataFrame:
    """100 less missing share (capped), duplicate share (capped) and a missing / short time axis."""
    cols = df.columns
    sizes = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
    nulls = sum((F.sum(F.col(c).isNull().cast("long") * F.col("_c")) for c in cols), F.lit(0))
    rep = sizes.agg(F.sum("_c").alias("n_records"), F.sum(F.col("_c") - 1).alias("n_duplicates"), nulls.alias("n_null"),
                    F.floor((F.max(F.unix_micros(time_col)) - F.min(F.unix_micros(time_col))) / 86_400_000_000)
                    .alias("span_days"))
    missing = F.col("n_null") * 100.0 / (F.col("n_records") * len(cols))
    dup = F.col("n_duplicates") * 100.0 / F.col("n_records")
    score = (100 - F.least(F.lit(40.0), missing) - F.least(F.lit(20.0), dup)
             - F.when(F.col("span_days").isNull() | (F.col("span_days") / 365.25 < 1 / 12), 10.0).otherwise(0.0))
    return rep.select("n_records", "n_duplicates", "n_null",
                      F.greatest(F.lit(0.0), F.bround(score, 0)).cast("long").alias("quality_score"))


def is_sentinel(col: Column) -> Column:
    return col.isin(*SENTINELS)


def ingest_qa(df: DataFrame, order: str = "seq") -> DataFrame:
    """Per-station ingest report: duplicates, sentinels, negatives, spikes, coverage, gaps."""
    k = ["station_id"]
    kept = df.groupBy("station_id", "ts").agg(F.max_by("value", order).alias("value"), F.count(F.lit(1)).alias("c"))
    bad = F.coalesce(is_sentinel(F.col("value")), F.lit(False))
    # distinct values per station with their counts: medians and spikes never need the raw rows again
    vals = kept.groupBy("station_id", "value").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("c") - 1).alias("d"))
    raw = vals.groupBy(*k).agg(F.sum("d").alias("n_duplicates"), F.sum(F.when(bad, F.col("k")).otherwise(0)).alias("n_sentinels"))
    good = vals.where(~bad & F.col("value").isNotNull())
    med = exact_quantiles(good, k, {"med": 0.5}, weight="k")
    dev = good.join(med, k).select(*k, F.abs(F.col("value") - F.col("med")).alias("value"), "k")
    mad = value_ranks(dev, k, weight="k")
    mad_q = mad.groupBy(*k).agg(*quantile_aggs({"mad": 0.5}))
    spike = (F.col("n") > 30) & (F.col("value") / (1.4826 * F.when(F.col("mad") == 0, 1e-9).otherwise(F.col("mad"))) > 12)
    spikes = mad.join(mad_q, k).groupBy(*k).agg(F.sum(F.when(spike, F.col("cnt")).otherwise(0)).alias("n_spikes"))
    days = kept.where(~bad & F.col("value").isNotNull()).groupBy("station_id", F.to_date("ts").alias("date")).agg(
        F.count(F.lit(1)).alias("c"), F.sum((F.col("value") < 0).cast("long")).alias("neg"),
        F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    step = F.datediff("date", F.lag("date").over(by(k)))
    span = F.floor((F.unix_micros(F.max("t1").cast("timestamp")) - F.unix_micros(F.min("t0").cast("timestamp"))) / 86_400_000_000) + 1
    cover = (days.withColumn("step", step).groupBy(*k).agg(
        F.sum("c").alias("n_values"), F.min("date").alias("start"), F.max("date").alias("end"),
        F.count(F.lit(1)).alias("n_days"), span.cast("long").alias("n_days_span"), F.sum("neg").alias("n_negative"),
        F.coalesce(F.max(F.when(F.col("step") > 30, F.col("step") - 1)), F.lit(0)).cast("long").alias("longest_gap"),
        F.sum((F.col("step") > 30).cast("long")).alias("n_gaps"))
        .withColumn("coverage_pct", F.round(F.col("n_days") * 100.0 / F.col("n_days_span"), 1))
        .withColumn("n_gaps", F.coalesce("n_gaps", F.lit(0))))
    return cover.join(raw, k).join(spikes, k).select(
        "station_id", "n_values", "start", "end", "n_days", "n_days_span", "coverage_pct", "n_duplicates", "n_sentinels",
        "n_negative", "n_spikes", "n_gaps", "longest_gap",
        F.array_join(F.array_compact(F.array(
            F.when((F.col("n_negative") > 0) & (F.col("n_sentinels") == 0), "negatives"),
            F.when(F.col("n_spikes") > 0, "spikes"), F.when(F.col("coverage_pct") < 80, "coverage"))), ",").alias("warnings"))


def gap_list(df: DataFrame, top: int = 20) -> DataFrame:
    """Day gaps over 30 days, the longest ``top`` per station."""
    days = df.where("value IS NOT NULL").select("station_id", F.to_date("ts").alias("date")).distinct()
    w = by(["station_id"])
    gaps = (days.withColumn("gap_from", F.lag("date").over(w))
            .withColumn("days", (F.datediff("date", "gap_from") - 1).cast("long")).where("days >= 30"))
    r = F.row_number().over(Window.partitionBy("station_id").orderBy(F.desc("days"), "gap_from"))
    return gaps.withColumn("r", r).where(F.col("r") <= top).select("station_id", "gap_from", "days")


def yearly_coverage(df: DataFrame) -> DataFrame:
    days = df.where("value IS NOT NULL").select("station_id", F.to_date("ts").alias("date")).distinct()
    y = F.year("date")
    length = F.datediff(F.make_date(F.col("year") + 1, F.lit(1), F.lit(1)), F.make_date("year", F.lit(1), F.lit(1)))
    return (days.groupBy("station_id", y.alias("year")).agg(F.count(F.lit(1)).alias("n_days"))
            .select("station_id", F.col("year").cast("long").alias("year"), "n_days",
                    F.round(F.col("n_days") * 100.0 / length, 1).alias("coverage_pct")))


def rollup_counts(df: DataFrame) -> DataFrame:
    """Counts at (source, station, parameter) and every coarser level in one pass."""
    return df.rollup("source", "station_id", "parameter").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("n_values"))
