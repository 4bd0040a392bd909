"""Profiles and summaries of observation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.functions.arith import correlation, ratio
from limnos.operators.series import quantile_aggs, value_ranks

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def moments_from_ranks() -> dict:
    """count / mean / sd over the value-count table: the raw rows are read once for ranks and moments alike."""
    n, v, c = F.max("n"), F.col("value"), F.col("cnt")
    return {"n": n, "mean": F.sum(v * c) / n, "min": F.min(v), "max": F.max(v)}


def describe(df: DataFrame, keys: Sequence[str] = ("parameter",), digits: int = 4) -> DataFrame:
    """count, mean, sample sd, quartiles and inter-quartile outliers per key."""
    keys = list(keys)
    ranked = value_ranks(df, keys)
    m = moments_from_ranks()
    stats = ranked.groupBy(*keys).agg(m["n"].alias("n_values"), m["mean"].alias("mean"), m["min"].alias("min"),
                                      m["max"].alias("max"), *quantile_aggs(QUARTILES))
    iqr = F.col("q75") - F.col("q25")
    out = (F.col("value") < F.col("q25") - 1.5 * iqr) | (F.col("value") > F.col("q75") + 1.5 * iqr)
    spread = ranked.join(stats.select(*keys, "mean", "q25", "q75"), keys).groupBy(*keys).agg(
        F.sum(F.when(out, F.col("cnt")).otherwise(0)).alias("n_outliers"),
        F.sqrt(ratio(F.sum(F.pow(F.col("value") - F.col("mean"), 2) * F.col("cnt")), F.max("n") - 1)).alias("std"))
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return stats.join(spread, keys).join(rows, keys).select(
        *keys, "n_values", (F.col("_rows") - F.col("n_values")).alias("n_missing"),
        *[F.round(c, digits).alias(c) for c in ("mean", "min", "q25", "median", "q75", "max")],
        F.round(F.coalesce("std", F.lit(0.0)), digits).alias("std"), "n_outliers")


def profile(df: DataFrame) -> DataFrame:
    """Records, stations, parameters, sources and span. Distinct sets are reduced before they are gathered."""
    per = df.groupBy("station_id", "parameter", "source").agg(
        F.count(F.lit(1)).alias("c"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    days = F.floor((F.unix_micros(F.max("t1")) - F.unix_micros(F.min("t0"))) / 86_400_000_000)
    return per.agg(F.sum("c").alias("n_records"), F.count_distinct("station_id").alias("n_stations"),
                   F.count_distinct("parameter").alias("n_parameters"),
                   F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"),
                   F.array_join(F.sort_array(F.collect_set("parameter")), ",").alias("parameters"),
                   F.round(days / 365.25, 1).alias("time_span_years"))


# Column names recognised by role, in order of preference.
ROLE_NAMES = {
    "time": ("sample_datetime", "reading_datetime", "datetime", "timestamp", "date", "time", "ts"),
    "station": ("station_id", "station", "site_no", "site_id", "user_id"),
    "parameter": ("parameter", "variable", "characteristic", "event_type"),
    "value": ("value", "result", "reading", "measurement"),
}


def column_roles(df: DataFrame) -> dict[str, str | None]:
    """Role → column, from the schema alone (no job runs)."""
    lower = {c.lower(): c for c in df.columns}
    roles = {role: next((lower[n] for n in names if n in lower), None) for role, names in ROLE_NAMES.items()}
    if roles["time"] is None:
        roles["time"] = next((f.name for f in df.schema.fields if f.dataType.typeName() in ("timestamp", "date")), None)
    return roles


def profile_columns(df: DataFrame) -> DataFrame:
    r = column_roles(df)
    n_null = sum((F.sum(F.col(c).isNull().cast("long")) for c in df.columns), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("n_records"), F.lit(r["time"]).alias("time_col"), F.lit(r["station"]).alias("station_col"),
        F.lit(r["parameter"]).alias("param_col"), F.lit(r["value"]).alias("value_col"),
        F.count_distinct(F.col(r["station"])).alias("n_stations"), F.min(r["time"]).alias("date_min"),
        F.max(r["time"]).alias("date_max"),
        F.round(100.0 * (1 - n_null / (F.count(F.lit(1)) * len(df.columns))), 4).alias("completeness_pct"))


def parameter_correlation(df: DataFrame, index: Sequence[str] = ("ts", "station_id"), digits: int = 3) -> DataFrame:
    """Pearson matrix over the (index × parameter) pivot, pairwise complete.

    The pivot turns the handful of parameters of one index cell into columns, so no pair rows are
    made; every pair is one ``corr`` in a single map-side combined aggregate.
    """
    means = df.where("value IS NOT NULL").groupBy(*index, "parameter").agg(F.avg("value").alias("value"))
    names = [r[0] for r in df.select("parameter").distinct().orderBy("parameter").collect()]
    wide = means.groupBy(*index).pivot("parameter", names).agg(F.first("value"))
    cells = [F.struct(F.lit(a).alias("param1"), F.lit(b).alias("param2"),
                      correlation(F.col(f"`{a}`"), F.col(f"`{b}`")).alias("r"),
                      F.count(F.col(f"`{a}`") + F.col(f"`{b}`")).alias("n"))
             for i, a in enumerate(names) for b in names[i + 1:]]
    return (wide.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("c")).select("c.*")
            .withColumn("r", F.round("r", digits)))


def station_summary(df: DataFrame, keys: Sequence[str] = ("station_id",)) -> DataFrame:
    """Length and spread of daily-bounded series."""
    years = F.datediff(F.max("date"), F.min("date")) / 365.25
    return df.groupBy(*keys).agg(
        F.count("value").alias("n"), F.min("date").alias("start"), F.max("date").alias("end"),
        F.round(years, 2).alias("years"), F.round(F.avg("value"), 4).alias("mean"),
        F.round(F.percentile("value", F.lit(0.5)), 4).alias("median"), F.min("value").alias("min"), F.max("value").alias("max"))
