"""Writers: records, daily bundles, catalogs and exchange formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_records(df: DataFrame, path: str, fmt: str = "json") -> None:
    if fmt == "geojson":
        geojson_lines(df).write.text(path)
    elif fmt == "csv":
        df.write.option("header", True).csv(path)
    elif fmt == "json":
        df.write.json(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def geojson_lines(df: DataFrame) -> DataFrame:
    """One GeoJSON feature per line; rows without a location are left out."""
    props = [c for c in df.columns if c not in ("latitude", "longitude")]
    feature = F.struct(F.lit("Feature").alias("type"),
                       F.struct(F.lit("Point").alias("type"), F.array("longitude", "latitude").alias("coordinates")).alias("geometry"),
                       F.struct(*props).alias("properties"))
    return df.where("latitude IS NOT NULL AND longitude IS NOT NULL").select(F.to_json(feature).alias("value"))


def write_bundle(daily: DataFrame, path: str) -> None:
    """Daily series as one folder per (variable, source), each file sorted by station and date.

    Stations are spread over files by range, so one large source does not end in a single task and
    file statistics stay selective for a station filter.
    """
    (daily.repartitionByRange("variable", "source", "station_id").sortWithinPartitions("variable", "source", "station_id", "date")
     .write.partitionBy("variable", "source").parquet(path))


def bundle_info(daily: DataFrame) -> DataFrame:
    per = daily.groupBy("variable", "source", "station_id").agg(
        F.count(F.lit(1)).alias("c"), F.min("date").alias("a"), F.max("date").alias("b"))
    return per.groupBy("variable", "source").agg(F.count(F.lit(1)).alias("n_stations"), F.sum("c").alias("n_rows"),
                                                 F.min("a").alias("first"), F.max("b").alias("last"))


def wkt_point(lon: Column, lat: Column) -> Column:
    """Text geometry of a station."""
    return F.format_string("POINT (%s %s)", lon, lat)


def write_catalog(stations: DataFrame, path: str) -> None:
    """Station catalog sorted by (source, station_id) with a text geometry."""
    (stations.withColumn("geometry", wkt_point(F.col("longitude"), F.col("latitude")))
     .repartitionByRange("source", "station_id").sortWithinPartitions("source", "station_id").write.parquet(path))


def hec_records(rows: DataFrame, time: str = "date", watershed: str = "UNKNOWN", source: str = "OBS") -> DataFrame:
    """One header per (station, parameter): pathname, time step label, first unit, type, start and number of values.

    The label comes from the median distance of neighbouring times; longer than a day, or a single value, is irregular.
    """
    k = ["station_id", "parameter"]
    t = F.unix_timestamp(F.col(time).cast("timestamp"))
    d = rows.withColumn("_t", t).withColumn("_step", F.col("_t") - F.lag("_t").over(Window.partitionBy(*k).orderBy("_t")))
    unit = F.min_by(F.col("unit"), F.col("_t")) if "unit" in rows.columns else F.lit("unknown")
    agg = d.groupBy(*k).agg(F.percentile("_step", F.lit(0.5)).alias("step_seconds"), F.count(F.lit(1)).alias("n"), F.min("_t").alias("_start"), unit.alias("unit"))
    # Labels by the most seconds that a step may take.
    label = F.lit("IR-YEAR")
    for seconds, name in ((86400, "1DAY"), (3600, "1HOUR"), (900, "15MIN"), (300, "5MIN"), (60, "1MIN")):
        label = F.when(F.col("step_seconds") <= seconds, name).otherwise(label)
    start = F.upper(F.date_format(F.timestamp_seconds("_start"), "ddMMMyyyy"))
    path = F.concat(F.lit(f"/{watershed}/"), F.col("station_id").cast("string"), F.lit("/"), F.col("parameter"), F.lit("/"), start, F.lit("/"), label, F.lit(f"/{source}/"))
    return agg.select(*k, path.alias("pathname"), label.alias("time_step"), F.coalesce("unit", F.lit("unknown")).alias("unit"), F.lit("INST-VAL").alias("type"), "step_seconds",
                      F.timestamp_seconds("_start").alias("start"), "n")


def write_hec_csv(rows: DataFrame, path: str, time: str = "date", watershed: str = "UNKNOWN", source: str = "OBS") -> None:
    """Rows of pathname, timestamp, value, unit and type, in order of path and time; no series is gathered into one row."""
    k = ["station_id", "parameter"]
    stamp = F.date_format(F.col(time).cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("timestamp")
    out = rows.select(*k, stamp, "value").join(hec_records(rows, time, watershed, source).select(*k, "pathname", "unit", "type"), k)
    (out.select("pathname", "timestamp", "value", "unit", "type").repartitionByRange("pathname", "timestamp").sortWithinPartitions("pathname", "timestamp")
     .write.option("header", True).csv(path))


def swmm_lines(rows: DataFrame, ts: str = "ts", value: str = "value") -> DataFrame:
    """Fixed-width time-series lines: name, date, time, value."""
    line = F.format_string("%-16s %s %12.4f", F.col("station_id").cast("string"), F.date_format(ts, "MM/dd/yyyy HH:mm"), F.col(value))
    return rows.where(F.col(value).isNotNull()).withColumn("line", line)


def write_swmm(rows: DataFrame, path: str, ts: str = "ts", value: str = "value") -> None:
    swmm_lines(rows, ts, value).repartitionByRange("station_id", ts).sortWithinPartitions("station_id", ts).select("line").write.text(path)


def series_groups(daily: DataFrame) -> DataFrame:
    """One row per (station, parameter) with its first unit and location and its ordered points."""
    points = F.array_sort(F.collect_list(F.struct(F.col("date").cast("string").alias("time"), "value")))
    return daily.groupBy("station_id", "parameter").agg(
        F.min("unit").alias("unit"), F.first("latitude", True).alias("latitude"), F.first("longitude", True).alias("longitude"),
        points.alias("point"))


def write_waterml(daily: DataFrame, path: str) -> None:
    series_groups(daily).write.option("rootTag", "Collection").option("rowTag", "observationMember").format("xml").save(path)


def large_sample_rows(daily: DataFrame, stations: DataFrame, forcing: DataFrame, prefix: str = "obs") -> DataFrame:
    """Per-gauge daily rows for a large-sample export: flow in mm/day beside its forcing."""
    gauge = F.concat(F.lit(prefix + "_"), F.col("station_id").cast("string"))
    d = daily.join(stations.select("station_id", "area_km2"), "station_id").where("area_km2 > 0")
    d = d.join(forcing, ["station_id", "date"], "left")
    keep = [c for c in forcing.columns if c not in ("station_id", "date")]
    return d.select(gauge.alias("gauge_id"), "date", (F.col("value") * 86.4 / F.col("area_km2")).alias("streamflow"), *keep)


def write_large_sample(rows: DataFrame, attributes: DataFrame, path: str) -> None:
    rows.repartitionByRange("gauge_id", "date").sortWithinPartitions("gauge_id", "date").write.partitionBy("gauge_id").parquet(f"{path}/timeseries")
    attributes.write.parquet(f"{path}/attributes")


def check_large_sample(rows: DataFrame, attributes: DataFrame, prefix: str = "obs") -> DataFrame:
    """Problem rows of an export: bad ids, nulls, negative flow, missing series, uneven steps."""
    w = Window.partitionBy("gauge_id").orderBy("date")
    step = rows.withColumn("step", F.datediff("date", F.lag("date").over(w)))
    said = lambda d, text: d.select("gauge_id", F.lit(text).alias("problem")).distinct()
    return (said(attributes.where(~F.col("gauge_id").startswith(prefix + "_")), "bad prefix")
            .unionByName(said(attributes.join(rows, "gauge_id", "left_anti"), "no series"))
            .unionByName(said(rows.where("streamflow IS NULL"), "null flow"))
            .unionByName(said(rows.where("streamflow < 0"), "negative flow"))
            .unionByName(said(step.where("step <> 1"), "uneven step")))
