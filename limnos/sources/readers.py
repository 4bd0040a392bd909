"""Readers over landed agency exports: every one yields long rows ready for the canonical schema."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CANDIDATE_DELIMITERS = (",", "\t", ";", "|")


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """Most frequent delimiter of all lines that are no comments, in one aggregate; the earlier candidate on ties."""
    lines = spark.read.text(path).where("trim(value) <> '' AND NOT ltrim(value) LIKE '#%'")
    counts = lines.agg(*[F.sum(F.length("value") - F.length(F.replace("value", F.lit(d), F.lit("")))).alias(str(i)) for i, d in enumerate(CANDIDATE_DELIMITERS)]).first()
    return max(enumerate(CANDIDATE_DELIMITERS), key=lambda c: (counts[c[0]] or 0, -c[0]))[1]


def read_table(spark: SparkSession, path: str, fmt: str = "text", schema: str | None = None, multi_line: bool = False) -> DataFrame:
    """Delimited text with # comments (all columns as strings) or JSON records.

    ``multi_line``: each JSON file is one document over several lines, a list of records or ``{"data": [records]}``.
    """
    if fmt == "json":
        reader = spark.read.option("multiLine", multi_line)
        df = reader.schema(schema).json(path) if schema else reader.json(path)
        return df.select(F.inline("data")) if df.columns == ["data"] and dict(df.dtypes)["data"].startswith("array<struct") else df
    reader = spark.read.option("header", True).option("comment", "#").option("sep", sniff_delimiter(spark, path)).option(
        "ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    if schema:
        reader = reader.schema(schema)
    df = reader.csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


def read_records(spark: SparkSession, path: str, fmt: str, schema: str) -> DataFrame:
    """CSV or JSON with an explicit schema: no inference pass over the data."""
    return spark.read.schema(schema).option("header", True).csv(path) if fmt == "csv" else spark.read.schema(schema).json(path)


def wide_daily(df: DataFrame, attributes: DataFrame | None = None, stations: Sequence[str] | None = None,
               start: str | None = None, end: str | None = None, date: str = "date") -> DataFrame:
    """One column per gauge → long rows. Gauges and dates are chosen before the unpivot, so the scan is pruned."""
    cols = [c for c in df.columns if c != date and (stations is None or c in set(stations))]
    d = df.select(F.col(date).cast("date").alias("date"), *[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) for c in cols])
    if start:
        d = d.where(F.col("date") >= start)
    if end:
        d = d.where(F.col("date") <= end)
    long = d.unpivot(["date"], cols, "station_id", "value").where("value IS NOT NULL")
    return long if attributes is None else long.join(attributes, "station_id", "left")


def per_station_text(spark: SparkSession, path: str, station_pattern: str = r"/([^/_]+)_[^/]*$") -> DataFrame:
    """Whitespace files with year month day value columns; the station is read from the file path."""
    t = spark.read.text(path).withColumn("station_id", F.regexp_extract(F.col("_metadata.file_path"), station_pattern, 1))
    p = F.split(F.trim("value"), r"\s+")
    n = lambda i, kind: F.expr(f"try_cast(p[{i}] AS {kind})")
    d = t.withColumn("p", p).select("station_id", n(0, "INT").alias("y"), n(1, "INT").alias("m"), n(2, "INT").alias("d"), n(3, "DOUBLE").alias("value"))
    return d.where("y IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)").select("station_id", F.make_date("y", "m", "d").alias("date"), "value")


def header_text(spark: SparkSession, path: str, floor: float = -900.0) -> DataFrame:
    """Station exports with ``# key: value`` headers and ``date;time;value`` rows; missing codes are dropped.

    A header belongs to one file, so each (small, one-station) file is one record; its rows explode out.
    """
    t = spark.read.text(path, wholetext=True)
    key = lambda k: F.nullif(F.trim(F.regexp_extract("value", rf"(?im)^#+\s*{k}\.?\s*:[ \t]*(.*)$", 1)), F.lit(""))
    meta = t.select(key("GRDC-No").alias("station_id"), key("Station").alias("name"), key("Latitude").alias("lat"), key("Longitude").alias("lon"),
                    F.explode(F.split("value", r"\r?\n")).alias("line"))
    p = F.split("line", ";")
    rows = meta.where("NOT ltrim(line) LIKE '#%'").withColumn("p", F.transform(p, lambda x: F.trim(x))).where("size(p) >= 3")
    rows = rows.select("station_id", "name", *[F.expr(f"try_cast({c} AS DOUBLE)").alias(n) for c, n in (("lat", "latitude"), ("lon", "longitude"))],
                       F.expr("try_cast(p[0] AS DATE)").alias("date"), F.expr("try_cast(p[2] AS DOUBLE)").alias("value"))
    return rows.where((F.col("value") > floor) & F.col("date").isNotNull())


def parameter_files(spark: SparkSession, path: str, stations: DataFrame, country: str | None = None, start: str | None = None,
                    end: str | None = None, cap: int | None = None) -> DataFrame:
    """One CSV per parameter (its file name) with a station table; country text, date range and an optional row cap."""
    d = spark.read.option("header", True).csv(path)
    if "parameter" not in d.columns:  # folders named parameter=... already carry it
        d = d.withColumn("parameter", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.csv$", 1))
    s = stations if country is None else stations.where(F.lower("country").contains(country.lower()))
    d = d.withColumn("date", F.expr("try_cast(substring(date, 1, 10) AS DATE)")).withColumn("value", F.expr("try_cast(value AS DOUBLE)")).where("value IS NOT NULL")
    if start:
        d = d.where(F.col("date") >= start)
    if end:
        d = d.where(F.col("date") <= end)
    d = d.join(s, "station_id", "left" if country is None else "inner")
    return d if cap is None else d.orderBy(*d.columns).limit(cap)  # the order makes a rerun keep the same rows


def result_rows(df: DataFrame) -> DataFrame:
    """Water-quality result exports: blank and '-' dropped, date and time with a date-only fallback."""
    v = F.trim("ResultMeasureValue")
    stamp = F.concat_ws(" ", "ActivityStartDate", F.coalesce("ActivityStartTime/Time", F.lit("00:00:00")))
    ts = F.coalesce(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp("ActivityStartDate", F.lit("yyyy-MM-dd")))
    d = df.where(~F.coalesce(v, F.lit("")).isin("", "-")).select(
        F.coalesce("MonitoringLocationIdentifier", F.lit("unknown")).alias("station_id"), ts.alias("ts"),
        F.coalesce("CharacteristicName", F.lit("unknown")).alias("parameter"), F.expr("try_cast(trim(ResultMeasureValue) AS DOUBLE)").alias("value"),
        F.coalesce(F.col("`ResultMeasure/MeasureUnitCode`"), F.lit("")).alias("unit"))
    return d.where("ts IS NOT NULL AND value IS NOT NULL")


def parallel_arrays(lines: DataFrame, col: str = "value", section: str = "daily") -> DataFrame:
    """``{daily: {time: [...], var: [...]}}`` documents → one row per time and variable, nulls dropped."""
    doc = lines.select(F.from_json(col, f"latitude DOUBLE, longitude DOUBLE, {section} MAP<STRING, STRING>, {section}_units MAP<STRING, STRING>").alias("j"))
    t = F.from_json(F.col(f"j.{section}")["time"], "ARRAY<STRING>")
    d = doc.select("j.latitude", "j.longitude", t.alias("time"), F.col(f"j.{section}_units").alias("units"), F.explode(F.map_entries(F.map_filter(
        f"j.{section}", lambda k, v: k != "time"))).alias("e"))
    d = d.select("latitude", "longitude", F.col("e.key").alias("parameter"), F.coalesce(F.col("units")[F.col("e.key")], F.lit("")).alias("unit"),
                 F.explode(F.arrays_zip("time", F.from_json("e.value", "ARRAY<DOUBLE>").alias("v"))).alias("z"))
    return d.select("latitude", "longitude", "parameter", "unit", F.to_timestamp("z.time").alias("ts"), F.col("z.v").alias("value")).where("value IS NOT NULL")


def indicator_rows(df: DataFrame) -> DataFrame:
    """Country-year rows from either header set (country… or Area / Element / Value)."""
    names = {"Area": "country", "Area Code": "country_code", "Year": "year", "Element": "variable", "Value": "value", "Unit": "unit"}
    d = df.select([F.col(f"`{c}`").alias(names.get(c, c)) for c in df.columns])
    return d.withColumn("year", F.expr("try_cast(year AS INT)")).withColumn("value", F.expr("try_cast(value AS DOUBLE)")).where("value IS NOT NULL AND year IS NOT NULL")


def cube_rows(df: DataFrame) -> DataFrame:
    """Gridded productivity rows: dates parsed, bounding box text normalised to four rounded numbers."""
    box = F.transform(F.split(F.regexp_replace("bbox", r"[\[\]\s]", ""), ","), lambda x: F.format_string("%.6f", x.cast("double")))
    return df.select("cube_code", *[F.expr(f"try_cast({c} AS DATE)").alias(c) for c in ("date", "start_date", "end_date") if c in df.columns],
                     F.array_join(box, ",").alias("bbox"), F.expr("try_cast(value AS DOUBLE)").alias("value"), "unit").where("value IS NOT NULL")


def waterml_series(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Series documents (one element per station and parameter) → one row per point."""
    d = spark.read.format("xml").option("rowTag", "observationMember").schema(schema).load(path)
    return d.select("station_id", "parameter", "unit", "latitude", "longitude", F.explode("point").alias("p")).select(
        "station_id", "parameter", "unit", "latitude", "longitude", F.to_timestamp("p.time").alias("ts"), F.col("p.value").alias("value"))


def read_bundle(spark: SparkSession, path: str, variable: str | None = None, stations: Sequence | None = None) -> DataFrame:
    """Daily bundle; the variable prunes folders and the station filter reaches the row groups."""
    d = spark.read.parquet(path)
    if variable:
        d = d.where(F.col("variable") == variable)
    return d.where(F.col("station_id").isin(list(stations))) if stations is not None else d


def apply_mapping(df: DataFrame, time: str, value: str, factor: float = 1.0, decimal: str = ".", formats: Sequence[str] = ("yyyy-MM-dd",),
                  station: str | None = None) -> DataFrame:
    """Column mapping of a messy table: text trimmed, decimal comma, sentinels nulled before unit scaling."""
    from limnos.operators.quality import is_sentinel

    raw = F.trim(F.col(value))
    if decimal == ",":
        raw = F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    ts = F.coalesce(*[F.try_to_timestamp(F.trim(F.col(time)), F.lit(f)) for f in formats])
    d = df.withColumn("_v", raw).withColumn("_n", F.expr("try_cast(_v AS DOUBLE)"))
    keep = [F.col(station).alias("station_id")] if station else []
    out = F.when(~is_sentinel(F.col("_n")), F.col("_n")) * F.lit(float(factor))
    return d.select(*keep, ts.alias("ts"), out.alias("value"), F.coalesce(is_sentinel(F.col("_n")), F.lit(False)).alias("was_sentinel")).where("ts IS NOT NULL")


# Name patterns → variable and unit; unit patterns → SI unit and factor; names of flag columns.
NAME_HINTS = ((r"discharge|streamflow|\bflow\b|\bq\b|debit|débit|caudal|流量", "discharge", "m3/s"),
              (r"stage|water[_ ]?level|gauge[_ ]?height|gage[_ ]?height|hauteur|nivel|水位|\bh\b", "water_level", "m"),
              (r"precip|rain|pluie|lluvia|降雨|雨量", "precipitation", "mm"), (r"ground ?water|piezo|well|nappe|地下水", "groundwater_level", "m"),
              (r"\bet0\b|evapotrans|\beto\b", "evapotranspiration", "mm"), (r"storage|reservoir|volume|蓄水", "reservoir_storage", "hm3"))
UNIT_HINTS = ((r"cfs|ft3/s|ft³/s|cubic feet", "m3/s", 0.028316846592), (r"m3/s|m³/s|cms|cumec", "m3/s", 1.0), (r"l/s|litre|liter", "m3/s", 0.001),
              (r"\bmm\b", "mm", 1.0), (r"\bcm\b", "m", 0.01), (r"\bft\b|feet", "m", 0.3048), (r"\binch|\bin\b", "mm", 25.4))
FLAG_NAME = r"flag|qual|code|status|remark|comment|id\b"


STATION_NAME = r"station|site|gauge|gage|code|id$"
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy/MM/dd", "yyyyMMdd",
                "MM/dd/yyyy", "MM/dd/yyyy HH:mm", "dd.MM.yyyy", "dd/MM/yyyy")


# A text in the format looks like this; anything else is no candidate, and failing to parse it would cost far more than to see that.
_LOOKS = {"yyyy": r"[+-]?\d{4,}", "MM": r"\d{2}", "dd": r"\d{2}", "HH": r"\d{2}", "mm": r"\d{2}", "ss": r"\d{2}", "'T'": "[Tt]", "X": r"([Zz]|[+-]\d.*)", "XXX": r"([Zz]|[+-]\d.*)", ".": "[.]"}


def _look(fmt: str) -> str:
    """Pattern that every text in a date format of ``DATE_FORMATS`` meets."""
    return "^" + "".join(_LOOKS.get(p, p) for p in re.findall(r"yyyy|MM|dd|HH|mm|ss|'T'|X+|.", fmt)) + "$"


def _parses(text: Column) -> Column:
    """Whether a text is a time in one of ``DATE_FORMATS``."""
    some = F.lit(False)
    for fmt in DATE_FORMATS:
        some = some | (text.rlike(_look(fmt)) & F.try_to_timestamp(text, F.lit(fmt)).isNotNull())
    return text.rlike("|".join(map(_look, DATE_FORMATS))) & some


def _hint(name: str, hints) -> tuple | None:
    return next((h[1:] for h in hints if re.search(h[0], name, re.I)), None)


def guess_mapping(df: DataFrame) -> DataFrame:
    """One scored row per column over all rows: date share, numeric share, name and unit hints, approximate distinct count, rows."""
    n = lambda c, cond: F.coalesce(F.avg(F.when(c.isNotNull(), cond.cast("double"))), F.lit(0.0))
    rows = []
    for at, name in enumerate(df.columns):
        c = F.col(f"`{name}`")
        text = F.trim(c.cast("string"))
        is_date = _parses(text)
        is_num = F.replace(text, F.lit(","), F.lit(".")).try_cast("double").isNotNull()
        bonus = (1.0 if _hint(name, NAME_HINTS) else 0.0) + (0.2 if _hint(name, UNIT_HINTS) else 0.0) - (0.8 if re.search(FLAG_NAME, name, re.I) else 0.0)
        rows.append(F.struct(F.lit(name).alias("column_name"), n(c, is_date).alias("date_share"), n(c, is_num).alias("numeric_share"), F.lit(bonus).alias("hint"),
                             F.approx_count_distinct(c).alias("n_distinct"), F.lit(at).alias("place"), F.count(F.lit(1)).alias("n_rows")))
    d = df.agg(F.array(*rows).alias("r")).select(F.explode("r").alias("r")).select("r.*")
    return d.withColumn("score", F.when(F.col("numeric_share") >= 0.5, F.col("numeric_share") + F.col("hint")))


def decide_mapping(df: DataFrame, variable: str | None = None, min_date_share: float = 0.6) -> DataFrame:
    """One row: the columns to read, what they hold and how sure that is.

    The date column is the one whose values parse most often (the first of equal ones, null below ``min_date_share``); the value column
    has the best score of the others. Variable, unit and factor to it follow from the name of the value column, discharge where it says
    nothing; a given ``variable`` stays. The station column is the first other one with a station-like name whose values repeat twenty
    times on average. ``date_format`` is left to the reader. A table without rows, dates or numbers gives nulls there and confidence 0.
    """
    about = []
    for name in df.columns:
        by_name, by_unit = _hint(name, NAME_HINTS), _hint(name, UNIT_HINTS)
        what = variable or (by_name[0] if by_name else "discharge")
        unit, factor = by_unit or (next((u for _, v, u in NAME_HINTS if v == what), ""), 1.0)
        about.append(F.struct(F.lit(what).alias("variable"), F.lit(unit).alias("unit"), F.lit(factor).alias("to_si_factor"), F.lit(re.search(STATION_NAME, name, re.I) is not None).alias("station_like")))
    scored = guess_mapping(df).withColumn("about", F.array(*about)[F.col("place")])
    # as many structs as the table has columns
    d = scored.agg(F.array_sort(F.collect_list(F.struct("place", "column_name", "date_share", "score", "n_distinct", "n_rows", "about"))).alias("columns"))
    d = d.withColumn("date", F.array_max(F.transform("columns", lambda c: F.struct(c["date_share"].alias("share"), -c["place"], c["column_name"].alias("name")))))
    d = d.withColumn("date_column", F.when(F.col("date.share") >= min_date_share, F.col("date.name")))
    rest = F.filter("columns", lambda c: ~c["column_name"].eqNullSafe(F.col("date_column")))
    d = d.withColumn("best", F.array_max(F.transform(F.filter(rest, lambda c: c["score"] > -1), lambda c: F.struct(c["score"].alias("score"), -c["place"], c["column_name"].alias("name"), c["about"].alias("about")))))
    repeats = lambda c: c["about"]["station_like"] & ~c["column_name"].eqNullSafe(F.col("best.name")) & (c["n_distinct"] <= F.greatest(F.lit(1), F.floor(c["n_rows"] / 20)))
    sure = F.when(F.col("date_column").isNotNull() & F.col("best").isNotNull(), F.least(F.lit(0.95), 0.4 + F.col("best.score") / 3)).otherwise(0.0)
    return d.select("date_column", F.col("best.name").alias("value_column"), "best.about.variable", "best.about.unit", "best.about.to_si_factor",
                    F.get(F.filter(rest, repeats), F.lit(0))["column_name"].alias("station_column"), F.col("date.share").alias("date_share"), sure.alias("confidence"))
