"""The driver tables seen as water-observation tables (and the same views as SQL text for the checks)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def obs(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select(
        F.lit("events").alias("source"), F.col("user_id").alias("station_id"),
        F.col("event_type").alias("parameter"), F.col("ts").cast("timestamp").alias("ts"), "value",
        F.col("event_id").alias("seq"))


OBS = "obs AS (SELECT 'events' AS source, user_id AS station_id, event_type AS parameter, ts, value, event_id AS seq FROM events)"


def obs_defects(spark, sf) -> DataFrame:
    """Observations with nulls, repeated rows and mixed units."""
    o = obs(spark, sf).select(
        "source", "station_id", "parameter", "ts",
        F.when(F.col("seq") % 10 != 0, F.col("value")).alias("value"),
        F.when(F.col("seq") % 97 == 0, "ug/L").otherwise("mg/L").alias("unit"), "seq")
    return o.withColumn("copy", F.explode(F.when(F.col("seq") % 50 == 0, F.array(F.lit(0), F.lit(1)))
                                          .otherwise(F.array(F.lit(0)))))


DEFECTS = ("defects AS (SELECT 'events' AS source, user_id AS station_id, event_type AS parameter, ts, "
           "CASE WHEN event_id % 10 <> 0 THEN value END AS value, "
           "CASE WHEN event_id % 97 = 0 THEN 'ug/L' ELSE 'mg/L' END AS unit, event_id AS seq, c AS copy "
           "FROM events, (SELECT 0 AS c UNION ALL SELECT 1) cc WHERE c = 0 OR event_id % 50 = 0)")


def flow(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(
        (F.col("l_suppkey") % 10).alias("station_id"), F.to_date("l_shipdate").alias("date")).agg(
        F.sum("l_quantity").alias("value"))


FLOW = ("flow AS (SELECT l_suppkey % 10 AS station_id, CAST(l_shipdate AS DATE) AS date, "
        "sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)")


def supplier_flow(spark, sf) -> DataFrame:
    """One station per supplier: the number of stations grows with the table."""
    return table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("station_id"), F.to_date("l_shipdate").alias("date")).agg(
        F.sum("l_quantity").alias("value"))


SFLOW = ("sflow AS (SELECT l_suppkey AS station_id, CAST(l_shipdate AS DATE) AS date, "
         "sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)")


def long_flow(spark, sf) -> DataFrame:
    """One station per supplier over half a century: each line number has seven years of its own."""
    return table(spark, sf, "lineitem").groupBy(
        F.col("l_suppkey").alias("station_id"), F.add_months(F.to_date("l_shipdate"), ((F.col("l_linenumber") - 1) * 84).cast("int")).alias("date")).agg(
        F.sum("l_quantity").alias("value"))


LFLOW = ("lflow AS (SELECT l_suppkey AS station_id, CAST(CAST(l_shipdate AS DATE) + to_months(CAST((l_linenumber - 1) * 84 AS INTEGER)) AS DATE) AS date, "
         "sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)")


def rain(spark, sf) -> DataFrame:
    """Daily sums with values on nearly every day of a year."""
    return table(spark, sf, "lineitem").groupBy(
        (F.col("l_suppkey") % 10).alias("station_id"), F.to_date("l_shipdate").alias("date")).agg(
        F.round(F.sum("l_extendedprice") / 1e4, 7).alias("value"))


RAIN = ("rain AS (SELECT l_suppkey % 10 AS station_id, CAST(l_shipdate AS DATE) AS date, "
        "round(sum(l_extendedprice) / 1e4, 7) AS value FROM lineitem GROUP BY 1, 2)")


def precip(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").groupBy(
        (F.col("o_custkey") % 10).alias("station_id"), F.to_date("o_orderdate").alias("date")).agg(
        F.round(F.sum("o_totalprice") / 1e5, 7).alias("value"))


PRECIP = ("precip AS (SELECT o_custkey % 10 AS station_id, CAST(o_orderdate AS DATE) AS date, "
          "round(sum(o_totalprice) / 1e5, 7) AS value FROM orders GROUP BY 1, 2)")


def paired(spark, sf) -> DataFrame:
    q = flow(spark, sf).withColumnRenamed("value", "obs")
    return q.join(precip(spark, sf).withColumnRenamed("value", "sim"), ["station_id", "date"])


PAIRED = (FLOW + ", " + PRECIP + ", paired AS (SELECT station_id, date, f.value AS obs, p.value AS sim "
          "FROM flow f JOIN precip p USING (station_id, date))")


def stations(spark, sf) -> DataFrame:
    s, n, r = (table(spark, sf, t) for t in ("supplier", "nation", "region"))
    return (s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        F.lower("r_name").alias("source"), F.col("s_suppkey").alias("station_id"), F.col("s_name").alias("name"),
        F.col("n_name").alias("country"),
        ((F.col("s_suppkey") * 37 % 180) - 90 + 0.5).alias("latitude"),
        ((F.col("s_suppkey") * 91 % 360) - 180 + 0.5).alias("longitude"),
        F.when(F.col("s_suppkey") % 3 == 0, F.array(F.lit("discharge"), F.lit("level")))
        .when(F.col("s_suppkey") % 3 == 1, F.array(F.lit("level")))
        .otherwise(F.array(F.lit("precipitation"))).alias("variables"),
        F.col("s_acctbal").alias("acctbal")))


STATION = ("station AS (SELECT lower(r_name) AS source, s_suppkey AS station_id, s_name AS name, n_name AS country, "
           "CAST((s_suppkey * 37 % 180) - 90 + 0.5 AS DOUBLE) AS latitude, "
           "CAST((s_suppkey * 91 % 360) - 180 + 0.5 AS DOUBLE) AS longitude, "
           "CASE s_suppkey % 3 WHEN 0 THEN ['discharge', 'level'] WHEN 1 THEN ['level'] ELSE ['precipitation'] END AS variables, "
           "s_acctbal AS acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey "
           "JOIN region ON n_regionkey = r_regionkey)")


def indicators(spark, sf) -> DataFrame:
    o, c, n = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    return (o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
            .groupBy(F.col("n_name").alias("country"), F.year("o_orderdate").cast("long").alias("year"),
                     F.col("o_orderpriority").alias("variable"))
            .agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
            .withColumn("unit", F.lit("usd")))


INDICATOR = ("indicator AS (SELECT n_name AS country, year(o_orderdate) AS year, o_orderpriority AS variable, "
             "round(sum(o_totalprice), 2) AS value, 'usd' AS unit FROM orders JOIN customer ON o_custkey = c_custkey "
             "JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)")


def weather(spark, sf) -> DataFrame:
    v = F.col("value")
    return flow(spark, sf).select(
        "station_id", "date", (5 + v % 10).alias("t_min"), (13 + v % 10).alias("t_max"), F.lit(40.0).alias("rh_min"),
        F.lit(80.0).alias("rh_max"), F.lit(2.0).alias("wind_speed"), (15 + v % 7).alias("solar_radiation"),
        F.lit(30.0).alias("latitude"), F.lit(70.0).alias("elevation"))


WEATHER = (FLOW + ", weather AS (SELECT station_id, date, 5 + value % 10 AS t_min, 13 + value % 10 AS t_max, "
           "40.0::DOUBLE AS rh_min, 80.0::DOUBLE AS rh_max, 2.0::DOUBLE AS wind_speed, 15 + value % 7 AS solar_radiation, "
           "30.0::DOUBLE AS latitude, 70.0::DOUBLE AS elevation FROM flow)")


def basins(spark, sf) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, sf, "part").select(
        (p + 1).alias("hybas_id"), F.floor((p + 1) / 2).cast("long").alias("next_down"),
        F.col("p_size").cast("double").alias("sub_area"), F.col("p_retailprice").alias("elev"),
        F.when(p % 13 == 0, -9999.0).otherwise(F.col("p_retailprice") / 10).alias("precip"))


BASIN = ("basin AS (SELECT p_partkey + 1 AS hybas_id, (p_partkey + 1) // 2 AS next_down, "
         "CAST(p_size AS DOUBLE) AS sub_area, p_retailprice AS elev, "
         "CASE WHEN p_partkey % 13 = 0 THEN -9999.0::DOUBLE ELSE p_retailprice / 10 END AS precip FROM part)")


def cells(spark, sf) -> DataFrame:
    p = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.lit("g").alias("grid_id"), F.floor(p / 20).cast("long").alias("row"), (p % 20).alias("col"),
        F.col("p_retailprice").alias("elev"))


CELL = ("cell AS (SELECT 'g' AS grid_id, p_partkey // 20 AS row, p_partkey % 20 AS col, "
        "p_retailprice AS elev FROM part)")


def gaugings(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("station_id"), F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_quantity").alias("stage"), F.col("l_extendedprice").alias("discharge"))


GAUGING = ("gauging AS (SELECT l_suppkey % 10 AS station_id, l_shipdate AS ts, l_quantity AS stage, "
           "l_extendedprice AS discharge FROM lineitem)")
