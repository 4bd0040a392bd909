"""Station catalog search, proximity and spatial bookkeeping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def search(df: DataFrame, bbox: tuple[float, float, float, float] | None = None, variable: str | None = None,
           sources: Sequence[str] | None = None, text: str | None = None) -> DataFrame:
    """Catalog rows inside (west, south, east, north), measuring a variable, by source and by name or id."""
    if bbox:
        w, s, e, n = bbox
        df = df.where(F.col("longitude").between(w, e) & F.col("latitude").between(s, n))
    if variable:
        df = df.where(F.array_contains("variables", variable))
    if sources:
        df = df.where(F.col("source").isin(list(sources)))
    if text:
        t = text.lower()
        df = df.where(F.lower("name").contains(t) | F.lower(F.col("station_id").cast("string")).contains(t))
    return df


def near(df: DataFrame, lat: float, lon: float, limit: int) -> DataFrame:
    """The ``limit`` closest stations by squared degrees with a fixed longitude shrink."""
    d = F.pow(F.col("latitude") - lat, 2) + F.pow(0.7 * (F.col("longitude") - lon), 2)
    return df.withColumn("d2", d).orderBy("d2", "station_id").limit(limit)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def assign_boxes(points: DataFrame, boxes: DataFrame, tile: float = 20.0) -> DataFrame:
    """First box (lowest ``box_id``) that contains each point; both sides meet on a grid tile."""
    t = lambda c: F.floor(F.col(c) / tile)
    p = points.withColumn("_tx", t("longitude")).withColumn("_ty", t("latitude"))
    b = boxes.withColumn("_tx", F.explode(F.sequence(t("west"), t("east")))).withColumn(
        "_ty", F.explode(F.sequence(t("south"), t("north"))))
    hit = (F.col("longitude").between(F.col("west"), F.col("east"))) & (F.col("latitude").between(F.col("south"), F.col("north")))
    return p.join(b, ["_tx", "_ty"]).where(hit).groupBy("station_id").agg(F.min("box_id").alias("box_id"))


def bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.min("longitude").alias("west"), F.min("latitude").alias("south"), F.max("longitude").alias("east"),
                  F.max("latitude").alias("north"), F.count(F.lit(1)).alias("n_stations"))


def assign_area(df: DataFrame) -> DataFrame:
    """Agency area when given, else the basin area; the scope is local when it is under half the upstream area."""
    area = F.coalesce(F.when(F.col("agency_area") > 0, F.col("agency_area")), F.col("up_area"))
    src = F.when(F.col("agency_area") > 0, "agency").when(F.col("up_area").isNotNull(), "basin")
    return df.withColumn("area_km2", area).withColumn("area_source", src).withColumn(
        "attribute_scope", F.when(F.col("area_km2") < 0.5 * F.col("up_area"), "local").otherwise("upstream"))


def stride_sample(df: DataFrame, max_points: int, keys: Sequence[str] = ("station_id",)) -> DataFrame:
    """Every step-th row per key so that at most about ``max_points`` remain."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("_rn", F.row_number().over(w.orderBy("date")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    step = F.greatest(F.lit(1), F.ceil(F.col("_n") / max_points))
    return d.where(F.col("_rn") % step == 0).drop("_rn", "_n")


def even_pick(df: DataFrame, count: int, group: str = "source", order: str = "station_id") -> DataFrame:
    """Evenly spaced members of each group: rank r is kept when it is round(i n / count) for some i."""
    w = Window.partitionBy(group)
    d = df.withColumn("_r", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    picked = F.floor((F.col("_r") + 1) * count / F.col("_n")) > F.floor(F.col("_r") * count / F.col("_n"))
    return d.where((F.col("_n") <= count) | picked).drop("_r", "_n")


def suggest(df: DataFrame, limit: int, order: Sequence[Column]) -> DataFrame:
    """Round-robin over sources, the best record of each source first.

    Nobody beyond a source's first ``limit`` records can come out, so each source is first cut to that in salted parts.
    """
    part = Window.partitionBy("source", "_salt").orderBy(*order)
    best = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(64))).withColumn("_turn", F.row_number().over(part)).where(F.col("_turn") <= limit).drop("_salt", "_turn")
    w = Window.partitionBy("source").orderBy(*order)
    return best.withColumn("turn", F.row_number().over(w)).orderBy("turn", "source").limit(limit)
