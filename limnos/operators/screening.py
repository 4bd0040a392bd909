"""Threshold alerts, guideline screens and water-quality indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.functions.arith import ratio
from limnos.functions import dims
from limnos.operators.series import avg_rank_expr, quantile_aggs, value_ranks

LOWER_BOUND = ("dissolved_oxygen",)


def breaches(df: DataFrame, standards: list[str] | None = None, strict_bounds: bool = False) -> DataFrame:
    """Samples beyond a limit of their parameter, with ratio and severity.

    The limit table has a fixed size, so it is broadcast and the sample table is never shuffled.
    Only oxygen is tested as a minimum; with ``strict_bounds`` the lower pH limit is one as well.
    """
    lim = dims.thresholds(df.sparkSession, standards).withColumnRenamed("unit", "limit_unit")
    lower = F.col("parameter").isin(*LOWER_BOUND)
    if strict_bounds:
        lower = lower | ((F.col("parameter") == "pH") & (F.col("limit_value") < 7))
    v, x = F.col("value"), F.col("limit_value")
    inf = F.lit(float("inf"))
    ratio = F.when(lower, F.when(v != 0, x / v).otherwise(inf)).otherwise(F.when(x != 0, v / x).otherwise(inf))
    hit = F.when(lower, v < x).otherwise(v > x)
    return (df.join(F.broadcast(lim), "parameter").where(hit).withColumn("ratio", ratio)
            .withColumn("severity", severity(F.col("ratio"))))


def severity(ratio: Column) -> Column:
    return F.when(ratio < 1.0, "info").when(ratio < 1.5, "warning").otherwise("critical")


def alert_report(df: DataFrame, standards: list[str] | None = None) -> DataFrame:
    """Totals by severity and the number of samples with an alert.

    The limits of a parameter travel as one small array, so a sample is tested in place: the whole
    report is one broadcast join and one global sum, without a shuffle of samples.
    """
    lim = dims.thresholds(df.sparkSession, standards).groupBy("parameter").agg(F.collect_list("limit_value").alias("limits"))
    v, lower = F.col("value"), F.col("parameter").isin(*LOWER_BOUND)
    inf = F.lit(float("inf"))
    ratio = F.transform("limits", lambda x: F.when(lower & (v < x), F.when(v != 0, x / v).otherwise(inf))
                        .when(~lower & (v > x), F.when(x != 0, v / x).otherwise(inf)))
    rows = df.join(F.broadcast(lim), "parameter", "left").withColumn("_r", F.array_compact(ratio))
    of = lambda s: F.sum(F.coalesce(F.size(F.filter("_r", lambda r: severity(r) == s)), F.lit(0)).cast("long"))
    names = ("critical", "warning", "info")
    return rows.withColumn("_r", F.coalesce("_r", F.array().cast("array<double>"))).agg(
        *[F.coalesce(of(s), F.lit(0)).alias(s) for s in names],
        F.sum((F.size("_r") > 0).cast("long")).alias("samples_with_alerts"), F.count(F.lit(1)).alias("total_samples"))


def top_alerts(df: DataFrame, n: int = 20, tie: tuple[str, ...] = ("seq", "standard", "limit_value")) -> DataFrame:
    return breaches(df).orderBy(F.desc("ratio"), *tie).limit(n)


def guideline_screen(df: DataFrame) -> DataFrame:
    """Share of samples outside the guideline range per parameter."""
    g = dims.guidelines(df.sparkSession)
    v, lo, hi = F.col("value"), F.col("low"), F.col("high")
    out = F.when(hi.isNull(), v < lo).when(lo == 0, v > hi).otherwise((v < lo) | (v > hi))
    rows = (df.where("value IS NOT NULL").withColumn("parameter", F.lower("parameter")).drop("unit")
            .join(F.broadcast(g), "parameter"))
    agg = rows.groupBy("parameter").agg(F.count(F.lit(1)).alias("n"), F.sum(out.cast("long")).alias("n_exceed"))
    pct = F.round(100.0 * F.col("n_exceed") / F.col("n"), 1)
    return agg.withColumn("pct", pct).withColumn(
        "status", F.when(F.col("pct") > 10, "Alert").when(F.col("n_exceed") > 0, "Warning").otherwise("OK"))


def guideline_exceedance(df: DataFrame) -> DataFrame:
    """The second form of the screen: both bounds tested, EXCEEDANCE or OK."""
    g = dims.guidelines(df.sparkSession).drop("unit")
    v = F.col("value")
    out = (v < F.col("low")) | (v > F.coalesce("high", F.lit(float("inf"))))
    rows = df.where("value IS NOT NULL").withColumn("parameter", F.lower("parameter")).join(F.broadcast(g), "parameter")
    agg = rows.groupBy("parameter").agg(
        F.count(F.lit(1)).alias("n_measurements"), F.round(F.avg("value"), 4).alias("mean"),
        F.round(F.min("value"), 4).alias("min"), F.round(F.max("value"), 4).alias("max"),
        F.sum(out.cast("long")).alias("n_exceedances"))
    return (agg.withColumn("pct_exceedances", F.round(100.0 * F.col("n_exceedances") / F.col("n_measurements"), 1))
            .withColumn("status", F.when(F.col("n_exceedances") > 0, "EXCEEDANCE").otherwise("OK")))


def status_class(df: DataFrame) -> DataFrame:
    """Good / Moderate / Poor of every sample by its parameter's rule."""
    v, g, m = F.col("value"), F.col("good"), F.col("moderate")
    cls = (F.when(F.col("kind") == "range", F.when(v.between(g, m), "Good").otherwise("Poor"))
           .when(F.col("kind") == "lower", F.when(v <= g, "Good").when(v <= m, "Moderate").otherwise("Poor"))
           .otherwise(F.when(v >= g, "Good").when(v >= m, "Moderate").otherwise("Poor")))
    return (df.where("value IS NOT NULL").join(F.broadcast(dims.eqs(df.sparkSession)), "parameter")
            .withColumn("status", cls))


def status_compliance(df: DataFrame) -> DataFrame:
    agg = status_class(df).groupBy("parameter").agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum((F.col("status") == "Good").cast("long")).alias("n_compliant"))
    pct = F.col("n_compliant") * 100.0 / F.col("n_samples")
    return agg.withColumn("compliance_pct", F.round(pct, 2)).withColumn(
        "status_class", F.when(pct >= 95, "High").when(pct >= 75, "Good").when(pct >= 50, "Moderate")
        .when(pct >= 25, "Poor").otherwise("Bad"))


def rpi_points(param: Column, value: Column) -> Column:
    """Points 1 / 3 / 6 / 10 of the river pollution index."""
    # Upper limits of 1, 3 and 6 points (oxygen: lower limits).
    steps = {"BOD5": (3.0, 4.9, 15.0), "SS": (20.0, 49.9, 100.0), "NH3-N": (0.50, 0.99, 3.00)}
    out = F.when(param == "DO", F.when(value >= 6.5, 1).when(value >= 4.6, 3).when(value >= 2.0, 6).otherwise(10))
    for name, (a, b, c) in steps.items():
        out = out.when(param == name, F.when(value <= a, 1).when(value <= b, 3).when(value <= c, 6).otherwise(10))
    return out.cast("long")


def rpi_index(df: DataFrame, order: str = "seq") -> DataFrame:
    """Index per station and day from the last value of each parameter (at least three of four)."""
    four = df.where(F.col("parameter").isin("DO", "BOD5", "SS", "NH3-N") & F.col("value").isNotNull())
    last = four.groupBy("station_id", F.to_date("ts").alias("date"), "parameter").agg(
        F.max_by("value", order).alias("value"))
    pts = last.withColumn("points", rpi_points(F.col("parameter"), F.col("value")))
    day = pts.groupBy("station_id", "date").agg(F.count(F.lit(1)).alias("n_params"), F.avg("points").alias("x"))
    return (day.where("n_params >= 3").withColumn("rpi", F.bround("x", 2)).withColumn(
        "category", F.when(F.col("x") <= 2, "Non-polluted").when(F.col("x") <= 3, "Lightly polluted")
        .when(F.col("x") <= 6, "Moderately polluted").otherwise("Severely polluted")).drop("x"))


def trophic_state(df: DataFrame) -> DataFrame:
    """Carlson index per station from chlorophyll-a and total phosphorus means."""
    mean = lambda p: F.avg(F.when(F.col("parameter") == p, F.col("value")))
    m = df.groupBy("station_id").agg(mean("Chlorophyll-a").alias("chl"), mean("TP").alias("tp"))
    chl = F.when(F.col("chl") > 0, F.round(9.81 * F.log("chl") + 30.6, 2))
    tp = F.when(F.col("tp") > 0, F.round(14.42 * F.log("tp") + 4.15, 2))
    m = m.select("station_id", chl.alias("tsi_chl"), tp.alias("tsi_tp")).where("tsi_chl IS NOT NULL OR tsi_tp IS NOT NULL")
    tsi = F.when(F.col("tsi_chl").isNull(), F.col("tsi_tp")).when(F.col("tsi_tp").isNull(), F.col("tsi_chl")).otherwise(
        (F.col("tsi_chl") + F.col("tsi_tp")) / 2)
    return m.withColumn("tsi", F.round(tsi, 3)).withColumn(
        "state", F.when(F.col("tsi") < 30, "Oligotrophic").when(F.col("tsi") < 50, "Mesotrophic")
        .when(F.col("tsi") < 70, "Eutrophic").otherwise("Hypereutrophic"))


def spatial_heterogeneity(df: DataFrame) -> DataFrame:
    """Spread of station means and Kruskal-Wallis H per parameter.

    Everything derives from one count table per (parameter, station, value): station means, and the
    ranks per parameter over all stations by the two-level rank table.
    """
    counts = df.where("value IS NOT NULL").groupBy("parameter", "station_id", "value").agg(F.count(F.lit(1)).alias("k"))
    st = counts.groupBy("parameter", "station_id").agg(F.sum("k").alias("c"), (F.sum(F.col("value") * F.col("k")) / F.sum("k")).alias("m"))
    spread = st.groupBy("parameter").agg(F.count(F.lit(1)).alias("n_stations"), F.stddev_samp("m").alias("sd"),
                                         F.avg("m").alias("mm"), F.min("m").alias("mean_min"), F.max("m").alias("mean_max"))
    tested = counts.join(st.where("c >= 3").select("parameter", "station_id", "c"), ["parameter", "station_id"])
    ranks = value_ranks(tested, ["parameter"], weight="k").withColumn("r", avg_rank_expr())
    ties = ranks.groupBy("parameter").agg(F.sum(F.pow("cnt", 3) - F.col("cnt")).alias("ties"), F.max("n").alias("n"))
    sums = (tested.join(ranks.select("parameter", "value", "r"), ["parameter", "value"])
            .groupBy("parameter", "station_id").agg(F.sum(F.col("r") * F.col("k")).alias("rs"), F.max("c").alias("c"))
            .groupBy("parameter").agg(F.sum(F.col("rs") * F.col("rs") / F.col("c")).alias("ss"), F.count(F.lit(1)).alias("g")))
    n = F.col("n")
    h = ratio(12 / (n * (n + 1)) * F.col("ss") - 3 * (n + 1), 1 - F.col("ties") / (F.pow(n, 3) - n))
    return spread.join(sums, "parameter").join(ties, "parameter").where("g >= 2").select(
        "parameter", "n_stations", F.round(F.when(F.col("mm") != 0, F.col("sd") / F.col("mm") * 100).otherwise(0.0), 2)
        .alias("spatial_cv_pct"), F.round(h, 4).alias("kruskal_h"), (F.col("g") - 1).alias("dof"),
        F.round("mean_min", 8).alias("mean_min"), F.round("mean_max", 8).alias("mean_max"))


# Discharge standards and background concentrations of treatment parameters (mg/L).
TREATMENT_STANDARD = {"BOD5": 30.0, "COD": 100.0, "NH3-N": 10.0, "SS": 30.0, "TN": 15.0, "TP": 2.0}
WETLAND_BACKGROUND = {"BOD5": 3.5, "COD": 15.0, "NH3-N": 0.2, "TN": 1.5, "TP": 0.02, "SS": 5.0}


def treatment_performance(df: DataFrame, day_keys: tuple[str, ...] = ("parameter",)) -> DataFrame:
    """Compliance, variability, quartile removal, areal rate and trend removal per treatment parameter.

    The trend is fitted on the daily means (bounded by the calendar), everything else on all samples.
    """
    k = list(day_keys)
    std = F.create_map(*[F.lit(x) for kv in TREATMENT_STANDARD.items() for x in kv])
    bg = F.create_map(*[F.lit(x) for kv in WETLAND_BACKGROUND.items() for x in kv])
    rows = df.where("value IS NOT NULL")
    ranked = value_ranks(rows, k)
    n = F.max("n")
    base = ranked.groupBy(*k).agg(
        n.alias("n"), (F.sum(F.col("value") * F.col("cnt")) / n).alias("mean"),
        F.sum(F.when(F.col("value") <= std[F.col("parameter")], F.col("cnt")).otherwise(0)).alias("ok"),
        *quantile_aggs({"q75": 0.75, "q25": 0.25}))
    var = ranked.join(base.select(*k, "mean"), k).groupBy(*k).agg(
        (F.sum(F.pow(F.col("value") - F.col("mean"), 2) * F.col("cnt")) / F.max("n")).alias("var"))
    days = rows.groupBy(*k, F.to_date("ts").alias("date")).agg(F.avg("value").alias("value"))
    first = days.groupBy(*k).agg(F.min("date").alias("d0"))
    x = F.datediff("date", "d0").cast("double")
    trend = days.join(first, k).groupBy(*k).agg(F.regr_slope("value", x).alias("slope"),
                                                F.regr_intercept("value", x).alias("icpt"), F.max(x).alias("xl"))
    cs = F.coalesce(bg[F.col("parameter")], F.lit(0.0))
    cin, cout = F.col("q75"), F.col("q25")
    k_est = F.when(cin > cs, -F.log(F.greatest(F.lit(0.01), (cout - cs) / (cin - cs)))).otherwise(0.0)
    removal = F.when(F.col("icpt") > 0, F.greatest(F.lit(0.0), -F.col("slope") * F.col("xl") / F.col("icpt") * 100))
    return base.where("n >= 5").join(var, k).join(trend, k).select(
        *k, "n", F.round("mean", 4).alias("mean"), F.round(F.sqrt("var"), 4).alias("std"),
        F.round(F.when(F.col("mean") != 0, F.sqrt(F.col("var") * F.col("n") / (F.col("n") - 1)) / F.col("mean") * 100)
                .otherwise(0.0), 2).alias("cv_pct"),
        F.round(F.when(std[F.col("parameter")].isNotNull(), F.col("ok") * 100.0 / F.col("n")), 2).alias("compliance_pct"),
        F.round(F.when(cin > 0, (cin - cout) / cin * 100).otherwise(0.0), 2).alias("quartile_removal_pct"),
        F.round(k_est, 4).alias("k_rate"), F.round(removal, 2).alias("trend_removal_pct"),
        F.round("slope", 6).alias("trend_slope"))


def oxygen_sag(df: DataFrame, do_sat: float = 9.0, kd: float = 0.3, ka: float = 0.5) -> DataFrame:
    """Streeter-Phelps critical point from mean oxygen and oxygen demand per station."""
    if ka == kd:
        ka += 0.01
    mean = lambda *p: F.avg(F.when(F.col("parameter").isin(*p), F.col("value")))
    cnt = lambda *p: F.count(F.when(F.col("parameter").isin(*p), F.col("value")))
    m = df.groupBy("station_id").agg(mean("DO").alias("do_mean"), mean("BOD5", "BOD").alias("bod"),
                                     cnt("DO").alias("n1"), cnt("BOD5", "BOD").alias("n2")).where("n1 >= 5 AND n2 >= 5")
    d0, bod = F.lit(do_sat) - F.col("do_mean"), F.col("bod")
    arg = (ka / kd) * (1 - d0 * (ka - kd) / (kd * bod))
    m = m.withColumn("tc", F.when((bod > 0) & (arg > 0), F.greatest(F.lit(0.0), F.log(arg) / (ka - kd))).otherwise(0.0))
    tc = F.col("tc")
    dc = F.when(bod > 0, kd * bod / (ka - kd) * (F.exp(-kd * tc) - F.exp(-ka * tc)) + d0 * F.exp(-ka * tc)).otherwise(d0)
    return m.select("station_id", F.round("do_mean", 4).alias("do_mean"), F.round("bod", 4).alias("bod_mean"),
                    F.round("tc", 4).alias("critical_time"), F.round(dc, 4).alias("critical_deficit"),
                    F.round(do_sat - dc, 4).alias("critical_do"))


def oxygen_profile(sag: DataFrame, do_sat: float = 9.0, kd: float = 0.3, ka: float = 0.5, days: float = 10.0,
                   points: int = 50) -> DataFrame:
    """Oxygen along travel time for every station of an ``oxygen_sag`` result."""
    t = F.col("i") * days / (points - 1)
    d0 = do_sat - F.col("do_mean")
    deficit = kd * F.col("bod_mean") / (ka - kd) * (F.exp(-kd * t) - F.exp(-ka * t)) + d0 * F.exp(-ka * t)
    return sag.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).select(
        "station_id", F.round(t, 4).alias("t_days"), F.round(do_sat - deficit, 4).alias("do_mg_l"))
