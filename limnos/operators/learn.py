"""Machine-learning tasks on Spark ML, and features for them."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.operators.ensemble import cross_products, solve_rows
from limnos.operators.series import KEYS, by, exact_quantiles, numbered
from limnos.operators.periods import trailing
from limnos.session import cut


def lag_features(df: DataFrame, lags: Sequence[int] = (1, 2, 3, 7), windows: Sequence[int] = (7, 30), keys: Sequence[str] = KEYS) -> DataFrame:
    """Lags, full-window rolling mean and sd, and calendar columns; rows without a complete history are dropped."""
    d = df.select(*keys, "date", F.col("value").alias("y"))
    for n in lags:
        d = d.withColumn(f"lag_{n}", F.lag("y", n).over(by(keys)))
    for w in windows:
        full = F.count("y").over(trailing(keys, w)) == w
        d = d.withColumn(f"rolling_mean_{w}", F.when(full, F.avg("y").over(trailing(keys, w)))).withColumn(
            f"rolling_std_{w}", F.when(full, F.stddev_samp("y").over(trailing(keys, w))))
    d = d.withColumn("dayofyear", F.dayofyear("date").cast("long")).withColumn("month", F.month("date").cast("long")).withColumn(
        "season", F.floor(F.month("date") % 12 / 3).cast("long"))
    return d.dropna()


def seasonal_features(df: DataFrame, lags: Sequence[int] = (1, 2, 3, 7, 14, 30), keys: Sequence[str] = KEYS) -> DataFrame:
    """Lags, day-of-year sine and cosine, running means that may be short at the start."""
    d = df.select(*keys, "date", F.col("value").alias("y"))
    for n in lags:
        d = d.withColumn(f"lag_{n}", F.lag("y", n).over(by(keys)))
    a = 2 * math.pi * F.dayofyear("date") / 365.25
    d = d.withColumn("doy_sin", F.sin(a)).withColumn("doy_cos", F.cos(a))
    for w in (7, 30):
        d = d.withColumn(f"rolling_mean_{w}", F.avg("y").over(trailing(keys, w)))
    return d.dropna()


def enough(df: DataFrame, rows: int) -> bool:
    """Whether a training table has at least ``rows`` rows (reads no more than that); says so where it has not."""
    found = df.limit(rows).count()
    if found < rows:
        warnings.warn(f"{found} training rows where {rows} are needed: the result is empty", stacklevel=3)
    return found >= rows


def holdout(df: DataFrame, share: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Repeatable split by row hash (a rerun task draws the same rows)."""
    h = F.pmod(F.xxhash64(*df.columns), F.lit(1000)) < int(share * 1000)
    return df.where(~h), df.where(h)


def pca_clusters(wide: DataFrame, names: Sequence[str], k: int = 3, components: int = 2, seed: int = 42) -> DataFrame:
    """Standardised principal components clustered by k-means."""
    if not enough(wide, 10):
        return wide.limit(0).select("*", *[F.lit(0.0).alias(f"pc{i + 1}") for i in range(min(components, len(names)))], F.lit(0).alias("cluster"))
    stages = [VectorAssembler(inputCols=list(names), outputCol="_x"), StandardScaler(inputCol="_x", outputCol="_z", withMean=True),
              PCA(k=min(components, len(names)), inputCol="_z", outputCol="_p"), KMeans(k=k, seed=seed, featuresCol="_p", predictionCol="cluster")]
    d = Pipeline(stages=stages).fit(wide).transform(wide)
    p = vector_to_array("_p")
    return d.select(*wide.columns, *[F.get(p, F.lit(i)).alias(f"pc{i + 1}") for i in range(min(components, len(names)))], "cluster")


def forest_classify(wide: DataFrame, names: Sequence[str], trees: int = 100, seed: int = 42) -> DataFrame:
    """Terciles of the first parameter from the others: accuracy and importances."""
    target, xs = names[0], list(names[1:])
    spark = wide.sparkSession
    if not enough(wide, 20):
        return spark.createDataFrame([], "feature string, importance double, accuracy double")
    q = exact_quantiles(wide.select(F.lit(0).alias("_k"), F.col(target).alias("value")), ["_k"], {"lo": 1 / 3, "hi": 2 / 3})
    x = F.col(target)
    d = wide.join(F.broadcast(q), F.lit(True)).withColumn("label", F.when(x < F.col("lo"), 0.0).when(x < F.col("hi"), 1.0).otherwise(2.0))
    train, test = holdout(d.select(*names, "label"), 0.3)
    va = VectorAssembler(inputCols=xs, outputCol="features")
    model = RandomForestClassifier(numTrees=trees, seed=seed).fit(va.transform(train))
    acc = MulticlassClassificationEvaluator(metricName="accuracy").evaluate(model.transform(va.transform(test)))
    return spark.createDataFrame([(c, float(i), float(acc)) for c, i in zip(xs, model.featureImportances.toArray())], "feature string, importance double, accuracy double")


def regress(train: DataFrame, test: DataFrame, xs: Sequence[str], y: str, kind: str = "gbt", weight: str | None = None, seed: int = 42) -> DataFrame:
    """Predictions of the test rows by boosted trees, a forest or a ridge line."""
    if not enough(train, 10):
        return test.limit(0).withColumn("prediction", F.lit(0.0))
    models = {"gbt": lambda: GBTRegressor(labelCol=y, maxIter=100, maxDepth=5, stepSize=0.1, seed=seed), "forest": lambda: RandomForestRegressor(labelCol=y, numTrees=100, maxDepth=5, seed=seed),
              "linear": lambda: LinearRegression(labelCol=y, regParam=1e-6), "ridge": lambda: LinearRegression(labelCol=y, regParam=1.0, elasticNetParam=0.0)}
    m = models[kind]()
    if weight:
        m = m.setWeightCol(weight)
    va = VectorAssembler(inputCols=list(xs), outputCol="features", handleInvalid="skip")
    return m.fit(va.transform(train)).transform(va.transform(test)).drop("features")


def skill(pred: DataFrame, y: str, keys: Sequence[str] = ()) -> DataFrame:
    v = F.var_pop(y)
    return pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.when(v > 0, 1 - F.avg(F.pow(F.col("prediction") - F.col(y), 2)) / v).alias("r2"),
                                   F.sqrt(F.avg(F.pow(F.col("prediction") - F.col(y), 2))).alias("rmse"))


def lag_forecast(monthly: DataFrame, n_lags: int = 6, steps: int = 6, keys: Sequence[str] = KEYS, kind: str = "linear") -> DataFrame:
    """One pooled model on lagged monthly values; the last ``steps`` months of each station are held out."""
    f = lag_features(monthly, range(1, n_lags + 1), (), keys)
    s = numbered(f.withColumnRenamed("y", "value"), keys).withColumnRenamed("value", "y")
    xs = [f"lag_{i}" for i in range(1, n_lags + 1)]
    train, test = s.where(F.col("rn") <= F.col("n") - steps), s.where(F.col("rn") > F.col("n") - steps)
    return regress(train, test, xs, "y", kind).select(*keys, "date", "y", "prediction")


def transfer(features: DataFrame, donors: DataFrame, target_weight: float = 4.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Donor-pooled linear model of every target with the target's own early rows at a higher weight, scored on its late rows.

    ``donors`` is (target, donor). A target's late half and everything that donors observed from its start on are kept out of the
    target's training table. All targets are fitted at once: their weighted cross products are one grouped aggregate.
    """
    key = keys[0]
    xs = [c for c in features.columns if c.startswith(("lag_", "rolling_", "doy_"))]
    s = numbered(features.withColumnRenamed("y", "value"), keys).withColumnRenamed("value", "y").withColumn("late", F.col("rn") > F.col("n") / 2)
    split = s.where("late").groupBy(F.col(key).alias("target")).agg(F.min("date").alias("split"))
    early = s.where("NOT late").select(F.col(key).alias("target"), *xs, "y", F.lit(float(target_weight)).alias("w"))
    pairs = donors.where(F.col("target") != F.col("donor")).join(split, "target").withColumnRenamed("donor", key)
    pool = pairs.join(s.select(key, "date", *xs, "y"), key).where("date < split").select("target", *xs, "y", F.lit(1.0).alias("w"))
    rows = pool.unionByName(early).withColumn("one", F.lit(1.0))
    names = ["one", *xs]
    r = F.sqrt("w")
    weighted = rows.select("target", *[(F.col(c) * r).alias(c) for c in names], (F.col("y") * r).alias("y"))
    beta = solve_rows(cross_products(weighted, names, "y", ["target"]), names, ["target"], [1e-6] * len(names))
    wide = beta.groupBy("target").pivot("term", names).agg(F.first("estimate")).select("target", *[F.col(c).alias(f"b_{c}") for c in names])
    test = s.where("late").withColumn("target", F.col(key)).withColumn("one", F.lit(1.0)).join(wide, "target")
    predicted = sum((F.col(f"b_{c}") * F.col(c) for c in names), F.lit(0.0))
    return skill(test.withColumn("prediction", predicted), "y", keys)


def stacking(df: DataFrame, xs: Sequence[str], y: str, folds: int = 5, bases: Sequence[str] = ("linear", "forest"), test_share: float = 0.2) -> DataFrame:
    """Out-of-fold base predictions train a ridge meta-model, the bases are fitted again on all training rows; scored on rows held out.

    Folds follow a row hash, so equal rows stay together; rows are told apart by a number that is written with them.
    """
    d = cut(df.withColumn("_id", F.monotonically_increasing_id()))
    h = F.xxhash64(*df.columns)
    train = d.where(F.pmod(h, F.lit(1000)) >= int(test_share * 1000)).withColumn("_f", F.pmod(F.shiftright(h, 20), F.lit(folds)))
    test = d.where(F.pmod(h, F.lit(1000)) < int(test_share * 1000))
    oof, again = train.select("_id", y), test.select("_id", y)
    for b in bases:
        parts = None
        for f in range(folds):
            p = regress(train.where(F.col("_f") != f), train.where(F.col("_f") == f), xs, y, b).select("_id", F.col("prediction").alias(f"p_{b}"))
            parts = p if parts is None else parts.unionByName(p)
        oof = oof.join(parts, "_id")
        again = again.join(regress(train, test, xs, y, b).select("_id", F.col("prediction").alias(f"p_{b}")), "_id")
    return skill(regress(oof, again, [f"p_{b}" for b in bases], y, "ridge"), y)


def anomaly_scores(features: DataFrame, names: Sequence[str], contamination: float = 0.05, keys: Sequence[str] = KEYS) -> DataFrame:
    """Largest robust z over the lag features per row; the top share of each station is flagged.

    Spark ML has no isolation forest; median and scaled absolute deviation per station take its place.
    """
    k = list(keys)
    med = features.groupBy(*k).agg(*[F.percentile(c, F.lit(0.5)).alias(f"m_{c}") for c in names])
    d = features.join(med, k)
    dev = d.select(*k, "date", "y", *[F.abs(F.col(c) - F.col(f"m_{c}")).alias(c) for c in names])
    mad = dev.groupBy(*k).agg(*[F.percentile(c, F.lit(0.5)).alias(f"s_{c}") for c in names])
    z = F.greatest(*[F.when(F.col(f"s_{c}") > 0, F.col(c) / (1.4826 * F.col(f"s_{c}"))).otherwise(0.0) for c in names])
    d = dev.join(mad, k).select(*k, "date", "y", z.alias("anomaly_score"))
    cutv = exact_quantiles(d.select(*k, F.col("anomaly_score").alias("value")), k, {"cut": 1 - contamination})
    return d.join(cutv, k).select(*k, "date", "y", "anomaly_score", (F.col("anomaly_score") > F.col("cut")).alias("is_anomaly"))


# Standards whose exceedance is simulated (oxygen: falling below).
EXCEED = {"DO": 5.0, "BOD5": 4.0, "COD": 25.0, "NH3-N": 1.0, "SS": 50.0, "pH": 9.0}


def monte_carlo(df: DataFrame, n: int = 5000, seed: int = 42) -> DataFrame:
    """Simulated interval and exceedance probability of each parameter from its mean and sd.

    Draws come from hashed uniforms, so a rerun task repeats them. The closed-form tail stands beside.
    """
    from limnos.functions.special import norm_cdf, norm_ppf

    st = df.where("value IS NOT NULL").groupBy("parameter").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.count(F.lit(1)).alias("n"))
    st = st.where("n >= 10 AND std > 0")
    d = st.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(n))))
    d = d.withColumn("u", (F.pmod(F.xxhash64(F.lit(seed), "parameter", "i"), F.lit(2 ** 40)) + 0.5) / float(2 ** 40))
    d = d.withColumn("x", F.col("mean") + F.col("std") * norm_ppf("u"))
    lim = F.create_map(*[F.lit(v) for kv in EXCEED.items() for v in kv])[F.col("parameter")]
    hit = F.when(F.col("parameter") == "DO", F.col("x") < lim).otherwise(F.col("x") > lim)
    g = d.groupBy("parameter").agg(F.percentile("x", F.lit(0.025)).alias("ci_low"), F.percentile("x", F.lit(0.975)).alias("ci_high"), F.avg(hit.cast("double")).alias("exceedance_probability"))
    out = st.join(g, "parameter").withColumn("_z", (lim - F.col("mean")) / F.col("std") * F.when(F.col("parameter") == "DO", 1.0).otherwise(-1.0))
    return out.withColumn("normal_tail", norm_cdf("_z")).drop("_z")
