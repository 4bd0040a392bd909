"""Spark helpers of this subpackage: joins that split hot keys, gapless numbering without one task per key, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from limnos.session import scratch_path

BROADCAST_ROWS = 1_000_000  # rows of two or three longs: at most some 40 MB; larger sides are shuffled


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends, lost executors cost nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side whose counted rows stay below ``limit``; leave any larger one to a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def join_split(left: DataFrame, right: DataFrame, keys: str | list[str], how: str = "inner") -> DataFrame:
    """Equi-join whose hot keys can be split at run time.

    An aggregated side keeps its partitioning, which stops the runtime from splitting the other side's hot key. One more key that
    follows from the others makes Spark deal out both sides anew.
    """
    keys = [keys] if isinstance(keys, str) else keys
    again = F.pmod(F.xxhash64(*keys), F.lit(1024))
    return left.withColumn("_again", again).join(right.withColumn("_again", again), [*keys, "_again"], how).drop("_again")


def gapless(df: DataFrame, key: str, order: list[str], out: str, spread: int = 256, bucket: Column | None = None) -> DataFrame:
    """Number the rows of every key from 0 without gaps, with ``spread`` tasks a key instead of one.

    Rows go to ``spread`` buckets of each key by a hash of ``order``; a bucket's base is the count of the buckets before it, so the
    only window over a whole key has ``spread`` rows. ``order`` must tell the rows apart for the numbering to be repeatable. With a
    ``bucket`` that never falls along ``order`` the numbers follow ``order`` through the whole key.
    """
    b = "_bucket"
    dealt = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(spread)).cast("int") if bucket is None else bucket)
    counts = dealt.groupBy(key, b).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col(key).alias("_k"), F.col(b).alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(key, b).orderBy(*order)
    numbered = dealt.withColumn("_rank", F.row_number().over(inside) - 1)
    return (numbered.join(bases, numbered[key].eqNullSafe(bases["_k"]) & (numbered[b] == bases["_b"]))
            .withColumn(out, (F.col("_base") + F.col("_rank")).cast("long")).drop("_k", "_b", "_base", "_rank", b))


def file_place() -> Column:
    """Place of a row in a table read from Parquet files that Spark wrote in order: writing task, file of the task, row of the file."""
    name = F.col("_metadata.file_name")
    number = lambda pattern: F.regexp_extract(name, pattern, 1).try_cast("int")
    return F.struct(number("^part-([0-9]+)").alias("task"), number("-c([0-9]+)[.]").alias("file"), F.col("_metadata.row_index").alias("row"))


def running(df: DataFrame, key: str, value: str, order: list[str], out: str, spread: int = 1024) -> DataFrame:
    """Sum of ``value`` over the rows of a key before each row, in order of a hash bucket and then of ``order``, without one task per key."""
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(spread)).cast("int"))
    sums = dealt.groupBy(key, "_bucket").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(key, "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (dealt.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(bases, [key, "_bucket"])
            .withColumn(out, F.col("_base") + F.col("_own")).drop("_bucket", "_base", "_own"))


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(links: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """Connected components by alternating large-star and small-star: every linked node beside the smallest node it reaches.

    Large-star ties each larger neighbour of a node to the node's smallest neighbour, small-star ties the smaller ones and the node
    itself. Both are a minimum per node (combined before the shuffle) joined back to the edges, so a hub's edges are spread over
    tasks. The loop ends when every edge leads straight to a node without a smaller one. Empty links give an empty table. Columns: node, component.
    """
    e = landed(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
               .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    while not e.isEmpty():
        both = _neighbours(e)
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        large = join_split(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = landed(large, name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = join_split(large, low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = landed(tied.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), name)
        chained = e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
        forked = e.groupBy("u").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi")).where("_lo < _hi").select("u")
        if chained.unionByName(forked).isEmpty():
            break
    # every edge now leads from a node to the smallest node of its component
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def with_columns(df: DataFrame, fields: dict[str, T.DataType]) -> T.StructType:
    """Schema of ``df`` with more fields."""
    return T.StructType(df.schema.fields + [T.StructField(k, v) for k, v in fields.items()])
