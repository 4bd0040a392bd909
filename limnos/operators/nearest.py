"""Nearest places on the globe without comparing all pairs.

Places become unit vectors, so neither the dateline nor a pole is an edge, and the cube around the globe is cut into cells, 64 in each cell of the
level before. Donors are only counted by cell. Every target goes down the cells: the counts within reach bound its k-th distance, cells beyond
that bound go, the others are replaced by their own cells until they hold few donors. Only then do donors meet targets. The search is
exact; what a target looks at follows from k and not from the number of donors, and a crowded cell is split before anyone reads it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.operators.catalog import haversine
from limnos.session import cut

BITS = 2  # cell halvings a level and axis
LEVELS = 10  # the smallest cells measure some 12 m
LEAF = 32
EARTH_KM = 6371.0
SLACK = 1e-9  # of unit vectors: distances round to less than that


def _vector(df: DataFrame, lat: str, lon: str) -> DataFrame:
    phi, lam = F.radians(lat), F.radians(lon)
    return df.withColumn("_x", F.cos(phi) * F.cos(lam)).withColumn("_y", F.cos(phi) * F.sin(lam)).withColumn("_z", F.sin(phi))


def _cell(level: Column | int) -> Column:
    """Number of a vector's cell on a level: 21 bits an axis."""
    axis = lambda c: F.least(F.floor((F.col(c) + 1) * float(1 << (BITS * LEVELS - 1))), F.lit((1 << BITS * LEVELS) - 1))
    down = lambda c: F.floor(axis(c) / F.pow(F.lit(2.0), BITS * (LEVELS - F.lit(level)))).cast("long")
    return down("_x") * (1 << 42) + down("_y") * (1 << 21) + down("_z")


def _bounds() -> tuple[Column, Column]:
    """Least and greatest distance between the vector (_x, _y, _z) and the box of (level, cell)."""
    size = F.pow(F.lit(2.0), 1 - BITS * F.col("level"))
    near, far = F.lit(0.0), F.lit(0.0)
    for c, shift in (("_x", 42), ("_y", 21), ("_z", 0)):
        lo = F.shiftright("cell", shift).bitwiseAND((1 << 21) - 1) * size - 1
        gap = F.greatest(F.lit(0.0), lo - F.col(c), F.col(c) - lo - size)
        reach = F.greatest(F.col(c) - lo, lo + size - F.col(c))
        near, far = near + gap * gap, far + reach * reach
    return F.sqrt(near), F.sqrt(far)


def _pruned(frontier: DataFrame, k: int) -> DataFrame:
    near, far = _bounds()
    d = frontier.withColumn("_near", near).withColumn("_far", far)
    so_far = F.sum("n").over(Window.partitionBy("target").orderBy("_far", "level", "cell"))
    d = d.withColumn("_all", so_far).withColumn("_reach", F.min(F.when(F.col("_all") >= k, F.col("_far"))).over(Window.partitionBy("target")))
    return d.where(F.col("_reach").isNull() | (F.col("_near") <= F.col("_reach") + SLACK)).drop("_near", "_far", "_all", "_reach")


def nearest(targets: DataFrame, donors: DataFrame, k: int, id_col: str = "station_id", lat: str = "latitude", lon: str = "longitude", skip_self: bool = False) -> DataFrame:
    """(target, donor, km, place): the ``k`` nearest donors of every target, exactly; distances within a millimetre go by donor id.

    Rows without coordinates are left out. ``skip_self`` keeps a target from being its own donor. With fewer than ``k`` donors all of
    them come out. Ids must be unique on both sides.
    """
    want = k + 1 if skip_self else k
    known = lambda d: d.select(F.col(id_col).alias("_id"), F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon")).dropna()
    # of donors at one place the first by id suffice
    first = F.row_number().over(Window.partitionBy("_lat", "_lon").orderBy("_id"))
    d = _vector(known(donors).withColumn("_first", first).where(F.col("_first") <= want).drop("_first"), "_lat", "_lon")
    d = cut(d.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(LEVELS)))).withColumn("cell", _cell(F.col("level"))).drop("_x", "_y", "_z"))
    up = sum((F.shiftright(F.shiftright("cell", s).bitwiseAND((1 << 21) - 1), BITS) * (1 << s) for s in (42, 21, 0)), F.lit(0).cast("long"))
    counts = cut(d.groupBy("level", "cell").agg(F.count(F.lit(1)).alias("n")))
    parents = counts.where(F.col("n") > LEAF).select((F.col("level") + 1).alias("level"), F.col("cell").alias("parent"))
    below = counts.withColumn("parent", up).join(parents, ["level", "parent"], "left_semi")
    leaf = (F.col("n") <= LEAF) | (F.col("level") == LEVELS)
    tree = cut(counts.where("level = 1").withColumn("parent", F.lit(0).cast("long")).unionByName(below).withColumn("leaf", leaf))
    t = _vector(known(targets), "_lat", "_lon").withColumnRenamed("_id", "target")
    top = F.broadcast(tree.where("level = 1").drop("parent"))  # at most 64 cells
    frontier = cut(_pruned(t.join(top, F.lit(True)), want))
    for _ in range(LEVELS):
        open_ = frontier.where("NOT leaf")
        if open_.isEmpty():
            break
        inner = open_.select("target", "_lat", "_lon", "_x", "_y", "_z", (F.col("level") + 1).alias("level"), F.col("cell").alias("parent")).join(tree, ["level", "parent"]).drop("parent")
        frontier = cut(_pruned(frontier.where("leaf").unionByName(inner), want))
    own = d.join(tree.where("leaf").select("level", "cell"), ["level", "cell"]).select("level", "cell", F.col("_id").alias("donor"), F.col("_lat").alias("_dlat"), F.col("_lon").alias("_dlon"))
    met = frontier.select("target", "_lat", "_lon", "level", "cell").join(own, ["level", "cell"])
    if skip_self:
        met = met.where("target <> donor")
    met = met.withColumn("km", haversine(F.col("_lat"), F.col("_lon"), F.col("_dlat"), F.col("_dlon"), EARTH_KM))
    place = F.row_number().over(Window.partitionBy("target").orderBy(F.round("km", 6), "donor"))
    return met.withColumn("place", place).where(F.col("place") <= k).select("target", "donor", "km", "place")


def spatial_weights(targets: DataFrame, donors: DataFrame, k: int = 10, **columns) -> DataFrame:
    """(target, donor, km, weight): inverse-distance weights of each target's ``k`` nearest donors, which add up to one."""
    d = nearest(targets, donors, k, **columns).withColumn("_i", 1 / (F.col("km") + 1e-6))
    return d.select("target", "donor", "km", (F.col("_i") / F.sum("_i").over(Window.partitionBy("target"))).alias("weight"))


__all__: Sequence[str] = ("nearest", "spatial_weights")
