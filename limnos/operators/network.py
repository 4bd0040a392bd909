"""River networks and grids as pointer tables.

Every node points at the node it drains to. Walking such a tree one step per round would need as
many rounds as it is deep; instead the pointers are doubled (2, 4, 8 ... steps), so a whole
traversal of any tree takes log2(depth) joins. Each round is written to the shared checkpoint
folder, which keeps the plan short and lets lost executors be replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limnos.session import cut


def pointers(edges: DataFrame, node: str, down: str) -> DataFrame:
    """(v, j): node and where it drains; null at an outlet or where the target is not in the table."""
    e = edges.select(F.col(node).alias("v"), F.col(down).alias("j"))
    known = e.select(F.col("v").alias("j"), F.lit(True).alias("_in"))
    return e.join(known, "j", "left").select("v", F.when(F.col("_in"), F.col("j")).alias("j"))


def jump_tables(ptr: DataFrame) -> list[DataFrame]:
    """J_0, J_1, ... with J_k(v) the node 2^k steps downstream; stops when every pointer has run out.

    A path without cycles has fewer steps than there are nodes, so more doublings than that mean a cycle.
    """
    rounds = max(1, ptr.count()).bit_length() + 1
    tables, cur = [], cut(ptr.where("j IS NOT NULL"))
    while len(tables) < rounds and not cur.isEmpty():
        tables.append(cur)
        nxt = cur.alias("a").join(cur.alias("b"), F.col("a.j") == F.col("b.v")).select(F.col("a.v").alias("v"), F.col("b.j").alias("j"))
        cur = cut(nxt)
    if not cur.isEmpty():
        raise ValueError("the network has a cycle; run break_cycles first")
    return tables


def break_cycles(ptr: DataFrame) -> DataFrame:
    """Drops the outgoing pointer of nodes on a cycle (flat cells that drain into each other).

    After more doublings than the tree can be deep, the only live targets are cycle members.
    """
    rounds = max(1, ptr.count()).bit_length()
    cur = cut(ptr.where("j IS NOT NULL"))
    for _ in range(rounds):
        if cur.isEmpty():
            return ptr
        cur = cut(cur.alias("a").join(cur.alias("b"), F.col("a.j") == F.col("b.v")).select(F.col("a.v").alias("v"), F.col("b.j").alias("j")))
    on_cycle = cur.select(F.col("j").alias("v")).distinct().withColumn("_c", F.lit(True))
    return ptr.join(on_cycle, "v", "left").select("v", F.when(F.col("_c").isNull(), F.col("j")).alias("j"))


def upstream_sums(values: DataFrame, tables: Sequence[DataFrame], sums: Sequence[str] = (), maxs: Sequence[str] = ()) -> DataFrame:
    """Sum (or maximum) of each column over a node and everything upstream of it, for all nodes at once.

    Invariant: after round k a node holds the total within 2^k steps, so adding the totals of the
    nodes exactly 2^k steps upstream doubles the reach.
    """
    cols = [*sums, *maxs]
    acc = values.select("v", *cols)
    for t in tables:
        inc = t.join(acc, "v").groupBy(F.col("j").alias("v")).agg(
            *[F.sum(c).alias(f"_{c}") for c in sums], *[F.max(c).alias(f"_{c}") for c in maxs])
        acc = cut(acc.join(inc, "v", "left").select(
            "v", *[(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in sums],
            *[F.greatest(c, f"_{c}").alias(c) for c in maxs]))
    return acc


def downstream_closure(seeds: DataFrame, tables: Sequence[DataFrame]) -> DataFrame:
    """All nodes on the way down from the seeds, seeds included."""
    reach = seeds.select("v").distinct()
    for t in tables:
        reach = cut(reach.unionByName(t.join(reach, "v").select(F.col("j").alias("v"))).distinct())
    return reach


def downstream_path(start: DataFrame, tables: Sequence[DataFrame]) -> DataFrame:
    """(start, v, step): the path below each start node, in log rounds."""
    path = start.select(F.col("v").alias("start"), "v", F.lit(0).cast("long").alias("step"))
    for k, t in enumerate(tables):
        more = path.join(t, "v").select("start", F.col("j").alias("v"), (F.col("step") + (1 << k)).alias("step"))
        path = cut(path.unionByName(more))
    return path


def members(ptr: DataFrame, outlets: DataFrame) -> DataFrame:
    """(v, outlet): the nearest given outlet at or below each node; nodes that drain elsewhere are left out.

    Outlets stop the walk, so for nested outlets a node belongs to the first one it meets.
    """
    o = outlets.select("v").distinct().withColumn("_o", F.lit(True))
    cur = ptr.join(o, "v", "left").select("v", F.when(F.col("_o").isNull(), F.col("j")).alias("j"))
    tables = jump_tables(break_cycles(cur))
    root = ptr.select("v", F.col("v").alias("root"))
    for t in reversed(tables):  # longest jump first: each is taken at most once
        root = cut(root.join(t.select(F.col("v").alias("root"), "j"), "root", "left").select("v", F.coalesce("j", "root").alias("root")))
    return root.join(o.select(F.col("v").alias("root")), "root").select("v", F.col("root").alias("outlet"))


def strahler(ptr: DataFrame, tables: Sequence[DataFrame]) -> DataFrame:
    """Stream order. A node has order above k exactly when it lies at or below a node with two tributaries
    of order k or more, so the loop runs over orders, not over levels, until no order has two tributaries."""
    left, levels, held, k = ptr.where("v IS NOT NULL"), [], None, 1
    while True:
        joins = left.where("j IS NOT NULL").groupBy(F.col("j").alias("v")).agg(F.count(F.lit(1)).alias("c"))
        seeds = cut(joins.where("c >= 2").select("v"))
        if seeds.isEmpty():
            break
        k += 1
        at_least = downstream_closure(seeds, tables)
        levels.append(at_least.select("v", F.lit(k).cast("long").alias("_k")))
        n = at_least.count()
        # the next order lies within this one, which drains into itself: the rest of the network is not read again
        if held is None or 4 * n <= held:
            held, left = n, cut(left.join(at_least, "v", "left_semi"))
            tables = [t for t in (cut(t.join(at_least, "v", "left_semi")) for t in tables) if not t.isEmpty()]
        else:
            left = left.join(at_least, "v", "left_semi")
    if not levels:
        return ptr.select("v", F.lit(1).cast("long").alias("strahler"))
    top = reduce(DataFrame.unionByName, levels).groupBy("v").agg(F.max("_k").alias("_k"))
    return cut(ptr.select("v").join(top, "v", "left").select("v", F.coalesce("_k", F.lit(1).cast("long")).alias("strahler")))


def area_weighted(attrs: DataFrame, tables: Sequence[DataFrame], mean: Sequence[str] = (), total: Sequence[str] = (), top: Sequence[str] = (),
                  area: str = "sub_area", nodata: float = -9999.0) -> DataFrame:
    """Catchment attributes of every node: area-weighted means, sums and maxima over its upstream area.

    An attribute that is nodata in the whole upstream area is null.
    """
    w = F.greatest(F.col(area), F.lit(0.0))
    ok = lambda c: F.when(F.col(c) > nodata, F.col(c))
    known = sorted({*mean, *total})
    v = attrs.select("v", F.lit(1).cast("long").alias("n_sub_basins"), w.alias("area"), *[F.coalesce(ok(c) * w, F.lit(0.0)).alias(f"m_{c}") for c in mean],
                     *[F.coalesce(ok(c), F.lit(0.0)).alias(f"s_{c}") for c in total], *[ok(c).isNotNull().cast("long").alias(f"k_{c}") for c in known], *[ok(c).alias(f"x_{c}") for c in top])
    s = upstream_sums(v, tables, ["n_sub_basins", "area", *[f"m_{c}" for c in mean], *[f"s_{c}" for c in total], *[f"k_{c}" for c in known]], [f"x_{c}" for c in top])
    d = F.when(F.col("area") > 0, F.col("area")).otherwise(1.0)
    return s.select("v", "n_sub_basins", F.col("area").alias("area_km2"), *[F.when(F.col(f"k_{c}") > 0, F.col(f"m_{c}") / d).alias(f"{c}_mean") for c in mean],
                    *[F.when(F.col(f"k_{c}") > 0, F.col(f"s_{c}")).alias(f"{c}_sum") for c in total], *[F.col(f"x_{c}").alias(f"{c}_max") for c in top])


# ── elevation grids ─────────────────────────────────────────────────────────────
# Flow codes with row and column offset, clockwise from east.
D8 = ((1, 0, 1), (2, 1, 1), (4, 1, 0), (8, 1, -1), (16, 0, -1), (32, -1, -1), (64, -1, 0), (128, -1, 1))


def cell_id(grid: Column, row: Column, col: Column) -> Column:
    return F.concat_ws(":", grid, row.cast("string"), col.cast("string"))


def neighbours(cells: DataFrame) -> DataFrame:
    """One row per cell with its own elevation and the array of existing neighbours.

    Each cell sends its elevation to the cells around it, so the exchange is by cell key and a grid
    with very long rows or columns is as balanced as a square one.
    """
    send = F.array(*[F.struct(F.lit(c).alias("code"), F.lit(i).alias("ord"), (F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), F.col("elev").alias("elev"))
                     for i, (c, dr, dc) in enumerate(D8)])
    sent = cells.select("grid_id", F.explode(send).alias("s")).select("grid_id", F.col("s.row").alias("row"), F.col("s.col").alias("col"),
                                                                     F.struct("s.ord", "s.code", "s.elev").alias("nb"))
    own = cells.select("grid_id", "row", "col", F.col("elev").alias("own"), F.lit(None).cast(sent.schema["nb"].dataType).alias("nb"))
    g = own.unionByName(sent.withColumn("own", F.lit(None).cast("double"))).groupBy("grid_id", "row", "col").agg(
        F.max("own").alias("elev"), F.array_sort(F.collect_list("nb")).alias("nb"))
    return g.where("elev IS NOT NULL")


def d8_direction(cells: DataFrame) -> DataFrame:
    """Steepest-descent code per cell; flats take their first neighbour that is not higher, pits 0."""
    drop = lambda n: (F.col("elev") - n["elev"]) / F.when(n["code"].isin(1, 4, 16, 64), 1.0).otherwise(2 ** 0.5)
    best = F.aggregate("nb", F.struct(F.lit(0.0).alias("d"), F.lit(0).alias("code")), lambda a, n: F.when(
        drop(n) > a["d"], F.struct(drop(n).alias("d"), n["code"].alias("code"))).otherwise(a), lambda a: a["code"])
    flat = F.get(F.filter("nb", lambda n: n["elev"] <= F.col("elev")), F.lit(0))["code"]
    return neighbours(cells).withColumn("_b", best).select(
        "grid_id", "row", "col", "elev", F.when(F.col("_b") != 0, F.col("_b")).otherwise(F.coalesce(flat, F.lit(0))).cast("long").alias("direction"))


def grid_pointers(direction: DataFrame) -> DataFrame:
    dr = F.lit(0)
    dc = F.lit(0)
    for c, r, k in D8:
        dr, dc = F.when(F.col("direction") == c, r).otherwise(dr), F.when(F.col("direction") == c, k).otherwise(dc)
    g = direction.withColumn("v", cell_id(F.col("grid_id"), F.col("row"), F.col("col")))
    g = g.withColumn("down", F.when(F.col("direction") != 0, cell_id(F.col("grid_id"), F.col("row") + dr, F.col("col") + dc)))
    return pointers(g, "v", "down")


def slope_degrees(cells: DataFrame, cell_size: float = 1.0) -> DataFrame:
    """Gradient slope: central differences inside, one-sided at the edges."""
    at = lambda code: F.get(F.filter("nb", lambda n: n["code"] == code), F.lit(0))["elev"]
    def grad(lo: Column, hi: Column) -> Column:
        e = F.col("elev")
        return F.when(lo.isNull() & hi.isNull(), 0.0).when(lo.isNull(), hi - e).when(hi.isNull(), e - lo).otherwise((hi - lo) / 2) / cell_size
    d = neighbours(cells).withColumn("gx", grad(at(16), at(1))).withColumn("gy", grad(at(64), at(4)))
    return d.select("grid_id", "row", "col", F.degrees(F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))).alias("slope_deg"))


def flow_accumulation(ptr: DataFrame, tables: Sequence[DataFrame]) -> DataFrame:
    return upstream_sums(ptr.select("v", F.lit(1).cast("long").alias("accumulation")), tables, ["accumulation"])


def snap_points(points: DataFrame, accumulation: DataFrame, distance: int = 5) -> DataFrame:
    """Cell with the largest accumulation in the window around each point; ties go to the first in row order.

    A point spreads over its (2 d + 1)^2 window cells, so the lookup is an equi-join by cell.
    """
    off = F.sequence(F.lit(-distance), F.lit(distance))
    w = points.withColumn("dr", F.explode(off)).withColumn("dc", F.explode(off)).select(
        "point_id", "grid_id", (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"))
    hit = w.join(accumulation, ["grid_id", "row", "col"])
    best = F.max_by(F.struct("grid_id", "row", "col", "accumulation"), F.struct("accumulation", -F.col("row"), -F.col("col")))
    return hit.groupBy("point_id").agg(best.alias("b")).select("point_id", "b.*")


def catchment_stats(cells: DataFrame, key: Sequence[str], cell_size: float = 1.0, threshold: int = 100) -> DataFrame:
    """Area, mean elevation and slope, stream density and elongation of catchment cells."""
    n = F.count(F.lit(1))
    area = n * cell_size * cell_size / 1e6
    length = F.sqrt(F.pow(F.max("row") - F.min("row"), 2) + F.pow(F.max("col") - F.min("col"), 2)) * cell_size
    streams = F.sum((F.col("accumulation") >= threshold).cast("long")) * cell_size / 1000
    diameter = 2 * F.sqrt(n * cell_size * cell_size / F.pi())
    return cells.groupBy(*key).agg(n.alias("n_cells"), area.alias("area_km2"), F.avg("elev").alias("mean_elevation"), F.avg("slope_deg").alias("mean_slope"),
                                   (streams / area).alias("stream_density"), F.when(n < 2, 1.0).when(length > 0, diameter / length).otherwise(1.0).alias("elongation_ratio"))


def prepare(ptr: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Pointers and their jump tables, with cycles cut when there are any."""
    ptr = cut(ptr)
    try:
        return ptr, jump_tables(ptr)
    except ValueError:
        ptr = cut(break_cycles(ptr))
        return ptr, jump_tables(ptr)
