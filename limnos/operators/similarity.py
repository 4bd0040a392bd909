"""Catchment similarity, donors and regionalisation.

Ranking every target against every donor is quadratic in the number of catchments. Donors are cut into
blocks of neighbours by median splits; a target first meets its own block, and then only blocks whose
bounding box could hold a nearer donor than the k-th it has found. Tasks return local top k lists.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limnos.functions.arith import correlation, ratio
from limnos.operators.ensemble import cross_products, solve_rows
from limnos.session import cut

SCALE_KM = 500.0


@dataclass(frozen=True)
class Feature:
    column: str
    transform: str | None = None
    weight: float = 1.0


# Catchment attributes with their transform and weight.
CATCHMENT_FEATURES = (
    Feature("area_km2", "log10", 1.5), Feature("elevation_m", None, 1.0), Feature("slope_deg", "log1p", 1.0),
    Feature("precipitation_mm_yr", None, 1.5), Feature("aridity_index", "log1p", 1.5), Feature("temperature_c", None, 1.0),
    Feature("snow_cover_pct", None, 1.0), Feature("forest_pct", None, 0.7), Feature("cropland_pct", None, 0.7),
    Feature("urban_pct", "log1p", 0.7), Feature("clay_pct", None, 0.5), Feature("sand_pct", None, 0.5),
    Feature("population_density", "log1p", 0.5), Feature("degree_of_regulation_pct", "log1p", 0.7))


def transformed(f: Feature) -> Column:
    x = F.col(f.column).cast("double")
    if f.transform == "log10":
        return F.when(x.isNotNull(), F.log10(F.greatest(x, F.lit(1e-3))))  # greatest() would pass over a missing value
    if f.transform == "log1p":
        return F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))
    return x


def feature_table(df: DataFrame, key: str, features: Sequence[Feature], extra: Sequence[str] = ()) -> DataFrame:
    return df.select(F.col(key).alias("id"), *extra, *[transformed(f).alias(f"f{i}") for i, f in enumerate(features)])


def _topk(did: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Column places of the k smallest scores of every row, by score and then donor id, and the scores. ``did`` must ascend."""
    kk = min(k, score.shape[1])
    limit = np.partition(score, kk - 1, axis=1)[:, kk - 1:kk] if kk else score[:, :0]
    keep = score <= limit if kk else np.zeros(score.shape, bool)
    rows, cols = np.nonzero(keep)
    order = np.lexsort((cols, score[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, np.arange(len(score)))
    pick = (first[:, None] + np.arange(kk)).astype(int)
    return cols[pick], score[np.arange(len(score))[:, None], cols[pick]]


MAX_BLOCKS = 20_000  # boxes that the driver holds: some 5 MB
SAMPLE_ROWS = 50_000  # expected donors that shape the splits; any splits give the same result


@dataclass(frozen=True)
class Splits:
    """Complete binary tree of median splits: the column and value of each inner slot. A missing value goes left."""

    columns: tuple[str, ...]
    side: np.ndarray
    cut: np.ndarray
    depth: int

    @classmethod
    def of(cls, rows: pd.DataFrame, columns: Sequence[str], blocks: int, worth: dict[str, float] | None = None) -> Splits:
        """``worth``: what a unit of a column adds to a score; a column without it counts by its standard deviations."""
        depth = max(1, math.ceil(math.log2(blocks)))
        x = rows[list(columns)].to_numpy(float)
        scale = np.nan_to_num(np.nanstd(x, axis=0)) if len(x) else np.ones(x.shape[1])
        scale = np.array([1 / worth[c] if c in (worth or {}) else s for c, s in zip(columns, scale)])
        side, cut_at = np.zeros((1 << depth) - 1, int), np.zeros((1 << depth) - 1)
        nodes = {0: np.arange(len(x))}
        for slot in range(len(side)):
            own = nodes.pop(slot, np.zeros(0, int))
            if len(own) > 1:
                v = np.nan_to_num(x[own], nan=-1e300)
                spread = np.array([np.ptp(c[np.isfinite(c)]) if np.isfinite(c).sum() > 1 else 0.0 for c in x[own].T]) / np.where(scale > 0, scale, 1)
                side[slot] = int(spread.argmax())
                cut_at[slot] = np.median(v[:, side[slot]])
                right = v[:, side[slot]] > cut_at[slot]
                nodes[2 * slot + 1], nodes[2 * slot + 2] = own[~right], own[right]
        return cls(tuple(columns), side, cut_at, depth)

    def place(self, df: DataFrame) -> Column:
        """Block of every row."""
        side, cut_at, depth = self.side, self.cut, self.depth

        @F.pandas_udf("int")
        def block(*cols: pd.Series) -> pd.Series:
            v = np.nan_to_num(np.stack([c.to_numpy(float) for c in cols], axis=1), nan=-1e300)
            slot, row = np.zeros(len(v), int), np.arange(len(v))
            for _ in range(depth):
                slot = 2 * slot + 1 + (v[row, side[slot]] > cut_at[slot])
            return pd.Series(slot - len(side))

        return block(*[df[c] for c in self.columns])


def _chunked(df: DataFrame, by: str, rows: int, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """``df`` with a ``_chunk`` that holds some ``rows`` rows of a value of ``by``, and the (value, chunks) table."""
    sizes = cut(df.groupBy(by).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_chunks")))
    return df.join(F.broadcast(sizes), by).withColumn("_chunk", F.pmod(F.xxhash64(id_col), F.col("_chunks")).cast("int")).drop("_chunks"), sizes


def block_topk(targets: DataFrame, donors: DataFrame, k: int, distance, bound, columns: Sequence[str], rows_per_block: int = 3000, skip_self: bool = True,
               worth: Callable[[pd.DataFrame], dict[str, float]] | None = None) -> DataFrame:
    """(target, donor, score, place): the k nearest donors of every target, exactly; equal scores go by donor id.

    ``distance(t, d)`` maps two blocks (pandas) to a score matrix; ``bound(t, boxes)`` gives the least score that a donor in a box can
    have, from ``lo_c``, ``hi_c`` (null where all are) and ``some_c`` (whether values are missing) of every column in ``columns``.
    ``worth`` tells from sampled donors what a unit of each column adds to a score, so that blocks are cut along what decides it.
    """
    kind, want = dict(targets.dtypes)["id"], k + 1 if skip_self else k
    targets, donors = (d.select(*[F.col(c).alias(c) for c in d.columns]) for d in (targets, donors))  # one table may be both sides
    # of equal donors the first by id suffice
    rest = [c for c in donors.columns if c != "id"]
    donors = cut(donors.withColumn("_r", F.row_number().over(Window.partitionBy(*rest).orderBy("id"))).where(F.col("_r") <= want).drop("_r"))
    targets = cut(targets)
    n = donors.count()
    rows_per_block = max(rows_per_block, -(-n // MAX_BLOCKS))
    n_blocks = -(-n // rows_per_block)
    if n_blocks <= 1:
        boxes = pd.DataFrame({"_block": [0]})
        d, t = donors.withColumn("_block", F.lit(0)), targets.withColumn("_block", F.lit(0))
    else:
        shape = donors.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000)) < min(1.0, SAMPLE_ROWS / n) * 1_000_000).select(*columns).toPandas()
        splits = Splits.of(shape, columns, n_blocks, worth(shape) if worth else None)
        d, t = cut(donors.withColumn("_block", splits.place(donors))), targets.withColumn("_block", splits.place(targets))
        sides = [e for c in columns for e in (F.min(F.when(~F.isnan(c), F.col(c))).alias(f"lo_{c}"), F.max(F.when(~F.isnan(c), F.col(c))).alias(f"hi_{c}"),
                                              F.max(F.col(c).isNull() | F.isnan(c)).alias(f"some_{c}"))]
        boxes = d.groupBy("_block").agg(*sides).toPandas()  # at most 2 MAX_BLOCKS rows
    ids = boxes["_block"].to_numpy(int)

    def scored(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b = b.sort_values("id")
        did = b["id"].to_numpy()
        score = distance(a, b)
        if skip_self:
            score = np.where(a["id"].to_numpy()[:, None] == did[None, :], np.inf, score)
        cols, best = _topk(did, score, k)
        return did, cols, best

    def home(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for at in range(0, len(a), 500):
            part = a.iloc[at:at + 500]
            if b.empty:
                donor, best = np.empty((len(part), 0), int), np.empty((len(part), 0))
            else:
                did, cols, best = scored(part, b)
                donor = did[cols]
            reach = best[:, k - 1] if best.shape[1] >= k else np.full(len(part), np.inf)
            open_ = np.zeros((len(part), 0), bool) if len(ids) == 1 else (bound(part, boxes) <= reach[:, None] * (1 + 1e-9) + 1e-9) & (ids[None, :] != part["_block"].to_numpy()[:, None])
            ok = np.isfinite(best)
            out.append(pd.DataFrame({"target": part["id"].to_numpy(), "donor": [x[m] for x, m in zip(donor, ok)], "score": [x[m] for x, m in zip(best, ok)],
                                     "reach": reach, "blocks": [ids[m].tolist() for m in open_] if len(ids) > 1 else [[] for _ in range(len(part))]}))
        return pd.concat(out) if out else pd.DataFrame(columns=["target", "donor", "score", "reach", "blocks"])

    def meet(t: DataFrame, fn, schema: str) -> DataFrame:
        t, sizes = _chunked(t, "_block", rows_per_block)
        spread = d.join(F.broadcast(sizes), "_block").withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))).drop("_chunks")
        return t.groupBy("_block", "_chunk").cogroup(spread.groupBy("_block", "_chunk")).applyInPandas(fn, schema)

    first = cut(meet(t, home, f"target {kind}, donor array<{kind}>, score array<double>, reach double, blocks array<int>"))
    local = first.select("target", F.explode(F.arrays_zip("donor", "score")).alias("e")).select("target", "e.donor", "e.score")
    if n_blocks > 1:
        visits = first.where(F.size("blocks") > 0).select(F.col("target").alias("id"), "reach", F.explode("blocks").alias("_block"))

        def visit(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"target": [], "donor": [], "score": []})]
            for at in range(0, len(a) if len(b) else 0, 500):
                part = a.iloc[at:at + 500]
                did, cols, best = scored(part, b)
                row, col = np.nonzero(np.isfinite(best) & (best <= part["reach"].to_numpy()[:, None]))
                out.append(pd.DataFrame({"target": part["id"].to_numpy()[row], "donor": did[cols[row, col]], "score": best[row, col]}))
            return pd.concat(out)

        local = local.unionByName(meet(targets.join(visits, "id"), visit, f"target {kind}, donor {kind}, score double"))
    w = Window.partitionBy("target").orderBy("score", "donor")
    return local.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def _leave_one_out_spread(donors: DataFrame, n: int, targets: DataFrame) -> DataFrame:
    """Adds each feature's population sd over the donors without the target itself (closed form from sums)."""
    f = [f"f{i}" for i in range(n)]
    # sums around the overall means: squares of large values would lose the spread
    middle = F.broadcast(donors.agg(*[F.avg(c).alias(f"m_{c}") for c in f]))
    around = donors.join(middle, F.lit(True)).select("id", *[(F.col(c) - F.col(f"m_{c}")).alias(c) for c in f])
    one = around.agg(*[F.count(c).alias(f"n_{c}") for c in f], *[F.sum(c).alias(f"s_{c}") for c in f], *[F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in f])
    inside = targets.join(donors.select("id").withColumn("_d", F.lit(1.0)), "id", "left").join(F.broadcast(one), F.lit(True)).join(middle, F.lit(True))
    own = F.coalesce("_d", F.lit(0.0))
    out = [F.col(c) for c in targets.columns]
    for c in f:
        x = F.when(F.col(c).isNotNull(), own * (F.col(c) - F.col(f"m_{c}"))).otherwise(0.0)
        m = F.col(f"n_{c}") - F.when(F.col(c).isNotNull(), own).otherwise(0.0)
        mu = ratio(F.col(f"s_{c}") - x, m)
        var = F.greatest(ratio(F.col(f"q_{c}") - x * x, m) - mu * mu, F.lit(0.0))
        out.append(F.when(var > 0, F.sqrt(var)).otherwise(1.0).alias(f"sd_{c}"))
    return inside.select(*out)


# What a method's score is made of: attributes, ground distance. An unknown name is a KeyError.
METHODS = {"similarity": (True, False), "proximity": (False, True), "combined": (True, True)}


def similar(targets: DataFrame, donors: DataFrame, features: Sequence[Feature], k: int = 10, method: str = "similarity", rows_per_block: int = 3000) -> DataFrame:
    """Top-k donors by standardised attribute distance, ground distance or both.

    Both tables come from ``feature_table`` (``lat`` / ``lon`` extra columns for ground distance). A
    missing donor value counts three standard deviations; features a target lacks are left out.
    """
    by_attributes, by_ground = METHODS[method]
    n, w = len(features), np.array([f.weight for f in features])
    cols, sds = [f"f{i}" for i in range(n)], [f"sd_f{i}" for i in range(n)]
    t = _leave_one_out_spread(donors, n, targets)

    def distance(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
        attr = ground = 0.0
        if by_attributes:
            x, y, sd = a[cols].to_numpy(float), b[cols].to_numpy(float), a[sds].to_numpy(float)
            acc, tot = np.zeros((len(a), len(b))), np.zeros(len(a))
            for i in range(n):
                has = ~np.isnan(x[:, i])
                z = np.abs(y[None, :, i] - x[:, None, i]) / sd[:, None, i]
                z = np.where(np.isnan(y[None, :, i]), 3.0, z) * w[i]
                acc += np.where(has[:, None], z * z, 0.0)
                tot += has * w[i] ** 2
            attr = np.sqrt(acc / np.maximum(tot, 1e-9)[:, None])
        if by_ground:
            ground = _ground_km(a, b)
        return np.hypot(attr, ground / SCALE_KM) if by_attributes and by_ground else attr if by_attributes else ground

    def bound(a: pd.DataFrame, boxes: pd.DataFrame) -> np.ndarray:
        attr = ground = 0.0
        if by_attributes:
            x, sd = a[cols].to_numpy(float), a[sds].to_numpy(float)
            acc, tot = np.zeros((len(a), len(boxes))), np.zeros(len(a))
            for i in range(n):
                has = ~np.isnan(x[:, i])
                z = _gap(x[:, i], boxes, f"f{i}") / sd[:, None, i]
                z = np.where(np.isnan(z), 3.0, np.where(boxes[f"some_f{i}"].to_numpy(bool)[None, :], np.minimum(z, 3.0), z)) * w[i]
                acc += np.where(has[:, None], z * z, 0.0)
                tot += has * w[i] ** 2
            attr = np.sqrt(acc / np.maximum(tot, 1e-9)[:, None])
        if by_ground:
            chord = np.sqrt(sum(_gap(v, boxes, c) ** 2 for v, c in zip(_on_sphere(a), _SPHERE)))
            ground = np.nan_to_num(2 * 6371.0088 * np.arcsin(np.minimum(chord / 2, 1.0)), nan=1e9)
        return np.hypot(attr, ground / SCALE_KM) if by_attributes and by_ground else attr if by_attributes else ground

    shape = cols if by_attributes else []
    if by_ground:
        phi, lam = F.radians("lat"), F.radians("lon")
        on_sphere = lambda d: d.withColumns({"_ux": F.cos(phi) * F.cos(lam), "_uy": F.cos(phi) * F.sin(lam), "_uz": F.sin(phi)})
        t, donors, shape = on_sphere(t), on_sphere(donors), [*shape, *_SPHERE]

    def worth(sample: pd.DataFrame) -> dict[str, float]:
        per_sd = dict(zip(cols, w / math.sqrt(max((w * w).sum(), 1e-9)))) if by_attributes else {}
        sd = sample[list(per_sd)].std(ddof=0)
        far = {c: 6371.0088 / (SCALE_KM if by_attributes else 1.0) for c in _SPHERE} if by_ground else {}
        return {c: v / sd[c] for c, v in per_sd.items() if sd[c] > 0 and v > 0} | far

    return block_topk(t, donors, k, distance, bound, shape, rows_per_block, worth=worth)


_SPHERE = ("_ux", "_uy", "_uz")


def _gap(x: np.ndarray, boxes: pd.DataFrame, c: str) -> np.ndarray:
    """Distance from every value to every box's side; not a number where the box has no values."""
    lo, hi = boxes[f"lo_{c}"].to_numpy(float), boxes[f"hi_{c}"].to_numpy(float)
    return np.maximum(0.0, np.maximum(lo[None, :] - x[:, None], x[:, None] - hi[None, :]))


def _on_sphere(d: pd.DataFrame) -> np.ndarray:
    """Unit vectors of the places of a block."""
    phi, lam = np.radians(d["lat"].to_numpy(float)), np.radians(d["lon"].to_numpy(float))
    return np.stack([np.cos(phi) * np.cos(lam), np.cos(phi) * np.sin(lam), np.sin(phi)])


def _ground_km(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
    """Great-circle distances of two blocks from the chords between their places; unknown places are far from everything."""
    half_chord = np.sqrt(sum((u[:, None] - v[None, :]) ** 2 for u, v in zip(_on_sphere(a), _on_sphere(b)))) / 2
    return np.nan_to_num(2 * 6371.0088 * np.arcsin(np.minimum(half_chord, 1.0)), nan=1e9)


# Signatures that weigh double.
SIGNATURE_WEIGHTS = {"baseflow_index": 2.0, "flashiness_index": 2.0, "seasonality_index": 2.0, "runoff_ratio": 2.0}


def signature_distance(targets: DataFrame, donors: DataFrame, names: Sequence[str], k: int = 10, max_distance: float | None = None,
                       weights: dict[str, float] | None = None, rows_per_block: int = 3000) -> DataFrame:
    """Top-k donors by relative signature differences (each scaled by the mean magnitude of the two values)."""
    wt = SIGNATURE_WEIGHTS if weights is None else weights
    w = [wt.get(c, 1.0) for c in names]

    def distance(a: pd.DataFrame, b: pd.DataFrame) -> np.ndarray:
        acc = np.zeros((len(a), len(b)))
        for c, wi in zip(names, w):
            x, y = a[c].to_numpy(float)[:, None], b[c].to_numpy(float)[None, :]
            m = (np.abs(x) + np.abs(y)) / 2
            with np.errstate(all="ignore"):
                d = wi * ((x - y) / m) ** 2
            acc += np.where((m > 0) & np.isfinite(m), d, 0.0)
        return np.sqrt(acc)

    def bound(a: pd.DataFrame, boxes: pd.DataFrame) -> np.ndarray:
        acc = np.zeros((len(a), len(boxes)))
        for c, wi in zip(names, w):
            # a term falls towards the target's own value from both sides, so a box's nearest value has the least
            x = a[c].to_numpy(float)[:, None]
            y = np.clip(x, boxes[f"lo_{c}"].to_numpy(float)[None, :], boxes[f"hi_{c}"].to_numpy(float)[None, :])
            m = (np.abs(x) + np.abs(y)) / 2
            with np.errstate(all="ignore"):
                d = wi * ((x - y) / m) ** 2
            acc += np.where((m > 0) & np.isfinite(m) & ~boxes[f"some_{c}"].to_numpy(bool)[None, :], d, 0.0)
        return np.sqrt(acc)

    top = block_topk(targets, donors, k, distance, bound, list(names), rows_per_block)
    return top if max_distance is None else top.where(F.col("score") <= max_distance)


def similar_basins(targets: DataFrame, stations: DataFrame, features: Sequence[Feature] = CATCHMENT_FEATURES, k: int = 10, method: str = "similarity",
                   sources: Sequence[str] | None = None, require_discharge: bool = True, rows_per_block: int = 3000) -> tuple[DataFrame, DataFrame]:
    """Ranking (target, donor, score, place, similarity_distance, distance_km) and deltas (target, donor, feature, station, own).

    ``stations`` holds id, source, variables (array), latitude, longitude and the attributes; with ``require_discharge`` only stations
    that measure discharge are candidates, with ``sources`` only those of the named archives. A station is never its own donor. Deltas
    list the untransformed attributes that both sides know, to three decimals.
    """
    by_attributes, by_ground = METHODS[method]
    ground = [F.col("latitude").alias("lat"), F.col("longitude").alias("lon")]
    wanted = stations.where(F.array_contains("variables", "discharge")) if require_discharge else stations
    wanted = wanted.where(F.col("source").isin(list(sources))) if sources else wanted
    t, d = feature_table(targets, "id", features, ground), feature_table(wanted, "id", features, ground)
    top = cut(similar(t, d, features, k, method, rows_per_block))
    raw = [f.column for f in features]
    place = lambda df, end: df.select(F.col("id").alias(end), F.col("latitude").alias(f"{end}_lat"), F.col("longitude").alias(f"{end}_lon"))
    far = top.join(place(targets, "target"), "target").join(place(stations, "donor"), "donor")
    from limnos.operators.catalog import haversine

    km = haversine(F.col("target_lat"), F.col("target_lon"), F.col("donor_lat"), F.col("donor_lon"), 6371.0088)
    apart = F.col("score") if not by_ground else F.sqrt(F.greatest(F.pow("score", 2) - F.pow(km / SCALE_KM, 2), F.lit(0.0))) if by_attributes else F.lit(None).cast("double")
    ranked = far.select("target", "donor", "score", "place", apart.alias("similarity_distance"), (km if by_ground else F.lit(None).cast("double")).alias("distance_km"))
    wide = lambda df, end, v: df.select(F.col("id").alias(end), F.array(*[F.col(c).cast("double") for c in raw]).alias(v))
    both = top.select("target", "donor").join(wide(stations, "donor", "_there"), "donor").join(wide(targets, "target", "_here"), "target")
    cells = [F.struct(F.lit(c).alias("feature"), F.col("_there")[i].alias("station"), F.col("_here")[i].alias("own")) for i, c in enumerate(raw)]
    deltas = both.select("target", "donor", F.explode(F.array(*cells)).alias("e")).select("target", "donor", "e.*")
    return ranked, deltas.where("station IS NOT NULL AND own IS NOT NULL").select("target", "donor", "feature", F.round("station", 3).alias("station"), F.round("own", 3).alias("own"))


def percent_differences(a: DataFrame, b: DataFrame, names: Sequence[str], on: str = "id") -> DataFrame:
    """Field-by-field percent difference of two signature tables."""
    long = lambda d, v: d.select(on, *[F.col(c).cast("double").alias(c) for c in names]).unpivot([on], list(names), "signature", v)
    j = long(a, "x").join(long(b, "y"), [on, "signature"]).where("x IS NOT NULL AND y IS NOT NULL")
    den = F.when(F.abs("x") > 0, F.abs("x")).otherwise(1.0)
    return j.select(on, "signature", (F.abs(F.col("x") - F.col("y")) / den * 100).alias("percent_difference"))


def knn_estimates(top: DataFrame, values: DataFrame, log_names: Sequence[str] = (), bounds: dict[str, tuple[float | None, float | None]] | None = None) -> DataFrame:
    """Inverse-distance weighted donor means with a band of one weighted sd; ``values`` is (id, signature, value)."""
    is_log = F.col("signature").isin(list(log_names)) if log_names else F.lit(False)
    y = F.when(is_log, F.log(F.greatest(F.col("value"), F.lit(1e-3)))).otherwise(F.col("value"))
    d = top.join(values.where("value IS NOT NULL").withColumnRenamed("id", "donor"), "donor").withColumn("y", y).withColumn("w", 1 / (F.col("score") + 0.05))
    w, v = F.col("w"), F.col("y")
    g = d.groupBy("target", "signature").agg((F.sum(w * v) / F.sum(w)).alias("m"), (F.sum(w * v * v) / F.sum(w)).alias("m2"),
                                             F.min("value").alias("donor_min"), F.max("value").alias("donor_max"), F.count(F.lit(1)).alias("n_donors"))
    sd = F.sqrt(F.greatest(F.col("m2") - F.col("m") * F.col("m"), F.lit(0.0)))

    def back(e: Column) -> Column:
        out = F.when(is_log, F.exp(e)).otherwise(e)
        for name, (lo, hi) in (bounds or {}).items():
            hit = F.col("signature") == name
            out = F.when(hit & F.lit(lo is not None), F.greatest(out, F.lit(lo).cast("double"))).otherwise(out)
            out = F.when(hit & F.lit(hi is not None), F.least(out, F.lit(hi).cast("double"))).otherwise(out)
        return out

    return g.select("target", "signature", back(F.col("m")).alias("estimate"), back(F.col("m") - sd).alias("low"), back(F.col("m") + sd).alias("high"),
                    "donor_min", "donor_max", "n_donors")


def ridge_estimates(donors: DataFrame, targets: DataFrame, values: DataFrame, n: int, log_names: Sequence[str] = (), lam: float = 1.0,
                    bounds: dict[str, tuple[float | None, float | None]] | None = None) -> DataFrame:
    """Ridge regression of every signature on the standardised attributes, applied to all targets.

    ``bounds`` holds physical limits by signature; the estimate and its band are clipped to them.

    The design reduces to its cross products in one aggregate per signature; only those are solved.
    """
    f = [f"f{i}" for i in range(n)]
    one = donors.agg(*[F.avg(c).alias(f"mu_{c}") for c in f], *[F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"sg_{c}") for c in f])
    z = lambda d: d.join(F.broadcast(one), F.lit(True)).select("id", F.lit(1.0).alias("z_one"), *[F.coalesce((F.col(c) - F.col(f"mu_{c}")) / F.col(f"sg_{c}"), F.lit(0.0)).alias(f"z_{c}") for c in f])
    is_log = F.col("signature").isin(list(log_names)) if log_names else F.lit(False)
    y = F.when(is_log, F.log(F.greatest(F.col("value"), F.lit(1e-3)))).otherwise(F.col("value"))
    names = ["z_one", *[f"z_{c}" for c in f]]
    rows = z(donors).join(values.where("value IS NOT NULL"), "id").withColumn("y", y)
    prod = cross_products(rows, names, "y", ["signature"]).where(F.col("n") >= max(20, n + 5))
    beta = solve_rows(prod, names, ["signature"], [0.0] + [lam] * n)
    wide = beta.groupBy("signature").pivot("term", names).agg(F.first("estimate")).join(beta.groupBy("signature").agg(F.first("resid_sd").alias("sd"), F.max("n").alias("n_fit")), "signature")
    wide = wide.select("signature", "sd", "n_fit", *[F.col(c).alias(f"b_{c}") for c in names])
    pred = sum((F.col(f"b_{c}") * F.col(c) for c in names), F.lit(0.0))
    def back(e):
        e = F.when(is_log, F.exp(e)).otherwise(e)
        for name, (lo, hi) in (bounds or {}).items():
            inside = e if lo is None else F.greatest(e, F.lit(lo))
            inside = inside if hi is None else F.least(inside, F.lit(hi))
            e = F.when(F.col("signature") == name, inside).otherwise(e)
        return e

    d = z(targets).join(F.broadcast(wide), F.lit(True)).withColumn("p", pred)  # one fitted row per signature
    return d.select(F.col("id").alias("target"), "signature", back(F.col("p")).alias("estimate"), back(F.col("p") - F.col("sd")).alias("low"),
                    back(F.col("p") + F.col("sd")).alias("high"), "n_fit")


def loo_skill(estimates: DataFrame, values: DataFrame, log_names: Sequence[str] = ()) -> DataFrame:
    """NSE, r2 and median relative error per signature of leave-one-out estimates."""
    j = estimates.join(values.withColumnRenamed("id", "target"), ["target", "signature"]).where("value IS NOT NULL")
    is_log = F.col("signature").isin(list(log_names)) if log_names else F.lit(False)
    t = lambda c: F.when(is_log, F.log(F.greatest(F.col(c), F.lit(1e-3)))).otherwise(F.col(c))
    j = j.withColumn("o", t("value")).withColumn("s", t("estimate"))
    ape = F.when(F.abs("value") > 1e-9, F.abs(F.col("estimate") - F.col("value")) / F.abs("value"))
    v = F.var_pop("o")
    return j.withColumn("ape", ape).groupBy("signature").agg(
        F.count(F.lit(1)).alias("n"), F.when(v > 0, 1 - F.avg(F.pow(F.col("s") - F.col("o"), 2)) / v).alias("nse"),
        F.pow(correlation("o", "s"), 2).alias("r2"), F.percentile("ape", F.lit(0.5)).alias("median_ape")).where("n >= 10")


def proximity_weights(donors: DataFrame, lat: float, lon: float) -> DataFrame:
    """Normalised inverse-distance weights of donors for one target point."""
    from limnos.operators.catalog import haversine

    d = donors.withColumn("inv", 1 / (haversine(F.col("latitude"), F.col("longitude"), F.lit(lat), F.lit(lon), 6371.0) + 1e-6))
    total = d.agg(F.sum("inv").alias("_t"))
    return d.join(F.broadcast(total), F.lit(True)).withColumn("weight", F.col("inv") / F.col("_t")).drop("inv", "_t")


PAIRS_AT_ONCE = 250_000  # pairs of stations that a task holds: some 15 MB
PAIRED_BLOCKS = 2_000  # blocks of a variogram, whose pairs the driver looks through


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of (x, y) points."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def chain(order) -> list:
        out: list = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    rows = pts.tolist()
    return np.array(chain(rows) + chain(rows[::-1]))


def _farthest(points: np.ndarray) -> float:
    """Largest distance between any two points, from the corners of their hull."""
    corners, most = hull(points), 0.0
    for at in range(0, len(corners), 1000):
        most = max(most, float(((corners[at:at + 1000, None, :] - corners[None, :, :]) ** 2).sum(2).max()))
    return math.sqrt(most)


def variogram(stations: DataFrame, bins: int = 15, rows_per_block: int = 4000) -> DataFrame:
    """Empirical variogram of (lat, lon, value) stations over half the largest distance.

    Stations are cut into blocks of neighbours. Of two blocks that lie wholly in one distance bin, their counts and sums give all
    pairs; blocks farther apart than the last bin are passed over; only the rest compares stations, one pair of blocks a task.
    """
    s = cut(stations.select("lat", "lon", "value").dropna())
    n = s.count()
    bins, blocks = min(bins, n), min(PAIRED_BLOCKS, max(1, -(-n // rows_per_block)))
    kind = "bin long, pairs long, sq double, half double"
    if blocks > 1:
        shape = s.where(F.pmod(F.xxhash64("lat", "lon", "value"), F.lit(1_000_000)) < min(1.0, SAMPLE_ROWS / n) * 1_000_000).select("lat", "lon").toPandas()
        s = cut(s.withColumn("_blk", Splits.of(shape, ["lat", "lon"], blocks).place(s)))
    else:
        s = s.withColumn("_blk", F.lit(0))
    # a block's corners come first, so the farthest pair needs no second look at the stations
    corners = s.groupBy("_blk").applyInPandas(lambda p: pd.DataFrame(hull(p[["lat", "lon"]].to_numpy(float)), columns=["lat", "lon"]), "lat double, lon double")
    far = corners.toPandas().to_numpy(float)
    half = _farthest(far) / 2 if len(far) else 0.0
    edges, mean = np.linspace(0, half, bins + 1) if n else np.zeros(1), F.lit(float(s.agg(F.avg("value")).first()[0] or 0.0))
    v = F.col("value") - mean
    box = s.groupBy("_blk").agg(*[f(c).alias(f"{name}_{c}") for c in ("lat", "lon") for name, f in (("lo", F.min), ("hi", F.max))], F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    box = box.orderBy("_blk").toPandas()  # at most 2 PAIRED_BLOCKS rows
    done, open_ = np.zeros((bins, 2)), []
    for i in range(len(box)):
        other = np.arange(i, len(box))
        lo, hi = box[["lo_lat", "lo_lon"]].to_numpy(float), box[["hi_lat", "hi_lon"]].to_numpy(float)
        near = np.sqrt((np.maximum(0, np.maximum(lo[other] - hi[i], lo[i] - hi[other])) ** 2).sum(1))
        most = np.sqrt((np.maximum(hi[other] - lo[i], hi[i] - lo[other]) ** 2).sum(1))
        slack = 1e-9 * half
        b = np.clip(np.searchsorted(edges, near, "right") - 1, 0, max(bins - 1, 0))
        one = (other > i) & (near > edges[b] + slack) & (most < edges[b + 1] - slack) if bins else np.zeros(len(other), bool)
        count, total, square = box["n"].to_numpy(float), box["s"].to_numpy(float), box["q"].to_numpy(float)
        j = other[one]
        np.add.at(done, b[one], np.stack([count[i] * count[j], count[j] * square[i] + count[i] * square[j] - 2 * total[i] * total[j]], axis=1))
        left = other[~one & (near <= half + slack)]
        open_.append(np.stack([np.full(len(left), box["_blk"].iloc[i]), box["_blk"].to_numpy()[left]], axis=1))
    spark = stations.sparkSession
    pairs = spark.createDataFrame(pd.DataFrame(np.concatenate(open_) if open_ else np.zeros((0, 2), int), columns=["_bi", "_bj"]), "_bi int, _bj int")
    sides = pairs.select("_bi", "_bj", F.explode(F.array_distinct(F.array("_bi", "_bj"))).alias("_blk"))

    def sums(key, pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = (pdf[pdf["_blk"] == k] for k in key)
        out = np.zeros((bins, 2))
        y, w = b[["lat", "lon"]].to_numpy(float), b["value"].to_numpy(float)
        step = max(1, PAIRS_AT_ONCE // max(1, len(b)))
        for at in range(0, len(a), step):
            x, v = a[["lat", "lon"]].to_numpy(float)[at:at + step], a["value"].to_numpy(float)[at:at + step]
            d = np.sqrt((x[:, :1] - y[:, 0]) ** 2 + (x[:, 1:] - y[:, 1]) ** 2)
            place = np.searchsorted(edges, d, "left") - 1
            use = (place >= 0) & (place < bins)
            if key[0] == key[1]:
                use &= np.arange(at, at + len(x))[:, None] < np.arange(len(b))
            place, g = place[use], ((v[:, None] - w) ** 2)[use]
            out += np.stack([np.bincount(place, minlength=bins), np.bincount(place, g, minlength=bins)], axis=1)
        return pd.DataFrame({"bin": np.arange(bins), "pairs": out[:, 0].astype(int), "sq": out[:, 1], "half": half})

    rows = sides.join(s, "_blk").groupBy("_bi", "_bj").applyInPandas(sums, kind)
    known = spark.createDataFrame(pd.DataFrame({"bin": np.arange(bins), "pairs": done[:, 0].astype(int), "sq": done[:, 1], "half": half}), kind)
    g = rows.unionByName(known).groupBy("bin").agg(F.sum("pairs").alias("pairs"), F.sum("sq").alias("sq"), F.max("half").alias("half")).where("pairs > 0")
    return g.select("bin", ((F.col("bin") + 0.5) * F.col("half") / bins).alias("bin_center"), "pairs", (F.col("sq") / F.col("pairs") / 2).alias("gamma"))


def variogram_model(stations: DataFrame, gamma: DataFrame, bins: int = 15) -> DataFrame:
    """Sill, nugget and range read off the stations and the empirical variogram."""
    s = stations.agg(F.var_pop("value").alias("sill"), F.count(F.lit(1)).alias("n_stations"))
    g = gamma.agg(F.min_by("gamma", "bin").alias("nugget"), F.max(F.col("bin_center") / (F.col("bin") + 0.5)).alias("width"))
    return s.join(g, F.lit(True)).select("n_stations", "sill", "nugget", (F.col("width") * F.least(F.lit(bins), F.col("n_stations")) * 0.6).alias("range"))


