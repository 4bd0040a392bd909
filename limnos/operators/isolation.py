"""Isolation forest: rows that random splits cut off early are anomalies.

Every key gets ``trees`` trees, each grown from ``sample`` of its rows. Rows are drawn by a hash of key, time and tree, so a rerun task
draws the same ones. A tree is stored as complete-binary-tree arrays
(split feature, split value, and the path length of every slot of the last level), so rows walk it by arithmetic on one index, all rows of
a key at once.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.operators.series import KEYS, exact_quantiles
from limnos.session import cut

TREES = 100
SAMPLE = 256
_EULER = 0.5772156649015329


def usual_path(n):
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, float)
    many = 2 * (np.log(np.maximum(n, 2) - 1) + _EULER) - 2 * (np.maximum(n, 2) - 1) / np.maximum(n, 2)
    return np.where(n > 2, many, np.where(n == 2, 1.0, 0.0))


def _stirred(h: np.ndarray, j: int) -> np.ndarray:
    """Another order of the hashes for every j."""
    x = (h + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def grow_trees(x: np.ndarray, tree: np.ndarray, trees: int, height: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Split features and values of the inner slots and path lengths of the last level, one row per tree, all trees level by level.

    ``tree`` numbers the tree of each row. A row goes left unless its value exceeds the split. A node ends that holds one row, only equal
    rows, or stands at ``height``; the path length of a node that ends early fills all slots below it.
    """
    feature, split, path = np.zeros((trees, (1 << height) - 1), np.int32), np.zeros((trees, (1 << height) - 1)), np.zeros((trees, 1 << height))
    slot, live, columns = np.zeros(len(x), np.int64), np.arange(len(x)), np.ascontiguousarray(x.T)
    places = np.min_scalar_type(trees * (2 << height))  # short numbers sort faster
    for depth in range(height + 1):
        if len(live) == 0:
            break
        live = live[np.argsort((tree[live] * np.int64(2 << height) + slot[live]).astype(places), kind="stable")]
        t, s, own = tree[live], slot[live], columns.take(live, axis=1)
        first = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (s[1:] != s[:-1]))))
        size, t, s = np.diff(np.append(first, len(live))), t[first], s[first]
        low, high = (np.stack([least.reduceat(c, first) for c in own], axis=1) for least in (np.minimum, np.maximum))
        apart = high > low
        ends = (size < 2) | ~apart.any(1) | (depth == height)
        width = 1 << height - depth
        below = ((s[ends] + 1 - (1 << depth)) * width)[:, None] + np.arange(width)
        path[t[ends][:, None], below] = (depth + usual_path(size[ends]))[:, None]
        f = np.where(apart, rng.random(apart.shape), -1.0).argmax(1)
        node = np.arange(len(first))
        lo, hi = low[node, f], high[node, f]
        cutting = np.minimum(lo + rng.random(len(first)) * (hi - lo), np.nextafter(hi, lo))
        feature[t[~ends], s[~ends]], split[t[~ends], s[~ends]] = f[~ends], cutting[~ends]
        go = np.repeat(~ends, size)
        live, of = live[go], np.repeat(node, size)[go]
        slot[live] = 2 * slot[live] + 1 + (x[live, f[of]] > cutting[of])
    return feature, split, path


def grown(h: np.ndarray, x: np.ndarray, key: Sequence, trees: int, sample: int, seed: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int, float]:
    """Trees of one key from its rows and their hashes, with their height and the path length that scores one half."""
    by = np.argsort(h, kind="stable")
    h, x = h[by], x[by]
    most = min(sample, len(x))
    height = max(1, math.ceil(math.log2(max(most, 2))))
    # the rows whose hash, stirred anew for every tree, is among the smallest
    row = np.concatenate([np.sort(np.argpartition(_stirred(h, j), most - 1)[:most]) for j in range(trees)])
    rng = np.random.default_rng([seed, zlib.crc32(repr([str(v) for v in key]).encode())])
    return grow_trees(x[row], np.repeat(np.arange(trees), most), trees, height, rng), height, float(usual_path(most))


def _hashed(rows: DataFrame, names: Sequence[str], keys: Sequence[str], order: str, seed: int, carry: Sequence[str] = ()) -> DataFrame:
    return rows.select(*keys, *carry, F.xxhash64(*keys, order, F.lit(seed)).alias("h"), F.array(*[F.col(c).cast("double") for c in names]).alias("x"))


def _arrays(t: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(t.column("h")).view(np.uint64), np.asarray(t.column("x").combine_chunks().flatten()).reshape(t.num_rows, width)


def forests(features: DataFrame, names: Sequence[str], trees: int = TREES, sample: int = SAMPLE, seed: int = 42, keys: Sequence[str] = KEYS, order: str = "date") -> DataFrame:
    """One row per key: ``forest`` (array of trees), ``height`` and ``usual``, the path length that scores one half.

    ``names`` must not be null. A key with fewer rows than ``sample`` uses all of them in each tree.
    """
    k = list(keys)
    types = dict(features.dtypes)
    d = _hashed(features, names, k, order, seed)
    kind = pa.list_(pa.struct([("feature", pa.list_(pa.int32())), ("split", pa.list_(pa.float64())), ("path", pa.list_(pa.float64()))]))

    def grow(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        trained, height, usual = grown(*_arrays(block.combine_chunks(), len(names)), [v.as_py() for v in key], trees, sample, seed)
        forest = [{"feature": f, "split": s, "path": p} for f, s, p in zip(*[g.tolist() for g in trained])]
        columns = [*[pa.array([v.as_py()], v.type) for v in key], pa.array([height], pa.int32()), pa.array([usual]), pa.array([forest], kind)]
        return pa.Table.from_arrays(columns, names=[*k, "height", "usual", "forest"])

    schema = ", ".join([*[f"{c} {types[c]}" for c in k], "height int, usual double, forest array<struct<feature: array<int>, split: array<double>, path: array<double>>>"])
    return d.groupBy(*k).applyInArrow(grow, schema)


def walk(forest: Sequence[dict], x: np.ndarray) -> np.ndarray:
    """Mean path length of every row over the trees: all rows take a step at once."""
    total, rows = np.zeros(len(x)), np.arange(len(x))
    for t in forest:
        feature, split, path = (np.asarray(t[c]) for c in ("feature", "split", "path"))
        slot = np.zeros(len(x), np.int64)
        for _ in range(len(path).bit_length() - 1):
            slot = 2 * slot + 1 + (x[rows, feature[slot]] > split[slot])
        total += path[slot - len(feature)]
    return total / len(forest)


def path_lengths(rows: DataFrame, forest: DataFrame, names: Sequence[str], carry: Sequence[str], keys: Sequence[str] = KEYS, order: str = "date") -> DataFrame:
    """Mean path length of every row over its key's trees, beside ``carry`` and ``usual``. Rows of a key meet its forest in one task."""
    k, types = list(keys), dict(rows.dtypes)
    kept = [*k, order, *carry]
    d = rows.select(*kept, F.array(*[F.col(c).cast("double") for c in names]).alias("_x"))

    def score(own: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame(columns=[*kept, "path", "usual"])
        return own[kept].assign(path=walk(trees["forest"].iloc[0], np.stack(own["_x"].to_list())), usual=float(trees["usual"].iloc[0]))

    schema = ", ".join([*[f"`{c}` {types[c]}" for c in kept], "path double, usual double"])
    return d.groupBy(*k).cogroup(forest.groupBy(*k)).applyInPandas(score, schema)


_STEP = 1 << 18  # places (trees x rows) that walk at once


def walk_all(feature: np.ndarray, split: np.ndarray, path: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``walk`` of all trees at once, some rows at a time; path lengths are added in the order of the trees."""
    trees, inner = feature.shape
    root, leaves = (np.arange(trees) * inner)[:, None], (np.arange(trees) * (inner + 1) - inner)[:, None]
    feature, split, path, total, step = feature.ravel(), split.ravel(), path.ravel(), np.zeros(len(x)), max(1, _STEP // trees)
    for at in range(0, len(x), step):
        own = np.ascontiguousarray(x[at:at + step])
        first, own = np.arange(len(own)) * own.shape[1], own.ravel()
        slot = np.zeros((trees, len(first)), np.int64)
        for _ in range((inner + 1).bit_length() - 1):
            node = slot + root
            slot = 2 * slot + 1 + (own.take(feature.take(node) + first) > split.take(node))
        for found in path.take(slot + leaves):
            total[at:at + step] += found
    return total / trees


def forest_paths(rows: DataFrame, names: Sequence[str], carry: Sequence[str], trees: int = TREES, sample: int = SAMPLE, seed: int = 42, keys: Sequence[str] = KEYS,
                 order: str = "date") -> DataFrame:
    """``path_lengths`` of rows over the ``forests`` that their own keys give, grown and walked in one task: a forest, larger than its key's rows, is not written."""
    k, types = list(keys), dict(rows.dtypes)
    kept = [*k, order, *carry]

    def score(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        t = block.combine_chunks()
        h, x = _arrays(t, len(names))
        trained, _, usual = grown(h, x, [v.as_py() for v in key], trees, sample, seed)
        found = [pa.array(walk_all(*trained, x)), pa.array(np.full(len(x), usual))]
        return pa.Table.from_arrays([*[t.column(c) for c in kept], *found], names=[*kept, "path", "usual"])

    schema = ", ".join([*[f"`{c}` {types[c]}" for c in kept], "path double, usual double"])
    return _hashed(rows, names, k, order, seed, [order, *carry]).groupBy(*k).applyInArrow(score, schema)


def isolation_scores(features: DataFrame, names: Sequence[str], contamination: float = 0.05, trees: int = TREES, sample: int = SAMPLE, seed: int = 42,
                     keys: Sequence[str] = KEYS) -> DataFrame:
    """Anomaly score 2 ** (-path / usual path) of every row; of each key, rows above the 1 - ``contamination`` quantile are flagged.

    Input rows hold the keys, ``date``, ``y`` and the features; rows with a null feature are left out. A key with one row, or equal rows only, scores
    one half or as all its rows do, and none is flagged.
    """
    k = list(keys)
    known = features.dropna(subset=list(names))
    paths = forest_paths(known, names, ["y"], trees, sample, seed, k)
    scored = cut(paths.select(*k, "date", "y", F.when(F.col("usual") > 0, F.pow(F.lit(2.0), -F.col("path") / F.col("usual"))).otherwise(0.5).alias("anomaly_score")))
    limit = exact_quantiles(scored.select(*k, F.col("anomaly_score").alias("value")), k, {"cut": 1 - contamination})
    return scored.join(limit, k).select(*k, "date", "y", "anomaly_score", (F.col("anomaly_score") > F.col("cut")).alias("is_anomaly"))
