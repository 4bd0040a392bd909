"""Near-duplicate vectors: rotated sign codes with correction factors give unbiased inner products, bounds pick the pairs to recompute.

A unit vector is padded to ``CODE`` dimensions, rotated by one fixed random rotation and kept as its signs with the factor f = <signs /
sqrt(CODE), vector>. For a pair, <signs_a / sqrt(CODE), b> / f_a estimates the cosine without bias, and its error stays below ``SURE``
times sqrt((1 - f_a**2) / f_a**2 / (CODE - 1)) but for a chance of about exp(-SURE**2 / 2). A pair whose estimate plus bound stays
below the limit is settled; every other pair is recomputed in double precision, so no link below the limit comes out.

Pairs meet in band buckets, the signs of further random directions. ``banding`` takes as many bits a band as keep buckets of unrelated
vectors small at the table's size, and as many bands as keep the chance that a pair at the limit shares none below ``MISS``. A bucket
is dealt into blocks that are compared inside tasks, which return one count and one tie for each vector and block pair, never pairs.
A pair counts in the first band that it shares only. Equal vectors are one member with a multiplicity.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limnos.llm.spread import components, join_split, landed

CODE = 512
MISS = 1e-4
SURE = 5.0
LIMIT = 0.95
BLOCK = 256
BUCKET = 128  # unrelated vectors that a bucket may hold


def banding(n: int, limit: float = LIMIT, miss: float = MISS) -> tuple[int, int]:
    """Bits a band and bands for ``n`` vectors; a sign agrees with probability 1 - angle / pi."""
    agree = 1 - math.acos(limit) / math.pi
    bits = max(1, math.ceil(math.log2(max(n, 2) / BUCKET))) if n > BUCKET else 1
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-agree**bits)))


@lru_cache(maxsize=2)
def rotation(dim: int, code: int, seed: int = 9) -> np.ndarray:
    """First ``dim`` rows of a random rotation of ``code`` dimensions, which is what it does to padded vectors."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((code, dim)))
    return (q * np.sign(np.diag(r))).T


def _unit(batch_vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which rows have one; other lengths, nulls, zeros and non-finite values have none."""
    n = len(batch_vectors)
    x = np.zeros((n, dim))
    ok = np.zeros(n, bool)
    if n and dim:
        lengths = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(batch_vectors), -1))
        values, first = batch_vectors.values, np.asarray(batch_vectors.offsets)
        flat = np.asarray(values.cast(pa.float64()).fill_null(np.nan))
        whole = np.flatnonzero(lengths == dim)
        x[whole] = flat[first[:-1][whole][:, None] + np.arange(dim)]
        with np.errstate(over="ignore", invalid="ignore"):
            largest = np.abs(x).max(1)
            ok[whole] = np.isfinite(x[whole]).all(1) & (largest[whole] > 0)
        x[ok] /= largest[ok][:, None]
        x[ok] /= np.linalg.norm(x[ok], axis=1)[:, None]
        x[~ok] = 0
    return x, ok


def encode(vectors: DataFrame, dim: int, bits: int, n_bands: int, id_col: str = "vec_id", vector_col: str = "embedding", code: int = CODE) -> DataFrame:
    """(vec_id, unit, code, factor, bands) of every vector; unit is null for vectors that link with nothing."""
    def task(batches):
        turn = rotation(dim, code) if dim else None
        aims = np.random.default_rng(10).standard_normal((dim, bits * n_bands))
        weigh = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                ids, raw = batch.column(0).slice(at, 1000), batch.column(1).slice(at, 1000)
                x, ok = _unit(raw, dim)
                n = len(ids)
                turned = x @ turn if dim else np.zeros((n, code))
                bands = ((x @ aims >= 0).reshape(n, n_bands, bits) * weigh).sum(2) * n_bands + np.arange(n_bands, dtype=np.int64)
                packed = np.packbits(turned >= 0, axis=1)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([u.tobytes() if k else None for u, k in zip(x, ok)], pa.binary()), pa.array([c.tobytes() for c in packed], pa.binary()),
                     pa.array(np.abs(turned).sum(1) / np.sqrt(code)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * n_bands), pa.array(bands.ravel()))],
                    names=["vec_id", "unit", "code", "factor", "bands"])

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(
        task, "vec_id long, unit binary, code binary, factor double, bands array<long>")


def _compare(limit: float, sure: float):
    def compare(group):
        import pandas as pd
        g = group.drop_duplicates("node")
        node, own, copies = g["node"].to_numpy(), g["own"].to_numpy(), g["copies"].to_numpy()
        bands, here = np.stack(g["bands"].to_list()), int(g["band"].iat[0])
        unit = np.stack([np.frombuffer(u) for u in g["unit"]])
        factor = g["factor"].to_numpy()
        signs = np.unpackbits(np.stack([np.frombuffer(c, np.uint8) for c in g["code"]]), axis=1).astype(np.float32) * 2 - 1
        width = signs.shape[1]
        # <signs, rotated other> equals <signs rotated back, other>: one small product a block
        back = signs @ rotation(unit.shape[1], width).T.astype(np.float32) / np.sqrt(width)
        estimate = (back @ unit.T.astype(np.float32)) / factor[:, None]
        bound = sure * np.sqrt(np.maximum(1 - factor**2, 0) / factor**2 / (width - 1))
        first = np.ones((len(g), len(g)), bool)
        for k in range(here):  # a pair that shares an earlier band was compared there
            first &= bands[:, None, k] != bands[None, :, k]
        maybe = np.triu((estimate + bound[:, None] >= limit) & first, 1)
        if g["block"].iat[0] != g["block2"].iat[0]:
            maybe &= own[:, None] != own[None, :]
        i, j = np.nonzero(maybe)
        exact = np.einsum("ij,ij->i", unit[i], unit[j])
        i, j = i[exact >= limit], j[exact >= limit]
        n = np.bincount(i, copies[j], minlength=len(g)) + np.bincount(j, copies[i], minlength=len(g))
        hit = n > 0
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for a, b in zip(node[i].tolist(), node[j].tolist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
        tie = np.array([find(x) for x in node[hit].tolist()], np.int64)
        return pd.DataFrame({"node": node[hit], "n": n[hit].astype(np.int64), "tie": tie})

    return compare


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", limit: float = LIMIT, sure: float = SURE) -> DataFrame:
    """Links of cosine >= ``limit``: vec_id, n_links, component_id (smallest id reachable), kept, one row per input row.

    Vectors that are null, zero, of another length than most or hold null or non-finite values link with nothing. Equal vectors and
    repeated rows link with each other; a row with a null id links with nothing and is kept. An empty table gives no rows; other
    columns are not read. Of pairs exactly at the limit, a share of ``MISS`` shares no band and is missed, far fewer above it.
    """
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    size = (v.where("v is not null").groupBy(F.size("v").alias("dim")).count().withColumn("all", F.sum("count").over(Window.partitionBy()))
            .orderBy(F.desc("count"), "dim").first())
    dim = int(size["dim"]) if size else 0
    bits, n_bands = banding(size["all"] if size else 0, limit)
    coded = landed(encode(v, dim, bits, n_bands, "vec_id", "v"), "coded")
    usable = coded.where("unit is not null and vec_id is not null").withColumn("node", F.xxhash64(F.sha2("unit", 256)))
    # one member for all equal vectors: combined by its name before the shuffle
    members = landed(usable.groupBy("node").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), *[F.first(c).alias(c) for c in ("unit", "code", "factor", "bands")]), "members")
    classes = members.select("node", "first_id", "copies")
    placed = members.select("node", F.posexplode("bands").alias("band", "bucket"))
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = landed(join_split(placed, sizes, "bucket").select("bucket", "band", "node", F.pmod(F.xxhash64("node", "bucket"), F.ceil(F.col("n") / BLOCK)).alias("block"),
                                                             F.ceil(F.col("n") / BLOCK).alias("blocks")), "dealt")
    # block pairs (i, j), i <= j: a member of block k takes part in (k, j) and (i, k)
    sides = F.expr("transform(sequence(0L, blocks - 1), o -> struct(least(block, o) AS block1, greatest(block, o) AS block2))")
    met = dealt.select("bucket", "band", "node", F.col("block").alias("own"), F.explode(sides).alias("p")).select("bucket", "band", "node", "own", F.col("p.block1").alias("block"), "p.block2")
    rows = join_split(met, members.drop("first_id"), "node")
    found = landed(rows.groupBy("bucket", "block", "block2").applyInPandas(_compare(limit, sure), "node long, n long, tie long"), "found")
    links = found.groupBy("node").agg(F.sum("n").alias("n"))
    labels = components(found.select("node", "tie").distinct(), "node", "tie")
    each = classes.join(links, "node", "left").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    each = landed(each, "each")
    smallest = each.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = landed(join_split(each, smallest, "component").select("node", "copies", "n", "component_id"), "known")
    linked = join_split(usable.select("vec_id", "node"), known, "node").select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    alone = coded.where("unit is null or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
