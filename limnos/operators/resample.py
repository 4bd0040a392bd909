"""Resamples drawn by hash, whole blocks of them at a time inside a task.

The n-th value of a resample comes from the MD5 digest of ``key:resample:n``. The digests of a block are computed side by side in
arrays, and so are the L-moments and the GEV fits of its resamples.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limnos.functions.special import LANCZOS

BLOCK = 1 << 16  # draws side by side: fewer cost more a draw, more leave the cache

# MD5's start, sines and rotations.
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SINES = tuple(int(abs(math.sin(i + 1)) * 2 ** 32) for i in range(64))
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_WORD = tuple([*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]])


def _digest_heads(words: Sequence[np.ndarray | int], n: int) -> np.ndarray:
    """First 60 bits of the digests of ``n`` messages of one block; a word that all messages share is a number."""
    a, b, c, d = (np.full(n, s, np.uint32) for s in _START)
    t, u = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=t)
            t &= b
            t ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=t)
            t &= d
            t ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=t)
            t ^= d
        else:
            np.invert(d, out=t)
            t |= b
            t ^= c
        t += a
        w = words[_WORD[i]]
        if isinstance(w, int):
            t += np.uint32((w + _SINES[i]) & 0xFFFFFFFF)
        else:
            t += w
            t += np.uint32(_SINES[i])
        turn = _TURNS[i // 16][i % 4]
        np.left_shift(t, np.uint32(turn), out=u)
        t >>= np.uint32(32 - turn)
        t |= u
        t += b
        a, b, c, d, t = d, t, b, c, a
    a += np.uint32(_START[0])
    b += np.uint32(_START[1])
    return (a.byteswap().astype(np.uint64) << np.uint64(28)) | (b.byteswap() >> np.uint32(4))


@lru_cache(maxsize=32)
def _endings(at: int, first: int, reps: int, n: int) -> list[np.ndarray | None] | None:
    """The 16 words of the messages ``resample:place`` that begin at byte ``at`` of a block, None for a word of zeros; None if they don't fit."""
    texts = np.array([b"%d:%d" % (r, i) for r in range(first, first + reps) for i in range(n)])
    width = texts.dtype.itemsize
    if at + width > 55:
        return None
    block = np.zeros((len(texts), 64), np.uint8)
    block[:, at:at + width] = texts.view(np.uint8).reshape(-1, width)
    size = at + np.char.str_len(texts)
    block[np.arange(len(texts)), size] = 0x80
    words = np.ascontiguousarray(block.view("<u4").T)
    words[14] = size * 8
    return [w if w.any() else None for w in words]


def places(prefixes: Sequence[bytes], first: int, reps: int, n: int) -> np.ndarray:
    """Drawn places, below ``n``, of ``reps`` resamples from the ``first`` on for each of some prefixes of one length: (prefix, resample, place)."""
    ends, m = _endings(len(prefixes[0]), first, reps, n), len(prefixes)
    if ends is None:
        heads = np.array([int.from_bytes(hashlib.md5(b"%b%d:%d" % (p, r, i), usedforsecurity=False).digest()[:8], "big") >> 4
                          for p in prefixes for r in range(first, first + reps) for i in range(n)], np.uint64)
    else:
        start = np.frombuffer(b"".join(p.ljust(64, b"\0") for p in prefixes), "<u4").reshape(m, 16).T
        each = lambda s: int(s[0]) if (s == s[0]).all() else np.repeat(s, reps * n)
        heads = _digest_heads([each(s) if e is None else (s[:, None] | e).ravel() for s, e in zip(start, ends, strict=True)], m * reps * n)
    return (heads % np.uint64(n)).astype(np.int64).reshape(m, reps, n)


def _gamma(x: np.ndarray) -> np.ndarray:
    z = x - 1
    series = LANCZOS[0] + sum(c / (z + i) for i, c in enumerate(LANCZOS[1:], start=1))
    t = z + 7.5
    return math.sqrt(2 * math.pi) * np.power(t, z + 0.5) * np.exp(-t) * series


class Fits:
    """GEV fits by L-moments of the resamples of some arrays of one length, each with its prefix: (array, resample) tables of shape,
    location, scale, smallest value, and whether the values differ."""

    def __init__(self, x: np.ndarray, prefixes: Sequence[bytes], reps: int):
        n = x.shape[1]
        order = np.argsort(x, axis=1, kind="stable")
        rank, values, i = np.argsort(order, axis=1).astype(np.int32), np.take_along_axis(x, order, 1), np.arange(n, dtype=float)
        row = np.arange(len(x))[:, None, None]
        step = max(1, BLOCK // (n * len(x)))
        parts = []
        for first in range(0, reps, step):
            drawn = np.sort(rank[row, places(prefixes, first, min(step, reps - first), n)], axis=2)
            v = values[row, drawn]
            parts.append(np.stack((v.sum(2), v @ i, v @ (i * (i - 1)), v[..., 0], v[..., -1])))
        s0, s1, s2, self.least, most = np.concatenate(parts, axis=2)
        self.spread = self.least != most
        b0, b1, b2 = s0 / n, s1 / (n * (n - 1)), s2 / (n * (n - 1) * (n - 2))
        l2, l3 = 2 * b1 - b0, 6 * b2 - 6 * b1 + b0
        t3 = np.where(np.abs(l2) <= 1e-15, 0.0, l3 / l2)
        c = 2 / (3 + t3) - math.log(2) / math.log(3)
        self.shape = s = 7.8590 * c + 2.9554 * c * c
        self.flat = np.abs(s) <= 1e-10
        g = _gamma(1 + s)
        self.scale = np.where(self.flat, l2 / math.log(2), l2 * s / (g * (1 - np.power(2.0, -s))))
        self.loc = np.where(self.flat, b0 - self.scale * 0.5772156649, b0 - self.scale * (1 - g) / s)

    def level(self, p: float) -> np.ndarray:
        y = -math.log(p)
        return np.where(self.flat, self.loc - self.scale * math.log(y), self.loc + self.scale * (1 - np.power(y, self.shape)) / self.shape)


BAND = T.ArrayType(T.StructType([T.StructField("band", T.ArrayType(T.DoubleType())), T.StructField("n_boot", T.LongType())]))


def bands(df: DataFrame, x: str, of: Sequence, n_boot: int, levels: Callable[[Fits], list[tuple[np.ndarray, np.ndarray]]], share: Sequence[float], out: str) -> DataFrame:
    """Adds ``out``: for each of the levels of a row's resamples, given with a mask of those that count, the quantiles at ``share`` and their number.

    ``x`` is the row's array of values and ``of``, joined by colons, names its draws. Rows are dealt over tasks by their number, not by
    their size: what they cost is the draws.
    """
    d = df.withColumn("_of", F.concat_ws(":", *of))
    schema = T.StructType([*df.schema.fields, T.StructField(out, BAND)])
    kept, kind = df.columns, pa.list_(pa.struct([("band", pa.list_(pa.float64())), ("n_boot", pa.int64())]))

    def task(batches):
        for batch in batches:
            names, arrays = batch.column(batch.schema.get_field_index("_of")).to_pylist(), batch.column(batch.schema.get_field_index(x))
            got, alike = [None] * len(names), defaultdict(list)
            for at, (name, values) in enumerate(zip(names, arrays, strict=True)):
                alike[len(name.encode()), len(values)].append(at)
            for (_, n), rows in alike.items():
                step = max(1, BLOCK // (n * n_boot))
                for lo in range(0, len(rows), step):
                    some = rows[lo:lo + step]
                    with np.errstate(all="ignore"):
                        found = levels(Fits(np.array([arrays[at].values.to_numpy(zero_copy_only=False) for at in some]), [names[at].encode() + b":" for at in some], n_boot))
                    for j, at in enumerate(some):
                        cut = [v[j][keep[j]] for v, keep in found]
                        got[at] = [{"band": np.quantile(v, share).tolist() if len(v) else None, "n_boot": len(v)} for v in cut]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.array(got, kind)], names=[*kept, out])

    tasks = 8 * df.sparkSession.sparkContext.defaultParallelism
    return d.repartition(tasks, "_of").mapInArrow(task, schema)
