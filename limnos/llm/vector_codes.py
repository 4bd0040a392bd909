"""Vector code compression: product codebooks by Lloyd rounds over two trees, exact in integers.

A vector of whole numbers floor(256 x) is cut into equal parts; each part position has a codebook of its own. A task grows a tree over
a stretch of parts (median splits, each node with its box, count and sum) and meets it with a tree over the codebook's entries. A pair
of nodes has a least and a greatest distance; an entry node whose least distance exceeds the smallest greatest distance of any other can
hold no nearest entry, for no part of the node. What is left goes down both trees. A node with one entry left is assigned whole, by its
cached sum and count; leaves that stay uncertain compare integers, ties to the lower index. All bounds are integers too, so the result
does not depend on how rows are dealt to tasks.

Trees are grown anew in each pass, which costs less than to move them. Between passes a task gives one count and sum for each
component of an entry, Spark adds them up, and the driver holds nothing but codebooks, whose size does not depend on the rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.spread import join_split, landed, small

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
WIDE = 1 << 26  # larger whole numbers are set to this, so that all sums fit 64 bits
LEAF = 16
STRETCH = 1 << 22  # bytes of whole numbers under one set of trees


@dataclass
class Tree:
    """Nodes by level, as runs of points in tree order: bounds, boxes, sums, and where a node's children begin in the next level."""

    order: np.ndarray
    points: np.ndarray
    bounds: list[np.ndarray]
    low: list[np.ndarray]
    high: list[np.ndarray]
    sums: list[np.ndarray]
    child: list[np.ndarray]


def grow(points: np.ndarray, leaf: int) -> Tree:
    """Tree by halving each node of more than ``leaf`` points along its widest side."""
    n = len(points)
    order, bounds = np.arange(n), np.array([0, n])
    t = Tree(order, points, [], [], [], [], [])
    while True:
        own, begin, size = points[order], bounds[:-1], np.diff(bounds)
        for kept, add in ((t.low, np.minimum), (t.high, np.maximum), (t.sums, np.add)):
            kept.append(add.reduceat(own, begin, axis=0))
        t.bounds.append(bounds)
        split = size > leaf
        if not split.any():
            t.order, t.points = order, own
            return t
        side, node = (t.high[-1] - t.low[-1]).argmax(1), np.repeat(np.arange(len(size)), size)
        order = order[np.lexsort((own[np.arange(n), side[node]], node))]
        t.child.append(np.concatenate(([0], np.cumsum(1 + split))))
        bounds = np.sort(np.concatenate((bounds, (begin + size // 2)[split])))


def _run(first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All whole numbers of the runs that begin at ``first``, and the run each belongs to."""
    of = np.repeat(np.arange(len(many)), many)
    return first[of] + np.arange(len(of)) - (np.cumsum(many) - many)[of], of


def assign(t: Tree, entries: np.ndarray, e: Tree) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Nearest entry of every part: whole nodes as (level, nodes, entries), and single places in tree order with their entries."""
    square = (entries * entries).sum(1)
    depth, floor = len(t.bounds) - 1, len(e.bounds) - 1
    p = q = 0
    node, other = np.zeros(1, np.int64), np.zeros(1, np.int64)
    whole: list[tuple[int, np.ndarray, np.ndarray]] = []
    while len(node):
        lo, hi, elo, ehi = t.low[p][node], t.high[p][node], e.low[q][other], e.high[q][other]
        near = (np.maximum(0, np.maximum(lo - ehi, elo - hi)) ** 2).sum(1)
        far = (np.maximum(hi - elo, ehi - lo) ** 2).sum(1)
        first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        many = np.diff(np.append(first, len(node)))
        most = np.repeat(np.minimum.reduceat(far, first), many)
        if q < floor:
            keep = near <= most
        else:
            index = e.order[other]
            best = np.repeat(np.minimum.reduceat(np.where(far == most, index, len(entries)), first), many)
            keep = (near < most) | ((near == most) & (index <= best))
            # how much nearer an entry than ``best`` comes at the corner of the box that suits it most
            apart = entries[index] - entries[best]
            gain = 2 * (np.where(apart > 0, hi, lo) * apart).sum(1) + square[best] - square[index]
            keep &= (index == best) | (gain > 0) | ((gain == 0) & (index < best))
        node, other = node[keep], other[keep]
        if q == floor:
            first = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
            many = np.diff(np.append(first, len(node)))
            sure = first[many == 1]
            whole.append((p, node[sure], e.order[other[sure]]))
            left = np.repeat(many > 1, many)
            node, other = node[left], other[left]
            if p == depth:
                break
        here = np.zeros(len(node), np.int64)
        c, nc = (t.child[p][node], np.diff(t.child[p])[node]) if p < depth else (node, here + 1)
        d, nd = (e.child[q][other], np.diff(e.child[q])[other]) if q < floor else (other, here + 1)
        within, of = _run(here, nc * nd)
        node, other = c[of] + within // nd[of], d[of] + within % nd[of]
        by = np.argsort(node, kind="stable")
        node, other, p, q = node[by], other[by], min(p + 1, depth), min(q + 1, floor)
    if len(node) == 0:
        return whole, np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, of = _run(t.bounds[p][node], np.diff(t.bounds[p])[node])
    index = e.order[other][of]
    apart = ((t.points[place] - entries[index]) ** 2).sum(1)
    least = np.full(len(t.points), np.iinfo(np.int64).max)
    np.minimum.at(least, place, apart)
    tied = apart == least[place]
    pick = np.full(len(t.points), len(entries))
    np.minimum.at(pick, place[tied], index[tied])
    single = np.flatnonzero(pick < len(entries))
    return whole, single, pick[single]


def codes_of(t: Tree, found) -> np.ndarray:
    """Entry of every part in its first order."""
    out = np.empty(len(t.order), np.int64)
    for level, nodes, index in found[0]:
        place, of = _run(t.bounds[level][nodes], np.diff(t.bounds[level])[nodes])
        out[t.order[place]] = index[of]
    out[t.order[found[1]]] = found[2]
    return out


def _add(t: Tree, found, count: np.ndarray, total: np.ndarray) -> None:
    """Add counts and sums of all parts to their entries; whole nodes add their cached ones."""
    for level, nodes, index in found[0]:
        np.add.at(count, index, np.diff(t.bounds[level])[nodes])
        np.add.at(total, index, t.sums[level][nodes])
    np.add.at(count, found[2], 1)
    np.add.at(total, found[2], t.points[found[1]])


def _whole(vectors: pa.Array, parts: int, width: int) -> np.ndarray:
    """[rows, parts, width] whole numbers, padded with 0."""
    values, first = np.asarray(vectors.values), np.asarray(vectors.offsets)
    size = np.diff(first)
    x = np.zeros((len(vectors), parts * width), np.int64)
    place, of = _run(np.zeros(len(size), np.int64), size)
    x[of, place] = np.clip(np.floor(values[first[0]:first[-1]] * SCALE), -WIDE, WIDE)
    return x.reshape(len(vectors), parts, width)


def _stretches(batch: pa.RecordBatch, parts: int, width: int):
    rows = max(LEAF, STRETCH // (8 * parts * width))
    step = -(-batch.num_rows // max(1, -(-batch.num_rows // rows))) or 1
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield part, _whole(part.column(1), parts, width)


def _sums(books: np.ndarray):
    parts, k, width = books.shape

    def task(batches):
        count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        trees = [grow(b, 1) for b in books]
        for batch in batches:
            for _, x in _stretches(batch, parts, width):
                for j in range(parts):
                    t = grow(x[:, j], LEAF)
                    _add(t, assign(t, books[j], trees[j]), count[j], total[j])
        j, i = np.nonzero(count)
        if len(j):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(j, width)), pa.array(np.repeat(i, width)), pa.array(np.tile(np.arange(width), len(j))),
                                              pa.array(np.repeat(count[j, i], width)), pa.array(total[j, i].ravel())], names=["part", "entry", "place", "n", "total"])
    return task


def _coded(books: np.ndarray):
    parts, _, width = books.shape

    def task(batches):
        trees = [grow(b, 1) for b in books]
        for batch in batches:
            for rows, x in _stretches(batch, parts, width):
                codes, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
                for j in range(parts):
                    t = grow(x[:, j], LEAF)
                    codes[:, j] = codes_of(t, assign(t, books[j], trees[j]))
                    error += ((x[:, j] - books[j][codes[:, j]]) ** 2).sum(1)
                text = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array([text[i:i + 2 * parts] for i in range(0, len(text), 2 * parts)]), pa.array(error)],
                                                 names=["vec_id", "label", "code", "error"])
    return task


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES,
             rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Codes of all usable vectors (vec_id, label as text, code, error) and the codebooks [parts, entries, width].

    Rows go whose vector is null or holds null or non-finite components. Components become floor(256 x), at most ``WIDE`` in size (as
    262,144 and more in the vector). Vectors shorter than the longest, or than a multiple of ``parts``, are padded with 0. A codebook
    starts as that part of the ``entries`` smallest ids (null ids last, equal ids by their vectors), with fewer rows than that it is
    shorter; at most 256 entries. Repeated rows each count and come out repeated. Without usable rows the result is empty.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label")).where(F.col("v").isNotNull() & usable)
    longest = d.agg(F.max(F.size("v"))).first()[0]
    width = max(1, -(-(longest or 0) // parts))
    seeds = d.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()
    first = pa.array([r["v"] for r in seeds], pa.list_(pa.float64()))
    books = np.ascontiguousarray(_whole(first, parts, width).transpose(1, 0, 2))
    if longest is not None:
        for _ in range(rounds):
            sums = d.mapInArrow(_sums(books), "part long, entry long, place long, n long, total long").groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toArrow()
            at = [np.asarray(sums.column(c)) for c in ("part", "entry", "place")]
            books = books.copy()
            books[tuple(at)] = np.floor_divide(np.asarray(sums.column("total")), np.asarray(sums.column("n")))
    return d.mapInArrow(_coded(books), "vec_id long, label string, code string, error long") if longest is not None else d.selectExpr("vec_id", "label", "'' AS code", "0L AS error").limit(0), books


def digest(books: np.ndarray) -> str:
    """sha256 of all components in order, as comma-joined decimals."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def report(vectors: DataFrame, label_col: str = "label", **options) -> DataFrame:
    """vec_id, code, error, label_error (the error of all rows with the same label, null labels together) and codebooks_sha256."""
    coded, books = compress(vectors, label_col=label_col, **options)
    coded = landed(coded.withColumn("_label", F.coalesce(F.concat(F.lit("s"), F.col("label")), F.lit("n"))), "codes")
    sums = landed(coded.groupBy("_label").agg(F.sum("error").alias("label_error")), "errors")
    n = sums.count()
    both = coded.join(small(sums, n), "_label") if n <= 10_000 else join_split(coded, sums, "_label")
    return both.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
