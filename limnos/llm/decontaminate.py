"""Benchmark decontamination: windows of benchmark words as a broadcast hash set, scanned over every document's word windows.

The benchmark is small and fixed beside the corpus, but its size is checked: items are dealt into blocks of at most ``BLOCK_WINDOWS``
windows (16 bytes each) and the corpus is scanned once for a block, so what a task holds is bounded whatever the benchmark's size.
A hash hit is verified by comparing the words themselves before it counts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.arrays import Sieve, Words, lowered, pieces, table, windows, words
from limnos.llm.spread import landed, small

WINDOW = 10
BLOCK_BYTES = 8 << 20  # benchmark text a block may hold; windows of it take about 30 MB in a task

IS_WORD = table(lambda b: not (b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F))
FOLD = lowered()
EMPTY = hashlib.sha256(b"").hexdigest()


def _spelled(data: np.ndarray, w: Words, at: int, length: int) -> bytes:
    return b" ".join(data[w.begin[i]:w.end[i]].tobytes() for i in range(at, at + length))


class TestWindows:
    """Every distinct window of a block of benchmark items, by length: hash, spelling and the items that hold it."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        held: dict[int, dict[int, tuple[bytes, set[str]]]] = {}
        for p in pieces(pa.array([t for _, t in items], pa.string())):
            w, folded = words(p, IS_WORD, FOLD), FOLD[p.data]
            by_length = {n: windows(w, n) for n in {min(int(c), window) for c in w.counts if c}}
            for d in range(len(p)):
                n = min(int(w.counts[d]), window)
                if n:
                    at, h = by_length[n]
                    for i in range(*np.searchsorted(at, w.bounds[d:d + 2])):
                        held.setdefault(n, {}).setdefault(int(h[i]), (_spelled(folded, w, int(at[i]), n), set()))[1].add(items[p.first + d][0])
        self.lengths = {n: (Sieve(np.array(list(x), np.uint64)), x) for n, x in sorted(held.items())}

    def hits(self, p, w: Words):
        """Marked words of a piece, and for each text the items with windows in it."""
        marked, found = np.zeros(len(w.hashes), bool), {}
        folded = None
        for n, (sieve, held) in self.lengths.items():
            at, h = windows(w, n)
            where, _ = sieve.find(h)
            if len(where) and folded is None:
                folded = FOLD[p.data]
            for i in where:
                start = int(at[i])
                spelling, items = held[int(h[i])]
                if _spelled(folded, w, start, n) == spelling:
                    marked[start:start + n] = True
                    found.setdefault(int(np.searchsorted(w.bounds, start, "right")) - 1, set()).update(items)
        return marked, found


def _runs(marked: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([False], marked, [False])).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Benchmark windows inside every document.

    Returns one row per input row: doc_id, n_words, n_hit (words inside any occurrence), spans (array of [first, last) word runs, with
    their byte offsets), items (sorted ids as strings). A null text has no words; an item that is null or has no words has no window;
    an item with a null id counts as the id "null". Repeated items count once, repeated documents come out repeated. Empty tables:
    no documents give no rows, no items give no hits. Other columns are not read.
    """
    spark = docs.sparkSession
    bench = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = -(-total // block_bytes) or 1
    schema = "doc_id long, n_words long, spans array<struct<first:int,last:int,from_byte:int,to_byte:int>>, items array<string>"

    def scanned(part: DataFrame, rows: list) -> DataFrame:
        shared = spark.sparkContext.broadcast([(r["item"], r["text"]) for r in rows])
        ready = []

        def task(batches):
            if not ready:
                ready.append(TestWindows(shared.value, window))
            tests = ready[0]
            for batch in batches:
                ids = batch.column(0)
                for p in pieces(batch.column(1)):
                    w = words(p, IS_WORD, FOLD)
                    marked, found = tests.hits(p, w)
                    spans = [[] for _ in range(len(p))]
                    for d in found:
                        b, e = int(w.bounds[d]), int(w.bounds[d + 1])
                        spans[d] = [{"first": x, "last": y, "from_byte": int(w.begin[b + x] - p.starts[d]), "to_byte": int(w.end[b + y - 1] - p.starts[d])}
                                    for x, y in _runs(marked[b:e])]
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(p.first, len(p)), pa.array(w.counts), pa.array(spans, pa.list_(pa.struct(
                            [(k, pa.int32()) for k in ("first", "last", "from_byte", "to_byte")]))),
                         pa.array([sorted(found.get(d, ())) for d in range(len(p))], pa.list_(pa.string()))],
                        names=["doc_id", "n_words", "spans", "items"])

        return part.mapInArrow(task, schema)

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if n_blocks == 1:
        out = scanned(d, bench.collect())
    else:  # a larger benchmark goes through in blocks; only documents with hits meet again
        dealt = landed(bench.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(2 * n_blocks))), "items")
        keyed = landed(d.withColumn("row", F.monotonically_increasing_id()), "numbered")
        parts = [scanned(keyed.select(F.col("row").alias("doc_id"), "text"), dealt.where(F.col("block") == k).collect()) for k in range(2 * n_blocks)]
        found = None
        for part in parts:
            hit = part.where(F.size("items") > 0)
            found = hit if found is None else found.unionByName(hit)
        merged = found.groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        counts = scanned(keyed.select(F.col("row").alias("doc_id"), "text"), []).select(F.col("doc_id").alias("row"), "n_words")
        out = (keyed.select("row", "doc_id").join(counts, "row").join(merged.withColumnRenamed("doc_id", "row"), "row", "left")
               .select("doc_id", "n_words", F.coalesce(_merged("spans"), F.from_json(F.lit("[]"), "array<struct<first:int,last:int,from_byte:int,to_byte:int>>")).alias("spans"),
                       F.coalesce("items", F.array().cast("array<string>")).alias("items")))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), "spans", "items")


def _merged(spans: str):
    """Union of overlapping or touching runs."""
    def step(done, s):
        last = F.element_at(done, -1)
        joined = F.struct(last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"), last["from_byte"].alias("from_byte"),
                          F.greatest(last["to_byte"], s["to_byte"]).alias("to_byte"))
        more = F.when(F.size(done) == 0, F.array(s)).when(s["first"] <= last["last"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined)))
        return more.otherwise(F.concat(done, F.array(s)))
    kind = "array<struct<first:int,last:int,from_byte:int,to_byte:int>>"
    return F.when(F.size(spans) > 0, F.aggregate(F.array_sort(spans), F.from_json(F.lit("[]"), kind), step))


def report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``scan`` as one digest row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    s = scan(docs, items, **options)
    return s.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def without_spans(docs: DataFrame, items: DataFrame, window: int = WINDOW, drop_share: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents with their benchmark passages cut out, in one pass over the texts and with the columns of ``docs``.

    ``drop_share``: a document of whose words more than this share is hit goes as a whole; None keeps all. Columns may have any names.
    A null text stays null. The benchmark must fit one block here (``BLOCK_BYTES``); a larger one raises, use ``scan``.
    """
    spark = docs.sparkSession
    bench = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > BLOCK_BYTES:
        raise ValueError("the benchmark is larger than one block")
    shared = spark.sparkContext.broadcast([(r["item"], r["text"]) for r in bench.collect()])
    column, ready = docs.columns.index(text_col), []

    def task(batches):
        if not ready:
            ready.append(TestWindows(shared.value, window))
        tests = ready[0]
        for batch in batches:
            texts, changed, keep = batch.column(column), {}, np.ones(batch.num_rows, bool)
            for p in pieces(texts):
                w = words(p, IS_WORD, FOLD)
                marked, found = tests.hits(p, w)
                for d in found:
                    b, e = int(w.bounds[d]), int(w.bounds[d + 1])
                    runs = _runs(marked[b:e])
                    if drop_share is not None and sum(y - x for x, y in runs) > drop_share * (e - b):
                        keep[p.first + d] = False
                        continue
                    raw, out, at = p.data[p.starts[d]:p.starts[d + 1]], [], 0
                    for x, y in runs:
                        out.append(raw[at:w.begin[b + x] - p.starts[d]].tobytes())
                        at = int(w.end[b + y - 1] - p.starts[d])
                    out.append(raw[at:].tobytes())
                    changed[p.first + d] = b"".join(out).decode("utf-8", "replace")
            if changed:
                values = texts.to_pylist()
                for i, t in changed.items():
                    values[i] = t
                batch = batch.set_column(column, batch.schema.field(column), pa.array(values, texts.type))
            yield batch.filter(pa.array(keep)) if not keep.all() else batch

    return docs.mapInArrow(task, docs.schema)


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any benchmark window, with all their columns, in one pass; null texts stay.

    A benchmark of more than one block is scanned in blocks, and the ids found go.
    """
    size = items.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    if size <= BLOCK_BYTES:
        return without_spans(docs, items, window, 0.0, id_col, text_col)
    gone = landed(scan(docs, items, window, id_col, text_col).where("n_hit > 0").select(F.col("doc_id").alias("_id")).distinct(), "contaminated")
    return docs.withColumn("_id", F.col(id_col).cast("long")).join(small(gone, gone.count()), "_id", "left_anti").drop("_id")
