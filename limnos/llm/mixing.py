"""Mixing sources to target weights by a Pfair schedule of blocks.

A block runs as two halves of ``block / 2`` documents. Weights are exact fractions. Time is cut into frames: of the halves of a source
of weight w that are released before a frame ends (half j at j / w), as many run in it as earliest deadlines ((j + 1) / w) allow, so at
every frame's end each source stands within one half of its target. Inside a frame of T slots the i-th of a source's n halves is
released at slot floor(i * T / n) and due before ceil((i + 1) * T / n); in each slot the released half with the earliest deadline runs,
ties going to the source with more halves and then to its name. Both errors together stay below two halves: at every slot of a phase
each source has run within one block of its target weight, however long the mix and however many the sources.

A source that runs out ends a phase; the remaining weights go on among the remaining sources, so every document gets a place. Only
numbers of halves a frame and source are made on the driver; frames are laid out in tasks and joined to the documents by source and half.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.spread import gapless, join_split, landed, small

BLOCK = 8
FRAME = 1 << 16  # slots that one task lays out, or more with many sources
SLOTS_A_SOURCE = 1024  # least slots of a frame for each source, so that frames times sources stay below a thousandth of the documents
ROWS_A_TASK = 50_000  # rows of a source that one task numbers
TEMPER = 0.7  # default target: block counts to this power


def whole_weights(weights: list[float | Fraction]) -> np.ndarray:
    """Whole numbers in exactly the ratio of the weights."""
    exact = [Fraction(w) for w in weights]
    if any(w < 0 for w in exact):
        raise ValueError("weights must not be negative")
    unit = lcm(*[w.denominator for w in exact]) if exact else 1
    return np.array([int(w * unit) for w in exact], object)


def quotas(left: list[int], weights: list[float | Fraction], frame: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(phase, first slot, slots, sources, halves used before, halves to run) of consecutive frames until nothing is left.

    A phase lasts until the deadline of the last half of the source that runs out first. Sources of weight 0 come last, in equal shares.
    """
    left, p = np.array(left, object), whole_weights(weights)
    used, start, phase = np.zeros(len(left), object), 0, 0
    while (left > 0).any():
        live = np.flatnonzero((left > 0) & (p > 0))
        w = p[live]
        if not len(live):
            live = np.flatnonzero(left > 0)
            w = np.ones(len(live), object)
        total, room = w.sum(), left[live]
        length, ran, at = int((-(-room * total // w)).min()), np.zeros(len(live), object), 0
        while at < length:
            end = min(at + frame, length)
            due = w * end
            after = np.maximum(ran, np.minimum(due // total, room))
            free = np.flatnonzero(after < np.minimum(-(-due // total), room))
            deadline = -(-(after[free] + 1) * total // w[free])
            for k in sorted(range(len(free)), key=lambda k: (deadline[k], -w[free[k]], free[k]))[:end - after.sum()]:
                after[free[k]] += 1
            some = np.flatnonzero(after > ran)
            yield phase, start + at, end - at, live[some], (used[live] + ran)[some].astype(np.int64), (after - ran)[some].astype(np.int64)
            ran, at = after, end
        left[live] -= ran
        used[live] += ran
        start, phase = start + length, phase + 1


def one_frame(counts: list[int]) -> list[tuple[int, int, int, int]]:
    """(source, number, release, deadline) of the half in each slot of a frame that all counts fill, earliest deadline first.

    A source's next half waits for its release, its turn or both, so no more than one a source is held.
    """
    slots = sum(counts)
    waiting, ready, out = [(0, s, 0) for s in range(len(counts)) if counts[s]], [], []
    heapq.heapify(waiting)
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            release, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * slots // counts[s]), -counts[s], s, i, release))
        deadline, _, s, i, release = heapq.heappop(ready)
        out.append((s, i, release, deadline))
        if i + 1 < counts[s]:
            heapq.heappush(waiting, ((i + 1) * slots // counts[s], s, i + 1))
    return out


def _lay(group):
    import pandas as pd
    g = group.sort_values("number")
    source, number, release, deadline = np.array(one_frame(g["n"].tolist()), np.int64).T
    start = g["start"].iat[0]
    return pd.DataFrame({"key": g["key"].to_numpy()[source], "half": g["first_half"].to_numpy()[source] + number, "phase": g["phase"].iat[0],
                         "release": start + release, "deadline": start + deadline, "slot": start + np.arange(len(source))})


def laid_out(spark, halves: dict[str, int], weights: dict[str, float | Fraction], frame: int = FRAME) -> DataFrame:
    """(key, half, phase, release, deadline, slot) of every half of every source."""
    keys = sorted(halves)
    frame = max(frame, SLOTS_A_SOURCE * len(keys)) if frame >= FRAME else frame
    rows = list(quotas([halves[k] for k in keys], [weights[k] for k in keys], frame))
    each = [len(r[3]) for r in rows]
    whole = lambda parts: pa.array(np.concatenate([np.zeros(0, np.int64), *parts]).astype(np.int64))
    number = whole([r[3] for r in rows])
    table = pa.table({"frame": whole([np.repeat(np.arange(len(rows)), each)]), "phase": whole([np.repeat([r[0] for r in rows], each)]), "start": whole([np.repeat([r[1] for r in rows], each)]),
                      "number": number, "key": pa.array(keys, pa.string()).take(number), "first_half": whole([r[4] for r in rows]), "n": whole([r[5] for r in rows])})
    return spark.createDataFrame(table).groupBy("frame").applyInPandas(_lay, "key string, half long, phase int, release long, deadline long, slot long")


def schedule(docs: DataFrame, weights: dict[str, float | Fraction] | None = None, block: int = BLOCK, frame: int = FRAME, temper: float = TEMPER, id_col: str = "doc_id",
             source_col: str = "source") -> DataFrame:
    """Place of every document in the mix.

    Returns one row per input row: doc_id, source, block (number of the half block within the source), phase, release, deadline, slot
    (place of the half block among all, from 0), position (place of the document in it). Phase 0 has all sources at their target weights.
    Without ``weights`` the target is each source's number of half blocks to the power ``temper``; given ones are taken exactly, in any
    unit. A weight that is missing counts as the smallest one given, one of 0 puts a source after all others. A null source is a source
    of its own (null), null ids sort first, repeated rows get places of their own. Empty tables give no rows. Other columns are not read.

    The driver receives one count per source. With a ``block`` of 1 a document is the smallest part and the bound is two documents.
    """
    half = max(1, block // 2)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"))
    named = named.withColumn("key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")))
    counts = {r["key"]: r["n"] for r in named.groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}
    halves = {k: -(-n // half) for k, n in counts.items()}
    if weights is None:
        target = {k: float(n) ** temper for k, n in halves.items()}
    else:
        least = min(weights.values())
        target = {k: weights.get(k[1:] if k[0] == "s" else None, least) for k in halves}
    most = max(counts.values(), default=0)
    numbered = gapless(named.withColumn("_order", F.coalesce("doc_id", F.lit(-2**63))), "key", ["_order"], "rank", spread=max(256, most // ROWS_A_TASK))
    at = numbered.withColumn("half", F.floor(F.col("rank") / half))
    out = join_split(at, laid_out(docs.sparkSession, halves, target, frame), ["key", "half"])
    return out.select("doc_id", "source", F.col("half").alias("block"), "phase", "release", "deadline", "slot", (F.col("rank") % half).cast("int").alias("position"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, id_col: str = "doc_id", whole: bool = False, **options) -> DataFrame:
    """The documents of the mix, with the columns of ``docs``, in the order of the schedule.

    With ``whole`` every row comes out, phase after phase. Otherwise only the mix proper does, which ends when the first source runs
    out: up to there every source stands within one block of its target weight. Rows that share an id (or have none) share the first
    place among them. Rows are laid out in ranges of slots, so the files, read in order, are the schedule.
    """
    placed = schedule(docs, weights, block, id_col=id_col, **options)
    plan = landed((placed if whole else placed.where("phase = 0")).select("doc_id", "slot", "position"), "schedule")
    own = docs.columns
    ids = F.col(id_col).cast("long")
    first = plan.groupBy("doc_id").agg(F.min(F.struct("slot", "position")).alias("_at"))
    places = landed(first.select(F.col("doc_id").alias("_to"), F.col("_at.slot").alias("_slot"), F.col("_at.position").alias("_position")), "places")
    at = small(places, places.count())  # while it is small, only the laying out moves texts
    out = docs.withColumn("_id", ids).join(at, F.col("_id").eqNullSafe(F.col("_to")))
    # rows without an id share one place: a hash of the row deals them over tasks
    tie = F.when(F.col("_id").isNull(), F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in own]))))
    out = out.withColumn("_tie", tie)
    return out.repartitionByRange("_slot", "_position", "_tie").sortWithinPartitions("_slot", "_position", "_tie").select(*own)
