"""Quality by Bradley-Terry ranking: a linear score learned from preference pairs, cut at a quantile of the scores.

Every pair says that one labelled document is better than another. The score's weights maximise the likelihood that the better one of
a pair wins, which is a logistic loss on the difference of their features, minimised by Newton steps whose sums Spark adds up over
the pairs. The threshold is the score quantile that leaves as large a share of the labelled documents below it as the labels do.
All labelled documents outside the held-out fold take part in the features' moments, the pairs and the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.arrays import lowered, pieces, table, words
from limnos.llm.labelled import held_out, labelled
from limnos.llm.spread import landed, small

ROUNDS = 4  # pairs that each labelled document takes part in on its own side
RIDGE = 1.0
STEPS = 8
CLIP = 4.0  # standardised features are cut there
BINS = 1 << 16  # of the ranks, to find the threshold

_SPACE = table(lambda b: b in (9, 10, 11, 12, 13, 32))
_WORD = ~_SPACE
_FOLD = lowered()
_UPPER, _LOWER = table(lambda b: 65 <= b <= 90), table(lambda b: 97 <= b <= 122)
_DIGIT, _HIGH = table(lambda b: 48 <= b <= 57), table(lambda b: b >= 128)
_STOP = table(lambda b: chr(b) in ".,;:'")
_MARK = table(lambda b: 33 <= b <= 126 and not chr(b).isalnum() and chr(b) not in ".,;:'")

FEATURES = ("length", "word_length", "upper", "digits", "high", "stops", "marks", "marked_words", "distinct", "short_words", "long_words", "lines", "repeated_lines",
            "mark_kinds", "capital_words", "lone_marks", "repeated_windows")


def _share(mask: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of a mask in every text."""
    total = np.concatenate(([0], np.cumsum(mask)))
    return (total[starts[1:]] - total[starts[:-1]]).astype(float)


def features(p) -> np.ndarray:
    """One row per text of a piece; a text without words has zeros."""
    data, w = p.data, words(p, _WORD, _FOLD)
    n, n_bytes = w.counts, np.diff(p.starts)
    if len(w.hashes) == 0:
        return np.zeros((len(p), len(FEATURES)))
    m, size = np.maximum(n, 1), np.maximum(n_bytes, 1)
    mark, low, up = _MARK[data], _LOWER[data] | _HIGH[data], _UPPER[data]
    per_word = lambda mask: np.add.reduceat(mask.astype(np.int64), w.begin)  # noqa: E731  the spaces after a word hold none of these
    marks, letters = per_word(mark), per_word(low | up)
    length = w.end - w.begin
    over = lambda mask: _share(mask, w.bounds) / m
    text = np.repeat(np.arange(len(p)), n)
    order = np.lexsort((w.hashes, text))
    h, t = w.hashes[order], text[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])))
    distinct = np.bincount(t, new, minlength=len(p)) / m
    newline = data == 10
    lines = _share(newline, p.starts)
    repeated, kinds, windows_again = np.zeros(len(p)), np.zeros(len(p)), np.zeros(len(p))
    for d in range(len(p)):
        raw = data[p.starts[d]:p.starts[d + 1]]
        if lines[d]:
            parts = raw.tobytes().split(b"\n")
            repeated[d] = 1 - len(set(parts)) / len(parts)
        kinds[d] = np.count_nonzero(np.bincount(raw[mark[p.starts[d]:p.starts[d + 1]]], minlength=1))
        own = w.hashes[w.bounds[d]:w.bounds[d + 1]]
        if len(own) > 3:
            pair = own[:-2] * np.uint64(3) + own[1:-1] * np.uint64(7) + own[2:]
            windows_again[d] = 1 - len(np.unique(pair)) / len(pair)
    first_up = up[w.begin]
    return np.column_stack([
        np.log1p(n), _share(np.ones(len(data), bool), p.starts) / m, _share(up, p.starts) / size, _share(_DIGIT[data], p.starts) / size, _share(_HIGH[data], p.starts) / size,
        _share(_STOP[data], p.starts) / m, _share(mark, p.starts) / size, over((marks > 0) & (letters > 0)), distinct, over(length <= 3), over(length >= 12), lines / m, repeated,
        np.log1p(kinds), over(first_up), over((marks > 0) & (letters == 0)), windows_again])


def with_features(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``features`` of every whole text as an array column beside the id (and further long columns)."""
    keep = keep or []

    def task(batches):
        for batch in batches:
            for p in pieces(batch.column(1)):
                x = features(p)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(p.first, len(p)), flat, *[batch.column(2 + i).slice(p.first, len(p)) for i in range(len(keep))]],
                                                 names=["doc_id", "x", *keep])

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *[F.col(k).cast("long") for k in keep])
    return chosen.mapInArrow(task, "doc_id long, x array<double>" + "".join(f", {k} long" for k in keep))


def preference_pairs(known: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(better, worse) feature arrays: in each round every document meets one of the other class.

    Both classes are numbered by hash within ``SLOTS`` slots and meet in equal slots, so the number of pairs is in proportion to the
    labelled documents and no document of the smaller class meets all others.
    """
    s = known.select("x", "label", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round"), "doc_id")
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = max(1, min(sizes.get(0, 0), sizes.get(1, 0)))
    s = s.withColumn("slot", F.pmod(F.xxhash64("doc_id", "round", "label"), F.lit(slots)))
    good, bad = s.where("label = 1").withColumnRenamed("x", "better"), s.where("label = 0").withColumnRenamed("x", "worse")
    return good.select("round", "slot", "better").join(bad.select("round", "slot", "worse"), ["round", "slot"]).select("better", "worse")


def learn(pairs: DataFrame, centre: np.ndarray, scale: np.ndarray, steps: int = STEPS, ridge: float = RIDGE) -> np.ndarray:
    """Weights of the standardised features by Newton steps; each step is one pass over the pairs with one row of sums a task."""
    k = len(centre)
    weight = np.zeros(k)
    for _ in range(steps):
        now = weight

        def task(batches):
            g, h, loss = np.zeros(k), np.zeros((k, k)), 0.0
            for batch in batches:
                better, worse = (np.asarray(batch.column(i).flatten()).reshape(-1, k) for i in (0, 1))
                cut = lambda x: np.clip((x - centre) / scale, -CLIP, CLIP)
                d = cut(better) - cut(worse)
                lose = 1 / (1 + np.exp(np.clip(d @ now, -30, 30)))
                g += d.T @ lose
                h += (d * (lose * (1 - lose))[:, None]).T @ d
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate((g, h.ravel())).tolist()])], names=["sums"])

        sums = np.sum([r["sums"] for r in pairs.mapInArrow(task, "sums array<double>").collect()], axis=0)
        step = np.linalg.solve(sums[k:].reshape(k, k) + ridge * np.eye(k), sums[:k] - ridge * weight)
        weight = weight + step
        if np.abs(step).max() < 1e-6:
            break
    return weight


def weighted_quantile(df: DataFrame, value: str, freq: str, share: float, bins: int = BINS) -> float | None:
    """Exact quantile of ``value``, each row counting ``freq`` times, interpolated between neighbours as ``percentile`` does; null values don't count.

    Counts in equal bins tell which ones hold the two neighbours; only the values there are read again, so no task holds all values.
    """
    d = df.where(F.col(value).isNotNull())
    at = d.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.sum(freq).alias("n")).first()
    if at["n"] is None or at["lo"] == at["hi"]:
        return at["lo"]
    b = F.floor((F.col(value) - at["lo"]) / (at["hi"] - at["lo"]) * bins)
    position = (at["n"] - 1) * share
    below, before, wanted = {}, 0, {}
    for r in sorted(d.groupBy(b.alias("b")).agg(F.sum(freq).alias("n")).collect()):
        below[r["b"]] = before
        for place in (int(np.floor(position)), int(np.ceil(position))):
            if before <= place < before + r["n"]:
                wanted[place] = r["b"]
        before += r["n"]
    found = {}
    for bin_ in set(wanted.values()):
        before = below[bin_]
        for r in sorted(d.where(b == bin_).groupBy(value).agg(F.sum(freq).alias("n")).collect()):
            found |= {place: r[0] for place in wanted if before <= place < before + r["n"]}
            before += r["n"]
    low, high = int(np.floor(position)), int(np.ceil(position))
    return found[low] if found[low] == found[high] else (high - position) * found[low] + (position - low) * found[high]


def score_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 3, fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Quality of every whole text: doc_id, held_out, score (0 to 1), predicted (score >= 0.5).

    Learns from all labels outside the held-out fold and from no others. A text that is null or has no words scores as the average
    features of what it learns from do. Without labels of both classes every score is 0.5. Null ids are scored and teach nothing; repeated rows come out repeated; an
    empty table gives no rows; other columns are not read.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    taught, sizes = labelled(labels, label_col, folds, fold)
    taught = taught.withColumn("label", F.col("label").cast("long"))  # its type is part of the hash that deals out pairs
    out = held_out("doc_id", folds, fold)
    every = landed(with_features(d), "features") if min(sizes.values()) else None
    known = None if every is None else landed(every.join(small(taught, sum(sizes.values())), "doc_id"), "labelled")
    if known is None or known.select("label").distinct().count() < 2:
        return d.select("doc_id", out.alias("held_out"), F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    k = len(FEATURES)
    at = known.select(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(k)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(k)]).first()
    centre = np.array([at[f"m{i}"] for i in range(k)])
    scale = np.array([at[f"s{i}"] or 1.0 for i in range(k)])
    weight = learn(landed(preference_pairs(known), "pairs"), centre, scale)

    def ranked(frame: DataFrame, keep: list[str]) -> DataFrame:
        z = [F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), (F.col("x")[i] - float(centre[i])) / float(scale[i]))) * float(weight[i]) for i in range(k)]
        total = z[0]
        for term in z[1:]:
            total = total + term
        return frame.select("doc_id", *keep, F.when(F.exists("x", lambda v: v != 0), total).otherwise(F.lit(None)).alias("rank"))

    by_class = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = sizes[0] / (sizes[0] + sizes[1])
    weighted = ranked(known, ["label"]).withColumn("w", F.when(F.col("label") == 0, sizes[0] / by_class[0]).otherwise(sizes[1] / by_class[1]))
    weighted = weighted.select("rank", F.greatest(F.lit(1), F.round(F.col("w") * 10)).cast("int").alias("freq"))
    cut = weighted_quantile(weighted, "rank", "freq", share)
    score = 1 / (1 + F.exp(-F.greatest(F.least(F.coalesce(F.col("rank") - float(cut), F.lit(-float(cut))), F.lit(30.0)), F.lit(-30.0))))
    return (ranked(every, []).select("doc_id", out.alias("held_out"), score.alias("score"))
            .select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))
