"""Toxicity by two Kneser-Ney language models, one of toxic and one of ordinary documents, over one shared backoff.

A model spells words: P(byte | the ``ORDER`` - 1 bytes before it in the word). A class takes the discounted share of the n-gram and
leaves the freed mass to a distribution of order ``BACKOFF`` that both classes share. That one comes from every document of the
corpus, labelled or not. Both count how many distinct words of a document hold an n-gram, so a repeated line counts once. N-grams
that a class has seen less than ``CUTOFF`` times count as unseen: rare spellings fall back to what both share and say nothing.
Small differences, such as one class having more texts of a language, would add up over a long text, so each n-gram's difference
counts only by what exceeds ``MARGIN``.
The score is a logistic function of the difference of the log-likelihoods divided by the number of words, fitted on labelled
documents that the counts have not seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.arrays import Sieve, Words, lowered, pieces, table, words
from limnos.llm.labelled import held_out, labelled_sample, with_texts
from limnos.llm.spread import small

PER_CLASS = 4_000  # expected labelled documents of each class that the models learn from
ORDER, BACKOFF = 7, 4  # bytes; at most 8
DISCOUNT = 3.0  # more than is usual, so that chance in small samples stays with the shared backoff
CUTOFF = 4
MARGIN = 1.5  # of an n-gram's log-likelihood difference only what exceeds this counts
FIT_PARTS, FIT_PART = 5, 0  # part of the sample that fits the logistic function instead of the counts

IS_WORD = table(lambda b: 0x61 <= b <= 0x7A or b >= 0x80)
FOLD = lowered()
_EIGHT = np.uint64(8)


def spelled(folded: np.ndarray, w: Words, pick: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """N-gram codes of the picked words, padded by blanks, and where each word's codes begin; the last byte is the lowest."""
    size = w.end[pick] - w.begin[pick]
    first = np.concatenate(([0], np.cumsum(size + order)))
    x = np.full(int(first[-1]), 32, np.uint64)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    x[np.repeat(first[:-1] + order - 1, size) + inside] = folded[np.repeat(w.begin[pick], size) + inside]
    m = len(x) - order + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(pick) + 1, np.int64)
    code = np.zeros(m, np.uint64)
    for j in range(order):
        code = code << _EIGHT | x[j:j + m]
    n = size + 1  # every byte of the word and the blank after it
    at = np.repeat(first[:-1], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return code[at], np.concatenate(([0], np.cumsum(n)))


def _distinct(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First position of every distinct word of a piece, and each word's number among them."""
    _, first, number = np.unique(w.hashes, return_index=True, return_inverse=True)
    return first, number


@dataclass
class ClassModels:
    """What sets the classes apart, by n-gram and by history: probabilities in the ordinary [0] and the toxic [1] class."""

    grams: Sieve
    like: np.ndarray  # log P_toxic - log P_ordinary of an n-gram that one of them has kept
    histories: Sieve
    freed: np.ndarray  # the same difference for every other byte after the history; the shared factor cancels

    def difference(self, p) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood difference a word of every text of a piece, and its number of words."""
        w = words(p, IS_WORD, FOLD)
        n = w.counts
        if len(w.hashes) == 0:
            return np.zeros(len(p)), n
        first, number = _distinct(w)
        code, at = spelled(FOLD[p.data], w, first)
        diff = np.zeros(len(code))
        where, known = self.histories.find(code >> _EIGHT)
        diff[where] = self.freed[known]
        hit, known = self.grams.find(code[where])
        diff[where[hit]] = self.like[known]
        total = np.concatenate(([0.0], np.cumsum(np.add.reduceat(diff, at[:-1])[number])))
        return (total[w.bounds[1:]] - total[w.bounds[:-1]]) / np.maximum(n, 1), n


def _class_counts(sample: DataFrame) -> DataFrame:
    """In each class, how many distinct words of a document hold the n-gram, added up over documents by Spark."""
    def task(batches):
        for batch in batches:
            labels = np.asarray(batch.column(1))
            for p in pieces(batch.column(0)):
                w = words(p, IS_WORD, FOLD)
                if len(w.hashes) == 0:
                    continue
                first, number = _distinct(w)
                code, at = spelled(FOLD[p.data], w, first)
                once = np.unique(np.repeat(np.arange(len(p)), w.counts) * len(first) + number)  # a word counts once a document
                label, number = labels[p.first + once // len(first)], once % len(first)
                for c in (0, 1):
                    times = np.repeat(np.bincount(number[label == c], minlength=len(first)), np.diff(at))
                    gram, back = np.unique(code[times > 0], return_inverse=True)
                    n = np.bincount(back, times[times > 0], minlength=len(gram)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), c, np.int32)), pa.array(gram.view(np.int64)), pa.array(n)], names=["label", "gram", "n"])

    return sample.select("text", "label").mapInArrow(task, "label int, gram long, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))


def backoff_counts(docs: DataFrame, order: int = BACKOFF) -> DataFrame:
    """(gram, n) over all documents: how many distinct words of a document hold the n-gram, added up over documents.

    Every task adds up what it reads before anything is shuffled.
    """
    def task(batches):
        grams, counts = [], []

        def packed():
            g, back = np.unique(np.concatenate(grams), return_inverse=True)
            return g, np.bincount(back, np.concatenate(counts), minlength=len(g)).astype(np.int64)

        for batch in batches:
            for p in pieces(batch.column(0)):
                w = words(p, IS_WORD, FOLD)
                if len(w.hashes) == 0:
                    continue
                first, number = _distinct(w)
                text = np.repeat(np.arange(len(p)), w.counts)
                in_docs = np.bincount(np.unique(text * len(first) + number) % len(first), minlength=len(first))
                code, at = spelled(FOLD[p.data], w, first, order)
                g, back = np.unique(code, return_inverse=True)
                grams.append(g)
                counts.append(np.bincount(back, np.repeat(in_docs, np.diff(at)), minlength=len(g)))
                if len(grams) >= 32:
                    g, n = packed()
                    grams, counts = [g], [n]
        if grams:
            g, n = packed()
            for at in range(0, len(g), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(g[at:at + 100_000].view(np.int64)), pa.array(n[at:at + 100_000])], names=["gram", "n"])

    return docs.select("text").mapInArrow(task, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def fit_models(sample: DataFrame, docs: DataFrame, discount: float = DISCOUNT, cutoff: int = CUTOFF, margin: float = MARGIN) -> ClassModels:
    """Class models from a bounded labelled sample (text, label) and backoff counts from all texts of ``docs``.

    The driver receives n-grams that the sample has at least ``cutoff`` times, their histories and their shared probabilities, all
    bounded by the sample.
    """
    counts = _class_counts(sample).persist()
    held = counts.where(F.col("n") >= cutoff).toPandas()
    sums = (counts.groupBy("label", F.shiftright("gram", 8).alias("history")).agg(F.sum("n").alias("n"), F.max("n").alias("most"))
            .where(F.col("most") >= cutoff).select("label", "history", "n").toPandas())
    counts.unpersist()
    as_code = lambda x: x.to_numpy(np.int64).view(np.uint64)
    grams, histories = Sieve(as_code(held["gram"]), 22), Sieve(as_code(sums["history"]), 22)
    low = np.uint64((1 << 8 * BACKOFF) - 1)
    suffix = np.unique(grams.values & low)
    back = backoff_counts(docs).withColumn("history", F.shiftright("gram", 8))
    totals = back.groupBy("history").agg(F.sum("n").alias("total"))
    wanted = docs.sparkSession.createDataFrame(pa.table({"gram": suffix.view(np.int64)}))
    got = back.join(small(wanted, len(suffix)), "gram").join(totals, "history").select("gram", (F.col("n") / F.col("total")).alias("p")).toPandas()
    shared = np.full(len(suffix), 1e-6)
    shared[np.searchsorted(suffix, as_code(got["gram"]))] = got["p"].to_numpy()
    shared = shared[np.searchsorted(suffix, grams.values & low)]
    own, freed = np.zeros((2, len(grams.values))), np.ones((2, len(histories.values)))
    after = np.searchsorted(histories.values, grams.values >> _EIGHT)
    for c in (0, 1):
        seen, n = np.ones(len(histories.values)), held[held["label"] == c]
        s = sums[sums["label"] == c]
        seen[np.searchsorted(histories.values, as_code(s["history"]))] = s["n"].to_numpy(float)
        at = np.searchsorted(grams.values, as_code(n["gram"]))
        own[c, at] = (n["n"].to_numpy(float) - discount) / seen[after[at]]
        freed[c] -= np.bincount(after, own[c], minlength=len(histories.values))
    freed = np.maximum(freed, 1e-6)
    like = np.log(own + freed[:, after] * shared)
    beyond = lambda d: np.sign(d) * np.maximum(np.abs(d) - margin, 0)
    return ClassModels(grams, beyond(like[1] - like[0]), histories, beyond(np.log(freed[1]) - np.log(freed[0])))


def differences(docs: DataFrame, models: ClassModels) -> DataFrame:
    """(doc_id, diff, n_words) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def task(batches):
        for batch in batches:
            for p in pieces(batch.column(1)):
                d, n = shared.value.difference(p)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(p.first, len(p)), pa.array(d), pa.array(n)], names=["doc_id", "diff", "n_words"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(task, "doc_id long, diff double, n_words long")


def _logistic(x: np.ndarray, y: np.ndarray, weight_0: float) -> tuple[float, float, float]:
    """Slope, offset and scale of a one-variable logistic fit by Newton steps with a small ridge; ``weight_0`` is the weight of class 0."""
    if len(x) == 0 or y.min() == y.max():
        return 0.0, 0.0, 1.0
    scale = float(x.std()) or 1.0
    z, weight = x / scale, np.where(y == 1, 1.0, weight_0)
    a, b = 0.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g = np.array([(weight * (p - y) * z).sum() + 1e-2 * a, (weight * (p - y)).sum()])
        c = weight * p * (1 - p)
        h = np.array([[(c * z * z).sum() + 1e-2, (c * z).sum()], [(c * z).sum(), c.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -5, 5)), b - float(np.clip(step[1], -5, 5))
        if np.abs(step).max() < 1e-8:
            break
    return a, b, scale


def score_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = 5, fold: int = 0, per_class: int = PER_CLASS, id_col: str = "doc_id",
                   text_col: str = "text", **options) -> DataFrame:
    """Toxicity of every whole text: doc_id, held_out, score (0 to 1), predicted (score >= 0.5), diff, n_words.

    Learns from labels outside the held-out fold only, from as many ordinary as toxic documents; in the logistic fit an ordinary one
    weighs the square root of how much more frequent its class is. A text that is null or has no words has difference 0. Without labels of both
    classes every score is 0.5. Null ids are scored and teach nothing; repeated rows come out repeated; an empty table gives no rows;
    other columns are not read.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sample, sizes = labelled_sample(labels, label_col, folds, fold, per_class, even=True)
    known = with_texts(d, sample)
    part = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(FIT_PARTS)) == FIT_PART
    models = fit_models(known.where(~part), d, **options)
    fit = differences(known.where(part), models).join(sample, "doc_id").select("diff", "label").toPandas()
    a, b, scale = _logistic(fit["diff"].to_numpy(float), fit["label"].to_numpy(float), (sizes[0] / sizes[1]) ** 0.5 if sizes[0] and sizes[1] else 1.0)
    z = F.col("diff") * (a / scale) + b
    score = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    return (differences(d, models).select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), score.alias("score"), "diff", "n_words")
            .select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "diff", "n_words"))
