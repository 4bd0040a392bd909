"""Language identification: one bit-sliced Bloom filter answers, for an n-gram, the set of languages that contain it.

Position p of the filter holds one bit for each language; ``hashes`` positions are ANDed, so one lookup gives all languages at once.
A document's n-grams add up to one count for each language. A filter whose share of set bits is f answers wrongly with probability
f**hashes, which is subtracted from the counts before the largest one decides.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.arrays import Piece, pieces, table
from limnos.llm.labelled import held_out

GRAM = 4  # bytes of the lower-cased text
BITS = 20  # log2 of the filter's positions: 8 MB for up to 64 languages
HASHES = 3
SAMPLE = 5_000  # expected labelled documents a language that the filter is built from
LEAST_SHARE = 0.01  # an n-gram belongs to a language if this share of its sampled documents has it
UNKNOWN = "und"

_LETTER = table(lambda b: 97 <= b <= 122)
_FOLD = np.array([b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)  # all but letters and non-ASCII bytes are one space
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _folded(texts: pa.Array):
    """Pieces of lower-cased texts between spaces; a null text is empty. Only one piece at a time is copied."""
    for p in pieces(texts):
        low = pc.utf8_lower(texts.slice(p.first, len(p)).cast(pa.string()))
        q = next(pieces(pc.binary_join_element_wise(" ", low, " " * (GRAM - 1), ""), 1 << 62))
        yield Piece(p.first, q.data, q.starts)


def _packed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counted n-grams of several pieces as one."""
    grams, back = np.unique(np.concatenate([g for g, _ in held]), return_inverse=True)
    return grams, np.bincount(back, np.concatenate([n for _, n in held]), minlength=len(grams)).astype(np.int64)


def _grams(p) -> tuple[np.ndarray, np.ndarray]:
    """N-gram codes of a piece of folded texts, and for each text where its n-grams begin (a null text has none)."""
    x = _FOLD[p.data].astype(np.uint64)
    m = len(x) - GRAM + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(p) + 1, np.int64)
    code = x[:m].copy()
    for j in range(1, GRAM):
        code |= x[j:j + m] << np.uint64(8 * j)
    fits = np.ones(m, bool)
    for back in range(1, GRAM):
        at = p.starts[1:-1] - back
        fits[at[(at >= 0) & (at < m)]] = False
    at = np.flatnonzero(fits)
    return code[at], np.searchsorted(at, p.starts)


def _positions(code: np.ndarray, bits: int, hashes: int):
    for j in range(hashes):
        yield ((code + np.uint64(1)) * _MULTIPLIERS[j] >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class LanguageFilter:
    """Masks by position and 64 languages, the languages' names and the false positive rate of each."""

    names: list[str]
    masks: np.ndarray
    wrong: np.ndarray
    usual: int
    bits: int
    hashes: int

    def counts(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Corrected n-gram counts, one row per text and one column per language."""
        n = np.diff(at)
        out = np.zeros((len(n), len(self.names)))
        full = np.flatnonzero(n)
        if len(full) == 0:
            return out
        where = list(_positions(code, self.bits, self.hashes))
        for word in range(self.masks.shape[1]):
            column = self.masks[:, word]
            held = column[where[0]]
            for w in where[1:]:
                held &= column[w]
            for bit in range(min(64, len(self.names) - 64 * word)):
                out[full, 64 * word + bit] = np.add.reduceat((held >> np.uint64(bit)) & np.uint64(1), at[:-1][full])
        return np.maximum(0, (out - n[:, None] * self.wrong) / (1 - self.wrong))


def build_filter(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, share: float = LEAST_SHARE,
                 bits: int = BITS, hashes: int = HASHES) -> LanguageFilter:
    """Filter of all languages among labelled documents; rows without text or language teach nothing.

    Learns from a sample by hash of ``sample`` expected documents a language (all where there are fewer). Counting, thresholds and
    the filter's positions are Spark aggregates; the driver receives at most 2**bits positions, whatever the input.
    """
    d = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return LanguageFilter([], np.zeros((1 << bits, 1), np.uint64), np.zeros(0), 0, bits, hashes)
    rates = F.create_map(*[x for n in names for x in (F.lit(n), F.lit(min(1.0, sample / sizes[n])))])
    number = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    picked = d.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1_000_000)) < rates[F.col("lang")] * 1_000_000)

    def distinct(batches):
        for batch in batches:
            langs, held = np.asarray(batch.column(0)), {}
            for p in _folded(batch.column(1)):
                code, at = _grams(p)
                own = {}
                for d in range(len(p)):
                    own.setdefault(int(langs[p.first + d]), []).append(np.unique(code[at[d]:at[d + 1]]))
                for lang, each in own.items():
                    kept = held.setdefault(lang, [])
                    kept.append(np.unique(np.concatenate(each), return_counts=True))
                    if len(kept) >= 32:
                        held[lang] = [_packed(kept)]
            for lang, kept in held.items():
                grams, n = _packed(kept)
                yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(np.full(len(grams), lang, np.int32)), pa.array(n)], names=["gram", "lang", "n"])

    counted = picked.select(number[F.col("lang")].alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(distinct, "gram long, lang int, n long")
    docs = {r["lang"]: r["n"] for r in picked.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    need = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(i), F.lit(max(1.0, share * docs.get(n, 0))))])
    kept = counted.groupBy("gram", "lang").agg(F.sum("n").alias("n")).where(F.col("n") >= need[F.col("lang")])

    def placed(batches):
        for batch in batches:
            code, lang = np.asarray(batch.column(0)).view(np.uint64), np.asarray(batch.column(1))
            for w in _positions(code, bits, hashes):
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(lang // 64), pa.array((np.uint64(1) << (lang % 64).astype(np.uint64)).view(np.int64))],
                                                 names=["position", "word", "mask"])

    rows = kept.select("gram", "lang").mapInArrow(placed, "position long, word int, mask long").groupBy("position", "word").agg(F.bit_or("mask").alias("mask")).toPandas()
    masks = np.zeros((1 << bits, -(-len(names) // 64)), np.uint64)
    masks[rows["position"].to_numpy(), rows["word"].to_numpy()] = rows["mask"].to_numpy(np.int64).view(np.uint64)
    fill = np.array([float(((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(names))])
    return LanguageFilter(names, masks, np.minimum(fill**hashes, 0.999), max(range(len(names)), key=lambda i: (sizes[names[i]], -i)), bits, hashes)


def _has_letter(p, d: int) -> bool:
    raw = p.data[p.starts[d]:p.starts[d + 1]]
    return bool(_LETTER[raw].any()) or any(c.isalpha() for c in raw.tobytes().decode("utf-8", "replace"))


def _decided(f: LanguageFilter, p) -> tuple[list[str], np.ndarray]:
    """Language and score of every text of a piece."""
    letters = np.array([p.starts[d + 1] > p.starts[d] and _has_letter(p, d) for d in range(len(p))], bool)
    if not f.names:
        return [UNKNOWN] * len(p), np.zeros(len(p))
    c = f.counts(*_grams(p))
    total, best = c.sum(1), c.argmax(1)
    best[total <= 0] = f.usual
    score = np.where(letters & (total > 0), c.max(1) / np.maximum(total, 1e-12), 0.0)
    return [f.names[b] if ok else UNKNOWN for b, ok in zip(best, letters)], score


def identify(docs: DataFrame, fitted: LanguageFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every whole text: doc_id, lang_pred, score (the best language's share of all corrected counts).

    A text that is null or has no letter is "und" with score 0. A text with letters but no known n-gram gets the language with most
    labelled documents, score 0. Ties go to the first name in order. Without any learned language all are "und". Repeated rows come
    out repeated, an empty table gives no rows, other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def task(batches):
        for batch in batches:
            for p in _folded(batch.column(1)):
                names, score = _decided(shared.value, p)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(p.first, len(p)), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(task, "doc_id long, lang_pred string, score double")


def recognised(docs: DataFrame, fitted: LanguageFilter, text_col: str = "text", least_score: float = 0.0, languages: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` whose text has a language (one of ``languages``, if given) with at least ``least_score``, in one pass.

    Columns stay as they are, whatever their names; null and letterless texts go.
    """
    shared, place = docs.sparkSession.sparkContext.broadcast(fitted), docs.columns.index(text_col)

    def task(batches):
        for batch in batches:
            for p in _folded(batch.column(place)):
                names, score = _decided(shared.value, p)
                keep = [x != UNKNOWN and s >= least_score and (languages is None or x in languages) for x, s in zip(names, score)]
                yield batch.slice(p.first, len(p)).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(task, docs.schema)


def predict(docs: DataFrame, folds: int = 4, fold: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """Learn from the documents outside the held-out fold, predict all: doc_id, held_out, lang_pred, score."""
    out = held_out(id_col, folds, fold)
    fitted = build_filter(docs.where(~out), id_col, text_col, lang_col, **options)
    return identify(docs, fitted, id_col, text_col).select("doc_id", held_out("doc_id", folds, fold).alias("held_out"), "lang_pred", "score")
