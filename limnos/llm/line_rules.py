"""Quality rules, line first: lines that fail a punctuation, navigation or boilerplate rule go, then documents that lost too much text.

Rules for a line with words (words are runs of anything but ASCII white space, marks are ASCII signs other than letters and digits):

* punctuation: more than half of its words hold two marks side by side, or it has at most ``STUB`` words and does not end in a closing mark;
* navigation: at least two of its words, and more than a fifth of them, hold no letter and no digit (menu separators);
* boilerplate: it equals an earlier line of its text, or has at most ``PHRASE_WORDS`` words and holds one of ``PHRASES``.

Lines without words pass. A document is rejected if it has too few words or repeats itself too much (the base rules), or if the failed
lines held more than ``LOSS`` percent of its word characters. Every text is judged whole, each by itself: nothing is shuffled.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.arrays import pieces, table, windows, words

LEAST_WORDS = 50
REPEATED = 50  # percent of words that may lie in repeated windows
WINDOW = 3
STUB = 2
PHRASE_WORDS = 10
LOSS = 30  # percent of word characters that may be lost
SYMBOLS = "#*$%&|<>"
CLOSING = ".!?:;"
PHRASES = ("accept cookies", "all rights reserved", "back to top", "click here", "cookie policy", "enable javascript", "log in", "lorem ipsum", "privacy policy", "read more",
           "share this", "sign in", "sign up", "skip to content", "subscribe now", "terms of service", "terms of use")

_WORD = table(lambda b: not (b == 32 or 9 <= b <= 13))
_LINE = table(lambda b: b != 10)
_SAME = np.arange(256, dtype=np.uint8)
_SYMBOL = table(lambda b: chr(b) in SYMBOLS)
_SIGN = table(lambda b: b >= 128 or chr(b).isalnum())
_MARK = table(lambda b: 33 <= b <= 126 and not chr(b).isalnum())
_START = table(lambda b: b & 0xC0 != 0x80)  # first byte of a character
_CLOSED = table(lambda b: b >= 128 or chr(b) in CLOSING)
_PHRASE = re.compile("|".join(PHRASES).encode())


@dataclass
class Verdicts:
    """Counts and verdicts of a piece's texts, and spans of the lines that failed with the text each belongs to."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    n_lines: np.ndarray
    n_failed: np.ndarray
    lost_chars: np.ndarray
    base_failed: np.ndarray
    kept: np.ndarray
    failed_text: np.ndarray
    failed_begin: np.ndarray
    failed_end: np.ndarray


def _before(mask: np.ndarray) -> np.ndarray:
    """Number of true entries before each place."""
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def _again(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries equal an earlier entry of their text, and which have an equal one anywhere in it."""
    order = np.lexsort((value, text))
    same = (text[order][1:] == text[order][:-1]) & (value[order][1:] == value[order][:-1])
    later, any_ = np.zeros(len(text), bool), np.zeros(len(text), bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return later, any_


def judge(p, loss: int = LOSS) -> Verdicts:
    """Verdicts on all texts of a piece."""
    data, n = p.data, len(p)
    w, lines = words(p, _WORD, _SAME), words(p, _LINE, _SAME)
    n_words = w.counts
    chars, marks, signs = _before(_START[data]), _MARK[data], _before(_SIGN[data])
    symbols = _before(_SYMBOL[data])
    twice = _before(np.append(marks[:-1] & marks[1:], False)[:len(data)])
    word_text = np.repeat(np.arange(n), n_words)
    word_chars = np.bincount(word_text, chars[w.end] - chars[w.begin], minlength=n).astype(np.int64)
    at, hashes = windows(w, WINDOW)
    _, repeated = _again(word_text[at], hashes)
    marked = np.zeros(len(w.begin), bool)
    for k in range(WINDOW):
        marked[at[repeated] + k] = True
    n_repeat = np.bincount(word_text, marked, minlength=n).astype(np.int64)
    # lines: words first..last-1 each
    line_text = np.repeat(np.arange(n), lines.counts)
    first, last = np.searchsorted(w.begin, lines.begin), np.searchsorted(w.begin, lines.end)
    held = last > first
    line_text, begin, end, first, last, value = line_text[held], lines.begin[held], lines.end[held], first[held], last[held], lines.hashes[held]
    many = last - first
    later, _ = _again(line_text, value)
    n_dup = np.bincount(line_text, later, minlength=n).astype(np.int64)
    noisy, blank, size = _before(twice[w.end - 1] > twice[w.begin]), _before(signs[w.end] == signs[w.begin]), _before(np.zeros(len(w.begin), bool))
    size[1:] = np.cumsum(chars[w.end] - chars[w.begin])
    lone = blank[last] - blank[first]
    closed = _CLOSED[data[w.end[last - 1] - 1]]
    fails = (2 * (noisy[last] - noisy[first]) > many) | ((many <= STUB) & ~closed) | ((lone >= 2) & (5 * lone > many)) | later
    for k in np.flatnonzero((many <= PHRASE_WORDS) & ~fails):
        if _PHRASE.search(data[begin[k]:end[k]].tobytes().lower()):
            fails[k] = True
    lost = np.bincount(line_text, (size[last] - size[first]) * fails, minlength=n).astype(np.int64)
    base = (n_words < LEAST_WORDS) | (100 * n_repeat > REPEATED * n_words)
    return Verdicts(n_words, word_chars, symbols[p.starts[1:]] - symbols[p.starts[:-1]], n_dup, n_repeat, np.bincount(line_text, minlength=n),
                    np.bincount(line_text, fails, minlength=n).astype(np.int64), lost, base, ~base & (100 * lost <= loss * word_chars),
                    line_text[fails], begin[fails], end[fails])


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_failed", "lost_chars")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", loss: int = LOSS) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with words), n_failed (of those),
    lost_chars, base_failed, kept.

    A null text counts as empty, and an empty one has too few words. Rows with null ids and repeated rows come out as they are, an
    empty table gives no rows, other columns are not read. Lines are compared whole; of equal lines the first one stands.
    """
    def task(batches):
        for batch in batches:
            for p in pieces(batch.column(1)):
                v = judge(p, loss)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(p.first, len(p)), *[pa.array(getattr(v, c)) for c in COUNTS], pa.array(v.base_failed), pa.array(v.kept)],
                                                 names=["doc_id", *COUNTS, "base_failed", "kept"])

    kinds = ", ".join(["doc_id long", *[f"{c} long" for c in COUNTS], "base_failed boolean", "kept boolean"])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(task, kinds)


def clean(docs: DataFrame, text_col: str = "text", loss: int = LOSS) -> DataFrame:
    """The documents that are kept, with the columns of ``docs`` and without their failed lines (the others stand joined by line breaks).

    Null and empty texts go. Columns stay as they are, whatever their names; the text column becomes a string.
    """
    docs = docs.withColumn(text_col, F.col(text_col).cast("string"))
    place = docs.columns.index(text_col)

    def task(batches):
        for batch in batches:
            for p in pieces(batch.column(place)):
                v = judge(p, loss)
                cuts: dict[int, list[tuple[int, int]]] = {}
                for d, b, e in zip(v.failed_text.tolist(), v.failed_begin.tolist(), v.failed_end.tolist()):
                    if v.kept[d]:
                        cuts.setdefault(d, []).append((b, e))
                own = batch.slice(p.first, len(p))
                texts = own.column(place).to_pylist() if cuts else None
                for d, spans in cuts.items():
                    at, stop, out = int(p.starts[d]), int(p.starts[d + 1]), []
                    for b, e in spans:  # with the line break behind a line
                        out.append(p.data[at:b].tobytes())
                        at = min(e + 1, stop)
                    left = b"".join(out) + p.data[at:stop].tobytes()
                    texts[d] = left.removesuffix(b"\n" if spans[-1][1] == stop else b"").decode()
                if cuts:
                    own = own.set_column(place, own.schema.field(place), pa.array(texts, own.schema.field(place).type))
                yield own.filter(pa.array(v.kept))

    return docs.mapInArrow(task, docs.schema)
