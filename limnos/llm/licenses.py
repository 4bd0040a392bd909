"""License scan: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

A template is the set of its two-word shingles (one word where it has no more). For every distinct template length a text is cut into
all windows of as many words, each starting one word after the other. A window that holds ``CONTAINED`` of a template's shingles has
at least as many places with a shingle of that length's templates, which running counts tell at once, so minima are taken of few
windows of ordinary prose. ``BANDS`` bands of ``ROWS`` minima retrieve a template of similarity s with probability
1 - (1 - s**ROWS)**BANDS: 1 for a window equal to it, 0.9997 at 0.7 with 12 x 2. A retrieved window counts if it holds at least
``CONTAINED`` of the template's shingles; of a notice (``NOTICE`` words at most) it must hold every shingle with a digit, so that versions
without a template are not taken for others.
"""

from __future__ import annotations

import math
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.arrays import Sieve, lowered, mix, pieces, table, words
from limnos.llm.license_notices import NOTICES

BANDS, ROWS = 12, 2
SHINGLE = 2
CONTAINED = 0.8
NOTICE = 60  # words of the longest template whose numbers must all be there
RUN = 1 << 16  # windows that are looked at together
MOST_WORDS = 400_000  # words of all templates that a task holds

IS_WORD = table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
FOLD = lowered()

TEMPLATES = NOTICES
LONG = Path(__file__).with_name("license_texts")  # whole texts of the longer licenses, named by license


def template_rows() -> list[tuple[str, str]]:
    """(license, text) of all notices and whole texts."""
    return [(k, t) for k, each in TEMPLATES.items() for t in each] + [(f.stem, f.read_text()) for f in sorted(LONG.glob("*.txt"))]


def template_table(spark, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(license, text) rows of a template dictionary, by default of all notices and whole texts."""
    rows = template_rows() if templates is None else [(k, t) for k, each in templates.items() for t in each]
    return spark.createDataFrame(pa.table({"license": [r[0] for r in rows], "text": [r[1] for r in rows]}))


def _spread(h: np.ndarray, n: int) -> np.ndarray:
    """``n`` hash functions of the shingles, one row each."""
    r = np.random.default_rng(10)
    a, b = r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, n, dtype=np.uint64)
    return h[None, :] * a[:, None] + b[:, None]


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring columns, by doubled widths."""
    k = 1
    while 2 * k <= width:
        x = np.minimum(x[:, :-k], x[:, k:])
        k *= 2
    return np.minimum(x[:, :x.shape[1] - (width - k)], x[:, width - k:]) if width > k else x


def _holding(run: np.ndarray, width: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of ``own`` and places with one in every window of ``width`` shingles of a run, and all such places."""
    at = np.flatnonzero(np.isin(run, own))
    before = np.full(len(at), -1)
    order = np.argsort(run[at], kind="stable")
    same = run[at][order][1:] == run[at][order][:-1]
    before[order[1:][same]] = at[order[:-1][same]]  # place of the same shingle before; from there on this one adds nothing
    m = len(run) - width + 1
    lo, hi = np.maximum(before + 1, np.maximum(at - width + 1, 0)), np.minimum(at, m - 1) + 1
    inside = lo < hi
    step = np.bincount(lo[inside], minlength=m + 1) - np.bincount(hi[inside], minlength=m + 1)
    return np.cumsum(step)[:m], np.searchsorted(at, np.arange(m) + width) - np.searchsorted(at, np.arange(m)), at


class Templates:
    """Band buckets and shingle sets of all templates, by their length in words."""

    def __init__(self, rows: list[tuple[str, str]], bands: int, band_rows: int, contained: float):
        self.bands, self.rows, self.contained = bands, band_rows, contained
        self.names, self.sets, self.numbers, by_length = [], [], [], {}
        texts = pa.array([t for _, t in rows], pa.string())
        for p in pieces(texts):
            w = words(p, IS_WORD, FOLD)
            for d in range(len(p)):
                n = int(w.counts[d])
                if n:
                    at = slice(int(w.bounds[d]), int(w.bounds[d + 1]))
                    digit = np.array([any(0x30 <= c <= 0x39 for c in p.data[x:y]) for x, y in zip(w.begin[at], w.end[at], strict=True)])
                    by_length.setdefault(n, []).append((rows[p.first + d][0], w.hashes[at], digit))
        self.lengths = {}
        for n, each in sorted(by_length.items()):
            keys, owners = [], []
            for name, h, digit in each:
                s = self._shingles(h)
                self.names.append(name)
                self.numbers.append(np.unique(s[digit[:-1] | digit[1:] if n >= SHINGLE else digit]) if n <= NOTICE else s[:0])
                self.sets.append(np.unique(s))
                k = self._keys(_spread(s, bands * band_rows).min(1)[:, None])
                keys.append(k[:, 0])
                owners.append(np.full(bands, len(self.names) - 1))
            keys, owners = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(keys, kind="stable")
            sets = self.sets[-len(each):]
            need = min(math.ceil(contained * len(x) - 1e-9) for x in sets)
            self.lengths[n] = (Sieve(keys, 16), keys[order], owners[order], Sieve(np.concatenate(sets), 16), max(1, need))

    @staticmethod
    def _shingles(h: np.ndarray) -> np.ndarray:
        return mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) if len(h) >= SHINGLE else h

    def _keys(self, least: np.ndarray) -> np.ndarray:
        """Bucket of every band and column of minima."""
        out = np.zeros((self.bands, least.shape[1]), np.uint64)
        for r in range(self.rows):
            out = mix(out + least[r::self.rows] + np.arange(1, self.bands + 1, dtype=np.uint64)[:, None])
        return out

    def hits(self, w) -> list[tuple[int, int, int, int, float, int]]:
        """(template, first word, words, shingles of the template, their share, places with one) of every window of a piece that holds a template.

        First word and words go from the first to the last shingle of the template in the window.
        """
        out = []
        if len(w.hashes) == 0:
            return out
        pair = self._shingles(w.hashes) if len(w.hashes) > 1 else np.zeros(0, np.uint64)
        text = np.repeat(np.arange(len(w.bounds) - 1), w.counts)
        for n, (sieve, keys, owners, shingle_sieve, need) in self.lengths.items():
            base, width = (pair, n - SHINGLE + 1) if n >= SHINGLE else (w.hashes, n)
            m = len(w.hashes) - n + 1
            if m <= 0:
                continue
            marks = np.zeros(len(base) + 1, np.int64)
            marks[shingle_sieve.find(base)[0] + 1] = 1
            marks = np.cumsum(marks)
            start = np.flatnonzero(marks[width:width + m] - marks[:m] >= need)
            start = start[text[start] == text[start + n - 1]]
            cuts = np.flatnonzero((np.diff(start) > width) | (np.diff(start // RUN) > 0)) + 1
            for s in np.split(start, cuts) if len(start) else []:
                run, i = base[s[0]:s[-1] + width], s - s[0]
                k = self._keys(_least(_spread(run, self.bands * self.rows), width)[:, i])
                found: dict[int, set] = {}
                for x in sieve.find(k.ravel())[0]:
                    key = k.flat[x]
                    for t in owners[np.searchsorted(keys, key, "left"):np.searchsorted(keys, key, "right")]:
                        found.setdefault(int(t), set()).add(int(x) % len(s))
                for t, these in found.items():
                    held, places, at = _holding(run, width, self.sets[t])
                    for j in i[sorted(these)]:
                        share = float(held[j] / len(self.sets[t]))
                        if share >= self.contained and np.isin(self.numbers[t], run[j:j + width]).all():
                            first, last = at[np.searchsorted(at, j)], at[np.searchsorted(at, j + width) - 1]
                            out.append((t, int(s[0] + first), int(last - first) + min(n, SHINGLE), int(held[j]), share, int(places[j])))
        return out


def _clearest(matches: list[dict]) -> list[dict]:
    """Matches from the best to the least that overlap no better one of another license or of the same template (related licenses share most of their words)."""
    kept: list[dict] = []
    for m in matches:
        if not any((o["license"] != m["license"] or o["template"] == m["template"]) and o["first"] < m["first"] + m["words"] and m["first"] < o["first"] + o["words"] for o in kept):
            kept.append(m)
    return kept


def scan(docs: DataFrame, templates: DataFrame, bands: int = BANDS, rows: int = ROWS, contained: float = CONTAINED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licenses that every whole text names.

    Returns one row per input row: doc_id, licenses (sorted names), matches (array of license, first word, words, from_byte, to_byte and
    share, every occurrence of each template, in order of place). Of overlapping matches of different licenses, or of one template, the one
    with most shingles of its template counts, then the one with the larger share. A null text or one without words names none; a template that is null or
    has no words is skipped, as is one with a null name; repeated rows come out repeated; empty tables give no rows or no matches; other
    columns are not read. The templates' size is checked: beyond ``MOST_WORDS`` words an error asks to scan in parts.
    """
    held = templates.select(F.col("license").cast("string").alias("license"), F.col("text").cast("string").alias("text")).where("license is not null and text is not null")
    size = held.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    if size > MOST_WORDS:
        raise ValueError("too many template words for one scan; scan parts of the templates and join the results")
    shared = docs.sparkSession.sparkContext.broadcast([(r["license"], r["text"]) for r in held.distinct().collect()])
    ready = []
    kind = pa.list_(pa.struct([("license", pa.string()), ("first", pa.int32()), ("words", pa.int32()), ("from_byte", pa.int32()), ("to_byte", pa.int32()), ("share", pa.float64())]))

    def task(batches):
        if not ready:
            ready.append(Templates(shared.value, bands, rows, contained))
        known = ready[0]
        for batch in batches:
            for p in pieces(batch.column(1)):
                w = words(p, IS_WORD, FOLD)
                each: list[list] = [[] for _ in range(len(p))]
                for t, first, n, _, share, _ in sorted(known.hits(w), key=lambda h: (-h[3], -h[4], -h[5], h[1], known.names[h[0]], h[0])):
                    d = int(np.searchsorted(w.bounds, first, "right")) - 1
                    each[d].append({"template": t, "license": known.names[t], "first": first - int(w.bounds[d]), "words": n, "from_byte": int(w.begin[first] - p.starts[d]),
                                    "to_byte": int(w.end[first + n - 1] - p.starts[d]), "share": share})
                found = [[{k: v for k, v in m.items() if k != "template"} for m in sorted(_clearest(x), key=lambda m: (m["first"], m["license"], m["words"]))] for x in each]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(p.first, len(p)), pa.array([sorted({m["license"] for m in f}) for f in found], pa.list_(pa.string())),
                                                  pa.array(found, kind)], names=["doc_id", "licenses", "matches"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(task, "doc_id long, licenses array<string>, matches array<struct<license:string,first:int,words:int,from_byte:int,to_byte:int,share:double>>")


def report(docs: DataFrame, templates: DataFrame | None = None, **options) -> DataFrame:
    """``scan`` as one flat row per document: doc_id, n_licenses, licenses (comma-joined), n_matches, best_share."""
    s = scan(docs, template_table(docs.sparkSession) if templates is None else templates, **options)
    return s.select("doc_id", F.size("licenses").alias("n_licenses"), F.concat_ws(",", "licenses").alias("licenses"), F.size("matches").alias("n_matches"),
                    F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0)).alias("best_share"))
