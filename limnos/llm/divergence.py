"""Source divergence audit: how far each source's words stray from the other sources and from the whole of its language.

Counts of (lang, source, term) come from Arrow tasks that add up a stretch of text before Spark does. Probabilities are whole billionths,
p = 1 + floor(1e9 (count + 1) / (N + V)), and the divergence of p from q is floor((p - q)**2 / q); everything is integer arithmetic.

The terms of a group (lang, source) that stray most from the language are found as a dominance skyband. A term with a higher count in
the group, a lower one in the language and an earlier name has no smaller divergence and stands before in a tie, so a term that ``k``
others dominate is not among the first k. Partitions keep the terms that fewer than ``k`` of their own dominate, bands are merged
``FAN`` at a time until a group has one, and only that is ranked by divergence. The bands are exact: nothing is cut but dominated terms.

Pairs of sources are compared in blocks of ``SOURCES`` sources and some ``TERMS`` terms, dense inside a task, which returns one sum for a
pair. A group's anchor row stands in every block of terms, so sources that lack a block's terms take part with their count of 0.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limnos.llm.arrays import lowered, pieces, table
from limnos.llm.spread import join_split, landed

LEAST_DOCS = 3
TOP = 200
SCALE = 1_000_000_000
STRETCH = 1 << 22  # bytes of text that a task counts at once
MERGE = 600_000  # counted rows that a task adds up before it hands them on
TERMS = 20_000  # terms of a language that a block of pairs holds, as expected from a hash
SOURCES = 48  # sources on each side of such a block
BAND_ROWS = 50_000  # terms of a group in a first partition
FAN = 8
CHUNK = 512

_FOLD = lowered()
_TERM = table(lambda b: 97 <= b <= 122 or b >= 128)


def _counted(batches):
    """(lang, source, term, n, docs) of a task's text, added up over some stretches at a time."""
    held, rows = [], 0

    def merged():
        t = pa.Table.from_batches(held).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
        return t.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"]).to_batches(max_chunksize=100_000)

    for part in _stretches(batches):
        held.append(part)
        rows += part.num_rows
        if rows > MERGE:
            yield from merged()
            held, rows = [], 0
    if held:
        yield from merged()


def _stretches(batches):
    """Counts of every stretch of text; each row is a document."""
    for batch in batches:
        lang, source = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
        group = np.asarray(lang.indices).astype(np.int64) * len(source.dictionary) + np.asarray(source.indices)
        for p in pieces(batch.column(2), STRETCH):
            data = _FOLD[p.data]
            inside = _TERM[data]
            edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
            begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            if len(begin) == 0:
                continue
            # a run that crosses into the next text is two terms
            cuts = p.starts[1:-1]
            cuts = cuts[(cuts > 0) & (cuts < len(data))]
            cuts = np.unique(cuts[inside[cuts - 1] & inside[cuts]]) if len(cuts) else cuts
            begin, end = np.sort(np.concatenate((begin, cuts))), np.sort(np.concatenate((end, cuts)))
            places = np.zeros(len(begin) + 1, np.int32)
            np.cumsum(end - begin, out=places[1:])
            named = pa.StringArray.from_buffers(len(begin), pa.py_buffer(places), pa.py_buffer(data[inside])).dictionary_encode()
            terms = len(named.dictionary)
            text = np.searchsorted(p.starts, begin, "right") - 1
            each, n = np.unique(text * terms + np.asarray(named.indices), return_counts=True)  # a document's terms
            keys = group[p.first + each // terms] * terms + each % terms
            keys, back, docs = np.unique(keys, return_inverse=True, return_counts=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, back, n)
            at, which = pa.array(keys // terms), pa.array(keys % terms)
            width = len(source.dictionary)
            yield pa.RecordBatch.from_arrays([lang.dictionary.take(pc.divide(at, width)), source.dictionary.take(pa.array(keys // terms % width)), named.dictionary.take(which),
                                              pa.array(total), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])


def _share(count: str, total: str, terms: str):
    """1 + floor(SCALE * (count + 1) / (total + terms)) in longs, by long division in thousands; right for counts up to 9e15."""
    first = f"((1000 * ({count} + 1)) div ({total} + {terms}))"
    left = f"((1000 * ({count} + 1)) % ({total} + {terms}))"
    second, left2 = f"((1000 * {left}) div ({total} + {terms}))", f"((1000 * {left}) % ({total} + {terms}))"
    return F.expr(f"1 + {first} * 1000000 + {second} * 1000 + ((1000 * {left2}) div ({total} + {terms}))")


def counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS):
    """Tables of kept terms (lang, source, term, n, all: the term's count in the language), of groups (lang, source, total, own_terms) and
    of languages (lang, lang_total, terms). Groups without terms are there with 0; null values count as ''."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    d = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    raw = d.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    each = raw.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")  # at most one row a source
    kept = landed(each.withColumn("all", F.sum("n").over(whole)).withColumn("docs", F.sum("docs").over(whole)).where(F.col("docs") >= least_docs).drop("docs"), "kept")
    seen = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own_terms"))
    groups = landed(d.select("lang", "source").distinct().join(seen, ["lang", "source"], "left").fillna(0, ["total", "own_terms"]), "groups")
    names = kept.groupBy("lang", "term").agg(F.first("all").alias("all")).groupBy("lang").agg(F.sum("all").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    langs = groups.select("lang").distinct().join(names, "lang", "left").fillna(0, ["lang_total", "terms"])
    return kept, groups, landed(langs, "langs")


def band(n: np.ndarray, whole: np.ndarray, name: np.ndarray, k: int) -> np.ndarray:
    """Places of the terms that fewer than ``k`` others dominate: count at least as high, whole at most as high, name rank lower."""
    order = np.lexsort((name, whole, -n))
    # of equal counts the first k names suffice, which leaves little to compare
    n, whole, name = n[order], whole[order], name[order]
    new = np.flatnonzero(np.concatenate(([True], (n[1:] != n[:-1]) | (whole[1:] != whole[:-1]))))
    place = np.arange(len(n)) - np.repeat(new, np.diff(np.append(new, len(n))))
    few = place < k
    order, whole, name = order[few], whole[few], name[few]
    held = np.zeros(0, np.int64)
    for at in range(0, len(order), CHUNK):
        # counts fall along the order, so what comes before has no lower count; members of the band are enough to count dominators
        c = np.arange(at, min(at + CHUNK, len(order)))
        before = (whole[held][None, :] <= whole[c][:, None]) & (name[held][None, :] < name[c][:, None])
        beside = (whole[c][None, :] <= whole[c][:, None]) & (name[c][None, :] < name[c][:, None]) & (c[None, :] < c[:, None])
        held = np.concatenate((held, c[before.sum(1) + beside.sum(1) < k]))
    return order[held]


def _band(k: int):
    def task(block: pa.Table) -> pa.Table:
        t = block.combine_chunks()
        name = np.empty(t.num_rows, np.int64)
        name[np.asarray(pc.sort_indices(t, sort_keys=[("term", "ascending")]))] = np.arange(t.num_rows)  # byte order
        pick = band(np.asarray(t.column("n")), np.asarray(t.column("all")), name, k)
        return t.take(pa.array(np.sort(pick)))
    return task


def skyband(kept: DataFrame, groups: DataFrame, k: int = TOP) -> DataFrame:
    """The rows of ``kept`` (lang, source, term, n, all) that fewer than ``k`` of their group dominate. One partition of a group holds
    some ``BAND_ROWS`` terms at first, then ``FAN`` bands."""
    kinds = "lang string, source string, term string, n long, all long, part long"
    largest = groups.agg(F.max("own_terms")).first()[0] or 0
    parts = max(1, -(-largest // BAND_ROWS))
    dealt = join_split(kept, groups.select("lang", "source", F.greatest(F.lit(1), F.ceil(F.col("own_terms") / BAND_ROWS)).alias("_parts")), ["lang", "source"])
    now = dealt.select("lang", "source", "term", "n", "all", F.pmod(F.xxhash64("term"), F.col("_parts")).alias("part"))
    while True:
        now = landed(now.groupBy("lang", "source", "part").applyInArrow(_band(k), kinds), "band")
        if parts == 1:
            return now.drop("part")
        parts = -(-parts // FAN)
        now = now.withColumn("part", F.floor(F.col("part") / FAN))


def _pair_sums(block: pa.Table) -> pa.Table:
    """Sums of the divergence over a block's terms for ordered pairs with one source from either side, and how many terms there were."""
    t = block.combine_chunks()
    lang, side1, side2 = t.column("lang")[0].as_py(), t.column("side1")[0].as_py(), t.column("side2")[0].as_py()
    source, term = t.column("source").combine_chunks().dictionary_encode(), t.column("term").combine_chunks().dictionary_encode()
    code = np.asarray(source.indices)
    real = np.asarray(term.indices.is_valid())
    side = np.asarray(t.column("side"))
    share = np.asarray(t.column("share"))
    names, m = source.dictionary.to_pylist(), len(term.dictionary)
    base, of = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    base[code[~real]], of[code[~real]] = share[~real], side[~real]
    grid = np.repeat(base[:, None], m, axis=1)
    grid[code[real], np.asarray(term.indices.fill_null(0))[real]] = share[real]
    out = []
    for a in range(len(names)):
        for b in range(len(names)):
            if a != b and {int(of[a]), int(of[b])} == {side1, side2}:
                gap = grid[a] - grid[b]
                out.append((lang, names[a], names[b], int((gap * gap // grid[b]).sum()), m, int((base[a] - base[b]) ** 2 // base[b])))
    columns = list(zip(*out)) if out else [[]] * 6
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                                names=["lang", "source", "item", "value", "seen", "rest"])


def pairs(kept: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, source, item, value): divergence of each source from each other one of its language, over all kept terms."""
    sized = groups.join(langs, "lang").join(groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")), "lang")
    sized = sized.withColumn("sides", F.ceil(F.col("sources") / SOURCES)).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("terms") / TERMS)))
    # without any kept term all counts are 0 of 0: the share is 1 and the divergence 0
    zero = F.when(F.col("terms") == 0, F.lit(1).cast("long")).otherwise(_share("0L", "total", "terms"))
    sized = landed(sized.select("lang", "source", "total", "terms", "sides", "blocks", F.pmod(F.xxhash64("source"), F.col("sides")).alias("side"), zero.alias("zero")), "sized")
    own = join_split(kept.select("lang", "source", "term", "n"), sized.select("lang", "source", "total", "terms", "sides", "blocks", "side"), ["lang", "source"])
    own = own.select("lang", "source", "term", _share("n", "total", "terms").alias("share"), "side", "sides", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"))
    anchors = sized.select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("zero").alias("share"), "side", "sides",
                           F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))
    sides = F.expr("transform(sequence(0L, sides - 1), o -> struct(least(side, o) AS side1, greatest(side, o) AS side2))")
    rows = own.unionByName(anchors).withColumn("_p", F.explode(sides)).select("lang", "source", "term", "share", "side", "block", "_p.side1", "_p.side2")
    sums = rows.groupBy("lang", "block", "side1", "side2").applyInArrow(_pair_sums, "lang string, source string, item string, value long, seen long, rest long")
    added = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.first("rest").alias("rest"))
    return added.join(langs.select("lang", "terms"), "lang").select("lang", "source", "item", (F.col("value") + (F.col("terms") - F.col("seen")) * F.col("rest")).alias("value"))


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """Ranked divergences: lang, source, part (``pair`` or ``term``), item, value, rank from 1, by value and then by the item's bytes.

    ``pair``: every other source of the language. ``term``: the ``top`` kept terms that the source uses more than its language does; a
    kept term stands in at least ``least_docs`` documents of the language. Null and empty lang, source or text count as ''. Repeated
    rows are documents of their own; an empty table gives no rows; other columns are not read. A group without terms has pairs
    only, with a value of 0 where its language has no kept terms.
    """
    kept, groups, langs = counts(docs, lang_col, source_col, text_col, least_docs)
    two = landed(pairs(kept, groups, langs), "pairs").withColumn("part", F.lit("pair"))
    sizes = groups.join(langs, "lang")
    terms = join_split(skyband(kept, groups, top), sizes, ["lang", "source"])
    terms = terms.withColumn("p", _share("n", "total", "terms")).withColumn("q", _share("all", "lang_total", "terms")).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = two.select("lang", "source", "part", "item", "value").unionByName(terms).withColumn("rank", place)
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))
