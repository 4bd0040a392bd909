"""Near-duplicate documents: minima of universal hashes, bands, signature check, exact sets, components by alternating stars.

A document is the set of its distinct five-word shingles. Equal sets form a class at once; only one representative of a class goes
on. ``bands`` x ``rows`` multiply-shift hashes give a signature; two sets of similarity s share a band bucket with probability
1 - (1 - s**rows)**bands, which is 0.9999 at 0.75 and 0.014 at 0.3 with the default 64 x 7.

Within a bucket no list of all pairs is made. A bucket of few members compares those that are not connected yet; a larger one
compares every member with one pivot, which the hash order makes the same in all buckets, so a large family of copies becomes one
component in a round or two and drops out. Buckets that stay open (documents that share one passage) are compared block by block
inside tasks, which return links only; blocks of one component never meet. No bucket is ever cut short.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limnos.llm.arrays import lowered, mix, pieces, shingles, table, words
from limnos.llm.spread import components, join_split, landed, small

WORDS_A_SHINGLE = 5
BANDS, ROWS = 64, 7
SIMILAR = 75  # percent
SLACK = 0.12  # a pair goes to the exact check unless its signature lies this far (over five standard deviations) below the limit
FEW = 8  # members up to which a bucket lists the pairs that are not connected
PIVOTS = 2  # rounds in which the members of larger buckets meet one pivot
BLOCK = 128  # members a block of a bucket that stays open after that

SPACES = {9, 10, 11, 12, 13, 32}
IS_WORD = table(lambda b: b not in SPACES)
FOLD = lowered()


def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(75)
    return r.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, n, dtype=np.uint64)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _fixed(rows: np.ndarray, kind=None) -> pa.Array:
    """Rows of a matrix as binary values."""
    n, width = len(rows), rows[0].nbytes if len(rows) else 0
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def sign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, k: int = WORDS_A_SHINGLE) -> DataFrame:
    """One row per document: set size, a 128-bit name of the set, an 8-bit-a-hash signature and the band buckets."""
    n_hash = bands * rows

    def task(batches):
        a, b = _hash_family(n_hash)
        seeds = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for p in pieces(texts):
                h, at = shingles(words(p, IS_WORD, FOLD), k)
                n = len(p)
                size, name_a, name_b = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                for d in range(n):
                    if at[d + 1] > at[d]:
                        s = np.sort(h[at[d]:at[d + 1]])
                        if len(s) > 1:
                            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
                        size[d], name_a[d], name_b[d] = len(s), s.sum(), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum()
                full = np.flatnonzero(size)
                least = np.zeros((n, n_hash), np.uint64)
                if len(full):
                    start, t = at[:-1][full], np.empty_like(h)
                    for j in range(n_hash):
                        np.multiply(h, a[j], out=t)
                        np.add(t, b[j], out=t)
                        least[full, j] = np.minimum.reduceat(t, start)
                band = np.zeros((n, bands), np.uint64)
                for r in range(rows):
                    band = mix(band + least[:, r::rows] + seeds)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(p.first, n), pa.array(size), _long(name_a), _long(name_b), _fixed((least >> np.uint64(56)).astype(np.uint8)),
                     pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), _long(band.ravel()))],
                    names=["doc_id", "n_shingles", "name_a", "name_b", "signature", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        task, "doc_id long, n_shingles long, name_a long, name_b long, signature binary, bands array<long>")


def shingle_sets(docs: DataFrame, k: int = WORDS_A_SHINGLE) -> DataFrame:
    """Sorted distinct shingle hashes of every document as one binary value."""
    def task(batches):
        for batch in batches:
            for p in pieces(batch.column(1)):
                h, at = shingles(words(p, IS_WORD, FOLD), k)
                sets = [np.unique(h[at[d]:at[d + 1]]).tobytes() for d in range(len(p))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(p.first, len(p)), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(task, "doc_id long, shingles binary")


def _agreement():
    @F.pandas_udf("double")
    def share(x, y):
        import pandas as pd
        return pd.Series([float(np.mean(np.frombuffer(p, np.uint8) == np.frombuffer(q, np.uint8))) for p, q in zip(x, y)])
    return share


def similar_pairs(pairs: DataFrame, signatures: DataFrame, sets: DataFrame, percent: int = SIMILAR, slack: float = SLACK) -> DataFrame:
    """The pairs (a, b) whose full sets have at least ``percent`` of their union in common."""
    s = signatures.select("doc_id", "n_shingles", "signature")
    one = s.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("signature").alias("s_a"))
    two = s.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("signature").alias("s_b"))
    likely = (join_split(join_split(pairs, one, "a"), two, "b")
              .where((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")))
              .where(_agreement()("s_a", "s_b") >= percent / 100 - slack).select("a", "b").distinct())
    both = join_split(join_split(likely, sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a"),
                      sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")

    def task(batches):
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) and len(q):
                    if len(p) > len(q):
                        p, q = q, p
                    common = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
                    keep[i] = 100 * common >= percent * (len(p) + len(q) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return both.mapInArrow(task, "a long, b long").distinct()


def _open_buckets(members: DataFrame, labels: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Members with their component, and the buckets that still hold two components: size and pivot."""
    if labels.isEmpty():  # the first round, unless an id has several texts
        m = members.withColumn("c", F.col("node"))
    else:
        m = landed(join_split(members, labels, "node", "left").select("bucket", "node", "size", F.coalesce("component", "node").alias("c")), "placed")
    key = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("pivot"), F.col("c").alias("pivot_c"), F.col("size").alias("pivot_size"))
    b = m.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("_lo"), F.max("c").alias("_hi"), F.min(key).alias("p")).where("_lo < _hi")
    return m, b.select("bucket", "n", "p.pivot", "p.pivot_c", "p.pivot_size")


def _labels(signatures: DataFrame, docs: DataFrame, percent: int, few: int, ties: DataFrame) -> DataFrame:
    """Component of every representative that is tied or linked to another one; ``ties`` are links known beforehand."""
    placed = signatures.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("size"), F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi")).where("_lo < _hi").select("bucket")
    members = landed(join_split(placed, shared, "bucket").select("bucket", "node", "size").distinct(), "members")
    nodes = members.select(F.col("node").alias("doc_id")).distinct()
    n_nodes = nodes.count()
    sets = landed(shingle_sets(docs.select("doc_id", "text").join(small(nodes, n_nodes), "doc_id", "left_semi")), "sets")
    known = landed(signatures.join(small(nodes, n_nodes), "doc_id", "left_semi"), "known")
    labels = landed(components(ties, "a", "b"), "labels")

    def alike(p, q):  # sets whose sizes differ more can't be similar enough
        return 100 * F.least(p, q) >= percent * F.greatest(p, q)

    def tie(found: DataFrame) -> DataFrame:
        if found.isEmpty():
            return labels
        held = labels.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        return landed(components(found.unionByName(held), "a", "b"), "labels")

    for turn in range(PIVOTS):
        m, b = _open_buckets(members, labels, turn)
        m = landed(join_split(m, b, "bucket"), "open")
        if m.isEmpty():
            return labels
        tight = m.where(F.col("n") <= few)
        other = tight.select("bucket", F.col("node").alias("node2"), F.col("c").alias("c2"), F.col("size").alias("size2"))
        cross = tight.join(other, "bucket").where("node < node2 and c <> c2").where(alike("size", "size2")).select(F.col("node").alias("a"), F.col("node2").alias("b"))
        wide = m.where(F.col("n") > few)
        star = wide.where("c <> pivot_c").where(alike("size", "pivot_size")).select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
        pairs = landed(cross.unionByName(star).distinct(), "pairs")
        labels = tie(landed(similar_pairs(pairs, known, sets, percent), "links"))
        members = wide.where("node <> pivot").select("bucket", "node", "size")
    m, b = _open_buckets(members, labels, PIVOTS)
    m = landed(join_split(m, b.select("bucket"), "bucket"), "open")
    return labels if m.isEmpty() else tie(landed(_block_links(m, known, sets, percent), "links"))


def _block_links(members: DataFrame, known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components inside wide buckets (bucket, node, c), found block by block on the full sets.

    A component of more than ``BLOCK`` members of a bucket gets blocks of its own, smaller ones share blocks. Two blocks of one
    component never meet. A task holds two blocks and returns at most one link for each of their members. A pair is compared in the
    first band that it shares only.
    """
    per = landed(members.groupBy("bucket", "c").agg(F.count(F.lit(1)).alias("n_c")), "parts")
    shared = per.where(F.col("n_c") <= BLOCK).groupBy("bucket").agg(F.sum("n_c").alias("n_shared"))
    sized = join_split(members, per, ["bucket", "c"]).join(shared, "bucket", "left")
    big = F.col("n_c") > BLOCK
    slot = F.when(big, F.xxhash64("c", F.pmod(F.xxhash64("node"), F.ceil(F.col("n_c") / BLOCK)))).otherwise(F.pmod(F.xxhash64("c"), F.ceil(F.col("n_shared") / BLOCK)))
    dealt = landed(sized.select("bucket", "node", "c", slot.alias("block"), F.when(big, F.col("c")).alias("pure")), "dealt")
    blocks = landed(dealt.select("bucket", "block", "pure").distinct(), "blocks")
    right = blocks.select("bucket", F.col("block").alias("block2"), F.col("pure").alias("pure2"))
    met = blocks.join(right, "bucket").where("block < block2 and not (pure <=> pure2 and pure is not null) or block = block2 and pure is null")
    met = landed(met.select("bucket", "block", "block2"), "met")
    sides = met.select("bucket", F.col("block").alias("own"), "block", "block2").unionByName(
        met.where("block <> block2").select("bucket", F.col("block2").alias("own"), "block", "block2"))
    # an id with several texts brings each text's bands beside each set; the set's name tells which belong together
    data = known.select(F.col("doc_id").alias("node"), "name_a", "bands").join(sets.withColumnRenamed("doc_id", "node"), "node")
    rows = dealt.withColumnRenamed("block", "own").join(sides, ["bucket", "own"]).select("bucket", "block", "block2", "own", "node", "c")
    rows = join_split(rows, data, "node")

    def compare(group):
        import pandas as pd
        bucket = group["bucket"].iat[0]
        named = [np.frombuffer(x, np.uint64).sum().view(np.int64) == name and (b == bucket).any() for x, name, b in zip(group["shingles"], group["name_a"], group["bands"])]
        g = group[named].drop_duplicates(["node", "name_a"])
        if len(g) < 2:
            return pd.DataFrame([], columns=["a", "b"], dtype="int64")
        node, c, own = g["node"].to_numpy(), g["c"].to_numpy(), g["own"].to_numpy()
        bands = np.stack(g["bands"].to_list())
        here = (bands == bucket).argmax(1)
        each = [np.frombuffer(x, np.uint64) for x in g["shingles"]]
        size = np.array([len(x) for x in each])
        _, at = np.unique(np.concatenate(each), return_inverse=True)
        who = np.repeat(np.arange(len(each)), size)
        order = np.argsort(at, kind="stable")
        at, who = at[order], who[order]
        common = np.zeros((len(each), len(each)), np.float32)
        for lo in range(0, int(at[-1]) + 1, 4096):  # the shingles by parts, so the incidence matrix stays small
            part = slice(*np.searchsorted(at, (lo, lo + 4096)))
            m = np.zeros((len(each), 4096), np.float32)
            m[who[part], at[part] - lo] = 1
            common += m @ m.T
        linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
        linked &= c[:, None] != c[None, :]
        if g["block"].iat[0] != g["block2"].iat[0]:
            linked &= own[:, None] != own[None, :]
        root, out = {x: x for x in c.tolist()}, []

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for i, j in np.argwhere(np.triu(linked, 1)):
            if (bands[i] == bands[j]).argmax() == min(here[i], here[j]) and find(int(c[i])) != find(int(c[j])):
                root[find(int(c[i]))] = find(int(c[j]))
                out.append((int(node[i]), int(node[j])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.groupBy("bucket", "block", "block2").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = SIMILAR, bands: int = BANDS, rows: int = ROWS,
                    few: int = FEW) -> DataFrame:
    """Component of every document under links of at least ``percent`` shingle similarity.

    Returns one row per input row: doc_id, n_shingles, component_id (smallest id reachable), kept (id is its component's smallest).
    Texts that are null or hold no word have no shingles and link with nothing. A row with a null id links with nothing, has a null
    component and is kept. Repeated rows come out repeated; an id with several texts links through each of them. An empty table
    gives an empty result. Other columns, whatever their names, are not read.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = landed(sign(d, bands=bands, rows=rows), "signed")
    names = ["name_a", "name_b", "n_shingles"]
    real = signed.where("doc_id is not null and n_shingles > 0")
    classes = real.groupBy(*names).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    classes = landed(classes.where("copies > 1"), "classes").drop("copies")
    # ids, names and sizes only: the wide columns stay out of the shuffle unless a row is a representative
    member = landed(join_split(signed.select("doc_id", *names), classes, names, "left").select(
        "doc_id", *names, F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id")).otherwise(F.col("doc_id")).alias("rep")), "member")
    later = landed(member.where("doc_id > rep").select("doc_id", *names).distinct(), "later")
    firsts = real.join(small(later, later.count()), ["doc_id", *names], "left_anti")
    several = member.groupBy("doc_id").agg(F.min("rep").alias("_lo"), F.max("rep").alias("_hi")).where("_lo < _hi").select("doc_id")
    ties = member.join(several, "doc_id").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    labels = _labels(firsts, d, percent, few, landed(ties, "ties"))
    out = join_split(member, labels.where("node <> component").withColumnRenamed("node", "rep"), "rep", "left").withColumn(
        "component_id", F.coalesce("component", "rep"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns: one document of each group.

    Only the ids that go meet the texts. Of repeated rows of one id and text one stays; rows with null ids stay.
    """
    found = landed(near_duplicates(docs, id_col, text_col, **options), "found")
    gone = landed(found.where("not kept").select(F.col("doc_id").alias("_id")).distinct(), "gone")
    with_id = docs.withColumn("_id", F.col(id_col).cast("long"))
    left = with_id.join(small(gone, gone.count()), "_id", "left_anti")
    again = landed(found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_id")), "again")
    n = again.count()
    if n:
        repeated = left.join(small(again, n), "_id", "left_semi").dropDuplicates(["_id", text_col])
        left = left.join(small(again, n), "_id", "left_anti").unionByName(repeated)
    return left.select(*docs.columns)
