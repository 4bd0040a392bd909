"""Balanced label propagation: linked documents move towards the shard where most of their neighbours are, under capacity quotas.

Documents with equal link keys are neighbours of each other. They differ in nothing that matters here, so the propagation runs on how
many documents of a group each shard holds, at most one row for each group and shard, and never on pairs. In a round every group picks
a target among its own shards and the emptiest one, preferably one with room for all of it; its smaller parts ask to move to the
target; quotas admit as many as the target has room for, and swaps between two shards beyond that. A part only moves to a larger part
(or all parts together to a shard with room), so cut edges fall in every round and the loop ends when nobody moves. Documents without links fill the
shards up to counts that differ by at most one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from limnos.llm.spread import file_place, gapless, join_split, landed, running

SHARDS = 16
ROWS_A_TASK = 50_000
ROWS_A_RUN = 8_192  # consecutive rows of a file that one task numbers when shards keep an order


def _room(state: DataFrame, n_docs: int, shards: int) -> DataFrame:
    """Rows that each shard may hold by law, and how many more linked documents fit."""
    all_shards = state.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    quota = (F.lit(n_docs // shards) + (F.col("shard") < n_docs % shards).cast("long")).alias("quota")
    held = state.groupBy("shard").agg(F.sum("n").alias("held"))
    return all_shards.select("shard", quota).join(held, "shard", "left").select("shard", "quota", (F.col("quota") - F.coalesce("held", F.lit(0))).alias("room"))


def _round(state: DataFrame, n_docs: int, shards: int) -> DataFrame:
    """Admitted moves of one round: group, from shard, to shard, how many."""
    free = landed(_room(state, n_docs, shards), "room")
    room = F.broadcast(free)  # one row a shard
    per_group = Window.partitionBy("group")
    here = state.join(room.select("shard", "room"), "shard").withColumn("size", F.sum("n").over(per_group))
    most = F.broadcast(free.orderBy(F.desc("room"), "shard").limit(1).select(F.col("shard").alias("new"), F.col("room").alias("new_room")))
    # a target with room for the rest of the group first, then any with room, then the largest part
    tie = F.pmod(F.xxhash64("group", "shard"), F.lit(1 << 20))
    own = F.max(F.struct((F.col("room") >= F.col("size") - F.col("n")).alias("fits"), (F.col("room") > 0).alias("open"), "n", tie.alias("tie"), F.col("shard").alias("to"))).over(per_group)
    aimed = here.withColumn("own", own).withColumn("parts", F.count("shard").over(per_group)).where("parts > 1").crossJoin(most)
    whole = ~F.col("own.fits") & (F.col("new_room") >= F.col("size"))
    smaller = F.struct("n", tie.alias("tie")) < F.struct(F.col("own.n").alias("n"), F.col("own.tie").alias("tie"))
    aimed = aimed.withColumn("whole", whole).withColumn("to", F.when(F.col("whole"), F.col("new")).otherwise(F.col("own.to")))
    movers = landed(aimed.where(F.col("shard") != F.col("to")).where(F.col("whole") | smaller).select("group", "shard", "to", "n", "whole"), "movers")
    # groups that move together to the emptiest shard take its room first
    asks = movers.where("whole").groupBy("group", "to").agg(F.sum("n").alias("asked"))
    fitting = running(asks, "to", "asked", ["group"], "before").join(room.select(F.col("shard").alias("to"), "room"), "to").where("before + asked <= room")
    together = landed(movers.join(fitting.select("group", "asked"), "group").where("whole"), "together")
    used = together.groupBy("to").agg(F.sum("n").alias("used"))
    # two shards may swap what both send each other; what one sends beyond that needs room. One row for each pair of shards
    sent = movers.where("not whole").groupBy("shard", "to").agg(F.sum("n").alias("sent"))
    back = sent.select(F.col("to").alias("shard"), F.col("shard").alias("to"), F.col("sent").alias("back"))
    pair = sent.join(back, ["shard", "to"], "left").withColumn("swap", F.least("sent", F.coalesce("back", F.lit(0)))).withColumn("beyond", F.col("sent") - F.col("swap"))
    before = F.coalesce(F.sum("beyond").over(Window.partitionBy("to").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pair = pair.withColumn("ahead", before).join(room.select(F.col("shard").alias("to"), "room"), "to").join(used, "to", "left")
    left = F.greatest(F.lit(0), F.col("room")) - F.coalesce("used", F.lit(0)) - F.col("ahead")
    allowed = pair.select("shard", "to", (F.col("swap") + F.greatest(F.lit(0), F.least("beyond", left))).alias("allowed"))
    single = movers.where("not whole").withColumn("pair", F.col("shard") * shards + F.col("to"))
    queued = running(single, "pair", "n", ["group"], "before").join(F.broadcast(allowed), ["shard", "to"])
    granted = queued.select("group", "shard", "to", F.greatest(F.lit(0), F.least("n", F.col("allowed") - F.col("before"))).alias("moved")).where("moved > 0")
    return granted.unionByName(together.select("group", "shard", "to", F.col("n").alias("moved")))


def propagate(state: DataFrame, n_docs: int, shards: int) -> DataFrame:
    """Rounds of moves on (group, shard, n) until nobody moves."""
    state = landed(state, "state")
    while True:
        moves = landed(_round(state, n_docs, shards), "moves")
        if moves.isEmpty():
            return state
        change = moves.select("group", "shard", (-F.col("moved")).alias("n")).unionByName(moves.select("group", F.col("to").alias("shard"), F.col("moved").alias("n")))
        state = landed(state.unionByName(change).groupBy("group", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "state")


def shard(docs: DataFrame, shards: int = SHARDS, link: Column | None = None, id_col: str = "doc_id", text_col: str = "text", in_order: bool = False) -> DataFrame:
    """Shard of every document under the law ``rows``: counts of any two shards differ by at most one.

    ``link``: key of the groups whose documents belong together; by default the text itself. Returns one row per input row: doc_id,
    size (UTF-8 bytes plus 1), text_crc32, law, shard, slot (place in the shard, gapless from 0), grown_shard (null under this law),
    linked (whether another document has its key). A null key links with nothing; a null text has size 1 and checksum 0. Null ids and
    repeated rows get places of their own. With fewer documents than shards the first shards get one each. An empty table gives no
    rows. Other columns are not read. A group larger than a shard is parted into as few parts as the rounds find.

    ``in_order``: slots follow the order of ``docs``, which must then be read from Parquet files that lie in order; otherwise they
    follow a hash. The shards are the same either way.
    """
    text = F.col(text_col).cast("string")
    key = F.when(text.isNotNull(), F.xxhash64(text)) if link is None else F.when(link.isNotNull(), F.xxhash64(link))
    rows = landed(docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
                              F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), key.alias("group"), *([file_place().alias("_place")] if in_order else [])), "rows")
    placed_by = ["_place"] if in_order else ["_order"]
    n_docs = rows.count()
    groups = rows.where(F.col("group").isNotNull()).groupBy("group").agg(F.count(F.lit(1)).alias("size_g")).where("size_g > 1")
    groups = landed(groups, "groups")
    spread = max(256, n_docs // ROWS_A_TASK)
    tagged = landed(join_split(rows, groups, "group", "left").withColumn("linked", F.col("size_g").isNotNull()).drop("size_g"), "tagged")
    order = F.struct(F.coalesce("doc_id", F.lit(-2**63)), "size", "text_crc32")
    linked = gapless(tagged.where("linked").withColumn("_order", order), "group", ["_order"], "at", spread)
    linked = landed(linked, "linked")
    # the start: each group dealt evenly over all shards from a shard of its own, as a hash of its documents would do
    turn = F.pmod(F.xxhash64("group"), F.lit(shards))
    lots = groups.select("group", "size_g", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("lot"))
    n = (F.col("size_g") - F.col("lot") + shards - 1) / shards
    start = lots.select("group", F.pmod(turn + F.col("lot"), F.lit(shards)).cast("int").alias("shard"), F.floor(n).alias("n")).where("n > 0")
    state = propagate(_within(start, n_docs, shards), n_docs, shards)
    ahead = Window.partitionBy("group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = landed(state.select("group", "shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("lo"), "n"), "parts")
    placed = join_split(linked, parts, "group").where("at >= lo and at < lo + n").select("doc_id", "size", "text_crc32", "linked", "shard", *placed_by)
    # documents without links fill what the law leaves
    one = F.lit(0)
    single = gapless(tagged.where("not linked").withColumn("_order", order).withColumn("_all", one), "_all", ["_order"], "at", spread)
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    fill = _room(state, n_docs, shards).select("shard", F.coalesce(F.sum("room").over(before), F.lit(0)).alias("lo"), "room")
    filled = single.join(F.broadcast(fill), (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("lo") + F.col("room"))).select("doc_id", "size", "text_crc32", "linked", "shard", *placed_by)
    both = landed(placed.unionByName(filled), "placed")
    run = F.struct("_place.task", "_place.file", F.floor(F.col("_place.row") / ROWS_A_RUN).alias("run")) if in_order else None
    out = gapless(both, "shard", placed_by, "slot", max(64, spread // shards), run)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "linked")


def _within(start: DataFrame, n_docs: int, shards: int) -> DataFrame:
    """A start that keeps the quotas: what a shard holds too much of goes to the free places of the others, in order."""
    start = landed(start, "start")
    room = landed(_room(start, n_docs, shards), "room")
    if room.where("room < 0").isEmpty():
        return start
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    over = room.where("room < 0").select("shard", (-F.col("room")).alias("excess")).withColumn("from_place", F.coalesce(F.sum("excess").over(before), F.lit(0)))
    free = room.where("room > 0").select(F.col("shard").alias("to"), F.col("room").alias("free")).withColumn(
        "place", F.coalesce(F.sum("free").over(Window.partitionBy(F.lit(0)).orderBy("to").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    queued = running(start.join(F.broadcast(over), "shard"), "shard", "n", ["group"], "before").where("before < excess")
    leaving = queued.select("group", "shard", F.least("n", F.col("excess") - F.col("before")).alias("out"), (F.col("from_place") + F.col("before")).alias("p"))
    met = leaving.join(F.broadcast(free), (F.col("p") < F.col("place") + F.col("free")) & (F.col("p") + F.col("out") > F.col("place")))
    taken = F.least(F.col("p") + F.col("out"), F.col("place") + F.col("free")) - F.greatest("p", "place")
    moves = met.select("group", "shard", "to", taken.alias("moved"))
    change = moves.select("group", "shard", (-F.col("moved")).alias("n")).unionByName(moves.select("group", F.col("to").alias("shard"), F.col("moved").alias("n")))
    return start.unionByName(change).groupBy("group", "shard").agg(F.sum("n").alias("n")).where("n > 0")
