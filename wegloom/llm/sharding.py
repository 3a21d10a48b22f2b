"""Balanced label propagation: linked documents move to their neighbours' shard while shards stay even.

Documents are linked through hubs (here: equal texts), so a group of any size has as many links as members. Labels
start from a hash. In a round each hub takes the label most of its members have; a shard admits at most what its
capacity leaves, hubs by a hash below the admitted share, and of a hub too large for that only that share of its
members. Unlinked documents are then dealt so that every shard holds its quota exactly: they pay for the moves, and no
edge is cut by moving them. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wegloom.llm import common

UNIT = 1 << 20


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1), text_crc32 and hub (digest of the text); null texts are empty ones."""
    text = common.empty_if_null("text").cast("binary")
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("hub"))


def propagate(members: DataFrame, shards: int, quota: list[int], rounds: int = 6) -> DataFrame:
    """hub, shares: for hubs with two members or more, an array of (shard, n, first), gapless in the members' order.

    members: doc_id, hub. The state has a row for each hub and shard in use: at most `shards` rows a hub.
    """
    start = members.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    state = start.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
    linked = state.groupBy("hub").agg(F.sum("n").alias("m")).where("m > 1").select("hub")
    state = common.materialize(state.join(linked, "hub"), "labels")
    for turn in range(rounds):
        vote = state.groupBy("hub").agg(F.max_by("shard", F.struct("n", F.pmod(F.xxhash64("hub", "shard"), F.lit(UNIT)))).alias("to"))
        wish = state.join(vote, "hub")
        flows = wish.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()  # at most shards * shards rows
        load, wanted = [0] * shards, [0] * shards
        for r in flows:
            load[r["shard"]] += r["n"]
            if r["shard"] != r["to"]:
                wanted[r["to"]] += r["n"]
        if not any(wanted):
            break
        free = [max(0, q - x) for q, x in zip(quota, load)]
        admitted = [min(UNIT, f * UNIT // w) if w else 0 for f, w in zip(free, wanted)]
        if not any(admitted):
            break
        share = F.array(*[F.lit(a) for a in admitted])[F.col("to")]
        large = F.array(*[F.lit(max(1, q // 100)) for q in quota])[F.col("to")]
        draw = F.pmod(F.xxhash64("hub", F.lit(turn)), F.lit(UNIT))
        moved = F.when(F.col("shard") == F.col("to"), 0).when(F.col("n") > large, F.floor(F.col("n") * share / UNIT)).when(draw < share, F.col("n")).otherwise(0).cast("bigint")
        step = wish.withColumn("moved", moved)
        kept = step.select("hub", "shard", (F.col("n") - F.col("moved")).alias("n"))
        gone = step.select("hub", F.col("to").alias("shard"), F.col("moved").alias("n"))
        state = common.materialize(kept.unionAll(gone).where("n > 0").groupBy("hub", "shard").agg(F.sum("n").alias("n")), "labels")
    return state.groupBy("hub").agg(F.sort_array(F.collect_list(F.struct("shard", "n"))).alias("shares"), F.sum("n").alias("m"))


def assign(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Put every document into a shard; equal texts together as far as the quotas allow.

    Returns doc_id, size, text_crc32, law ('rows': the shards' counts are at most one apart), shard, slot (gapless
    from 0 in its shard), grown_shard (null under this law). Null and empty texts count as equal; repeated rows are
    documents of their own; an empty table gives no rows. Other columns of docs are not read.
    """
    base = common.materialize(sized(docs), "sized")
    total = base.count()
    buckets = max(16, total // 20_000)
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    hubs = propagate(base.select("doc_id", "hub"), shards, quota)
    # a member's place in its hub's shares: by a hash, so that no hub has to be numbered in one task
    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(UNIT)) * F.col("m") / UNIT
    walk = F.aggregate(
        "shares",
        F.struct(F.lit(-1).alias("shard"), F.lit(0).cast("bigint").alias("upto")),
        lambda a, x: F.struct(F.when((a["shard"] < 0) & (place < a["upto"] + x["n"]), x["shard"]).otherwise(a["shard"]).alias("shard"), (a["upto"] + x["n"]).alias("upto")),
    )["shard"]
    labelled = base.join(hubs, "hub", "left").select("doc_id", "size", "text_crc32", F.when(F.col("m").isNotNull(), walk).otherwise(-1).alias("label"))
    order = ["doc_id", "text_crc32"]
    ranked = common.materialize(common.two_level_rank(labelled, ["label"], order, buckets, "rank"), "ranked")
    quotas = F.array(*[F.lit(q) for q in quota])
    fixed = (F.col("label") >= 0) & (F.col("rank") < F.element_at(quotas, F.greatest(F.col("label"), F.lit(0)) + 1))
    kept = {r["label"]: r["n"] for r in ranked.where(fixed).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a shard
    rest = common.two_level_rank(ranked.where(~fixed).drop("rank"), [], order, buckets, "rank")
    to, slot, upto = F.lit(None).cast("int"), F.lit(None).cast("bigint"), total - sum(kept.values())
    for s in reversed(range(shards)):
        room = quota[s] - kept.get(s, 0)
        upto -= room
        here = (F.col("rank") >= upto) & (F.col("rank") < upto + room)
        to = F.when(here, s).otherwise(to)
        slot = F.when(here, F.col("rank") - upto + kept.get(s, 0)).otherwise(slot)
    every = ranked.where(fixed).withColumns({"shard": F.col("label"), "slot": F.col("rank")}).unionByName(rest.withColumns({"shard": to, "slot": slot}))
    return every.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("bigint"), F.lit(None).cast("int").alias("grown_shard"))
