"""Consumer groups: committed offsets, lag, liveness and assignment."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stage import KEY

#: Rows of members that a slot holds, until there are MOST_SLOTS; keys that are looked at to find the bound of one.
SLOT_ROWS, MOST_SLOTS, LOOKED_AT = 20_000, 4_096, 16
#: Partitions that are dealt at once.
DEALT = 65_536


def commit_offsets(committed: DataFrame, commits: DataFrame, topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The offsets after a commit, and a code for each request: 0, or 3 for an unknown topic, in request order."""
    known = commits.join(topics.select("topic", F.lit(True).alias("_k")).distinct(), "topic", "left")
    good = known.filter("_k").select("group", *KEY, "offset", "committed_at")
    codes = known.select("position", "group", *KEY, F.when(F.col("_k"), F.lit(0)).otherwise(F.lit(3)).alias("error_code")).orderBy("position")
    return latest_commits(committed.unionByName(good)), codes


def latest_commits(commits: DataFrame) -> DataFrame:
    """The offset committed last by each group and topition; of two at the same time the greater."""
    last = F.max(F.struct("committed_at", "offset")).alias("_l")
    return commits.groupBy("group", *KEY).agg(last).select("group", *KEY, F.col("_l.offset").alias("offset"), F.col("_l.committed_at").alias("committed_at"))


def fetch_offsets(commits: DataFrame, requests: DataFrame) -> DataFrame:
    """The committed offset of each requested (group, topic, partition); -1 where there is none."""
    found = latest_commits(commits).select("group", *KEY, "offset")
    return requests.join(found, ["group", *KEY], "left").select("group", *KEY, F.coalesce("offset", F.lit(-1)).cast("bigint").alias("offset"))


def lag(commits: DataFrame, stage: DataFrame) -> DataFrame:
    """How far each group is behind the end of each topition it has committed."""
    latest = latest_commits(commits).select("group", *KEY, "offset")
    return latest.join(stage.select(*KEY, "high_watermark"), KEY).select("group", *KEY, "offset", "high_watermark", F.greatest(F.col("high_watermark") - F.col("offset"), F.lit(0)).alias("lag"))


def expired_members(generation_members: DataFrame, members: DataFrame, now_ms: int) -> DataFrame:
    """Members of a generation that have no document or were last heard of longer ago than their session."""
    seen = members.select("group", "member_id", "last_contact_ms", "session_timeout_ms")
    rows = generation_members.join(seen, ["group", "member_id"], "left")
    return rows.filter(F.col("last_contact_ms").isNull() | (F.lit(now_ms) - F.col("last_contact_ms") > F.col("session_timeout_ms"))).select("group", "member_id")


def sweep(generations: DataFrame, generation_members: DataFrame, members: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Generations after expiry: those that lost a member count one up and have no leader; and the members left."""
    gone = expired_members(generation_members, members, now_ms)
    hit = gone.select("group").distinct().withColumn("_hit", F.lit(True))
    new = generations.join(hit, "group", "left")
    lost = F.coalesce("_hit", F.lit(False))
    out = new.select("group", F.when(lost, F.col("generation_id") + 1).otherwise(F.col("generation_id")).alias("generation_id"), F.when(~lost, F.col("leader")).alias("leader"))
    return out, generation_members.join(gone, ["group", "member_id"], "left_anti")


def renewal_due(members: DataFrame, now_ms: int) -> DataFrame:
    """Members whose liveness should be written again: after half a session at most."""
    return members.filter(F.lit(now_ms) - F.col("last_contact_ms") >= F.expr("session_timeout_ms div 2"))


def states(generations: DataFrame, members: DataFrame, assignments: DataFrame) -> DataFrame:
    """Empty without members, Stable with an assignment of this generation, CompletingRebalance with a leader but none, else Assigning."""
    count = members.groupBy("group").agg(F.count("*").alias("_n"))
    done = assignments.select("group", "generation_id", F.lit(True).alias("_a")).distinct()
    rows = generations.join(count, "group", "left").join(done, ["group", "generation_id"], "left")
    n = F.coalesce("_n", F.lit(0))
    state = F.when(n == 0, F.lit("Empty")).when(F.coalesce("_a", F.lit(False)), F.lit("Stable")).when(F.col("leader").isNotNull(), F.lit("CompletingRebalance")).otherwise(F.lit("Assigning"))
    return rows.select("group", "generation_id", n.cast("bigint").alias("members"), state.alias("state"))


def list_groups(states_: DataFrame, only: list[str] | None = None) -> DataFrame:
    return states_ if not only else states_.filter(F.col("state").isin(*only))


def describe(generations: DataFrame, members: DataFrame, assignments: DataFrame) -> DataFrame:
    """Each group with its state and its members in order of their ids."""
    listed = members.groupBy("group").agg(F.array_sort(F.collect_list("member_id")).alias("member_ids"))
    return states(generations, members, assignments).join(listed, "group", "left").withColumn("member_ids", F.coalesce("member_ids", F.array().cast("array<string>")))


def delete_groups(groups: DataFrame, ids: list[str]) -> DataFrame:
    return groups.filter(~F.col("group").isin(*ids)) if ids else groups


def stalled(generations: DataFrame, now_ms: int, floor_ms: int) -> DataFrame:
    """Groups that have been rebalancing for longer than their timeout and a floor."""
    limit = F.greatest(F.coalesce("rebalance_timeout_ms", F.lit(0)), F.lit(floor_ms))
    return generations.filter(F.col("state").isin("Assigning", "CompletingRebalance") & (F.lit(now_ms) - F.col("state_since_ms") > limit))


def overlapping(assignments: DataFrame) -> DataFrame:
    """Topitions that a generation has given to more than one member."""
    return assignments.groupBy("group", "generation_id", *KEY).agg(F.count_distinct("member_id").alias("members")).filter("members > 1")


def same_subscription(a: str, b: str):
    """Whether two topic lists name the same topics in any order; false where either can't be read."""
    return F.coalesce(F.array_sort(a) == F.array_sort(b), F.lit(False))


def _placed(members: DataFrame) -> DataFrame:
    """Members with ``_place``, a number in the order of (group, member_id) that only repeats of a member share.

    Each slot of neighbouring members is ordered by itself. Bounds of slots are keys of the table, chosen by a
    hash, so a task that runs again gives the same places.
    """
    keys = members.select("group", "member_id")
    rows = keys.count()
    slots = max(1, min(MOST_SLOTS, -(-rows // SLOT_ROWS)))
    bounds = []
    if slots > 1:
        looked_at = F.pmod(F.xxhash64("group", "member_id"), F.lit(max(1, rows // (slots * LOOKED_AT)))) == 0
        found = sorted((tuple(r) for r in keys.filter(looked_at).distinct().collect()), key=lambda k: [(x is not None, x) for x in k])
        bounds = found[LOOKED_AT::LOOKED_AT]
    slot = F.lit(0)
    if bounds:
        kinds = [f.dataType.simpleString() for f in keys.schema]
        listed = F.from_json(F.lit(json.dumps([{"g": g, "m": m} for g, m in bounds], default=str)), f"array<struct<g:{kinds[0]},m:{kinds[1]}>>")
        steps = F.array(*(F.lit(1 << j) for j in reversed(range(len(bounds).bit_length()))))
        key = F.struct(F.col("group").alias("g"), F.col("member_id").alias("m"))
        slot = F.aggregate(steps, slot, lambda at, step: F.when((at + step <= len(bounds)) & (F.get(listed, at + step - 1) <= key), at + step).otherwise(at))
    rank = F.dense_rank().over(Window.partitionBy("_slot").orderBy("group", "member_id"))
    return members.withColumn("_slot", slot).repartition(slots, "_slot").withColumn("_place", F.col("_slot").cast("bigint") * (1 << 32) + rank - 1)


def _named(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """Rows with the group and member_id of their ``_place``."""
    return rows.join(placed.select("_slot", "_place", "group", "member_id").distinct(), "_place")


def _subscribers(placed: DataFrame) -> DataFrame:
    """(group, topic, _word, _bits): the places of a topic's subscribers as bits of words of 64, so repeats count once."""
    each = placed.select("group", F.explode("topics").alias("topic"), F.expr("_place div 64").alias("_word"), F.expr("shiftleft(1L, cast(_place % 64 as int))").alias("_bit"))
    return each.groupBy("group", "topic", "_word").agg(F.bit_or("_bit").alias("_bits"))


def assign_range(members: DataFrame, topics: DataFrame) -> DataFrame:
    """(group, member_id, topic, partition): per topic its partitions in runs over its subscribers by id, the first ones one longer.

    ``members`` has group, member_id, topics; ``topics`` has topic, partitions.
    """
    placed = _placed(members.select("group", "member_id", "topics"))
    whole = Window.partitionBy("group", "topic")
    words = _subscribers(placed).withColumn("_c", F.bit_count("_bits")).withColumn("_n", F.sum("_c").over(whole)).withColumn("_before", F.sum("_c").over(whole.orderBy("_word")) - F.col("_c"))
    # subscribers beyond the number of partitions get none
    near = words.drop("group").join(topics.select("topic", "partitions"), "topic").filter("_before < partitions")
    ranked = near.select("topic", "partitions", "_n", "_before", "_word", F.posexplode(F.expr("filter(sequence(0, 63), b -> getbit(_bits, b) = 1)")).alias("_i", "_b"))
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_i")).withColumn("_place", F.col("_word") * 64 + F.col("_b"))
    each, more = F.expr("partitions div _n").cast("int"), F.expr("partitions % _n").cast("int")
    ranked = ranked.withColumn("_first", F.col("_rank") * each + F.least("_rank", more)).withColumn("_size", each + F.when(F.col("_rank") < more, 1).otherwise(0))
    ranked = _named(ranked.filter("_size > 0").select("topic", "_place", "_first", "_size"), placed)
    return ranked.select("group", "member_id", "topic", F.explode(F.sequence(F.col("_first").cast("int"), (F.col("_first") + F.col("_size") - 1).cast("int"))).alias("partition"))


def _deal(group: pa.Table) -> pa.Table:
    """Deals a group's topitions in order: a topic's go to as many subscribers in turn, from the one whose turn it is on."""
    group = group.combine_chunks()
    names = group["topic"].to_pylist()
    turn, places, topics, partitions = 0, [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
    for i in sorted(range(len(names)), key=names.__getitem__):
        word, bit, size = group["_words"][i].values.to_numpy(), group["_bits"][i].values.to_numpy().astype("<i8").view("<u8"), group["partitions"][i].as_py()
        ends = np.cumsum(np.bitwise_count(bit), dtype=np.int64)
        at = int(np.searchsorted(word, turn // 64))
        first = int(ends[at - 1]) if at else 0
        if at < len(word) and word[at] == turn // 64:
            first += (int(bit[at]) & ((1 << turn % 64) - 1)).bit_count()
        for low in range(0, size, DEALT):
            dealt = np.arange(low, min(low + DEALT, size))
            nth = (first + dealt) % ends[-1]
            at = np.searchsorted(ends, nth, "right")
            nth = nth - (ends[at] - np.bitwise_count(bit[at]))
            seen = np.unpackbits(bit[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").cumsum(1, dtype=np.uint8)
            places.append(word[at] * 64 + (seen == (nth + 1)[:, None]).argmax(1))
            topics.append(np.full(len(dealt), i, np.int32))
            partitions.append(dealt.astype(np.int32))
            turn = int(places[-1][-1]) + 1
    dealt = pa.array(names, pa.string()).take(pa.array(np.concatenate(topics)))
    return pa.table({"_place": np.concatenate(places), "topic": dealt, "partition": np.concatenate(partitions)})


def assign_round_robin(members: DataFrame, topics: DataFrame) -> DataFrame:
    """Topitions in order, dealt to members in order, each to the next one that subscribes to the topic.

    Whose turn it is depends on who was skipped, so each group is a fold over its own topics; of its members it sees
    a bit for each topic.
    """
    placed = _placed(members.select("group", "member_id", "topics").filter("member_id is not null"))
    sizes = topics.filter("partitions is not null").groupBy("topic").agg(F.max("partitions").alias("partitions"))
    words = _subscribers(placed).groupBy("group", "topic").agg(F.array_sort(F.collect_list(F.struct("_word", "_bits"))).alias("_w"))
    words = words.join(sizes, "topic").select("group", "topic", "partitions", F.col("_w._word").alias("_words"), F.col("_w._bits").alias("_bits"))
    dealt = words.groupBy("group").applyInArrow(_deal, "_place bigint, topic string, partition int")
    return _named(dealt, placed).select("group", "member_id", "topic", "partition")


#: Assignors by the names clients ask for.
ASSIGNORS = {"range": assign_range, "roundrobin": assign_round_robin, "cooperative-sticky": assign_round_robin, "uniform": assign_round_robin}
