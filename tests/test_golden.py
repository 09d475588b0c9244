"""Small cases with known results."""

import math
import random
import uuid

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logtide.functions import scalars as S
from logtide.operators import access, catalog, fetch, groups, log, producers, retention, segments, stage, txn


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def records(spark, data, columns="topic string, partition int, offset bigint, key string, value string, bytes bigint, timestamp_ms bigint"):
    return spark.createDataFrame(data, columns)


def single(spark, n=10):
    return records(spark, [("t", 0, i, f"k{i}", f"v{i}", 70, 1000 * i) for i in range(n)])


@pytest.mark.parametrize(("start", "want"), [(4, list(range(4, 10))), (10, []), (11, []), (100, [])])
def test_fetch_from(spark, start, want):
    asked = spark.createDataFrame([("t", 0, start)], "topic string, partition int, offset bigint")
    assert [r[0] for r in rows(fetch.fetch(single(spark), asked), "offset")] == want


def test_fetch_gives_one_however_small_the_budget(spark):
    asked = spark.createDataFrame([("t", 0, 0)], "topic string, partition int, offset bigint")
    assert rows(fetch.fetch(single(spark), asked, max_bytes=1), "offset") == [(0,)]
    assert len(rows(fetch.fetch(single(spark), asked, max_bytes=141), "offset")) == 3


def test_fetch_total_budget(spark):
    data = records(spark, [(t, 0, i, "k", "v", 100, 0) for t in "ab" for i in range(3)])
    asked = spark.createDataFrame([("a", 0, 0), ("b", 0, 0)], "topic string, partition int, offset bigint")
    assert rows(fetch.fetch(data, asked, total_bytes=350), "topic", "offset") == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]


def test_batches_may_begin_before_the_offset(spark):
    b = spark.createDataFrame([("t", 0, 0, 4), ("t", 0, 5, 4)], "topic string, partition int, base_offset bigint, last_offset_delta int")
    asked = spark.createDataFrame([("t", 0, 3)], "topic string, partition int, offset bigint")
    assert rows(fetch.fetch_batches(b, asked), "base_offset") == [(0,), (5,)]
    assert rows(fetch.next_offset(b), "next_offset") == [(10,)]


def test_offsets_are_dense_in_arrival_order(spark):
    data = spark.createDataFrame([("t", p, i, i // 3) for i, p in enumerate([0, 0, 1, 0, 1, 1, 1])], "topic string, partition int, arrival int, slot int")
    want = [(0, 0, 0), (0, 1, 1), (0, 3, 2), (1, 2, 0), (1, 4, 1), (1, 5, 2), (1, 6, 3)]
    assert rows(log.assign_offsets(data, ["arrival"]), "partition", "arrival", "offset") == want
    assert rows(log.assign_offsets(data, ["arrival"], slot=F.col("slot")), "partition", "arrival", "offset") == want
    base = spark.createDataFrame([("t", 0, 7)], "topic string, partition int, base bigint")
    assert rows(log.assign_offsets(data, ["arrival"], base=base), "partition", "offset")[:3] == [(0, 7), (0, 8), (0, 9)]


def test_compaction_keeps_offsets_and_the_end(spark):
    data = records(spark, [("t", 0, i, "alpha", v, 1, 0) for i, v in enumerate(["one", "two", "three"])])
    left = retention.compact(data)
    assert rows(left, "key", "value", "offset") == [("alpha", "three", 2)]
    floors = spark.createDataFrame([("t", 0, 3)], "topic string, partition int, high bigint")
    assert rows(stage.offset_stage(left, floors), "log_start", "high_watermark") == [(2, 3)]
    new = spark.createDataFrame([("t", 0, "beta", "x", 1, 0, 0)], "topic string, partition int, key string, value string, bytes bigint, timestamp_ms bigint, arrival int")
    assert (3,) in rows(log.append(left, stage.offset_stage(left, floors), new, ["arrival"]), "offset")


def test_compaction_of_a_batch(spark):
    data = records(spark, [("t", 0, 0, "k1", "a", 1, 0), ("t", 0, 1, "k2", "b", 1, 0), ("t", 0, 2, "k1", "c", 1, 0), ("t", 0, 3, None, "d", 1, 0)])
    assert rows(retention.compact(data), "offset") == [(1,), (2,), (3,)]
    head = spark.createDataFrame([("t", 0, "k2")], "topic string, partition int, key string")
    assert rows(retention.compact_behind(data, head), "offset") == [(2,), (3,)]
    only = spark.createDataFrame([("t", False)], "topic string, compacted boolean")
    assert retention.compact(data, policies=only).count() == 4


def test_offset_for_time(spark):
    data = records(spark, [("t", 0, i, "k", "v", 1, 1000 * (i + 1)) for i in range(3)])
    asked = spark.createDataFrame([("t", 0, ms) for ms in (500, 1500, 3000, 4000, -1, -2)], "topic string, partition int, timestamp_ms bigint")
    got = dict(rows(stage.list_offsets(data, asked), "timestamp_ms", "offset")[2:])
    assert got == {500: 0, 1500: 1, 3000: 2, 4000: None}
    # times need not follow offsets
    data = records(spark, [("t", 0, 0, "k", "v", 1, 9_000_000), ("t", 0, 1, "k", "v", 1, 10), ("t", 0, 2, "k", "v", 1, 5_000_000)])
    asked = spark.createDataFrame([("t", 0, ms) for ms in (0, 11, 9_000_001)], "topic string, partition int, timestamp_ms bigint")
    assert dict(rows(stage.list_offsets(data, asked), "timestamp_ms", "offset")) == {0: 0, 11: 0, 9_000_001: None}


TXN = "txn_id bigint, producer_id bigint, topic string, partition int, first_offset bigint, last_offset bigint, state string"


@pytest.mark.parametrize(
    ("high", "states", "reference", "kafka"),
    [(12, ("BEGIN", "BEGIN"), 0, 0), (13, ("COMMITTED", "BEGIN"), 0, 6), (14, ("COMMITTED", "COMMITTED"), 14, 14)],
)
def test_last_stable_offset_of_overlapping_transactions(spark, high, states, reference, kafka):
    ends = [12 if states[0] == "COMMITTED" else None, 13 if states[1] == "COMMITTED" else None]
    t = spark.createDataFrame([(1, 1, "t", 0, 0, ends[0], states[0]), (2, 2, "t", 0, 6, ends[1], states[1])], TXN)
    at = spark.createDataFrame([("t", 0, 0, high)], "topic string, partition int, log_start bigint, high_watermark bigint")
    assert rows(txn.last_stable_offset(t, at), "last_stable") == [(reference,)]
    assert rows(txn.last_stable_offset(t, at, mode="kafka"), "last_stable") == [(kafka,)]


def test_aborted_transactions(spark):
    t = spark.createDataFrame([(1, 5, "t", 0, 0, 3, "ABORTED"), (2, 6, "t", 0, 1, None, "BEGIN")], TXN)
    assert rows(txn.aborted_ranges(t), "producer_id", "first_offset") == [(5, 0)]
    data = spark.createDataFrame([("t", 0, i, 5 if i < 3 else 7, i == 3) for i in range(5)], "topic string, partition int, offset bigint, producer_id bigint, is_control boolean")
    at = spark.createDataFrame([("t", 0, 0, 5)], "topic string, partition int, log_start bigint, high_watermark bigint")
    assert rows(txn.committed_records(data, t.filter("state = 'ABORTED'"), at), "offset") == [(4,)]


def test_end_of_a_transaction_takes_an_offset(spark):
    t = spark.createDataFrame([("x", 5, 0, "BEGIN", "t", 0, 0, None)], "transactional_id string, producer_id bigint, producer_epoch smallint, state string, topic string, partition int, first_offset bigint, last_offset bigint")
    at = spark.createDataFrame([("t", 0, 3)], "topic string, partition int, high_watermark bigint")
    after, markers = txn.end_txn(t, at, "x", 5, 0, committed=False)
    assert rows(after, "state", "last_offset") == [("ABORTED", 3)]
    assert rows(markers, "offset", "control") == [(3, "abort")]
    assert rows(txn.add_partitions(t, "x", 5, 0, spark.createDataFrame([("t", 0), ("t", 1)], "topic string, partition int")), "partition") == [(0,), (1,)]


def test_producer_outcomes():
    t = producers.Tail()
    assert t.offer(0, 0, 0, 100) == ("admit", 100) and t.offer(0, 1, 2, 101) == ("admit", 101) and t.offer(0, 3, 3, 103) == ("admit", 103)
    assert t.offer(0, 0, 0, 9) == ("duplicate", 100) and t.offer(0, 1, 2, 9) == ("duplicate", 101)
    assert t.offer(0, 5, 5, 9)[0] == "out_of_order"
    assert t.offer(1, 0, 0, 110)[0] == "admit" and t.offer(0, 4, 4, 9)[0] == "fenced"
    t = producers.Tail(0, 2_147_483_647)
    assert t.offer(0, 2_147_483_647, 2_147_483_647, 1)[0] == "admit" and t.offer(0, 0, 0, 2)[0] == "admit"
    t = producers.Tail()
    assert t.offer(0, 3, 3, 1)[0] == "out_of_order"
    for i in range(6):
        t.offer(0, i, i, i)
    assert [t.offer(0, s, s, 99)[0] for s in (0, 1, 5, 6)] == ["out_of_order", "duplicate", "duplicate", "admit"]


def test_overlapping_segments(spark):
    e = spark.createDataFrame([("t", 0, 0, 1, 0, 10), ("t", 0, 1, 2, 10, 10), ("t", 0, 2, 1, 10, 10)], "topic string, partition int, seq bigint, writer_epoch bigint, base_offset bigint, record_count bigint")
    assert rows(segments.overlap_winners(e), "seq") == [(0,), (1,)]


def test_retention_keeps_the_end(spark):
    data = records(spark, [("t", 0, i, "k", "v", 1, 0) for i in range(3)])
    configs = spark.createDataFrame([("t", "retention.ms", "1800000")], "topic string, name string, value string")
    gone = retention.expired_records(data, retention.policy_of(configs), 3_600_000)
    assert gone.count() == 3
    left = data.join(gone, ["topic", "partition", "offset"], "left_anti")
    floors = spark.createDataFrame([("t", 0, 3)], "topic string, partition int, high bigint")
    at = stage.offset_stage(left, floors)
    assert rows(at, "log_start", "high_watermark") == [(3, 3)]
    asked = spark.createDataFrame([("t", 0, o) for o in (0, 3)] + [("u", 0, 0)], "topic string, partition int, offset bigint")
    assert rows(fetch.fetch_status(asked, at), "offset", "error_code", "log_start") == [(0, 1, 3), (0, 3, -1), (3, 0, 3)]


def test_policies(spark):
    configs = spark.createDataFrame([("a", "cleanup.policy", "compact"), ("b", "cleanup.policy", "compact,delete"), ("c", "retention.ms", "-1"), ("d", "x", "y")], "topic string, name string, value string")
    got = {r[0]: tuple(r[1:]) for r in retention.policy_of(configs).collect()}
    assert got == {"a": (False, True, None), "b": (True, True, 604_800_000), "c": (True, False, None), "d": (True, False, 604_800_000)}


def test_segments_go_as_a_whole(spark):
    e = spark.createDataFrame([("s1", "a", 10), ("s1", "b", 10), ("s2", "a", 10)], "segment string, topic string, max_timestamp bigint")
    p = spark.createDataFrame([("a", True, 100), ("b", True, 1000)], "topic string, deletes boolean, retention_ms bigint")
    assert rows(retention.expired_segments(e, p, 500)) == [("s2",)]


def test_truncation(spark):
    at = spark.createDataFrame([("t", 0, 5, 0)], "topic string, partition int, high_watermark bigint, log_start bigint")
    none = spark.createDataFrame([], "topic string, partition int, floor bigint")
    asked = spark.createDataFrame([("t", 0, -1)], "topic string, partition int, offset bigint")
    assert rows(retention.truncate(none, asked, at)) == [("t", 0, 5)]


@pytest.mark.parametrize("name", ["range", "roundrobin", "uniform"])
def test_assignments(spark, name):
    m = spark.createDataFrame([("g", "m1", ["a", "b"]), ("g", "m2", ["a"]), ("g", "m3", ["a", "b"])], "group string, member_id string, topics array<string>")
    t = spark.createDataFrame([("a", 7), ("b", 2)], "topic string, partitions int")
    got = rows(groups.ASSIGNORS[name](m, t), "topic", "partition", "member_id")
    assert [(x, p) for x, p, _ in got] == [("a", i) for i in range(7)] + [("b", 0), ("b", 1)]
    if name == "range":
        assert [x[2] for x in got] == ["m1", "m1", "m1", "m2", "m2", "m3", "m3", "m1", "m3"]
    else:
        assert [x[2] for x in got] == ["m1", "m2", "m3", "m1", "m2", "m3", "m1", "m3", "m1"]

def plain_assignments(members, topics):
    """Both assignors, by the rules: (range, round robin) as sets of (group, member, topic, partition)."""
    subscribed, by_range, by_turn = {}, set(), set()
    for g, m, names in members:
        subscribed.setdefault(g, {}).setdefault(m, set()).update(names or [])
    for g, of in subscribed.items():
        order, turn = sorted(of), 0
        for topic, n in sorted(topics):
            own = [m for m in order if topic in of[m]]
            at = 0
            for i, m in enumerate(own):
                size = n // len(own) + (i < n % len(own))
                by_range |= {(g, m, topic, p) for p in range(at, at + size)}
                at += size
            for p in range(n if own else 0):
                while topic not in of[order[turn % len(order)]]:
                    turn += 1
                by_turn.add((g, order[turn % len(order)], topic, p))
                turn += 1
    return by_range, by_turn


@pytest.mark.parametrize("slot_rows", [20_000, 7])
def test_assignments_of_many_members(spark, monkeypatch, slot_rows):
    monkeypatch.setattr(groups, "SLOT_ROWS", slot_rows)
    monkeypatch.setattr(groups, "DEALT", 5)
    rng = random.Random(3)
    topics = [(f"t{i}", n) for i, n in enumerate([7, 0, 1, 150, 3, 64, 12, 33])]
    members = [(g, f"m{i:03d}é" if i % 5 else f"{i}", rng.sample([t for t, _ in topics] + ["unknown"], rng.randrange(9))) for g, n in (("a", 130), ("b", 3), ("é", 70), ("one", 1)) for i in range(n)]
    members += rng.sample(members, 40) + [("a", "m001é", ["t0", "t0", None])] * 3 + [("b", "nothing", None), (None, "n1", ["t3"]), (None, "n2", ["t3", "t0"])]
    members = members[::-1]
    m = spark.createDataFrame(members, "group string, member_id string, topics array<string>")
    t = spark.createDataFrame(topics, "topic string, partitions int")
    by_range, by_turn = plain_assignments([(g, x, [n for n in names or [] if n]) for g, x, names in members], topics)
    for assign, want in ((groups.assign_range, by_range), (groups.assign_round_robin, by_turn)):
        got = [tuple(r) for r in assign(m, t).select("group", "member_id", "topic", "partition").collect()]
        assert len(got) == len(want) and set(got) == want
        assert assign(m.limit(0), t).count() == 0 and assign(m, t.limit(0)).count() == 0


def test_round_robin_sees_words_not_subscriptions(spark, tmp_path, monkeypatch):
    """A group's fold gets a row a topic and a bit a subscription: 5,000 members of 20 topics are some 80 words a topic."""
    seen, deal = str(tmp_path), groups._deal

    def watched(group: pa.Table) -> pa.Table:
        with open(f"{seen}/{uuid.uuid4().hex}", "w") as f:
            f.write(f"{group.num_rows} {group.nbytes}")
        return deal(group)

    monkeypatch.setattr(groups, "_deal", watched)
    m = spark.range(5_000).select(F.lit("g").alias("group"), F.format_string("m%05d", "id").alias("member_id"), F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.concat(F.lit("t"), i)).alias("topics"))
    t = spark.range(1, 21).select(F.concat(F.lit("t"), "id").alias("topic"), F.lit(3).alias("partitions"))
    assert groups.assign_round_robin(m, t).count() == 60
    rows, size = map(int, next(tmp_path.iterdir()).read_text().split())
    assert rows == 20 and size < 20 * 5_000


def test_range_orders_a_slot_at_a_time(spark, monkeypatch):
    """No task orders or buffers all of a topic's subscribers."""
    monkeypatch.setattr(groups, "SLOT_ROWS", 100)
    m = spark.range(3_000).select(F.lit("g").alias("group"), F.format_string("m%05d", "id").alias("member_id"), F.array(F.lit("t")).alias("topics"))
    sizes = [r["n"] for r in groups._placed(m).groupBy("_slot").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 3_000 and len(sizes) > 15 and max(sizes) < 500
    assert groups._subscribers(groups._placed(m)).count() < 3_000 / 64 + 2 * len(sizes)
    assert rows(groups.assign_range(m, spark.createDataFrame([("t", 4)], "topic string, partitions int")), "member_id", "partition") == [(f"m{i:05d}", i) for i in range(4)]


def test_access(spark):
    acls = spark.createDataFrame([("TOPIC", "abc", "PREFIXED", "User:a", "*", "WRITE", "ALLOW"), ("TOPIC", "abcx", "LITERAL", "User:a", "*", "ALL", "DENY"), ("TOPIC", "*", "LITERAL", "User:b", "h1", "READ", "ALLOW")], "resource_type string, resource_name string, pattern string, principal string, host string, operation string, permission string")
    asked = [
        (1, "User:a", "h", "TOPIC", "abcd", "WRITE"), (2, "User:a", "h", "TOPIC", "abcd", "DESCRIBE"), (3, "User:a", "h", "TOPIC", "abcx", "WRITE"), (4, "User:a", "h", "TOPIC", "ab", "WRITE"),
        (5, "User:b", "h1", "TOPIC", "x", "READ"), (6, "User:b", "h2", "TOPIC", "x", "READ"), (7, "User:c", "h", "TOPIC", "x", "READ"), (8, "User:root", "h", "TOPIC", "x", "READ"),
    ]
    df = spark.createDataFrame(asked, "request_id int, principal string, host string, resource_type string, resource_name string, operation string")
    assert rows(access.decide(df, acls, ["User:root"]), "request_id", "allowed") == [(1, True), (2, True), (3, False), (4, False), (5, True), (6, False), (7, False), (8, True)]
    assert access.acl_filter(acls, resource_name="abcx", pattern=access.MATCH).count() == 3
    left, gone = access.delete_acls(acls, principal="User:a")
    assert (left.count(), gone.count()) == (1, 2)
    assert access.create_acls(acls, acls).count() == 3


def test_quotas(spark):
    q = spark.createDataFrame([(None, 100.0, None, None), ("u", None, 8.0, None)], "entity_user string, producer_byte_rate double, consumer_byte_rate double, request_rate double")
    who = spark.createDataFrame([("User:u",), ("User:v",)], "principal string")
    assert rows(access.effective_quotas(who, q, 2)) == [("User:u", 50.0, 4.0, None), ("User:v", 50.0, None, None)]
    changes = spark.createDataFrame([(0, "u", "consumer_byte_rate", None), (1, "w", "request_rate", 1.0), (2, "x", "request_rate", -1.0), (3, "x", "consumer_byte_rate", 1.0), (4, None, "request_rate", 2.0)], "position int, entity_user string, key string, value double")
    after, judged = access.alter_quotas(q, changes)
    assert {tuple(r) for r in after.collect()} == {(None, 100.0, None, 2.0), ("w", None, None, 1.0)}
    assert {r[0]: r[1] for r in judged.collect()} == {"u": False, "w": False, "x": True, None: False}


def test_throttling_converges():
    tokens, waits, now = math.inf, [], 0.0
    for _ in range(50):
        tokens, wait = access.charge(tokens, now, now, 1024.0, 4096.0)
        waits.append(wait)
        now += wait
        tokens, _ = access.charge(tokens, now - wait, now, 1024.0, 0.0)
    assert max(waits) <= 10.0 and abs(50 * 4096 / now / 1024 - 1) < 0.2
    assert access.charge(0, 0, 1, 0.0, 1.0)[1] == 10.0


def test_topic_defaults(spark):
    topics = spark.createDataFrame([("a",), ("b",), ("c",)], "topic string")
    configs = spark.createDataFrame([("b", "cleanup.policy", "compact"), ("c", "cleanup.policy", "delete"), ("c", "retention.ms", "5")], "topic string, name string, value string")
    want = [("a", "cleanup.policy", "delete"), ("a", "retention.ms", "604800000"), ("b", "cleanup.policy", "compact"), ("c", "cleanup.policy", "delete"), ("c", "retention.ms", "5")]
    once = catalog.with_defaults(configs, topics)
    assert rows(once) == want and rows(catalog.with_defaults(once, topics)) == want


def test_catalog(spark):
    there = spark.createDataFrame([("a", "id-a", 3, 1, 1)], "topic string, topic_id string, partitions int, replication_factor smallint, incarnation bigint")
    asked = spark.createDataFrame([(0, "b", -1, -1), (1, "a", 1, 1), (2, "b", 2, 1)], "position int, topic string, partitions int, replication_factor int")
    after, codes = catalog.create_topics(there, asked)
    assert rows(after, "topic", "partitions") == [("a", 3), ("b", 3)] and rows(codes, "position", "error_code") == [(0, 0), (1, 36), (2, 36)]
    left, codes = catalog.delete_topics(there, spark.createDataFrame([(0, None, "id-a"), (1, "z", None)], "position int, topic string, topic_id string"))
    assert left.count() == 0 and rows(codes, "position", "error_code") == [(0, 0), (1, 3)]
    configs = spark.createDataFrame([("a", "x", "1"), ("a", "y", "2")], "topic string, name string, value string")
    changes = spark.createDataFrame([(0, "a", "x", "DELETE", None), (1, "a", "y", "SET", "3"), (2, "a", "z", "APPEND", "4")], "position int, topic string, name string, op string, value string")
    after, codes = catalog.alter_configs(configs, changes)
    assert rows(after) == [("a", "y", "3")] and rows(codes, "error_code") == [(0,), (0,), (40,)]


def test_group_offsets(spark):
    c = spark.createDataFrame([("g", "t", 0, 5, 1), ("g", "t", 0, 3, 2), ("g", "t", 0, 4, 2)], "group string, topic string, partition int, offset bigint, committed_at bigint")
    assert rows(groups.latest_commits(c), "offset") == [(4,)]
    asked = spark.createDataFrame([("g", "t", 0), ("g", "t", 1)], "group string, topic string, partition int")
    assert rows(groups.fetch_offsets(c, asked), "partition", "offset") == [(0, 4), (1, -1)]
    topics = spark.createDataFrame([("t",)], "topic string")
    new = spark.createDataFrame([(0, "g", "t", 0, 9, 3), (1, "g", "u", 0, 9, 3)], "position int, group string, topic string, partition int, offset bigint, committed_at bigint")
    after, codes = groups.commit_offsets(c, new, topics)
    assert rows(after, "topic", "offset") == [("t", 9)] and rows(codes, "error_code") == [(0,), (3,)]


def test_scalars(spark):
    df = spark.createDataFrame([("a.b.c.d", "my-topic-0000000007", "User:x", 2_147_483_647, 0b110100)], "topic string, name string, who string, seq int, attributes int")
    got = df.select(S.prefix_of("topic"), S.topition_topic("name"), S.topition_partition("name"), S.user_of("who"), S.next_sequence("seq"), S.compression("attributes"), S.is_transactional("attributes"), S.is_control("attributes")).first()
    assert tuple(got) == ("a.b.c", "my-topic", 7, "x", 0, "zstd", True, True)
    assert tuple(spark.sql("select cast('123456789' as binary) b").select(S.crc32c("b")).first()) == (0xE3069283,)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 20), st.integers(0, 3)), min_size=1, max_size=12, unique_by=lambda x: x))
def test_sweep_property(spark, data):
    e = [("t", 0, i, w, b, n) for i, (b, n, w) in enumerate(data)]
    df = spark.createDataFrame(e, "topic string, partition int, seq bigint, writer_epoch bigint, base_offset bigint, record_count bigint")
    covered, want = -1, []
    for _, _, seq, _, base, n in sorted(e, key=lambda x: (x[4], -x[3], -x[2])):
        if base >= covered:
            want.append((seq,))
            covered = base + n
    assert rows(segments.overlap_winners(df), "seq") == sorted(want)


def test_offsets_join_a_transaction(spark):
    none = spark.createDataFrame([], "transactional_id string, producer_id bigint, producer_epoch smallint, state string, topic string, partition int, first_offset bigint, last_offset bigint")
    once = txn.add_offsets(none, spark.createDataFrame([("g",), ("g",), ("h",)], "group string"), "tx", 4, 1)
    twice = txn.add_offsets(once, spark.createDataFrame([("g",)], "group string"), "tx", 4, 1)
    rows = twice.collect()
    assert {r.topic for r in rows} == {txn.OFFSETS_TOPIC} and len(rows) == len({r.partition for r in rows}) <= 2
    assert all(0 <= r.partition < txn.OFFSETS_PARTITIONS and (r.transactional_id, r.producer_id, r.producer_epoch, r.state) == ("tx", 4, 1, "BEGIN") for r in rows)


def test_the_entry_that_covers_an_offset(spark):
    """Entries of any size, overlapping and empty ones, against all pairs."""
    import random

    from logtide.operators import stage

    rng = random.Random(5)
    entries = [("t", i % 2, i, rng.randrange(0, 5000), rng.choice([0, 1, 2, 3, 64, 100, 1000, 2**33])) for i in range(120)]
    asked = [("t", p, o) for p in (0, 1, 2) for o in [0, 1, 4999, 2**32, 2**40, *(rng.randrange(0, 6000) for _ in range(40))]]
    got = stage.covering_entry(
        spark.createDataFrame(entries, "topic string, partition int, segment bigint, base_offset bigint, record_count bigint"),
        spark.createDataFrame(asked, "topic string, partition int, offset bigint"),
    ).collect()
    want = []
    for t, p, o in asked:
        hits = [(t, p, o, s, b, n) for _, q, s, b, n in entries if p == q and b <= o < b + n]
        want += hits or [(t, p, o, None, None, None)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_a_budget_by_slots_is_the_budget(spark):
    import random

    from pyspark.sql import functions as F

    from logtide.operators import fetch

    rng = random.Random(6)
    rows = spark.createDataFrame([("t", p, o, rng.choice([0, 1, 50, 400])) for p in range(3) for o in range(0, 900, p + 1)], "topic string, partition int, offset bigint, bytes bigint")
    for most in (0, 1, 500, 20_000, 10**9):
        plain, cut = fetch.within_budget(rows, most), fetch.within_budget(rows, most, slot=F.expr("offset div 64"))
        assert sorted(plain.collect()) == sorted(cut.collect())
