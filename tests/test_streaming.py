"""Stateful streams agree with folds over the same rows."""

import json

from pyspark.sql import functions as F

from logtide.operators import access, producers
from logtide.streaming import stateful


def run(spark, tmp_path, parts, schema, f, name):
    """Runs f over a file stream, one file a micro-batch."""
    source = tmp_path / f"{name}-in"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source / f"{i}"), timestampFormat="yyyy-MM-dd HH:mm:ss.SSS")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{source}/*")
    q = f(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_producers(spark, tmp_path):
    schema = "producer_id bigint, topic string, partition int, epoch int, base_sequence int, last_sequence int, base_offset bigint, position bigint"
    seqs = [(0, 0), (0, 1), (0, 1), (0, 3), (0, 2), (1, 0), (0, 3), (1, 1), (1, 0)]
    rows = [(1, "t", 0, e, s, s, i, i) for i, (e, s) in enumerate(seqs)]
    want = {(r.position, r.outcome, r.admitted_offset) for r in producers.classify(spark.createDataFrame(rows, schema)).collect()}
    got = run(spark, tmp_path, [rows[:4], rows[4:7], rows[7:]], schema, stateful.admit_producers, "producers")
    assert {(r.position, r.outcome, r.admitted_offset) for r in got.collect()} == want
    assert {o for _, o, _ in want} == {"admit", "duplicate", "out_of_order", "fenced"}


def test_throttle(spark, tmp_path):
    schema = "principal string, at_s double, cost double, rate double"
    rows = [("u", float(i), 900.0 + i, 100.0) for i in range(9)]
    want = sorted((r.at_s, r.wait_s) for r in access.throttle(spark.createDataFrame(rows, schema)).collect())
    got = run(spark, tmp_path, [rows[:3], rows[3:]], schema, stateful.throttle, "throttle")
    assert sorted((r.at_s, r.wait_s) for r in got.collect()) == want and want[-1][1] == 10.0


def test_groups(spark, tmp_path):
    def r(at, kind, member="", topics=("t",), generation=-1, assignment=None):
        return ("g", at, kind, member, list(topics), 1000, generation, assignment)

    plan = json.dumps({"a": "p0", "b": "p1"})
    rows = [
        r(0, "join"), r(1, "join", "a"), r(2, "join", "b"), r(3, "join", "a"), r(4, "sync", "b", generation=1), r(5, "sync", "a", generation=1, assignment=plan), r(6, "sync", "b", generation=1),
        r(7, "heartbeat", "a", generation=1), r(8, "heartbeat", "b", generation=0), r(900, "heartbeat", "b", generation=1), r(1200, "heartbeat", "b", generation=1), r(1201, "heartbeat", "a", generation=1), r(1202, "leave", "b"), r(1203, "leave", "b"),
    ]
    want = ["member_id_required", "ok", "ok", "ok", "rebalance_in_progress", "ok", "ok", "ok", "illegal_generation", "ok", "illegal_generation", "unknown_member_id", "ok", "unknown_member_id"]
    df = spark.createDataFrame(rows, stateful.REQUEST)
    batch = stateful.coordinate_batch(df).orderBy("at_ms").collect()
    assert [x.code for x in batch] == want
    assert [x.state for x in batch][5] == "Stable" and batch[6].answer == "p1" and batch[1].leader == "a"
    got = run(spark, tmp_path, [rows[:5], rows[5:9], rows[9:]], stateful.REQUEST, stateful.coordinate, "coordinate")
    assert [x.code for x in got.orderBy("at_ms").collect()] == want


def test_expired_members(spark, tmp_path):
    schema = "group string, member_id string, at_ms bigint, session_ms int"
    parts = [[("g", "a", 1000, 500), ("g", "b", 1000, 500)], [("g", "b", 1400, 500)], [("g", "c", 1800, 500)], [("g", "c", 1801, 500)]]
    got = run(spark, tmp_path, parts, schema, lambda s: stateful.expired_members(s.withColumn("at", F.timestamp_millis("at_ms"))), "expired")
    assert {(r.member_id, r.last_contact_ms) for r in got.collect()} == {("a", 1000)}


def test_append_once(spark, tmp_path):
    put = stateful.append_once(str(tmp_path / "sink"))
    put(spark.range(3), 0)
    put(spark.range(3), 0)
    put(spark.range(2), 1)
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 5
