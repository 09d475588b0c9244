"""Registered queries over the engine's operators, and SQL that gives the same rows.

The log is the projection of ``events`` by operators.log.events_log; tables of transactions, commits,
members, rules and limits are derived from the driver's tables, so that each query covers all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import prefix_of
from ..operators import access, catalog, fetch, groups, producers, retention, segments, stage, txn
from ..operators.log import events_log
from ..operators.stage import KEY

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LOG_SQL = """log AS (
  SELECT event_type AS topic, CAST(user_id % 4 AS INTEGER) AS "partition",
    row_number() OVER (PARTITION BY event_type, user_id % 4 ORDER BY ts, event_id) - 1 AS "offset",
    ts, user_id AS key, value, props, event_id, user_id % 7 AS producer_id, 'org.env.' || event_type AS prefix, event_id // 5 AS txn_id,
    CASE (event_id // 5) % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'committed' ELSE 'aborted' END AS txn_state,
    epoch_us(ts) // 1000 AS timestamp_ms, CAST(61 + coalesce(octet_length(encode(props)), 0) AS BIGINT) AS bytes
  FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL),
stage AS (SELECT topic, "partition", min("offset") AS log_start, max("offset") + 1 AS high_watermark FROM log GROUP BY ALL),
txns AS (
  SELECT txn_id, txn_id AS producer_id, topic, "partition", min("offset") AS first_offset, max("offset") AS last_offset,
    CASE WHEN max(ts) >= (SELECT max(ts) FROM log) - INTERVAL 1 DAY THEN 'BEGIN' WHEN txn_id % 3 = 2 THEN 'ABORTED' ELSE 'COMMITTED' END AS state
  FROM log GROUP BY txn_id, topic, "partition")"""
RETENTION_SQL = """policies AS (SELECT DISTINCT topic, CASE topic WHEN 'error' THEN NULL WHEN 'view' THEN 3 * 86400000 WHEN 'click' THEN 10 * 86400000 ELSE 604800000 END AS retention_ms FROM log),
clock AS (SELECT max(timestamp_ms) AS now_ms FROM log)"""


def register(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.replace("{LOG}", LOG_SQL).replace("{RETENTION}", RETENTION_SQL)
        return f

    return put


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with times in milliseconds and record sizes."""
    ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return events_log(spark, sf_dir).withColumn("timestamp_ms", ms).withColumn("bytes", (61 + F.coalesce(F.octet_length("props"), F.lit(0))).cast("bigint"))


def transactions(records: DataFrame) -> DataFrame:
    """A transaction for every five events, a row for each topition it touches; those of the last day are open."""
    last = records.agg((F.max("ts") - F.expr("interval 1 day")).alias("_open"))
    t = records.groupBy("txn_id", *KEY).agg(F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), F.max("ts").alias("_ts"))
    t = t.crossJoin(F.broadcast(last))  # one row
    state = F.when(F.col("_ts") >= F.col("_open"), F.lit("BEGIN")).when(F.col("txn_id") % 3 == 2, F.lit("ABORTED")).otherwise(F.lit("COMMITTED"))
    return t.select("txn_id", F.col("txn_id").alias("producer_id"), *KEY, "first_offset", "last_offset", state.alias("state"))


def _policies(records: DataFrame) -> DataFrame:
    t = F.col("topic")
    ms = F.when(t == "error", F.lit(None).cast("bigint")).when(t == "view", F.lit(3 * 86_400_000)).when(t == "click", F.lit(10 * 86_400_000)).otherwise(F.lit(604_800_000)).cast("bigint")
    return records.select("topic").distinct().select("topic", F.lit(True).alias("deletes"), ms.alias("retention_ms"))


@register("""WITH {LOG} SELECT topic, "partition", "offset", event_id FROM log""")
def log_assign_offsets(spark, sf_dir):
    return log(spark, sf_dir).select(*KEY, "offset", "event_id")


@register("""SELECT topic, array_to_string(string_split(topic, '.')[1:3], '.') AS prefix, count(*) AS records
FROM (SELECT 'org.env.' || event_type || '.p' || (user_id % 4) AS topic FROM events) GROUP BY ALL""")
def log_route_prefix(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    name = F.concat(F.lit("org.env."), "event_type", F.lit(".p"), (F.col("user_id") % 4).cast("string"))
    return e.groupBy(name.alias("topic")).agg(F.count("*").alias("records")).withColumn("prefix", prefix_of("topic"))


@register("""WITH {LOG} SELECT topic, "partition", log_start, high_watermark, high_watermark AS last_stable FROM stage""")
def offset_stage(spark, sf_dir):
    return stage.offset_stage(log(spark, sf_dir))


@register("""WITH {LOG} SELECT topic, "partition", -2 AS timestamp_ms, log_start AS "offset" FROM stage""")
def list_offsets_earliest(spark, sf_dir):
    return _listed(spark, sf_dir, -2)


@register("""WITH {LOG} SELECT topic, "partition", -1 AS timestamp_ms, high_watermark AS "offset" FROM stage""")
def list_offsets_latest(spark, sf_dir):
    return _listed(spark, sf_dir, -1)


def _listed(spark, sf_dir, what):
    records = log(spark, sf_dir)
    at = stage.offset_stage(records)
    return stage.list_offsets(records, at.select(*KEY, F.lit(what).alias("timestamp_ms")), at)


DAYS_SQL = """days AS (SELECT DISTINCT topic, "partition", timestamp_ms // 86400000 * 86400000 + 43200000 AS timestamp_ms FROM log)"""


def _days(records: DataFrame) -> DataFrame:
    """A request for noon of every day a topition has records of."""
    return records.select(*KEY, (F.expr("timestamp_ms div 86400000") * 86_400_000 + 43_200_000).alias("timestamp_ms")).distinct()


@register(f"""WITH {{LOG}}, {DAYS_SQL}
SELECT d.topic, d."partition", d.timestamp_ms, (SELECT min(l."offset") FROM log l WHERE l.topic = d.topic AND l."partition" = d."partition" AND l.timestamp_ms >= d.timestamp_ms) AS "offset" FROM days d""")
def list_offsets_for_time(spark, sf_dir):
    records = log(spark, sf_dir)
    return stage.list_offsets(records, _days(records))


@register(f"""WITH {{LOG}}, {DAYS_SQL}, segs AS (SELECT topic, "partition", "offset" // 64 AS segment, min("offset") AS base_offset, max(timestamp_ms) AS max_timestamp FROM log GROUP BY ALL)
SELECT d.topic, d."partition", d.timestamp_ms, min(s.base_offset) AS found FROM days d JOIN segs s ON s.topic = d.topic AND s."partition" = d."partition" AND s.max_timestamp >= d.timestamp_ms GROUP BY ALL""")
def list_offsets_for_time_segment(spark, sf_dir):
    records = log(spark, sf_dir)
    return stage.offset_for_time_by_segment(segments.manifest(records), _days(records))


@register("""WITH {LOG}, r AS (SELECT l.*, coalesce(sum(bytes) OVER (PARTITION BY topic, "partition" ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM log l JOIN stage s USING (topic, "partition") WHERE l."offset" >= s.high_watermark // 2)
SELECT topic, "partition", "offset", ts, key, value FROM r WHERE before < 65536""")
def fetch_from_offset(spark, sf_dir):
    records = log(spark, sf_dir)
    middle = stage.offset_stage(records).select(*KEY, F.expr("high_watermark div 2").alias("offset"))
    return fetch.fetch(records, middle, max_bytes=65_536, least_bytes=61).select(*KEY, "offset", "ts", "key", "value")


@register("""WITH {LOG}, r AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY topic, "partition" ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM log)
SELECT topic, "partition", "offset", bytes FROM r WHERE before < 4096""")
def fetch_max_bytes(spark, sf_dir):
    records = log(spark, sf_dir)
    start = records.select(*KEY).distinct().withColumn("offset", F.lit(0).cast("bigint"))
    return fetch.fetch(records, start, max_bytes=4_096, least_bytes=61).select(*KEY, "offset", "bytes")


@register("""WITH {LOG}, kept AS (SELECT topic, "partition", high_watermark // 4 AS log_start, high_watermark FROM stage),
asked AS (SELECT topic, "partition", unnest([0, high_watermark // 2, high_watermark, high_watermark + 10]) AS "offset" FROM stage UNION ALL SELECT topic, "partition", high_watermark // 3 FROM stage)
SELECT a.topic, a."partition", a."offset", CASE WHEN a."offset" < k.log_start THEN 1 WHEN a."offset" >= high_watermark // 3 AND a."offset" < high_watermark // 3 + 5 THEN 1 ELSE 0 END AS error_code, k.high_watermark, k.log_start
FROM asked a JOIN kept k USING (topic, "partition")""")
def fetch_status_out_of_range(spark, sf_dir):
    at = stage.offset_stage(log(spark, sf_dir))
    hw = F.col("high_watermark")
    third = F.expr("high_watermark div 3")
    kept = at.select(*KEY, F.expr("high_watermark div 4").alias("log_start"), "high_watermark")
    gap = at.select(*KEY, (third + 5).alias("floor"), third.alias("served_end"), hw.alias("served_at_high"))
    asked = at.select(*KEY, F.explode(F.array(F.lit(0).cast("bigint"), F.expr("high_watermark div 2"), hw, hw + 10, third)).alias("offset"))
    return fetch.fetch_status(asked, kept, truncation=gap)


LSO_SQL = """spans AS (SELECT t.*, s.high_watermark, CASE WHEN state = 'BEGIN' THEN s.high_watermark ELSE last_offset + 1 END AS e FROM txns t JOIN stage s USING (topic, "partition")),
marked AS (SELECT *, CASE WHEN first_offset >= coalesce(max(e) OVER (PARTITION BY topic, "partition" ORDER BY first_offset, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) THEN 1 ELSE 0 END AS fresh FROM spans),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY topic, "partition" ORDER BY first_offset, e) AS island FROM marked),
islands AS (SELECT topic, "partition", high_watermark, island, min(first_offset) AS first, bool_or(state = 'BEGIN') AS open FROM numbered GROUP BY ALL),
lso AS (SELECT topic, "partition", coalesce(min(first) FILTER (open), high_watermark) AS last_stable FROM islands GROUP BY topic, "partition", high_watermark)"""
COMMITTED_SQL = """committed AS (SELECT l.* FROM log l JOIN lso USING (topic, "partition") WHERE l."offset" < last_stable
  AND NOT EXISTS (SELECT 1 FROM txns t WHERE t.state = 'ABORTED' AND t.topic = l.topic AND t."partition" = l."partition" AND t.producer_id = l.txn_id AND l."offset" BETWEEN t.first_offset AND t.last_offset))"""


def _committed(spark, sf_dir):
    records = log(spark, sf_dir).withColumn("producer_id", F.col("txn_id"))
    return txn.committed_records(records, transactions(records), stage.offset_stage(records))


@register(f"""WITH {{LOG}}, {LSO_SQL}, {COMMITTED_SQL}, r AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY topic, "partition" ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM committed WHERE "offset" >= 10)
SELECT topic, "partition", "offset", ts, key, value FROM r WHERE before < 16384""")
def fetch_read_committed(spark, sf_dir):
    rows = _committed(spark, sf_dir).filter("offset >= 10")
    return fetch.within_budget(rows, 16_384, slot=F.expr("offset div 256")).select(*KEY, "offset", "ts", "key", "value")


@register(f"""WITH {{LOG}}, {LSO_SQL}, {COMMITTED_SQL} SELECT topic, "partition", "offset", txn_id FROM committed""")
def txn_committed_records(spark, sf_dir):
    return _committed(spark, sf_dir).select(*KEY, "offset", "txn_id")


@register(f"""WITH {{LOG}}, {LSO_SQL} SELECT * FROM lso""")
def txn_last_stable_offset(spark, sf_dir):
    records = log(spark, sf_dir)
    return txn.last_stable_offset(transactions(records), stage.offset_stage(records))


@register("""WITH {LOG} SELECT topic, "partition", coalesce(min(first_offset) FILTER (state = 'BEGIN'), any_value(high_watermark)) AS last_stable FROM txns JOIN stage USING (topic, "partition") GROUP BY ALL""")
def txn_last_stable_offset_kafka(spark, sf_dir):
    records = log(spark, sf_dir)
    return txn.last_stable_offset(transactions(records), stage.offset_stage(records), mode="kafka")


@register("""WITH {LOG} SELECT topic, "partition", producer_id, first_offset, last_offset FROM txns WHERE state = 'ABORTED'""")
def txn_aborted_ranges(spark, sf_dir):
    return txn.aborted_ranges(transactions(log(spark, sf_dir)))


@register("""WITH {LOG}, pending AS (SELECT 'g' || (txn_id % 5) AS "group", topic, "partition", max("offset") + 1 AS "offset", max(ts) AS committed_at, txn_id FROM log GROUP BY ALL),
seen AS (SELECT DISTINCT txn_id FROM txns WHERE state = 'COMMITTED')
SELECT "group", topic, "partition", arg_max("offset", (committed_at, "offset")) AS "offset" FROM pending JOIN seen USING (txn_id) GROUP BY ALL""")
def txn_offset_commit_visible(spark, sf_dir):
    records = log(spark, sf_dir)
    pending = records.groupBy(F.concat(F.lit("g"), (F.col("txn_id") % 5).cast("string")).alias("group"), *KEY, "txn_id").agg((F.max("offset") + 1).alias("offset"), F.max("ts").alias("committed_at"))
    pending = pending.withColumn("transactional_id", F.col("txn_id").cast("string")).withColumn("producer_id", F.col("txn_id"))
    seen = txn.visible_offset_commits(pending, transactions(records).withColumn("transactional_id", F.col("txn_id").cast("string")))
    return groups.latest_commits(seen).drop("committed_at")


@register("""WITH {LOG} SELECT topic, "partition", count(*) AS records, count(*) FILTER (value < 5) AS tombstones, min("offset") FILTER (NOT value < 5) AS first_value FROM log GROUP BY ALL""")
def fetch_tombstone_filter(spark, sf_dir):
    dead = F.col("value") < 5
    return log(spark, sf_dir).groupBy(*KEY).agg(F.count("*").alias("records"), F.count_if(dead).alias("tombstones"), F.min(F.when(~dead, F.col("offset"))).alias("first_value"))


@register("""WITH {LOG} SELECT topic, "partition", min("offset") AS log_start, count(*) AS records FROM log JOIN stage USING (topic, "partition") WHERE "offset" >= high_watermark // 3 GROUP BY ALL""")
def truncate_below_floor(spark, sf_dir):
    records = log(spark, sf_dir)
    at = stage.offset_stage(records)
    floors = retention.truncate(at.select(*KEY, F.lit(0).cast("bigint").alias("floor")), at.select(*KEY, F.expr("high_watermark div 3").alias("offset")), at)
    return retention.above_floor(records, floors).groupBy(*KEY).agg(F.min("offset").alias("log_start"), F.count("*").alias("records"))


@register("""WITH {LOG} SELECT topic, "partition", key, "offset", value FROM log QUALIFY row_number() OVER (PARTITION BY topic, "partition", key ORDER BY "offset" DESC) = 1""")
def compact_latest_per_key(spark, sf_dir):
    return retention.compact(log(spark, sf_dir).select(*KEY, "key", "offset", "value")).select(*KEY, "key", "offset", "value")


@register("""WITH {LOG} SELECT * FROM (SELECT topic, "partition", key, "offset", CASE WHEN value < 5 THEN NULL ELSE value END AS value FROM log QUALIFY row_number() OVER (PARTITION BY topic, "partition", key ORDER BY "offset" DESC) = 1) WHERE value IS NOT NULL""")
def compact_with_deletes(spark, sf_dir):
    rows = log(spark, sf_dir).select(*KEY, "key", "offset", F.when(F.col("value") < 5, None).otherwise(F.col("value")).alias("value"))
    return retention.compact(rows, drop_tombstones=True).select(*KEY, "key", "offset", "value")


@register("""WITH {LOG}, {RETENTION}, entries AS (SELECT CASE WHEN topic IN ('view', 'click') THEN 'a-' ELSE 'b-' END || (timestamp_ms // 86400000) AS segment, topic, max(timestamp_ms) AS max_timestamp FROM log GROUP BY ALL)
SELECT segment FROM entries JOIN policies USING (topic), clock GROUP BY segment HAVING bool_and(retention_ms IS NOT NULL) AND max(max_timestamp) < any_value(now_ms) - max(retention_ms)""")
def retention_whole_segment(spark, sf_dir):
    records = log(spark, sf_dir)
    name = F.concat(F.when(F.col("topic").isin("view", "click"), F.lit("a-")).otherwise(F.lit("b-")), F.expr("timestamp_ms div 86400000").cast("string"))
    entries = records.groupBy(name.alias("segment"), "topic").agg(F.max("timestamp_ms").alias("max_timestamp"))
    now = records.agg(F.max("timestamp_ms")).first()[0]
    return retention.expired_segments(entries, _policies(records), now)


@register("""WITH {LOG}, {RETENTION} SELECT topic, "partition", count(*) FILTER (retention_ms IS NOT NULL AND timestamp_ms < now_ms - retention_ms) AS expired FROM log JOIN policies USING (topic), clock GROUP BY ALL HAVING expired > 0""")
def retention_topic_policy(spark, sf_dir):
    records = log(spark, sf_dir)
    now = records.agg(F.max("timestamp_ms")).first()[0]
    return retention.expired_records(records, _policies(records), now).groupBy(*KEY).agg(F.count("*").alias("expired"))


@register("""WITH {LOG} SELECT topic, "partition", "offset" // 64 AS segment, min("offset") AS base_offset, count(*) AS record_count, CAST(sum(bytes) AS BIGINT) AS byte_len, max(timestamp_ms) AS max_timestamp FROM log GROUP BY ALL""")
def segment_manifest(spark, sf_dir):
    return segments.manifest(log(spark, sf_dir))


ENTRIES_SQL = """entries AS (SELECT topic, "partition", "offset" // 32 AS seq, min("offset") - (CASE WHEN ("offset" // 32) % 3 = 2 THEN 16 ELSE 0 END) AS base_offset,
  count(*) + (CASE WHEN ("offset" // 32) % 5 = 1 THEN 20 ELSE 0 END) AS record_count, ("offset" // 32) % 4 AS writer_epoch FROM log GROUP BY topic, "partition", "offset" // 32)"""


@register(f"""WITH RECURSIVE {{LOG}}, {ENTRIES_SQL},
ordered AS (SELECT *, row_number() OVER (PARTITION BY topic, "partition" ORDER BY base_offset, writer_epoch DESC, seq DESC) AS rn FROM entries),
sweep AS (
  SELECT topic, "partition", rn, seq, writer_epoch, base_offset, record_count, true AS kept, base_offset + record_count AS covered FROM ordered WHERE rn = 1
  UNION ALL
  SELECT o.topic, o."partition", o.rn, o.seq, o.writer_epoch, o.base_offset, o.record_count, o.base_offset >= s.covered, CASE WHEN o.base_offset >= s.covered THEN o.base_offset + o.record_count ELSE s.covered END
  FROM sweep s JOIN ordered o ON o.topic = s.topic AND o."partition" = s."partition" AND o.rn = s.rn + 1)
SELECT topic, "partition", seq, writer_epoch, base_offset, record_count FROM sweep WHERE kept""")
def segment_overlap_winners(spark, sf_dir):
    seq = F.expr("offset div 32")
    entries = log(spark, sf_dir).groupBy(*KEY, seq.alias("seq")).agg(F.min("offset").alias("base_offset"), F.count("*").alias("record_count"))
    entries = entries.withColumn("base_offset", F.col("base_offset") - F.when(F.col("seq") % 3 == 2, 16).otherwise(0)).withColumn("record_count", F.col("record_count") + F.when(F.col("seq") % 5 == 1, 20).otherwise(0))
    return segments.overlap_winners(entries.withColumn("writer_epoch", F.col("seq") % 4))


@register("""WITH {LOG}, live AS (SELECT prefix, timestamp_ms // 3600000 AS seq, CAST(sum(bytes) AS BIGINT) AS byte_len FROM log GROUP BY ALL),
ranked AS (SELECT *, count(*) OVER (PARTITION BY prefix) AS n, row_number() OVER (PARTITION BY prefix ORDER BY seq DESC) AS age FROM live),
old AS (SELECT * FROM ranked WHERE n > 64 AND age > 16)
SELECT prefix, seq, byte_len, CAST(coalesce(sum(byte_len) OVER (PARTITION BY prefix ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // 4096 AS bin FROM old""")
def segment_merge_plan(spark, sf_dir):
    live = log(spark, sf_dir).groupBy("prefix", F.expr("timestamp_ms div 3600000").alias("seq")).agg(F.sum("bytes").alias("byte_len"))
    return segments.merge_plan(live, threshold=64, target_bytes=4_096)


BATCHES_SQL = """batches AS (SELECT producer_id, topic, "partition", CAST(rn // 50 - (CASE WHEN event_id % 17 = 0 AND rn >= 50 THEN 1 ELSE 0 END) AS INTEGER) AS epoch,
  CAST(rn % 50 - (CASE WHEN event_id % 13 = 0 AND rn % 50 > 0 THEN 1 ELSE 0 END) AS INTEGER) AS base_sequence, CAST(rn % 50 - (CASE WHEN event_id % 13 = 0 AND rn % 50 > 0 THEN 1 ELSE 0 END) AS INTEGER) AS last_sequence, "offset" AS base_offset, "offset" AS position
  FROM (SELECT *, row_number() OVER (PARTITION BY producer_id, topic, "partition" ORDER BY "offset") - 1 AS rn FROM log))"""


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch for each event, fifty to an epoch; some repeat a sequence, some come from a fenced epoch."""
    rn = F.row_number().over(Window.partitionBy(*producers.KEY).orderBy("offset")) - 1
    rows = log(spark, sf_dir).withColumn("rn", rn)
    seq = (F.expr("rn % 50") - F.when((F.col("event_id") % 13 == 0) & (F.expr("rn % 50") > 0), 1).otherwise(0)).cast("int")
    epoch = (F.expr("rn div 50") - F.when((F.col("event_id") % 17 == 0) & (F.col("rn") >= 50), 1).otherwise(0)).cast("int")
    return rows.select(*producers.KEY, epoch.alias("epoch"), seq.alias("base_sequence"), seq.alias("last_sequence"), F.col("offset").alias("base_offset"), F.col("offset").alias("position"))


@register(f"""WITH {{LOG}}, {BATCHES_SQL}, e AS (SELECT *, coalesce(lag(CASE WHEN last_sequence = 2147483647 THEN 0 ELSE last_sequence + 1 END) OVER (PARTITION BY producer_id, topic, "partition", epoch ORDER BY position), 0) AS expected FROM batches)
SELECT producer_id, topic, "partition", epoch, base_sequence, base_offset, CAST(expected AS INTEGER) AS expected FROM e WHERE base_sequence <> expected""")
def producer_sequence_gaps(spark, sf_dir):
    return producers.sequence_gaps(batches(spark, sf_dir)).select(*producers.KEY, "epoch", "base_sequence", "base_offset", "expected")


@register(f"""WITH {{LOG}}, {BATCHES_SQL}, d AS (SELECT *, coalesce({", ".join(f'''CASE WHEN lag(base_sequence, {i}) OVER w = base_sequence THEN lag(base_offset, {i}) OVER w END''' for i in range(1, 6))}) AS original_offset
  FROM batches WINDOW w AS (PARTITION BY producer_id, topic, "partition", epoch ORDER BY position))
SELECT producer_id, topic, "partition", epoch, base_sequence, base_offset, original_offset FROM d WHERE original_offset IS NOT NULL""")
def producer_duplicates_last5(spark, sf_dir):
    return producers.duplicates(batches(spark, sf_dir)).select(*producers.KEY, "epoch", "base_sequence", "base_offset", "original_offset")


@register(f"""WITH {{LOG}}, {BATCHES_SQL}, f AS (SELECT *, max(epoch) OVER (PARTITION BY producer_id, topic, "partition" ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM batches)
SELECT producer_id, topic, "partition", epoch, base_offset, seen FROM f WHERE epoch < seen""")
def producer_epoch_fence(spark, sf_dir):
    return producers.fenced(batches(spark, sf_dir)).select(*producers.KEY, "epoch", "base_offset", "seen")


@register()
def producer_classify(spark, sf_dir):
    return producers.classify(batches(spark, sf_dir))


COMMITS_SQL = """commits AS (SELECT 'g' || (key % 3) AS "group", topic, "partition", "offset" AS "offset", ts AS committed_at FROM log),
latest AS (SELECT "group", topic, "partition", arg_max("offset", (committed_at, "offset")) AS "offset" FROM commits GROUP BY ALL)"""


def commits(records: DataFrame) -> DataFrame:
    """Every event commits its own offset for one of three groups."""
    return records.select(F.concat(F.lit("g"), (F.col("key") % 3).cast("string")).alias("group"), *KEY, "offset", F.col("ts").alias("committed_at"))


@register(f"""WITH {{LOG}}, {COMMITS_SQL} SELECT l.*, high_watermark, greatest(high_watermark - "offset", 0) AS lag FROM latest l JOIN stage USING (topic, "partition")""")
def group_lag(spark, sf_dir):
    records = log(spark, sf_dir)
    return groups.lag(commits(records), stage.offset_stage(records))


@register(f"""WITH {{LOG}}, {COMMITS_SQL} SELECT * FROM latest""")
def group_offset_latest_commit(spark, sf_dir):
    return groups.latest_commits(commits(log(spark, sf_dir))).drop("committed_at")


MEMBERS_SQL = """members AS (SELECT c_mktsegment AS "group", c_name AS member_id, c_custkey * 37 % 60000 AS last_contact_ms, 10000 + c_nationkey * 1000 AS session_timeout_ms, c_nationkey FROM customer)"""


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as members of the group of their market segment."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select(F.col("c_mktsegment").alias("group"), F.col("c_name").alias("member_id"), (F.col("c_custkey") * 37 % 60_000).alias("last_contact_ms"), (10_000 + F.col("c_nationkey") * 1_000).alias("session_timeout_ms"), "c_nationkey")


@register(f"""WITH {MEMBERS_SQL} SELECT "group", member_id FROM members WHERE 60000 - last_contact_ms > session_timeout_ms OR c_nationkey = 7""")
def group_expired_members(spark, sf_dir):
    m = members(spark, sf_dir)
    return groups.expired_members(m.select("group", "member_id"), m.filter("c_nationkey <> 7"), 60_000)


@register(f"""WITH {MEMBERS_SQL}, gen AS (SELECT 'BUILDING' AS "group", 3 AS generation_id, 'x' AS leader UNION ALL SELECT 'MACHINERY', 4, NULL UNION ALL SELECT 'FURNITURE', 5, 'y' UNION ALL SELECT 'nobody', 1, NULL),
n AS (SELECT "group", count(*) AS k FROM members GROUP BY ALL)
SELECT g."group", g.generation_id, coalesce(k, 0) AS members, CASE WHEN k IS NULL THEN 'Empty' WHEN g."group" = 'BUILDING' THEN 'Stable' WHEN leader IS NOT NULL THEN 'CompletingRebalance' ELSE 'Assigning' END AS state FROM gen g LEFT JOIN n ON g."group" = n."group" """)
def group_state(spark, sf_dir):
    gen = spark.createDataFrame([("BUILDING", 3, "x"), ("MACHINERY", 4, None), ("FURNITURE", 5, "y"), ("nobody", 1, None)], "group string, generation_id int, leader string")
    return groups.states(gen, members(spark, sf_dir), spark.createDataFrame([("BUILDING", 3), ("FURNITURE", 4)], "group string, generation_id int"))


TOPICS_SQL = """topics AS (SELECT n_name AS topic, CAST(n_nationkey * 20 + 3 AS INTEGER) AS partitions, n_regionkey FROM nation)"""


def _topics(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return n.select(F.col("n_name").alias("topic"), (F.col("n_nationkey") * 20 + 3).cast("int").alias("partitions"), "n_regionkey")


@register(f"""WITH {MEMBERS_SQL}, {TOPICS_SQL}, subs AS (SELECT "group", member_id, topic, partitions FROM members JOIN topics ON n_regionkey = c_nationkey % 5),
ranked AS (SELECT *, row_number() OVER (PARTITION BY "group", topic ORDER BY member_id) - 1 AS r, count(*) OVER (PARTITION BY "group", topic) AS n FROM subs),
runs AS (SELECT *, r * (partitions // n) + least(r, partitions % n) AS first, partitions // n + (CASE WHEN r < partitions % n THEN 1 ELSE 0 END) AS size FROM ranked)
SELECT "group", member_id, topic, CAST(unnest(range(first, first + size)) AS INTEGER) AS "partition" FROM runs""")
def assign_range(spark, sf_dir):
    topics = _topics(spark, sf_dir)
    by_region = topics.groupBy("n_regionkey").agg(F.collect_list("topic").alias("topics"))
    subscribed = members(spark, sf_dir).withColumn("n_regionkey", F.expr("c_nationkey % 5")).join(by_region, "n_regionkey")
    return groups.assign_range(subscribed.select("group", "member_id", "topics"), topics.select("topic", "partitions"))


@register(f"""WITH {MEMBERS_SQL}, {TOPICS_SQL}, ranked AS (SELECT "group", member_id, row_number() OVER (PARTITION BY "group" ORDER BY member_id) - 1 AS r, count(*) OVER (PARTITION BY "group") AS n FROM members),
dealt AS (SELECT topic, p AS "partition", row_number() OVER (ORDER BY topic, p) - 1 AS i FROM (SELECT topic, CAST(unnest(range(partitions)) AS INTEGER) AS p FROM topics))
SELECT "group", member_id, topic, "partition" FROM dealt JOIN ranked ON i % n = r""")
def assign_round_robin(spark, sf_dir):
    topics = _topics(spark, sf_dir).select("topic", "partitions")
    names = topics.agg(F.collect_list("topic").alias("topics"))  # the names of all topics, one row
    return groups.assign_round_robin(members(spark, sf_dir).select("group", "member_id").crossJoin(F.broadcast(names)), topics)


@register("""WITH t AS (SELECT n_name AS topic, CASE n_regionkey WHEN 0 THEN 'compact' WHEN 1 THEN 'compact,delete' WHEN 2 THEN 'delete' END AS policy, CASE WHEN n_nationkey % 2 = 0 AND n_regionkey > 1 THEN '1000' END AS ms FROM nation)
SELECT topic, 'cleanup.policy' AS name, coalesce(policy, 'delete') AS value FROM t UNION ALL
SELECT topic, 'retention.ms', coalesce(ms, '604800000') FROM t WHERE coalesce(policy, 'delete') <> 'compact'""")
def config_effective(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("topic"), "n_regionkey", "n_nationkey")
    policy = n.filter("n_regionkey in (0, 1, 2)").select("topic", F.lit("cleanup.policy").alias("name"), F.expr("case n_regionkey when 0 then 'compact' when 1 then 'compact,delete' else 'delete' end").alias("value"))
    limit = n.filter("n_nationkey % 2 = 0 and n_regionkey > 1").select("topic", F.lit("retention.ms").alias("name"), F.lit("1000").alias("value"))
    return catalog.with_defaults(policy.unionByName(limit), n)


ACLS = [
    ("TOPIC", "pro", "PREFIXED", "User:u1", "*", "READ", "ALLOW"), ("TOPIC", "*", "LITERAL", "User:*", "*", "DESCRIBE", "ALLOW"), ("TOPIC", "error", "LITERAL", "User:u2", "*", "ALL", "DENY"),
    ("TOPIC", "cli", "PREFIXED", "User:u2", "10.0.0.1", "WRITE", "ALLOW"), ("TOPIC", "view", "LITERAL", "User:u3", "*", "ALL", "ALLOW"), ("TOPIC", "p", "PREFIXED", "User:u3", "*", "WRITE", "DENY"),
    ("GROUP", "*", "LITERAL", "User:u1", "*", "READ", "ALLOW"), ("TOPIC", "signup", "LITERAL", "User:u1", "*", "ALTER_CONFIGS", "ALLOW"),
]
ACL_COLUMNS = "resource_type string, resource_name string, pattern string, principal string, host string, operation string, permission string"
ACLS_SQL = f"""acls(resource_type, resource_name, pattern, principal, host, operation, permission) AS (VALUES {", ".join(map(str, ACLS))})"""


@register(f"""WITH {ACLS_SQL}, asked AS (SELECT event_id AS request_id, 'User:u' || (user_id % 5) AS principal, CASE WHEN event_id % 2 = 0 THEN '10.0.0.1' ELSE '10.0.0.2' END AS host, 'TOPIC' AS resource_type, event_type AS resource_name,
  (['READ', 'WRITE', 'DESCRIBE', 'DESCRIBE_CONFIGS', 'ALTER'])[event_id % 5 + 1] AS operation FROM events),
hits AS (SELECT request_id, bool_or(a.permission = 'DENY' AND a.operation IN ('ALL', q.operation)) AS deny,
  bool_or(a.permission = 'ALLOW' AND (a.operation IN ('ALL', q.operation) OR (q.operation = 'DESCRIBE' AND a.operation IN ('READ', 'WRITE', 'DELETE', 'ALTER')) OR (q.operation = 'DESCRIBE_CONFIGS' AND a.operation = 'ALTER_CONFIGS'))) AS allow
  FROM asked q JOIN acls a ON a.resource_type = q.resource_type AND a.principal IN (q.principal, 'User:*') AND a.host IN ('*', q.host)
    AND ((a.pattern = 'LITERAL' AND a.resource_name IN ('*', q.resource_name)) OR (a.pattern = 'PREFIXED' AND starts_with(q.resource_name, a.resource_name))) GROUP BY request_id)
SELECT q.request_id, q.principal = 'User:u4' OR (NOT coalesce(deny, false) AND coalesce(allow, false)) AS allowed FROM asked q LEFT JOIN hits USING (request_id)""")
def acl_decision(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    operation = F.element_at(F.array(*map(F.lit, ("READ", "WRITE", "DESCRIBE", "DESCRIBE_CONFIGS", "ALTER"))), (F.col("event_id") % 5 + 1).cast("int"))
    asked = e.select(
        F.col("event_id").alias("request_id"), F.concat(F.lit("User:u"), (F.col("user_id") % 5).cast("string")).alias("principal"), F.when(F.col("event_id") % 2 == 0, F.lit("10.0.0.1")).otherwise(F.lit("10.0.0.2")).alias("host"),
        F.lit("TOPIC").alias("resource_type"), F.col("event_type").alias("resource_name"), operation.alias("operation"),
    )
    return access.decide(asked, spark.createDataFrame(ACLS, ACL_COLUMNS), super_users=["User:u4"]).select("request_id", "allowed")


@register(f"""WITH {ACLS_SQL} SELECT * FROM acls WHERE resource_type = 'TOPIC' AND ((pattern = 'LITERAL' AND resource_name IN ('*', 'purchase')) OR (pattern = 'PREFIXED' AND starts_with('purchase', resource_name)))""")
def acl_filter_match(spark, sf_dir):
    return access.acl_filter(spark.createDataFrame(ACLS, ACL_COLUMNS), resource_type="TOPIC", resource_name="purchase", pattern=access.MATCH)


QUOTAS_SQL = """quotas AS (SELECT c_name AS entity_user, CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 10.0 END AS producer_byte_rate, CASE WHEN c_custkey % 4 = 0 THEN 7.5 END AS consumer_byte_rate FROM customer WHERE c_custkey % 2 = 0)"""


@register(f"""WITH {QUOTAS_SQL} SELECT 'User:' || c_name AS principal, CAST(coalesce(producer_byte_rate, 1024.0) / 4 AS DOUBLE) AS producer_byte_rate, CAST(coalesce(consumer_byte_rate, 2048.0) / 4 AS DOUBLE) AS consumer_byte_rate, CAST(NULL AS DOUBLE) AS request_rate
FROM customer LEFT JOIN quotas ON c_name = entity_user""")
def quota_effective(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    own = c.filter("c_custkey % 2 = 0").select(F.col("c_name").alias("entity_user"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") * F.lit(10.0)).alias("producer_byte_rate"), F.when(F.col("c_custkey") % 4 == 0, F.lit(7.5)).alias("consumer_byte_rate"), F.lit(None).cast("double").alias("request_rate"))
    default = spark.createDataFrame([(None, 1024.0, 2048.0, None)], own.schema)
    return access.effective_quotas(c.select(F.concat(F.lit("User:"), "c_name").alias("principal")), own.unionByName(default), replicas=4)


@register("""WITH RECURSIVE c AS (SELECT 'u' || (user_id % 50) AS principal, (epoch_us(ts) // 1000) / 1000.0::DOUBLE AS at_s, value * 8::DOUBLE AS cost, row_number() OVER (PARTITION BY user_id % 50 ORDER BY epoch_us(ts) // 1000, value, event_id) AS rn FROM events),
fold AS (
  SELECT principal, at_s, cost, rn, greatest(least(0.01::DOUBLE, CAST('inf' AS DOUBLE)) - cost, -0.6::DOUBLE) AS tokens FROM c WHERE rn = 1
  UNION ALL
  SELECT c.principal, c.at_s, c.cost, c.rn, greatest(least(0.01::DOUBLE, f.tokens + greatest(0::DOUBLE, c.at_s - f.at_s) * 0.01::DOUBLE) - c.cost, 0.01::DOUBLE * -60) FROM fold f JOIN c ON c.principal = f.principal AND c.rn = f.rn + 1)
SELECT principal, count(*) AS charges, count(*) FILTER (tokens < 0) AS waits, CAST(round(sum(least(10::DOUBLE, greatest(0::DOUBLE, -tokens / 0.01::DOUBLE)))) AS BIGINT) AS wait_s FROM fold GROUP BY ALL""")
def quota_throttle(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)") / F.lit(1000.0)
    charges = e.select(F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("principal"), at.alias("at_s"), (F.col("value") * F.lit(8.0)).alias("cost"), F.lit(0.01).alias("rate"))
    waits = access.throttle(charges)
    return waits.groupBy("principal").agg(F.count("*").alias("charges"), F.count_if(F.col("wait_s") > 0).alias("waits"), F.round(F.sum("wait_s")).cast("bigint").alias("wait_s"))


@register("""SELECT o_custkey, c_name, o_orderkey, o_orderstatus, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def cdc_latest_state(spark, sf_dir):
    o, c = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    last = o.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("l"))
    return last.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_custkey", "c_name", "l.o_orderkey", "l.o_orderstatus", "l.o_totalprice")


@register("""WITH {LOG} SELECT prefix, count(*) AS records, CAST(sum(bytes) AS BIGINT) AS bytes FROM log GROUP BY ALL""")
def log_bytes_by_prefix(spark, sf_dir):
    return segments.bytes_by_prefix(log(spark, sf_dir))


@register("""WITH {LOG} SELECT topic, "partition", count(*) AS records, count(DISTINCT producer_id) AS producers, CAST(sum(bytes) AS BIGINT) AS bytes FROM log GROUP BY ALL""")
def log_growth(spark, sf_dir):
    return stage.table_growth(log(spark, sf_dir))


@register("""WITH {LOG}, segs AS (SELECT topic, "partition", "offset" // 64 AS segment, min("offset") AS base_offset, count(*) AS record_count FROM log GROUP BY ALL),
asked AS (SELECT topic, "partition", high_watermark // 2 AS "offset" FROM stage UNION ALL SELECT topic, "partition", high_watermark FROM stage)
SELECT a.topic, a."partition", a."offset", segment, base_offset, record_count FROM asked a LEFT JOIN segs s ON a.topic = s.topic AND a."partition" = s."partition" AND base_offset <= a."offset" AND a."offset" < base_offset + record_count""")
def fetch_covering_segment(spark, sf_dir):
    records = log(spark, sf_dir)
    asked = stage.offset_stage(records).select(*KEY, F.explode(F.array(F.expr("high_watermark div 2"), F.col("high_watermark"))).alias("offset"))
    return stage.covering_entry(segments.manifest(records), asked)


@register("""SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS events FROM events GROUP BY ALL""")
def tumbling_event_counts(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("events")).select("event_type", F.col("w.start").alias("window_start"), "events")


@register("""WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM m)
SELECT user_id, min(ts) AS session_start, count(*) AS events FROM s GROUP BY user_id, session""")
def session_windows(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count("*").alias("events")).select("user_id", F.col("w.start").alias("session_start"), "events")


@register(f"""WITH {{LOG}}, {LSO_SQL} SELECT topic, "partition", -1 AS timestamp_ms, last_stable AS "offset" FROM lso""")
def list_offsets_read_committed(spark, sf_dir):
    records = log(spark, sf_dir)
    at = stage.offset_stage(records, txns=transactions(records))
    return stage.list_offsets(records, at.select(*KEY, F.lit(-1).alias("timestamp_ms")), at, isolation="read_committed")


@register("""WITH {LOG}, r AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY topic, "partition" ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM log),
taken AS (SELECT * FROM r WHERE before < 4096), sums AS (SELECT topic, "partition", sum(bytes) AS b FROM taken GROUP BY ALL),
spent AS (SELECT topic, "partition", coalesce(sum(b) OVER (ORDER BY topic, "partition" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM sums)
SELECT topic, "partition", "offset", bytes FROM taken JOIN spent USING (topic, "partition") WHERE before + spent < 30000""")
def fetch_total_budget(spark, sf_dir):
    records = log(spark, sf_dir)
    start = records.select(*KEY).distinct().withColumn("offset", F.lit(0).cast("bigint"))
    return fetch.fetch(records, start, max_bytes=4_096, least_bytes=61, total_bytes=30_000).select(*KEY, "offset", "bytes")


@register("""WITH asked AS (SELECT n_nationkey AS position, CASE WHEN n_nationkey % 4 = 0 THEN r_name ELSE n_name END AS topic FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT position, topic, CASE WHEN n_regionkey IN (0, 1, 2) THEN 'id-' || n_nationkey END AS topic_id, CASE WHEN n_regionkey IN (0, 1, 2) THEN CAST(n_nationkey * 20 + 3 AS INTEGER) END AS partitions,
  CASE WHEN n_name IS NULL OR n_regionkey NOT IN (0, 1, 2) THEN 29 ELSE 0 END AS error_code FROM asked LEFT JOIN nation ON topic = n_name""")
def topic_metadata(spark, sf_dir):
    n, r = spark.read.parquet(f"{sf_dir}/nation.parquet"), spark.read.parquet(f"{sf_dir}/region.parquet")
    there = _topics(spark, sf_dir).join(n.select("n_name", "n_nationkey"), F.col("topic") == F.col("n_name")).select("topic", F.concat(F.lit("id-"), "n_nationkey").alias("topic_id"), "partitions", "n_regionkey")
    asked = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("position"), F.when(F.col("n_nationkey") % 4 == 0, F.col("r_name")).otherwise(F.col("n_name")).alias("topic"))
    return catalog.metadata(there, asked, allowed=there.filter("n_regionkey in (0, 1, 2)"))


@register(f"""WITH {TOPICS_SQL} SELECT topic, "partition" FROM (SELECT topic, CAST(unnest(range(partitions)) AS INTEGER) AS "partition" FROM topics) WHERE (topic, "partition") > ('FRANCE', 5) ORDER BY topic, "partition" LIMIT 300""")
def describe_topic_partitions(spark, sf_dir):
    rows = _topics(spark, sf_dir).select("topic", F.explode(F.sequence(F.lit(0), F.col("partitions") - 1)).alias("partition"))
    return fetch.page(rows, 300, after=("FRANCE", 5))


@register("""SELECT o_orderpriority AS "group", CAST(o_custkey % 3 AS INTEGER) AS generation_id, o_orderstatus AS topic, CAST(o_orderkey % 500 AS INTEGER) AS "partition", count(DISTINCT o_custkey % 20) AS members FROM orders GROUP BY ALL HAVING members > 1""")
def group_overlapping_assignments(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    given = o.select(F.col("o_orderpriority").alias("group"), (F.col("o_custkey") % 3).cast("int").alias("generation_id"), F.col("o_orderstatus").alias("topic"), (F.col("o_orderkey") % 500).cast("int").alias("partition"), (F.col("o_custkey") % 20).alias("member_id"))
    return groups.overlapping(given)


@register(f"""WITH {MEMBERS_SQL}, gone AS (SELECT DISTINCT "group" FROM members WHERE 60000 - last_contact_ms > session_timeout_ms)
SELECT DISTINCT m."group", CASE WHEN g."group" IS NULL THEN 1 ELSE 2 END AS generation_id, CASE WHEN g."group" IS NULL THEN 'lead' END AS leader FROM members m LEFT JOIN gone g ON m."group" = g."group" """)
def group_sweep(spark, sf_dir):
    m = members(spark, sf_dir)
    gen = m.select("group").distinct().select("group", F.lit(1).alias("generation_id"), F.lit("lead").alias("leader"))
    return groups.sweep(gen, m.select("group", "member_id"), m, 60_000)[0]


@register(f"""WITH {{LOG}}, {BATCHES_SQL} SELECT producer_id, topic, "partition", epoch, base_sequence, last_sequence, base_offset, position FROM batches""")
def producer_coordinates(spark, sf_dir):
    b = batches(spark, sf_dir).withColumn("base", F.expr("base_offset div 64 * 64"))
    one = F.struct("producer_id", F.col("epoch").alias("producer_epoch"), "base_sequence", "last_sequence", (F.col("base_offset") - F.col("base")).alias("offset_delta"), F.lit(0).alias("flags"))
    entries = b.groupBy("topic", "partition", "base").agg(F.collect_list(one).alias("producers")).withColumnRenamed("base", "base_offset")  # 64 offsets an entry
    return producers.coordinates(entries)


@register("""WITH {LOG}, entries AS (SELECT (timestamp_ms // 86400000)::VARCHAR AS segment, topic, "partition", max("offset") + 1 AS e FROM log GROUP BY ALL)
SELECT segment FROM entries JOIN stage USING (topic, "partition") GROUP BY segment HAVING bool_and(e <= high_watermark // 2)""")
def segment_reclaimable(spark, sf_dir):
    records = log(spark, sf_dir)
    day = F.expr("timestamp_ms div 86400000").cast("string")
    entries = records.groupBy(day.alias("segment"), *KEY).agg(F.min("offset").alias("base_offset"), F.max("offset").alias("_last")).withColumn("record_count", F.col("_last") + 1 - F.col("base_offset"))
    floors = stage.offset_stage(records).select(*KEY, F.expr("high_watermark div 2").alias("floor"))
    return retention.reclaimable(entries, floors)


@register("""WITH p AS (SELECT DISTINCT 'org.env.' || event_type AS prefix FROM events), c AS (SELECT 'org.env.' || event_type AS prefix, max(epoch_us(ts) // 1000) AS done FROM events WHERE event_type <> 'view' GROUP BY ALL)
SELECT prefix FROM p WHERE prefix NOT IN (SELECT prefix FROM c WHERE done > (SELECT max(done) FROM c) - 1200000)""")
def maintenance_due(spark, sf_dir):
    records = log(spark, sf_dir)
    claims = records.filter("topic <> 'view'").groupBy("prefix").agg(F.max("timestamp_ms").alias("maintained_at_ms"))
    now = claims.agg(F.max("maintained_at_ms")).first()[0]
    return retention.due_for_maintenance(records.select("prefix").distinct(), claims, now, 1_200_000)


@register("""WITH o AS (SELECT 'g' || (user_id % 200) AS "group", max(epoch_us(ts) // 1000) AS newest FROM events GROUP BY ALL) SELECT "group" FROM o WHERE newest < (SELECT max(newest) FROM o) - 21600000""")
def group_expiry(spark, sf_dir):
    owned = log(spark, sf_dir).select(F.concat(F.lit("g"), (F.col("key") % 200).cast("string")).alias("group"), F.col("timestamp_ms").alias("modified_ms"))
    now = owned.agg(F.max("modified_ms")).first()[0]
    return retention.expired_groups(owned, now, 21_600_000)


@register("""WITH {LOG}, b AS (SELECT topic, "partition", producer_id, "offset" // 16 AS position, count(*) AS n, max(timestamp_ms) AS newest FROM log GROUP BY ALL)
SELECT topic, "partition", producer_id, CAST(sum(n) - 1 AS INTEGER) AS last_offset_delta, max(newest) AS max_timestamp, CAST(sum(n) AS BIGINT) AS records, CAST(sum(n) * (sum(n) - 1) / 2 AS BIGINT) AS deltas FROM b GROUP BY ALL""")
def batches_combined(spark, sf_dir):
    records = log(spark, sf_dir)
    rank = F.row_number().over(Window.partitionBy(*KEY, "producer_id", F.expr("offset div 16")).orderBy("offset")) - 1
    parts = records.withColumn("offset_delta", rank).groupBy(*KEY, "producer_id", F.expr("offset div 16").alias("position")).agg(
        F.max("offset_delta").alias("last_offset_delta"), F.max("timestamp_ms").alias("max_timestamp"), F.array_sort(F.collect_list(F.struct("offset_delta", "key"))).alias("records")
    )  # 16 records a batch
    done = segments.combine_batches(parts)
    deltas = F.aggregate("records", F.lit(0).cast("bigint"), lambda a, x: a + x["offset_delta"])
    return done.select(*KEY, "producer_id", "last_offset_delta", "max_timestamp", F.size("records").cast("bigint").alias("records"), deltas.alias("deltas"))


@register("""WITH {LOG} SELECT topic, "partition", high_watermark AS base_offset, CAST(count(*) AS BIGINT) AS appended, max(high_watermark + rn) AS last_offset FROM (SELECT topic, "partition", row_number() OVER (PARTITION BY topic, "partition" ORDER BY event_id) - 1 AS rn FROM log WHERE value > 20) JOIN stage USING (topic, "partition") GROUP BY ALL""")
def log_append(spark, sf_dir):
    records = log(spark, sf_dir)
    at = stage.offset_stage(records)
    from ..operators.log import append

    grown = append(records.select(*KEY, "offset", "event_id"), at, records.filter("value > 20").select(*KEY, "event_id"), ["event_id"])
    new = grown.join(at.select(*KEY, "high_watermark"), KEY).filter("offset >= high_watermark")
    return new.groupBy(*KEY, F.col("high_watermark").alias("base_offset")).agg(F.count("*").alias("appended"), F.max("offset").alias("last_offset"))


@register(f"""WITH {QUOTAS_SQL} SELECT entity_user, CAST(producer_byte_rate AS DOUBLE) AS producer_byte_rate, CAST(consumer_byte_rate AS DOUBLE) AS consumer_byte_rate FROM quotas WHERE entity_user = 'Customer#000000012'""")
def quota_describe(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    own = c.filter("c_custkey % 2 = 0").select(F.col("c_name").alias("entity_user"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") * F.lit(10.0)).alias("producer_byte_rate"), F.when(F.col("c_custkey") % 4 == 0, F.lit(7.5)).alias("consumer_byte_rate"))
    return access.describe_quotas(own, user="Customer#000000012")


from . import protocol_queries as _more  # noqa: E402, F401  registers further queries
