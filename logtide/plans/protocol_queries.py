"""Registered queries over catalogs, groups, transactions, quotas and scalar columns, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import access, catalog, fetch, groups, metrics, producers, retention, segments, stage, txn
from ..operators import log as log_ops
from ..operators.stage import KEY
from .queries import COMMITS_SQL, MEMBERS_SQL, commits, log, members, register, transactions


def _table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(prefix: str, c) -> F.Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))


# --- groups ---------------------------------------------------------------------------------------

GENERATIONS_SQL = """gens AS (SELECT c_name AS "group", c_nationkey AS generation_id, CASE WHEN c_custkey % 2 = 0 THEN 'x' END AS leader, c_custkey FROM customer),
mem AS (SELECT c_name AS "group", CAST(o_orderkey AS VARCHAR) AS member_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 <> 0),
n AS (SELECT "group", count(*) AS k FROM mem GROUP BY ALL),
states AS (SELECT "group", generation_id, coalesce(k, 0) AS members, CASE WHEN coalesce(k, 0) = 0 THEN 'Empty' WHEN c_custkey % 3 = 0 THEN 'Stable' WHEN leader IS NOT NULL THEN 'CompletingRebalance' ELSE 'Assigning' END AS state
  FROM gens LEFT JOIN n USING ("group"))"""


def _groups(spark, sf_dir):
    """Every customer as a group, two thirds of the orders as members, an assignment for every third group."""
    c = _table(spark, sf_dir, "customer")
    gens = c.select(F.col("c_name").alias("group"), F.col("c_nationkey").alias("generation_id"), F.when(F.col("c_custkey") % 2 == 0, F.lit("x")).alias("leader"))
    mem = _table(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("group"), F.col("o_orderkey").cast("string").alias("member_id"))
    return gens, mem, c.filter("c_custkey % 3 = 0").select(F.col("c_name").alias("group"), F.col("c_nationkey").alias("generation_id"))


@register(f"""WITH {GENERATIONS_SQL} SELECT * FROM states WHERE state IN ('Stable', 'Empty')""")
def group_list_states(spark, sf_dir):
    return groups.list_groups(groups.states(*_groups(spark, sf_dir)), ["Stable", "Empty"])


@register(f"""WITH {GENERATIONS_SQL}, ids AS (SELECT "group", string_agg(member_id, ',' ORDER BY member_id) AS ids FROM mem GROUP BY ALL)
SELECT "group", generation_id, members, state, coalesce(ids, '') AS member_ids FROM states LEFT JOIN ids USING ("group")""")
def group_describe(spark, sf_dir):
    return groups.describe(*_groups(spark, sf_dir)).withColumn("member_ids", F.array_join("member_ids", ","))


@register("""SELECT c_name AS "group" FROM customer WHERE c_name NOT IN ('Customer#000000001', 'Customer#000000007', 'nobody')""")
def group_delete(spark, sf_dir):
    return groups.delete_groups(_groups(spark, sf_dir)[0].select("group"), ["Customer#000000001", "Customer#000000007", "nobody"])


@register("""SELECT c_name AS "group" FROM customer WHERE c_custkey % 4 IN (1, 2) AND 60000 - c_custkey * 37 % 60000 > greatest(CASE WHEN c_nationkey = 3 THEN 0 ELSE c_nationkey * 1000 END, 5000)""")
def group_stalled(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    state = F.element_at(F.array(*map(F.lit, ("Empty", "Assigning", "CompletingRebalance", "Stable"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    rows = c.select(F.col("c_name").alias("group"), state.alias("state"), F.when(F.col("c_nationkey") != 3, F.col("c_nationkey") * 1000).alias("rebalance_timeout_ms"), (F.col("c_custkey") * 37 % 60_000).alias("state_since_ms"))
    return groups.stalled(rows, 60_000, 5_000).select("group")


@register(f"""WITH {MEMBERS_SQL} SELECT "group", member_id FROM members WHERE 60000 - last_contact_ms >= session_timeout_ms // 2""")
def group_renewal_due(spark, sf_dir):
    return groups.renewal_due(members(spark, sf_dir), 60_000).select("group", "member_id")


@register("""SELECT c_name, c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AS same FROM customer""")
def group_same_subscription(spark, sf_dir):
    a, b = F.array("c_mktsegment", "c_name"), F.when(F.col("c_custkey") % 3 == 0, F.array("c_name")).otherwise(F.array("c_name", "c_mktsegment"))
    rows = _table(spark, sf_dir, "customer").select("c_name", "c_custkey", a.alias("a"), F.when(F.col("c_custkey") % 5 != 0, b).alias("b"))
    return rows.select("c_name", groups.same_subscription("a", "b").alias("same"))


@register(f"""WITH {{LOG}}, {COMMITS_SQL}, asked AS (SELECT 'g' || g AS "group", topic, "partition" FROM stage, unnest([0, 1, 9]) AS t(g))
SELECT a."group", a.topic, a."partition", coalesce(l."offset", -1) AS "offset" FROM asked a LEFT JOIN latest l USING ("group", topic, "partition")""")
def group_offset_fetch(spark, sf_dir):
    records = log(spark, sf_dir)
    asked = stage.offset_stage(records).select(F.explode(F.array(*map(F.lit, ("g0", "g1", "g9")))).alias("group"), *KEY)
    return groups.fetch_offsets(commits(records), asked)


@register(f"""WITH {{LOG}}, {COMMITS_SQL} SELECT event_id AS position, 'g' || (key % 3) AS "group", topic, "partition", CASE WHEN topic = 'error' THEN 3 ELSE 0 END AS error_code FROM log""")
def group_commit_codes(spark, sf_dir):
    records = log(spark, sf_dir)
    asked = records.select(F.col("event_id").alias("position"), _text("g", F.col("key") % 3).alias("group"), *KEY, "offset", F.col("ts").alias("committed_at"))
    return groups.commit_offsets(commits(records).limit(0), asked, records.filter("topic <> 'error'").select("topic").distinct())[1]


@register(f"""WITH {{LOG}}, {COMMITS_SQL} SELECT "group", topic, "partition", "offset" FROM latest WHERE topic <> 'error'""")
def group_commit_offsets(spark, sf_dir):
    records = log(spark, sf_dir)
    asked = commits(records.filter("offset % 2 = 1")).withColumn("position", F.col("offset"))
    known = commits(records.filter("offset % 2 = 0 and topic <> 'error'"))
    return groups.commit_offsets(known, asked, records.filter("topic <> 'error'").select("topic").distinct())[0].drop("committed_at")


# --- catalog --------------------------------------------------------------------------------------

CATALOG_SQL = """cat AS (SELECT c_name AS topic, 'id-' || c_custkey AS topic_id, c_nationkey + 1 AS partitions FROM customer WHERE c_nationkey < 20)"""


def _catalog(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").filter("c_nationkey < 20")
    return c.select(F.col("c_name").alias("topic"), _text("id-", "c_custkey").alias("topic_id"), (F.col("c_nationkey") + 1).cast("int").alias("partitions"))


def _by_name_or_id(spark, sf_dir):
    odd = F.col("c_custkey") % 2 == 1
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("position"), F.when(~odd, F.col("c_name")).alias("topic"), F.when(odd, _text("id-", "c_custkey")).alias("topic_id"))


@register(f"""WITH {CATALOG_SQL} SELECT c_custkey AS position, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE cat.topic END AS topic, cat.topic_id, cat.partitions FROM customer LEFT JOIN cat ON cat.topic = c_name""")
def topic_resolve(spark, sf_dir):
    return fetch.resolve_topics(_by_name_or_id(spark, sf_dir), _catalog(spark, sf_dir))


@register(f"""WITH {CATALOG_SQL} SELECT c_custkey AS position, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE cat.topic END AS topic, CASE WHEN cat.topic IS NULL THEN 3 ELSE 0 END AS error_code FROM customer LEFT JOIN cat ON cat.topic = c_name""")
def topic_delete_codes(spark, sf_dir):
    return catalog.delete_topics(_catalog(spark, sf_dir), _by_name_or_id(spark, sf_dir))[1]


@register(f"""WITH {CATALOG_SQL} SELECT cat.* FROM cat JOIN customer ON c_name = topic WHERE c_custkey % 3 <> 0""")
def topic_delete(spark, sf_dir):
    return catalog.delete_topics(_catalog(spark, sf_dir), _by_name_or_id(spark, sf_dir).filter("position % 3 = 0"))[0]


NEW_TOPICS_SQL = """asked AS (SELECT o_orderkey AS position, c_name AS topic, CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 7 END AS partitions FROM orders JOIN customer ON o_custkey = c_custkey),
judged AS (SELECT a.*, CASE WHEN cat.topic IS NOT NULL OR row_number() OVER (PARTITION BY a.topic ORDER BY position) > 1 THEN 36 ELSE 0 END AS error_code FROM asked a LEFT JOIN cat ON cat.topic = a.topic)"""


def _created(spark, sf_dir):
    """Every order asks for its customer's name as a topic."""
    o = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    asked = o.select(F.col("o_orderkey").alias("position"), F.col("c_name").alias("topic"), F.when(F.col("o_orderkey") % 2 == 0, -1).otherwise(7).alias("partitions"), F.lit(-1).alias("replication_factor"))
    return catalog.create_topics(_catalog(spark, sf_dir).withColumn("replication_factor", F.lit(1).cast("smallint")).withColumn("incarnation", F.lit(0).cast("bigint")), asked)


@register(f"""WITH {CATALOG_SQL}, {NEW_TOPICS_SQL} SELECT position, topic, error_code FROM judged""")
def topic_create_codes(spark, sf_dir):
    return _created(spark, sf_dir)[1]


@register(f"""WITH {CATALOG_SQL}, {NEW_TOPICS_SQL} SELECT topic, partitions, 1 AS replication_factor FROM cat UNION ALL SELECT topic, CASE WHEN partitions = -1 THEN 3 ELSE partitions END, 1 FROM judged WHERE error_code = 0""")
def topic_create(spark, sf_dir):
    return _created(spark, sf_dir)[0].select("topic", "partitions", "replication_factor")


CONFIGS_SQL = """conf AS (SELECT c_name AS topic, 'cleanup.policy' AS name, CASE c_custkey % 4 WHEN 0 THEN 'compact' WHEN 1 THEN 'delete' ELSE 'compact, delete' END AS value, c_custkey FROM customer WHERE c_custkey % 5 <> 0
  UNION ALL SELECT c_name, 'retention.ms', CASE WHEN c_custkey % 6 = 0 THEN '-1' ELSE CAST(c_custkey * 1000 AS VARCHAR) END, c_custkey FROM customer WHERE c_custkey % 2 = 0)"""


def _configs(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    policy = F.when(F.col("c_custkey") % 4 == 0, F.lit("compact")).when(F.col("c_custkey") % 4 == 1, F.lit("delete")).otherwise(F.lit("compact, delete"))
    ms = F.when(F.col("c_custkey") % 6 == 0, F.lit("-1")).otherwise((F.col("c_custkey") * 1000).cast("string"))
    return c.filter("c_custkey % 5 <> 0").select(F.col("c_name").alias("topic"), F.lit("cleanup.policy").alias("name"), policy.alias("value")).unionByName(
        c.filter("c_custkey % 2 = 0").select(F.col("c_name").alias("topic"), F.lit("retention.ms").alias("name"), ms.alias("value"))
    )


@register(f"""WITH {CONFIGS_SQL} SELECT topic, name, value FROM conf WHERE topic = 'Customer#000000002' AND name IN ('retention.ms', 'other')""")
def config_describe(spark, sf_dir):
    return catalog.describe_configs(_configs(spark, sf_dir), "Customer#000000002", ["retention.ms", "other"])


@register(f"""WITH {CONFIGS_SQL}, wide AS (SELECT topic, max(value) FILTER (name = 'cleanup.policy') AS policy, max(value) FILTER (name = 'retention.ms') AS ms FROM conf GROUP BY ALL),
parts AS (SELECT *, string_split_regex(coalesce(policy, 'delete'), '\\s*,\\s*') AS p, coalesce(CAST(ms AS BIGINT), 604800000) AS n FROM wide)
SELECT topic, list_contains(p, 'delete') AS deletes, list_contains(p, 'compact') AS compacted, CASE WHEN list_contains(p, 'delete') AND n >= 0 THEN n END AS retention_ms FROM parts""")
def config_policy(spark, sf_dir):
    return retention.policy_of(_configs(spark, sf_dir))


def _changes(spark, sf_dir):
    """Every order changes a setting of its customer's topic."""
    o = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    op = F.when(F.col("o_orderkey") % 5 == 0, F.lit("APPEND")).when(F.col("o_orderkey") % 3 == 0, F.lit("DELETE")).otherwise(F.lit("SET"))
    return o.select(F.col("o_orderkey").alias("position"), F.col("c_name").alias("topic"), F.when(F.col("o_orderkey") % 2 == 0, F.lit("retention.ms")).otherwise(F.lit("segment.bytes")).alias("name"), op.alias("op"), F.col("o_orderkey").cast("string").alias("value"))


CHANGES_SQL = """ch AS (SELECT o_orderkey AS position, c_name AS topic, CASE WHEN o_orderkey % 2 = 0 THEN 'retention.ms' ELSE 'segment.bytes' END AS name,
  CASE WHEN o_orderkey % 5 = 0 THEN 'APPEND' WHEN o_orderkey % 3 = 0 THEN 'DELETE' ELSE 'SET' END AS op, CAST(o_orderkey AS VARCHAR) AS value FROM orders JOIN customer ON o_custkey = c_custkey),
fin AS (SELECT topic, name, arg_max(op, position) AS op, arg_max(value, position) AS value FROM ch WHERE op <> 'APPEND' GROUP BY ALL)"""


@register(f"""WITH {CONFIGS_SQL}, {CHANGES_SQL} SELECT topic, name, value FROM conf WHERE (topic, name) NOT IN (SELECT (topic, name) FROM fin) UNION ALL SELECT topic, name, value FROM fin WHERE op = 'SET'""")
def config_alter(spark, sf_dir):
    return catalog.alter_configs(_configs(spark, sf_dir), _changes(spark, sf_dir))[0]


@register(f"""WITH {CHANGES_SQL} SELECT position, topic, name, CASE WHEN op = 'APPEND' THEN 40 ELSE 0 END AS error_code FROM ch""")
def config_alter_codes(spark, sf_dir):
    return catalog.alter_configs(_configs(spark, sf_dir), _changes(spark, sf_dir))[1]


# --- access and quotas ----------------------------------------------------------------------------

ACLS_SQL = """acls AS (SELECT 'TOPIC' AS resource_type, c_mktsegment AS resource_name, CASE WHEN c_custkey % 3 = 0 THEN 'PREFIXED' ELSE 'LITERAL' END AS pattern, 'User:' || c_name AS principal, '*' AS host,
  CASE WHEN c_custkey % 2 = 0 THEN 'READ' ELSE 'WRITE' END AS operation, CASE WHEN c_nationkey = 5 THEN 'DENY' ELSE 'ALLOW' END AS permission, c_custkey FROM customer)"""


def _acls(spark, sf_dir, only: str = "true"):
    k = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").filter(only).select(
        F.lit("TOPIC").alias("resource_type"), F.col("c_mktsegment").alias("resource_name"), F.when(k % 3 == 0, F.lit("PREFIXED")).otherwise(F.lit("LITERAL")).alias("pattern"), _text("User:", "c_name").alias("principal"),
        F.lit("*").alias("host"), F.when(k % 2 == 0, F.lit("READ")).otherwise(F.lit("WRITE")).alias("operation"), F.when(F.col("c_nationkey") == 5, F.lit("DENY")).otherwise(F.lit("ALLOW")).alias("permission"),
    )


@register(f"""WITH {ACLS_SQL} SELECT * EXCLUDE (c_custkey) FROM acls WHERE c_custkey % 7 < 5""")
def acl_create(spark, sf_dir):
    return access.create_acls(_acls(spark, sf_dir, "c_custkey % 7 < 3"), _acls(spark, sf_dir, "c_custkey % 7 between 2 and 4"))


@register(f"""WITH {ACLS_SQL} SELECT * EXCLUDE (c_custkey) FROM acls WHERE NOT (operation = 'READ' AND permission = 'ALLOW' AND resource_name = 'BUILDING')""")
def acl_delete(spark, sf_dir):
    return access.delete_acls(_acls(spark, sf_dir), operation="READ", permission="ALLOW", resource_name="BUILDING")[0]


@register("""WITH ch AS (SELECT c_name AS entity_user, 'producer_byte_rate' AS key, CASE WHEN c_nationkey = 4 THEN NULL WHEN c_nationkey = 6 THEN -1.0 ELSE c_custkey * 2.0 END AS v FROM customer WHERE c_custkey % 2 = 0),
q AS (SELECT c_name AS entity_user, CAST(c_custkey AS DOUBLE) AS p, CASE WHEN c_custkey % 3 = 0 THEN 5.0 END AS c FROM customer WHERE c_custkey % 4 < 2)
SELECT coalesce(q.entity_user, ch.entity_user) AS entity_user, CAST(CASE WHEN ch.key IS NULL OR ch.v < 0 THEN q.p ELSE ch.v END AS DOUBLE) AS producer_byte_rate, CAST(q.c AS DOUBLE) AS consumer_byte_rate, CAST(NULL AS DOUBLE) AS request_rate
FROM q FULL JOIN ch USING (entity_user) WHERE (CASE WHEN ch.key IS NULL OR ch.v < 0 THEN q.p ELSE ch.v END) IS NOT NULL OR q.c IS NOT NULL""")
def quota_alter(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    stored = c.filter("c_custkey % 4 < 2").select(F.col("c_name").alias("entity_user"), k.cast("double").alias("producer_byte_rate"), F.when(k % 3 == 0, F.lit(5.0)).alias("consumer_byte_rate"), F.lit(None).cast("double").alias("request_rate"))
    value = F.when(F.col("c_nationkey") == 4, F.lit(None).cast("double")).when(F.col("c_nationkey") == 6, F.lit(-1.0)).otherwise(k * 2.0)
    return access.alter_quotas(stored, c.filter("c_custkey % 2 = 0").select(k.alias("position"), F.col("c_name").alias("entity_user"), F.lit("producer_byte_rate").alias("key"), value.alias("value")))[0]


# --- producers, transactions, segments ------------------------------------------------------------


@register("""WITH known AS (SELECT 'tx-' || o_custkey AS tid, max(o_custkey) AS pid, max(o_orderkey % 5) AS e FROM orders GROUP BY ALL), top AS (SELECT max(o_custkey) AS t FROM orders),
asked AS (SELECT c_custkey AS position, CASE WHEN c_custkey % 7 <> 0 THEN 'tx-' || c_custkey END AS transactional_id FROM customer)
SELECT position, transactional_id, coalesce(pid, t + sum(CASE WHEN pid IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY position)) AS producer_id, CAST(coalesce(e + 1, 0) AS INTEGER) AS epoch
FROM asked LEFT JOIN known ON tid = transactional_id, top""")
def producer_init_ids(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    known = o.select(_text("tx-", "o_custkey").alias("transactional_id"), F.col("o_custkey").alias("producer_id"), (F.col("o_orderkey") % 5).cast("int").alias("epoch"))
    asked = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("position"), F.when(F.col("c_custkey") % 7 != 0, _text("tx-", "c_custkey")).alias("transactional_id"))
    return producers.init_producers(known, asked)


@register("""WITH b AS (SELECT 'o' || (l_orderkey % 50) AS topic, l_linenumber AS "partition", (l_orderkey * 1000 + l_suppkey) * 100000 + l_partkey AS position, l_partkey AS base_offset, CASE WHEN l_suppkey % 97 = 3 THEN 2 ELSE 0 END AS e FROM lineitem),
f AS (SELECT topic, "partition", arg_min(base_offset, position) AS base, coalesce(arg_min(e, position) FILTER (e <> 0), 0) AS error_code FROM b GROUP BY ALL)
SELECT topic, "partition", CASE WHEN error_code = 0 THEN base ELSE -1 END AS base_offset, error_code FROM f""")
def produce_responses(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem").select(
        _text("o", F.col("l_orderkey") % 50).alias("topic"), F.col("l_linenumber").alias("partition"), ((F.col("l_orderkey") * 1000 + F.col("l_suppkey")) * 100_000 + F.col("l_partkey")).alias("position"), F.col("l_partkey").alias("base_offset"), F.when(F.col("l_suppkey") % 97 == 3, 2).otherwise(0).alias("error_code")
    )
    return log_ops.produce_response(rows)


@register("""WITH {LOG} SELECT topic, "partition", producer_id, "offset", CAST(coalesce(sum(bytes) OVER (PARTITION BY topic, "partition", producer_id ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // 501 AS flush FROM log""")
def request_batches(spark, sf_dir):
    rows = log(spark, sf_dir).withColumn("arrival", F.col("offset"))
    return segments.batcher_groups(rows, 500).select(*KEY, "producer_id", "offset", "flush")


MERGED_SQL = """ent AS (SELECT prefix, timestamp_ms // 3600000 AS seq, topic, "partition", min("offset") AS base_offset, count(*) AS record_count, CAST(sum(bytes) AS BIGINT) AS byte_len, max(timestamp_ms) AS max_timestamp, min(producer_id) AS pid FROM log GROUP BY ALL),
live AS (SELECT prefix, seq, CAST(sum(byte_len) AS BIGINT) AS byte_len FROM ent GROUP BY ALL),
ranked AS (SELECT *, count(*) OVER (PARTITION BY prefix) AS n, row_number() OVER (PARTITION BY prefix ORDER BY seq DESC) AS age FROM live),
plan AS (SELECT prefix, seq, CAST(coalesce(sum(byte_len) OVER (PARTITION BY prefix ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // 4096 AS bin FROM ranked WHERE n > 64 AND age > 16)"""


@register(f"""WITH {{LOG}}, {MERGED_SQL} SELECT prefix, bin, topic, "partition", min(base_offset) AS base_offset, CAST(sum(record_count) AS BIGINT) AS record_count, CAST(sum(byte_len) AS BIGINT) AS byte_len, max(max_timestamp) AS max_timestamp, string_agg(CAST(pid AS VARCHAR), ',' ORDER BY base_offset) AS producers
FROM ent JOIN plan USING (prefix, seq) GROUP BY ALL""")
def segment_merged_entries(spark, sf_dir):
    entries = log(spark, sf_dir).groupBy("prefix", F.expr("timestamp_ms div 3600000").alias("seq"), *KEY).agg(
        F.min("offset").alias("base_offset"), F.count("*").alias("record_count"), F.sum("bytes").alias("byte_len"), F.max("timestamp_ms").alias("max_timestamp"), F.array(F.struct(F.min("producer_id").alias("producer_id"))).alias("producers")
    )
    plan = segments.merge_plan(entries.groupBy("prefix", "seq").agg(F.sum("byte_len").alias("byte_len")), threshold=64, target_bytes=4_096)
    return segments.merged_entries(entries, plan).withColumn("producers", F.array_join(F.transform("producers", lambda p: p["producer_id"].cast("string")), ","))


@register("""WITH {LOG} SELECT prefix, greatest(max("offset") // 100, 37) + 1 AS seq FROM log GROUP BY prefix""")
def segment_next_sequence(spark, sf_dir):
    records = log(spark, sf_dir)
    return segments.next_sequence(records.select("prefix", F.expr("offset div 100").alias("seq")).distinct(), records.select("prefix", F.lit(37).cast("bigint").alias("seq")).distinct())


@register("""WITH {LOG} SELECT topic, "partition", "offset" FROM log WHERE event_id % 2 = length(topic) % 2""")
def topic_incarnation(spark, sf_dir):
    records = log(spark, sf_dir).withColumn("incarnation", F.col("event_id") % 2)
    return retention.current_incarnation(records, records.select("topic", (F.length("topic") % 2).cast("bigint").alias("incarnation")).distinct()).select(*KEY, "offset")


@register("""WITH {LOG}, asked AS (SELECT 'tx' AS transactional_id, topic, "partition" FROM stage WHERE "partition" < 3), there AS (SELECT CAST(txn_id AS VARCHAR) AS transactional_id, state, topic, "partition" FROM txns)
SELECT transactional_id, state, topic, "partition" FROM there UNION ALL SELECT transactional_id, 'BEGIN', topic, "partition" FROM asked""")
def txn_add_partitions(spark, sf_dir):
    records = log(spark, sf_dir)
    new = records.filter("partition < 3").select(*KEY).distinct()
    once = txn.add_partitions(_txns(records), "tx", 1, 0, new)
    return txn.add_partitions(once, "tx", 1, 0, new.limit(5)).select("transactional_id", "state", *KEY)


def _txns(records: DataFrame) -> DataFrame:
    return transactions(records).select(F.col("txn_id").cast("string").alias("transactional_id"), "producer_id", F.lit(0).cast("smallint").alias("producer_epoch"), "state", *KEY, "first_offset", "last_offset")


@register("""WITH {LOG}, t AS (SELECT max(txn_id) FILTER (state = 'BEGIN') AS m FROM txns)
SELECT CAST(txn_id AS VARCHAR) AS transactional_id, topic, "partition", CASE WHEN txn_id = m THEN 'ABORTED' ELSE state END AS state, first_offset, CASE WHEN txn_id = m THEN high_watermark ELSE last_offset END AS last_offset FROM txns JOIN stage USING (topic, "partition"), t""")
def txn_end(spark, sf_dir):
    records = log(spark, sf_dir)
    table = _txns(records)
    last = table.filter("state = 'BEGIN'").agg(F.max(F.col("transactional_id").cast("bigint"))).first()[0]
    after = txn.end_txn(table, stage.offset_stage(records), str(last), last, 0, False)[0]
    return after.select("transactional_id", *KEY, "state", "first_offset", "last_offset")


@register("""WITH {LOG}, t AS (SELECT max(txn_id) FILTER (state = 'BEGIN') AS m FROM txns)
SELECT topic, "partition", high_watermark AS "offset", producer_id, 'commit' AS control FROM txns JOIN stage USING (topic, "partition"), t WHERE txn_id = m""")
def txn_end_markers(spark, sf_dir):
    records = log(spark, sf_dir)
    table = _txns(records)
    last = table.filter("state = 'BEGIN'").agg(F.max(F.col("transactional_id").cast("bigint"))).first()[0]
    return txn.end_txn(table, stage.offset_stage(records), str(last), last, 0, True)[1].select(*KEY, "offset", "producer_id", "control")


# --- reads ----------------------------------------------------------------------------------------


@register("""WITH {LOG}, asked AS (SELECT topic, "partition", unnest([0, high_watermark // 3 + 1, high_watermark]) AS "offset" FROM stage UNION ALL SELECT 'nothing', 0, 5)
SELECT a.topic, a."partition", a."offset", CASE WHEN s.topic IS NULL THEN 3 WHEN a."partition" % 2 = 0 AND a."offset" >= high_watermark // 3 AND a."offset" < high_watermark // 3 + 5 THEN 1 ELSE 0 END AS error_code,
  coalesce(high_watermark, 0) AS high_watermark, CASE WHEN s.topic IS NULL THEN -1 ELSE 0 END AS log_start FROM asked a LEFT JOIN stage s USING (topic, "partition")""")
def fetch_status_stale(spark, sf_dir):
    records = log(spark, sf_dir)
    at = stage.offset_stage(records)
    hw, third = F.col("high_watermark"), F.expr("high_watermark div 3")
    gap = at.select(*KEY, (third + 5).alias("floor"), third.alias("served_end"), F.when(F.col("partition") % 2 == 0, hw).otherwise(hw - 1).alias("served_at_high"))  # odd ones are stale
    asked = at.select(*KEY, F.explode(F.array(F.lit(0).cast("bigint"), third + 1, hw)).alias("offset")).unionByName(spark.createDataFrame([("nothing", 0, 5)], "topic string, partition int, offset bigint"))
    return fetch.fetch_status(asked, at, topics=records.select("topic").distinct(), truncation=gap)


BATCH_SQL = """bat AS (SELECT topic, "partition", "offset" // 10 AS b, min("offset") AS base_offset, count(*) - 1 AS last_offset_delta FROM log GROUP BY ALL)"""


def _ten(records: DataFrame) -> DataFrame:
    return records.groupBy(*KEY, F.expr("offset div 10").alias("b")).agg(F.min("offset").alias("base_offset"), (F.count("*") - 1).alias("last_offset_delta")).drop("b")


@register(f"""WITH {{LOG}}, {BATCH_SQL} SELECT topic, "partition", max(base_offset + last_offset_delta) + 1 AS next_offset FROM bat WHERE b % 4 <> 3 GROUP BY ALL""")
def fetch_next_offset(spark, sf_dir):
    return fetch.next_offset(_ten(log(spark, sf_dir)).filter("base_offset div 10 % 4 <> 3"))


@register(f"""WITH {{LOG}}, {BATCH_SQL} SELECT topic, "partition", base_offset, last_offset_delta FROM bat JOIN stage USING (topic, "partition") WHERE base_offset + last_offset_delta >= high_watermark // 2""")
def fetch_whole_batches(spark, sf_dir):
    records = log(spark, sf_dir)
    return fetch.fetch_batches(_ten(records), stage.offset_stage(records).select(*KEY, F.expr("high_watermark div 2").alias("offset")))


@register("""WITH {LOG}, f AS (SELECT producer_id AS request, sum(bytes) FILTER (topic <> 'error') AS b, bool_or(topic = 'error' AND "offset" = 3) AS e FROM log GROUP BY ALL)
SELECT request, CAST(coalesce(b, 0) AS BIGINT) AS bytes, coalesce(b, 0) >= request * 20000 OR request * 100 >= 500 OR e AS ready FROM f""")
def fetch_min_bytes(spark, sf_dir):
    records = log(spark, sf_dir)
    asked = records.select(F.col("producer_id").alias("request"), *KEY, "offset", (F.col("producer_id") * 20_000).alias("min_bytes"), F.lit(500).alias("max_wait_ms"), (F.col("producer_id") * 100).alias("waited_ms"))
    failed = F.when((F.col("topic") == "error") & (F.col("offset") == 3), 1).otherwise(0)
    return fetch.ready(asked, records.select(F.col("producer_id").alias("request"), F.when(F.col("topic") != "error", F.col("bytes")).alias("bytes"), failed.alias("error_code")))


@register("""WITH {LOG} SELECT topic, "partition", CASE WHEN "partition" = 0 THEN high_watermark + 7 ELSE min("offset") FILTER ("offset" >= high_watermark // 2) END AS log_start,
  CASE WHEN "partition" = 0 THEN high_watermark + 7 ELSE high_watermark END AS high_watermark, CASE WHEN "partition" = 0 THEN high_watermark + 7 ELSE high_watermark END AS last_stable FROM log JOIN stage USING (topic, "partition") GROUP BY topic, "partition", high_watermark""")
def offset_stage_drained(spark, sf_dir):
    records = log(spark, sf_dir)
    at = stage.offset_stage(records)
    left = records.join(at.select(*KEY, F.expr("high_watermark div 2").alias("_h")), KEY).filter("partition <> 0 and offset >= _h")
    return stage.offset_stage(left, floors=at.select(*KEY, F.when(F.col("partition") == 0, F.col("high_watermark") + 7).otherwise(F.col("high_watermark") - 1).alias("high")))


@register("""WITH {LOG}, low AS (SELECT l.* FROM log l JOIN stage USING (topic, "partition") WHERE "offset" < high_watermark // 2), head AS (SELECT DISTINCT topic, "partition", key FROM log JOIN stage USING (topic, "partition") WHERE "offset" >= high_watermark // 2)
SELECT topic, "partition", key, "offset" FROM low ANTI JOIN head USING (topic, "partition", key) QUALIFY row_number() OVER (PARTITION BY topic, "partition", key ORDER BY "offset" DESC) = 1""")
def compact_behind_head(spark, sf_dir):
    records = log(spark, sf_dir)
    rows = records.join(stage.offset_stage(records).select(*KEY, F.expr("high_watermark div 2").alias("_h")), KEY)
    return retention.compact_behind(rows.filter("offset < _h").select(*KEY, "key", "offset"), rows.filter("offset >= _h")).select(*KEY, "key", "offset")


@register("""SELECT 'org.env.' || event_type || '.p' || (user_id % 4) AS topic, CASE WHEN user_id % 4 = 1 THEN 'org.env.' || event_type || '.p1' ELSE 'org.env.' || event_type END AS prefix, count(*) AS records FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL GROUP BY ALL""")
def log_route_compacted(spark, sf_dir):
    e = _table(spark, sf_dir, "events").filter("event_type is not null and user_id is not null")
    name = F.concat(F.lit("org.env."), "event_type", F.lit(".p"), (F.col("user_id") % 4).cast("string"))
    rows = e.groupBy(name.alias("topic")).agg(F.count("*").alias("records"))
    configs = rows.select("topic", F.lit("cleanup.policy").alias("name"), F.when(F.col("topic").endswith(".p1"), F.lit("delete, compact")).otherwise(F.lit("delete")).alias("value"))
    return log_ops.with_prefix(rows, configs)


# --- scalars and metrics --------------------------------------------------------------------------


@register("""SELECT event_id, least(greatest(user_id, 10), 500) AS clamped, lpad(CAST(event_id AS VARCHAR), 20, '0') AS padded, event_id + user_id AS last, ['none', 'gzip', 'snappy', 'lz4', 'zstd'][CASE WHEN event_id % 8 < 5 THEN event_id % 8 + 1 END] AS codec,
  (event_id % 64) & 32 = 32 AS control, (event_id % 64) & 16 = 16 AS transactional, event_type || '-' || lpad(CAST(user_id AS VARCHAR), 10, '0') AS topition, event_type AS topic, CAST(user_id AS INTEGER) AS "partition",
  event_id % 3 <> 0 AND event_id % 2 <> 0 AS idempotent, CASE event_id % 3 WHEN 0 THEN 'abort' WHEN 1 THEN 'commit' END AS kind FROM events WHERE event_type IS NOT NULL AND user_id IS NOT NULL""")
def scalar_columns(spark, sf_dir):
    i = F.col("event_id")
    e = _table(spark, sf_dir, "events").filter("event_type is not null and user_id is not null").withColumn("attributes", (i % 64).cast("int")).withColumn("pid", F.when(i % 3 == 0, -1).otherwise(1)).withColumn("seq", F.when(i % 2 == 0, -1).otherwise(1))
    e = e.withColumn("codec_bits", (i % 8).cast("int")).withColumn("ctl", F.unhex(F.concat(F.lit("0000000"), (i % 3).cast("string")))).withColumn("topition", scalars.topition_text("event_type", "user_id"))
    return e.select(
        "event_id", scalars.clamp("user_id", 10, 500).alias("clamped"), scalars.padded_sequence("event_id").alias("padded"), scalars.max_offset("event_id", "user_id").alias("last"), scalars.compression("codec_bits").alias("codec"),
        scalars.is_control("attributes").alias("control"), scalars.is_transactional("attributes").alias("transactional"), "topition", scalars.topition_topic("topition").alias("topic"), scalars.topition_partition("topition").alias("partition"),
        scalars.is_idempotent("pid", "seq").alias("idempotent"), scalars.control_kind("ctl").alias("kind"),
    )


def _requests(spark, sf_dir):
    """Every event as a request that takes some milliseconds, some of which it is parked."""
    at = F.col("timestamp_ms")
    return log(spark, sf_dir).select(F.col("topic").alias("api"), at.alias("started_ms"), (at + F.col("event_id") % 12_000).alias("ended_ms"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 5_000).alias("parked_ms"), (F.col("event_id") % 11 == 0).cast("int").alias("error_code"))


@register(f"""WITH {{LOG}}, r AS (SELECT topic AS api, event_id % 12000 AS ms, event_id FROM log) SELECT api, count(*) AS requests, count(*) FILTER (event_id % 11 = 0) AS errors, CAST(sum(ms) AS BIGINT) AS total_ms,
{", ".join(f"count(*) FILTER (ms > {lo} AND ms <= {hi}) AS le_{hi}" for lo, hi in zip((-1, *metrics.BUCKETS_MS), metrics.BUCKETS_MS))}, count(*) FILTER (ms > {metrics.BUCKETS_MS[-1]}) AS le_inf FROM r GROUP BY ALL""")
def request_metrics(spark, sf_dir):
    return metrics.request_metrics(_requests(spark, sf_dir))


@register("""WITH {LOG}, r AS (SELECT timestamp_ms + CASE WHEN event_id % 3 = 0 THEN event_id % 5000 ELSE 0 END AS a, timestamp_ms + event_id % 12000 AS b FROM log),
steps AS (SELECT ms, sum(d) AS d FROM (SELECT a AS ms, 1 AS d FROM r WHERE a < b UNION ALL SELECT b AS ms, -1 AS d FROM r WHERE a < b) GROUP BY ms),
level AS (SELECT ms // 60000 AS slot, sum(d) OVER (ORDER BY ms) AS n FROM steps) SELECT slot, CAST(max(n) AS BIGINT) AS most FROM level GROUP BY ALL""")
def request_busy(spark, sf_dir):
    return metrics.busy(_requests(spark, sf_dir))
