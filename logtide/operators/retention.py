"""Compaction, retention and truncation. Watermarks outlive the records below them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import KEY

WEEK_MS = 604_800_000


def compact(records: DataFrame, *, policies: DataFrame | None = None, drop_tombstones: bool = False, payload: list[str] | None = None) -> DataFrame:
    """The latest record of each key, at its own offset; records without a key stay.

    One aggregation by key with map-side combining, so a hot key costs one row a task and not one window.
    ``policies`` (topic, compacted) limits it to compacted topics; all other records stay.
    """
    columns = records.columns
    others = [c for c in columns if c not in (*KEY, "key")]
    keyed = records.filter(F.col("key").isNotNull())
    loose = records.filter(F.col("key").isNull())
    if policies is not None:
        marked = records.join(policies.select("topic", F.col("compacted").alias("_c")), "topic", "left")
        keyed = marked.filter(F.coalesce("_c", F.lit(False)) & F.col("key").isNotNull()).drop("_c")
        loose = marked.filter(~F.coalesce("_c", F.lit(False)) | F.col("key").isNull()).drop("_c")
    latest = keyed.groupBy(*KEY, "key").agg(F.max_by(F.struct(*others), "offset").alias("_r")).select(*KEY, "key", *(F.col(f"_r.{c}").alias(c) for c in others)).select(*columns)
    if drop_tombstones:
        latest = latest.filter(F.col("value").isNotNull())
    return latest.unionByName(loose.select(*columns))


def compact_behind(batch: DataFrame, head: DataFrame) -> DataFrame:
    """A batch without what newer batches (``head``: topic, partition, key) or its own later records supersede."""
    return compact(batch.filter("key is not null").join(head.select(*KEY, "key").distinct(), [*KEY, "key"], "left_anti").select(*batch.columns).unionByName(batch.filter("key is null")))


def policy_of(configs: DataFrame) -> DataFrame:
    """(topic, deletes, compacted, retention_ms) from topic configs.

    No policy means delete, no retention a week, -1 for ever. A topic that is only compacted has no time limit.
    """
    wide = configs.groupBy("topic").agg(F.max(F.when(F.col("name") == "cleanup.policy", F.col("value"))).alias("policy"), F.max(F.when(F.col("name") == "retention.ms", F.col("value"))).alias("ms"))
    parts = F.split(F.coalesce("policy", F.lit("delete")), r"\s*,\s*")
    deletes = F.array_contains(parts, "delete")
    ms = F.coalesce(F.col("ms").try_cast("bigint"), F.lit(WEEK_MS))
    return wide.select("topic", deletes.alias("deletes"), F.array_contains(parts, "compact").alias("compacted"), F.when(deletes & (ms >= 0), ms).alias("retention_ms"))


def expired_segments(entries: DataFrame, policies: DataFrame, now_ms: int | Column) -> DataFrame:
    """Segments that go: all their topics may expire, and the newest record is older than the longest retention.

    ``entries`` is the manifest: segment, topic, max_timestamp. Topics without a policy keep a week.
    """
    joined = entries.join(policies.select("topic", F.col("deletes").alias("_d"), F.col("retention_ms").alias("_r")), "topic", "left")
    unknown = F.col("_d").isNull()
    limit = F.when(unknown, F.lit(WEEK_MS)).otherwise(F.col("_r"))
    grouped = joined.groupBy("segment").agg(F.max("max_timestamp").alias("newest"), F.max(limit).alias("longest"), F.bool_and(limit.isNotNull()).alias("all"))
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    return grouped.filter(F.col("all") & (F.col("newest") < now - F.col("longest"))).select("segment")


def expired_records(records: DataFrame, policies: DataFrame, now_ms: int) -> DataFrame:
    """Records whose own time is past their topic's retention."""
    joined = records.join(policies.select("topic", F.col("retention_ms").alias("_r"), F.lit(True).alias("_k")), "topic", "left")
    limit = F.when(F.col("_k").isNull(), F.lit(WEEK_MS)).otherwise(F.col("_r"))
    return joined.filter(limit.isNotNull() & (F.col("timestamp_ms") < F.lit(now_ms) - limit)).drop("_r", "_k")


def truncate(truncation: DataFrame, requests: DataFrame, stage: DataFrame) -> DataFrame:
    """Low watermarks after a delete request (topic, partition, offset): -1 means the end; floors never fall."""
    asked = requests.join(stage.select(*KEY, "high_watermark", "log_start"), KEY)
    floor = F.least(F.when(F.col("offset") == -1, F.col("high_watermark")).otherwise(F.col("offset")), F.col("high_watermark"))
    new = asked.select(*KEY, F.greatest(floor, F.col("log_start")).alias("floor"))
    return truncation.select(*KEY, "floor").unionByName(new).groupBy(*KEY).agg(F.max("floor").alias("floor"))


def above_floor(records: DataFrame, truncation: DataFrame) -> DataFrame:
    floors = truncation.select(*KEY, F.col("floor").alias("_floor"))
    return records.join(floors, KEY, "left").filter(F.col("offset") >= F.coalesce("_floor", F.lit(0))).drop("_floor")


def reclaimable(entries: DataFrame, truncation: DataFrame) -> DataFrame:
    """Segments every slice of which ends at or below its floor."""
    joined = entries.join(truncation.select(*KEY, F.col("floor").alias("_f")), KEY, "left")
    dead = F.col("base_offset") + F.col("record_count") <= F.coalesce("_f", F.lit(0))
    return joined.groupBy("segment").agg(F.bool_and(dead).alias("dead")).filter("dead").select("segment")


def current_incarnation(records: DataFrame, topics: DataFrame) -> DataFrame:
    """Records of topics as they exist now: one re-created under the same name inherits nothing."""
    return records.join(topics.select("topic", "incarnation"), ["topic", "incarnation"], "left_semi")


def due_for_maintenance(prefixes: DataFrame, claims: DataFrame, now_ms: int, recency_ms: int) -> DataFrame:
    """Prefixes that nobody has maintained within ``recency_ms``."""
    return prefixes.join(claims.filter(F.col("maintained_at_ms") > now_ms - recency_ms).select("prefix"), "prefix", "left_anti")


def expired_groups(owned: DataFrame, now_ms: int, keep_ms: int = WEEK_MS) -> DataFrame:
    """Groups of which nothing they own (group, modified_ms) is newer than ``keep_ms``."""
    return owned.groupBy("group").agg(F.max("modified_ms").alias("newest")).filter(F.col("newest") < now_ms - keep_ms).select("group")
