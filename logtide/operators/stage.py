"""Watermarks and offset lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import model as M

KEY = ["topic", "partition"]


def offset_stage(records: DataFrame, floors: DataFrame | None = None, txns: DataFrame | None = None, *, lso_mode: str = "reference") -> DataFrame:
    """One row a topition: log_start, last_stable, high_watermark.

    ``floors`` (topic, partition, high) holds watermarks that survive retention and compaction: the high
    watermark never falls below, and a drained log starts at its end. Without ``txns`` the last stable offset
    is the high watermark, and no transaction table is read.
    """
    found = records.groupBy(*KEY).agg(F.min("offset").alias("start"), (F.max("offset") + 1).alias("end"))
    if floors is not None:
        found = found.join(floors.select(*KEY, F.col("high").alias("floor")), KEY, "full")
    else:
        found = found.withColumn("floor", F.lit(None).cast("bigint"))
    stage = found.withColumn("high_watermark", F.greatest(F.coalesce("end", F.lit(0)), F.coalesce("floor", F.lit(0))).cast("bigint"))
    stage = stage.select(*KEY, F.coalesce("start", "high_watermark").cast("bigint").alias("log_start"), "high_watermark")
    if txns is None:
        return stage.withColumn("last_stable", F.col("high_watermark"))
    from .txn import last_stable_offset

    stable = last_stable_offset(txns, stage, mode=lso_mode)
    return stage.join(stable, KEY, "left").withColumn("last_stable", F.coalesce("last_stable", "high_watermark"))


def list_offsets(records: DataFrame, requests: DataFrame, stage: DataFrame | None = None, *, isolation: str = "read_uncommitted") -> DataFrame:
    """Per request (topic, partition, timestamp_ms): the offset asked for.

    -2 asks for the log start, -1 for the end (the last stable offset when reading committed), any other
    number for the first record at or after that time: null if there is none.
    """
    stage = offset_stage(records) if stage is None else stage
    end = "last_stable" if isolation == "read_committed" else "high_watermark"
    at = stage.select(*KEY, F.col("log_start").alias("_start"), F.col(end).alias("_end"))
    timed = requests.filter(F.col("timestamp_ms") >= 0).select(*KEY, "timestamp_ms").distinct()
    found = offset_for_time(records, timed)
    out = requests.join(at, KEY, "left").join(found, [*KEY, "timestamp_ms"], "left")
    known = F.when(F.col("timestamp_ms") == M.EARLIEST, F.col("_start")).when(F.col("timestamp_ms") == M.LATEST, F.col("_end")).otherwise(F.col("found"))
    return out.select(*KEY, "timestamp_ms", known.cast("bigint").alias("offset"))


def offset_for_time(records: DataFrame, requests: DataFrame, *, slot_ms: int = 3_600_000) -> DataFrame:
    """(topic, partition, timestamp_ms, found): the smallest offset at or after a time; record precision.

    Times need not follow offsets. Records are summed up a slot of time; a request is answered by the
    records of its own slot, found by an equi-join, and by the smallest offset of all later slots.
    """
    slot = lambda c: F.floor(F.col(c) / slot_ms).cast("bigint")
    rows = records.select(*KEY, "offset", F.col("timestamp_ms").alias("_at")).withColumn("_slot", slot("_at"))
    asked = requests.select(*KEY, F.col("timestamp_ms").alias("_asked")).distinct().withColumn("_slot", slot("_asked"))
    own = asked.join(rows, [*KEY, "_slot"]).filter("_at >= _asked").groupBy(*KEY, "_asked").agg(F.min("offset").alias("own"))
    slots = rows.groupBy(*KEY, "_slot").agg(F.min("offset").alias("_low")).unionByName(asked.select(*KEY, "_slot", F.lit(None).cast("bigint").alias("_low")))
    slots = slots.groupBy(*KEY, "_slot").agg(F.min("_low").alias("_low"))
    after = F.min("_low").over(Window.partitionBy(*KEY).orderBy(F.desc("_slot")).rowsBetween(Window.unboundedPreceding, -1))
    later = slots.withColumn("later", after).select(*KEY, "_slot", "later")
    out = asked.join(later, [*KEY, "_slot"], "left").join(own, [*KEY, "_asked"], "left")
    return out.select(*KEY, F.col("_asked").alias("timestamp_ms"), F.least("own", "later").alias("found"))


def offset_for_time_by_segment(segments: DataFrame, requests: DataFrame) -> DataFrame:
    """The base offset of the first segment that ends at or after a time; reads the manifest only."""
    ends = segments.select(*KEY, F.col("base_offset").alias("offset"), F.col("max_timestamp").alias("timestamp_ms"))
    return offset_for_time(ends, requests).filter("found is not null")


def table_growth(records: DataFrame) -> DataFrame:
    """Gauges of a log: records, producers and bytes a topition."""
    return records.groupBy(*KEY).agg(F.count("*").alias("records"), F.count_distinct("producer_id").alias("producers"), F.sum("bytes").alias("bytes"))


def covering_entry(segments: DataFrame, requests: DataFrame) -> DataFrame:
    """Range join: the manifest entry that holds each requested offset, null where none does."""
    # An entry is put into the one or two blocks of 2^level offsets that it touches, where 2^level is its size rounded up;
    # an offset asked for lies in one block of each level. So the join is on equal blocks, at any size of an entry.
    entries = segments.select(*KEY, "segment", "base_offset", "record_count").withColumn("_last", F.col("base_offset") + F.col("record_count") - 1)
    entries = entries.filter("record_count > 0").withColumn("_level", F.expr("length(bin(record_count - 1))"))
    entries = entries.withColumn("_block", F.explode(F.expr("array_distinct(array(shiftright(base_offset, _level), shiftright(_last, _level)))")))
    asked = requests.select(*KEY, "offset").distinct().withColumn("_level", F.explode(F.sequence(F.lit(1), F.lit(63)))).withColumn("_block", F.expr("shiftright(offset, _level)"))
    hits = asked.join(entries, [*KEY, "_level", "_block"]).filter("base_offset <= offset and offset <= _last")
    return requests.select(*KEY, "offset").join(hits.select(*KEY, "offset", "segment", "base_offset", "record_count"), [*KEY, "offset"], "left")
