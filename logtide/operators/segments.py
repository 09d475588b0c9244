"""The segment manifest: what each segment holds, which entries win, and which segments to merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stage import KEY


def manifest(records: DataFrame, span: int = 64) -> DataFrame:
    """One row for each topition and run of ``span`` offsets: base_offset, record_count, byte_len, max_timestamp."""
    return records.groupBy(*KEY, F.expr(f"offset div {span}").alias("segment")).agg(
        F.min("offset").alias("base_offset"), F.count("*").alias("record_count"), F.sum("bytes").alias("byte_len"), F.max("timestamp_ms").alias("max_timestamp")
    )


def overlap_winners(entries: DataFrame) -> DataFrame:
    """The entries of each topition that stay when writers overlapped.

    In order of base offset, then the higher writer epoch, then the higher sequence, an entry stays unless it
    begins before the end of those that stay. Which end counts depends on what stayed, so the sweep is a
    fold. It runs over one cluster of overlapping entries at a time: a topition of any length is cut where no
    earlier entry reaches, and clusters are short.
    """
    entries = entries.withColumn("_end", F.col("base_offset") + F.col("record_count"))
    order = Window.partitionBy(*KEY).orderBy("base_offset", F.desc("writer_epoch"), F.desc("seq"))
    reach = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    start = F.when(reach.isNull() | (F.col("base_offset") >= reach), F.lit(1)).otherwise(F.lit(0))
    entries = entries.withColumn("_start", start).withColumn("_cluster", F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    one = F.struct("base_offset", (-F.col("writer_epoch")).alias("_e"), (-F.col("seq")).alias("_s"), "_end", "seq", "writer_epoch", "record_count")
    grouped = entries.groupBy(*KEY, "_cluster").agg(F.array_sort(F.collect_list(one)).alias("_all"))
    empty = F.struct(F.lit(-1).cast("bigint").alias("end"), F.slice("_all", F.lit(1), F.lit(0)).alias("kept"))
    sweep = F.aggregate(
        "_all", empty,
        lambda a, x: F.when(x["base_offset"] < a["end"], a).otherwise(F.struct(F.greatest(a["end"], x["_end"]).alias("end"), F.concat(a["kept"], F.array(x)).alias("kept"))),
    )
    kept = grouped.select(*KEY, F.explode(sweep["kept"]).alias("_k"))
    return kept.select(*KEY, "_k.seq", "_k.writer_epoch", "_k.base_offset", "_k.record_count")


def merge_plan(segments: DataFrame, *, threshold: int = 256, keep_newest: int = 16, target_bytes: int = 16 * 1024 * 1024) -> DataFrame:
    """(prefix, seq, bin) of the segments to rewrite together.

    A prefix with more than ``threshold`` live segments merges all but its newest, in sequence, into bins that
    each begin where another ``target_bytes`` are full.
    """
    whole = Window.partitionBy("prefix")
    order = whole.orderBy("seq")
    ranked = segments.withColumn("_n", F.count("*").over(whole)).withColumn("_age", F.row_number().over(whole.orderBy(F.desc("seq"))))
    old = ranked.filter((F.col("_n") > threshold) & (F.col("_age") > keep_newest))
    before = F.coalesce(F.sum("byte_len").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return old.withColumn("bin", F.floor(before / target_bytes).cast("bigint")).select("prefix", "seq", "byte_len", "bin")


def next_sequence(live: DataFrame, floors: DataFrame) -> DataFrame:
    """(prefix, seq): the first sequence a writer may use; ``floors`` (prefix, seq) are the highest ever used, so names of segments that are gone are not used again."""
    both = live.select("prefix", "seq").unionByName(floors.select("prefix", "seq"))
    return both.groupBy("prefix").agg((F.max("seq") + 1).alias("seq"))


def merged_entries(entries: DataFrame, plan: DataFrame) -> DataFrame:
    """Manifest rows of the merged segments: the winning slices of each topition with their producers' coordinates."""
    rows = entries.join(plan.select("prefix", "seq", "bin"), ["prefix", "seq"])
    return rows.groupBy("prefix", "bin", *KEY).agg(
        F.min("base_offset").alias("base_offset"), F.sum("record_count").alias("record_count"), F.sum("byte_len").alias("byte_len"), F.max("max_timestamp").alias("max_timestamp"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("base_offset", "producers"))), lambda x: x["producers"])).alias("producers"),
    )


def bytes_by_prefix(records: DataFrame) -> DataFrame:
    return records.groupBy("prefix").agg(F.count("*").alias("records"), F.sum("bytes").alias("bytes"))


def combine_batches(batches: DataFrame) -> DataFrame:
    """Batches of one producer as one: records keep their order, their deltas are shifted, times are absolute.

    ``batches`` has topic, partition, producer_id, position, last_offset_delta, max_timestamp and records, an
    array of structs with offset_delta. One row a topition and producer is the result.
    """
    order = Window.partitionBy(*KEY, "producer_id").orderBy("position")
    shift = F.coalesce(F.sum(F.col("last_offset_delta") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = batches.withColumn("_shift", shift.cast("int")).withColumn("records", F.transform("records", lambda r: r.withField("offset_delta", (r["offset_delta"] + F.col("_shift")).cast("int"))))
    return moved.groupBy(*KEY, "producer_id").agg(
        (F.sum(F.col("last_offset_delta") + 1) - 1).cast("int").alias("last_offset_delta"), F.max("max_timestamp").alias("max_timestamp"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", "records"))), lambda x: x["records"])).alias("records"),
    )


def batcher_groups(requests: DataFrame, batch_min_size: int) -> DataFrame:
    """Adds ``flush``: requests of a topition and producer go together until their bytes exceed ``batch_min_size``."""
    key = [*KEY, "producer_id"]
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy(*key).orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return requests.withColumn("flush", F.floor(before / (batch_min_size + 1)).cast("bigint"))
