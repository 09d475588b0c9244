"""The log as a table: offset assignment, prefixes, and the projection of ``events`` that queries run on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import prefix_of

TOPITION = ("topic", "partition")


def assign_offsets(rows: DataFrame, order: Sequence[str], *, slot: Column | None = None, base: DataFrame | None = None, key: Sequence[str] = TOPITION) -> DataFrame:
    """Adds ``offset``: dense and increasing per topition in the order of ``order``, which must be unique.

    With ``slot``, a column that never decreases along the order (such as an hour), a topition is
    numbered by many tasks: rows are counted a slot, the counts are summed up, and each slot numbers its
    own rows. Without it a topition is one window. ``base`` (topic, partition, base) holds the next
    offset of topitions that exist already; others start at 0.
    """
    if slot is None:
        out = rows.withColumn("offset", F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("bigint") - 1)
    else:
        rows = rows.withColumn("_slot", slot)
        counts = rows.groupBy(*key, "_slot").agg(F.count("*").alias("_n"))
        before = Window.partitionBy(*key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
        rank = F.row_number().over(Window.partitionBy(*key, "_slot").orderBy(*order)).cast("bigint") - 1
        out = rows.withColumn("offset", rank).join(counts, [*key, "_slot"]).withColumn("offset", F.col("offset") + F.col("_before")).drop("_slot", "_before")
    if base is not None:
        known = base.select(*key, F.col("base").alias("_base"))
        out = out.join(known, list(key), "left").withColumn("offset", F.col("offset") + F.coalesce("_base", F.lit(0))).drop("_base")
    return out


def append(log: DataFrame, stage: DataFrame, rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``log`` with ``rows`` behind it: their offsets start at the stage's high watermark, whatever still exists below."""
    base = stage.select("topic", "partition", F.col("high_watermark").alias("base"))
    return log.unionByName(assign_offsets(rows, order, base=base), allowMissingColumns=True)


def produce_response(batches: DataFrame) -> DataFrame:
    """Base offset of the first batch of each topition's request, -1 and the code where a batch failed.

    ``batches`` has topic, partition, position (in the request), base_offset and error_code; batches behind
    the first failing one are not applied.
    """
    first = batches.groupBy("topic", "partition").agg(
        F.min_by("base_offset", "position").alias("base"), F.min(F.when(F.col("error_code") != 0, F.struct("position", "error_code"))).alias("bad")
    )
    code = F.coalesce(F.col("bad.error_code"), F.lit(0))
    return first.select("topic", "partition", F.when(code == 0, F.col("base")).otherwise(F.lit(-1)).cast("bigint").alias("base_offset"), code.cast("int").alias("error_code"))


def with_prefix(rows: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """Adds ``prefix``: the topic's first three components, or its own name if it is compacted."""
    if configs is None:
        return rows.withColumn("prefix", prefix_of("topic"))
    compacted = configs.filter((F.col("name") == "cleanup.policy") & F.array_contains(F.split("value", " *, *"), "compact")).select("topic", F.lit(True).alias("_compact")).distinct()
    return rows.join(compacted, "topic", "left").withColumn("prefix", F.when(F.col("_compact"), F.col("topic")).otherwise(prefix_of("topic"))).drop("_compact")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` seen as a log: one row a record, offsets dense per topition."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type is not null and user_id is not null")
    txn = F.expr("event_id div 5")
    rows = e.select(
        F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition"), "ts", F.col("user_id").alias("key"), "value", "props", "event_id",
        (F.col("user_id") % 7).alias("producer_id"), F.concat(F.lit("org.env."), "event_type").alias("prefix"), txn.alias("txn_id"),
        F.element_at(F.array(F.lit("open"), F.lit("committed"), F.lit("aborted")), (txn % 3 + 1).cast("int")).alias("txn_state"),
    )
    return assign_offsets(rows, ("ts", "event_id"), slot=F.to_date("ts"))
