"""Bounded range reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model as M
from .stage import KEY

OK, OUT_OF_RANGE, UNKNOWN_TOPIC = 0, 1, 3


def within_budget(rows: DataFrame, max_bytes: int, *, order: str = "offset", size: str = "bytes", key: list[str] | None = None, slot: Column | None = None) -> DataFrame:
    """The rows of each topition up to a byte budget: at least one, and none that starts once it is spent.

    With ``slot``, a column that never decreases along the order (such as a run of offsets), bytes are summed
    up a slot first, and only rows of the slots that the budget reaches are put in order.
    """
    key = KEY if key is None else key
    before = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    if slot is not None:
        rows = rows.withColumn("_slot", slot)
        sums = rows.groupBy(*key, "_slot").agg(F.sum(size).alias("_sum"))
        spent = F.coalesce(F.sum("_sum").over(Window.partitionBy(*key).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        reached = sums.withColumn("_spent", spent).filter(F.col("_spent") < max_bytes).select(*key, "_slot")
        rows = rows.join(reached, [*key, "_slot"], "left_semi").drop("_slot")
    return rows.withColumn("_before", F.coalesce(F.sum(size).over(before), F.lit(0))).filter(F.col("_before") < max_bytes).drop("_before")


def fetch(records: DataFrame, requests: DataFrame, *, max_bytes: int = M.DEFAULT_MAX_BYTES, least_bytes: int = 1, total_bytes: int | None = None) -> DataFrame:
    """The records from each requested offset on, within ``max_bytes`` a topition.

    ``least_bytes`` is the smallest size a record can have; as offsets are dense, it bounds the offsets that
    the budget can reach, and the scan is cut there before any ordering. ``total_bytes`` bounds all topitions
    together, in their order.
    """
    asked = requests.select(*KEY, F.col("offset").alias("_from"))
    reach = max_bytes // max(1, least_bytes) + 1
    rows = records.join(asked, KEY).filter((F.col("offset") >= F.col("_from")) & (F.col("offset") < F.col("_from") + reach)).drop("_from")
    rows = within_budget(rows, max_bytes)
    if total_bytes is None:
        return rows
    sums = rows.groupBy(*KEY).agg(F.sum("bytes").alias("_bytes"))
    sums = sums.withColumn("_spent", F.coalesce(F.sum("_bytes").over(Window.orderBy(*KEY).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row a requested topition
    rows = rows.join(sums.select(*KEY, "_spent"), KEY)
    before = Window.partitionBy(*KEY).orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    return rows.filter(F.col("_spent") < total_bytes).withColumn("_before", F.coalesce(F.sum("bytes").over(before), F.lit(0)) + F.col("_spent")).filter(F.col("_before") < total_bytes).drop("_before", "_spent")


def fetch_batches(batches: DataFrame, requests: DataFrame) -> DataFrame:
    """Whole batches that reach the requested offset; the first may begin before it."""
    asked = requests.select(*KEY, F.col("offset").alias("_from"))
    return batches.join(asked, KEY).filter(F.col("base_offset") + F.col("last_offset_delta") >= F.col("_from")).drop("_from")


def next_offset(batches: DataFrame) -> DataFrame:
    """Where to read on: behind the last batch's offset span, whether or not its records still exist."""
    return batches.groupBy(*KEY).agg(F.max(F.col("base_offset") + F.col("last_offset_delta") + 1).alias("next_offset"))


def fetch_status(requests: DataFrame, stage: DataFrame, topics: DataFrame | None = None, truncation: DataFrame | None = None) -> DataFrame:
    """A code for each request: out of range below the log start or inside a certified gap, ok at or after the end.

    A certification counts only while the log end is the one it was made at. Unknown topics get their own code,
    a high watermark of 0 and a log start of -1; a bad topition never fails the others.
    """
    out = requests.join(stage.select(*KEY, "log_start", "high_watermark"), KEY, "left")
    dead = F.lit(False)
    if truncation is not None:
        out = out.join(truncation.select(*KEY, "floor", "served_end", "served_at_high"), KEY, "left")
        dead = F.coalesce((F.col("served_at_high") == F.col("high_watermark")) & (F.col("offset") >= F.col("served_end")) & (F.col("offset") < F.col("floor")), F.lit(False))
    known = F.col("high_watermark").isNotNull()
    if topics is not None:
        out = out.join(topics.select("topic", F.lit(True).alias("_known")).distinct(), "topic", "left")
        known = F.coalesce("_known", F.lit(False))
    end = F.coalesce("high_watermark", F.lit(0))
    code = F.when(~known, F.lit(UNKNOWN_TOPIC)).when(F.col("offset") < F.coalesce("log_start", F.lit(0)), F.lit(OUT_OF_RANGE)).when(dead, F.lit(OUT_OF_RANGE)).otherwise(F.lit(OK))
    return out.select(*KEY, "offset", code.alias("error_code"), end.cast("bigint").alias("high_watermark"), F.when(known, F.coalesce("log_start", F.lit(0))).otherwise(F.lit(-1)).cast("bigint").alias("log_start"))


def ready(requests: DataFrame, found: DataFrame) -> DataFrame:
    """Which reads (request, topic, partition, offset, min_bytes, max_wait_ms, waited_ms) are answered now.

    A read waits until its topitions have ``min_bytes`` together, its time is up, or one of them failed.
    ``found`` has request, bytes and error_code, a row or none for each topition of a read.
    """
    have = found.groupBy("request").agg(F.sum("bytes").alias("_b"), F.max(F.col("error_code") != 0).alias("_e"))
    asked = requests.groupBy("request").agg(F.max("min_bytes").alias("min_bytes"), F.max("max_wait_ms").alias("max_wait_ms"), F.max("waited_ms").alias("waited_ms")).join(have, "request", "left")
    enough = (F.coalesce("_b", F.lit(0)) >= F.col("min_bytes")) | (F.col("waited_ms") >= F.col("max_wait_ms")) | F.coalesce("_e", F.lit(False))
    return asked.select("request", F.coalesce("_b", F.lit(0)).cast("bigint").alias("bytes"), enough.alias("ready"))


def page(rows: DataFrame, limit: int, after: tuple[str, int] | None = None) -> DataFrame:
    """Keyset pagination over topitions."""
    if after is not None:
        rows = rows.filter((F.col("topic") > after[0]) | ((F.col("topic") == after[0]) & (F.col("partition") > after[1])))
    return rows.orderBy("topic", "partition").limit(limit)


def resolve_topics(requests: DataFrame, topics: DataFrame) -> DataFrame:
    """Requests by name or id joined to the catalog in request order; null topic_id and partitions where unknown."""
    by_name = topics.select(F.col("topic").alias("_name"), F.col("topic_id").alias("_id1"), F.col("partitions").alias("_p1"))
    by_id = topics.select(F.col("topic").alias("_t2"), F.col("topic_id").alias("_id2"), F.col("partitions").alias("_p2"))
    out = requests.join(by_name, requests.topic == by_name["_name"], "left").join(by_id, requests.topic_id == by_id["_id2"], "left")
    return out.select("position", F.coalesce(requests.topic, "_t2").alias("topic"), F.coalesce("_id1", "_id2").alias("topic_id"), F.coalesce("_p1", "_p2").alias("partitions")).orderBy("position")
