"""Transactions: what a reader of committed records may see."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stage import KEY

OPEN = ("BEGIN", "PREPARE_COMMIT", "PREPARE_ABORT")
COMMITTED, ABORTED = "COMMITTED", "ABORTED"


def last_stable_offset(txns: DataFrame, stage: DataFrame, *, mode: str = "reference") -> DataFrame:
    """(topic, partition, last_stable) for topitions with transactions.

    ``txns`` has one row a transaction and topition: first_offset, last_offset (its marker's, null while it is
    open), state. ``kafka``: the first offset of the earliest open transaction. ``reference``: transactions
    whose spans overlap settle together, so it is the start of the first run of overlapping spans that holds
    an open one. Without an open transaction it is the high watermark.
    """
    rows = txns.join(stage.select(*KEY, "high_watermark"), KEY)
    is_open = F.col("state").isin(*OPEN)
    if mode == "kafka":
        found = rows.groupBy(*KEY, "high_watermark").agg(F.min(F.when(is_open, F.col("first_offset"))).alias("first"))
        return found.select(*KEY, F.coalesce("first", "high_watermark").alias("last_stable"))
    if mode != "reference":
        raise ValueError(f"lso_mode is reference or kafka, not {mode}")
    end = F.when(is_open, F.col("high_watermark")).otherwise(F.col("last_offset") + 1)
    rows = rows.select(*KEY, "high_watermark", "first_offset", end.alias("_end"), is_open.alias("_open"))
    order = Window.partitionBy(*KEY).orderBy("first_offset", "_end")
    reach = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(reach.isNull() | (F.col("first_offset") >= reach), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(order))
    islands = rows.groupBy(*KEY, "high_watermark", "_island").agg(F.min("first_offset").alias("first"), F.max("_open").alias("open"))
    found = islands.groupBy(*KEY, "high_watermark").agg(F.min(F.when(F.col("open"), F.col("first"))).alias("first"))
    return found.select(*KEY, F.coalesce("first", "high_watermark").alias("last_stable"))


def aborted_ranges(txns: DataFrame, from_offset: int = 0) -> DataFrame:
    """(topic, partition, producer_id, first_offset) of aborted transactions that end at or after an offset; open ones are not among them."""
    return txns.filter((F.col("state") == ABORTED) & (F.col("last_offset") >= from_offset)).select(*KEY, "producer_id", "first_offset", "last_offset")


def committed_records(records: DataFrame, txns: DataFrame, stage: DataFrame) -> DataFrame:
    """Records below the last stable offset, without control records and those of aborted transactions."""
    stable = last_stable_offset(txns, stage)
    bounded = records.join(stable, KEY, "left").filter(F.col("last_stable").isNull() | (F.col("offset") < F.col("last_stable"))).drop("last_stable")
    if "is_control" in records.columns:
        bounded = bounded.filter(~F.col("is_control"))
    gone = aborted_ranges(txns).select(F.col("topic").alias("_t"), F.col("partition").alias("_p"), F.col("producer_id").alias("_i"), F.col("first_offset").alias("_a"), F.col("last_offset").alias("_b"))
    inside = (F.col("topic") == F.col("_t")) & (F.col("partition") == F.col("_p")) & (F.col("producer_id") == F.col("_i")) & (F.col("offset") >= F.col("_a")) & (F.col("offset") <= F.col("_b"))
    return bounded.join(gone, inside, "left_anti")


def add_partitions(txns: DataFrame, transactional_id: str, producer_id: int, epoch: int, topitions: DataFrame) -> DataFrame:
    """The transaction table with rows for topitions that join a transaction; joining twice changes nothing."""
    new = topitions.select(
        F.lit(transactional_id).alias("transactional_id"), F.lit(producer_id).cast("bigint").alias("producer_id"), F.lit(epoch).cast("smallint").alias("producer_epoch"), F.lit("BEGIN").alias("state"),
        *KEY, F.lit(None).cast("bigint").alias("first_offset"), F.lit(None).cast("bigint").alias("last_offset"),
    )
    there = txns.filter(F.col("state").isin(*OPEN)).select("transactional_id", *KEY)
    return txns.unionByName(new.join(there, ["transactional_id", *KEY], "left_anti"))


#: Where committed offsets are kept.
OFFSETS_TOPIC, OFFSETS_PARTITIONS = "__consumer_offsets", 50


def add_offsets(txns: DataFrame, groups: DataFrame, transactional_id: str, producer_id: int, epoch: int) -> DataFrame:
    """The transaction table with the partitions that keep the offsets of ``groups`` (group), which join the transaction."""
    kept = groups.select(F.lit(OFFSETS_TOPIC).alias("topic"), F.pmod(F.crc32("group"), F.lit(OFFSETS_PARTITIONS)).cast("int").alias("partition")).distinct()
    return add_partitions(txns, transactional_id, producer_id, epoch, kept)


def end_txn(txns: DataFrame, stage: DataFrame, transactional_id: str, producer_id: int, epoch: int, committed: bool) -> tuple[DataFrame, DataFrame]:
    """Ends a transaction: the new transaction table, and a control record for each of its topitions at their end."""
    mine = (F.col("transactional_id") == transactional_id) & (F.col("producer_id") == producer_id) & (F.col("producer_epoch") == epoch) & F.col("state").isin(*OPEN)
    joined = txns.join(stage.select(*KEY, F.col("high_watermark").alias("_end")), KEY, "left")
    state = F.when(mine, F.lit(COMMITTED if committed else ABORTED)).otherwise(F.col("state"))
    after = joined.select("transactional_id", "producer_id", "producer_epoch", state.alias("state"), *KEY, "first_offset", F.when(mine, F.col("_end")).otherwise(F.col("last_offset")).alias("last_offset"))
    markers = joined.filter(mine).select(*KEY, F.col("_end").alias("offset"), "producer_id", "producer_epoch", F.lit(True).alias("is_control"), F.lit("commit" if committed else "abort").alias("control"))
    return after, markers


def visible_offset_commits(pending: DataFrame, txns: DataFrame) -> DataFrame:
    """Offsets that a transaction commits (transactional_id, group, topic, partition, offset, committed_at): only those of committed ones count."""
    done = txns.filter(F.col("state") == COMMITTED).select("transactional_id", "producer_id").distinct()
    return pending.join(done, ["transactional_id", "producer_id"], "left_semi")
