"""Exactly-once appends: what becomes of each batch of a producer."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import model as M
from ..functions.scalars import next_sequence
from .log import assign_offsets

KEY = ["producer_id", "topic", "partition"]
ADMIT, DUPLICATE, OUT_OF_ORDER, FENCED = "admit", "duplicate", "out_of_order", "fenced"
REMEMBERED = 5


@dataclass
class Tail:
    """What a log remembers of a producer: its epoch, the sequence it expects, and its last five batches."""

    epoch: int = -1
    expected: int | None = None
    recent: deque = field(default_factory=lambda: deque(maxlen=REMEMBERED))

    def offer(self, epoch: int, first: int, last: int, offset: int) -> tuple[str, int | None]:
        """Judges a batch and remembers an admitted one; a duplicate gets the offset it had at first."""
        if epoch < self.epoch:
            return FENCED, None
        if epoch > self.epoch:
            if first != 0:
                return OUT_OF_ORDER, None
            self.epoch, self.expected = epoch, None
            self.recent.clear()
        for known, end, at in self.recent:
            if (known, end) == (first, last) or known == first:
                return DUPLICATE, at
        if first != (0 if self.expected is None else self.expected):
            return OUT_OF_ORDER, None
        self.expected = 0 if last == M.I32_MAX else last + 1
        self.recent.append((first, last, offset))
        return ADMIT, offset


def classify(batches: DataFrame) -> DataFrame:
    """Adds ``outcome`` and ``admitted_offset`` to batches (producer_id, topic, partition, epoch, base_sequence,
    last_sequence, base_offset, position), each judged behind those before it. Control batches are left out.

    A producer of a topition is one ordered stream by nature; its batches, without payload, are one group.
    """
    rows = batches.filter((F.col("flags").bitwiseAND(2) == 0) if "flags" in batches.columns else F.lit(True)).select(*KEY, "epoch", "base_sequence", "last_sequence", "base_offset", "position")

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("position", ignore_index=True)
        tail = Tail()
        out = [tail.offer(*x) for x in zip(group["epoch"], group["base_sequence"], group["last_sequence"], group["base_offset"])]
        group["outcome"], group["admitted_offset"] = [o for o, _ in out], pd.array([a for _, a in out], "Int64")
        return group

    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, outcome string, admitted_offset bigint"
    return rows.groupBy(*KEY).applyInPandas(fold, schema)


def sequence_gaps(batches: DataFrame) -> DataFrame:
    """Batches that do not begin where the one before ended, with the sequence that was expected."""
    order = Window.partitionBy(*KEY, "epoch").orderBy("position")
    expected = F.coalesce(next_sequence(F.lag("last_sequence").over(order)), F.lit(0))
    return batches.withColumn("expected", expected).filter(F.col("base_sequence") != F.col("expected"))


def duplicates(batches: DataFrame, last: int = REMEMBERED) -> DataFrame:
    """Batches that repeat the first sequence of one of the ``last`` before them in their stream."""
    order = Window.partitionBy(*KEY, "epoch").orderBy("position")
    again = F.coalesce(*(F.when(F.lag("base_sequence", i).over(order) == F.col("base_sequence"), F.lag("base_offset", i).over(order)) for i in range(1, last + 1)))
    return batches.withColumn("original_offset", again).filter("original_offset is not null")


def fenced(batches: DataFrame) -> DataFrame:
    """Batches of an epoch below the highest that the log had seen from their producer."""
    order = Window.partitionBy(*KEY).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return batches.withColumn("seen", F.max("epoch").over(order)).filter(F.col("epoch") < F.col("seen"))


def coordinates(entries: DataFrame) -> DataFrame:
    """Producer state rebuilt from the manifest alone: one row a batch, without control coordinates."""
    rows = entries.select("topic", "partition", "base_offset", F.posexplode("producers").alias("_i", "p"))
    rows = rows.filter(F.col("p.flags").bitwiseAND(2) == 0)
    at = F.col("base_offset") + F.col("p.offset_delta")
    return rows.select(F.col("p.producer_id").alias("producer_id"), "topic", "partition", F.col("p.producer_epoch").cast("int").alias("epoch"), F.col("p.base_sequence").alias("base_sequence"), F.col("p.last_sequence").alias("last_sequence"), at.alias("base_offset"), at.alias("position"))


def init_producers(known: DataFrame, requests: DataFrame) -> DataFrame:
    """(position, producer_id, epoch) of new ids: without a transactional id a fresh one, with a known one the
    same id and the next epoch. ``known`` has transactional_id, producer_id, epoch; positions are distinct."""
    top = known.agg(F.coalesce(F.max("producer_id"), F.lit(0)).alias("_top"))
    old = known.groupBy("transactional_id").agg(F.max(F.struct("producer_id", "epoch")).alias("_k")).filter("transactional_id is not null")
    rows = requests.join(old, "transactional_id", "left").crossJoin(F.broadcast(top))  # one row
    new = assign_offsets(rows.filter("_k is null").select("position", F.lit(0).alias("_all")), ["position"], slot=F.expr("position div 10000"), key=["_all"])
    rows = rows.join(new.select("position", (F.col("offset") + 1).alias("_fresh")), "position", "left")
    fresh = F.col("_fresh")
    return rows.select("position", "transactional_id", F.coalesce("_k.producer_id", F.col("_top") + fresh).alias("producer_id"), F.coalesce(F.col("_k.epoch") + 1, F.lit(0)).cast("int").alias("epoch"))
