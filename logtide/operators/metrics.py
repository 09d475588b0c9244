"""Request metrics: counts, errors and durations of an API's calls, and how busy a broker was."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Upper ends of the duration buckets in milliseconds; the last bucket has none.
BUCKETS_MS = (5, 10, 25, 50, 100, 250, 500, 1_000, 2_500, 5_000, 10_000)


def request_metrics(requests: DataFrame) -> DataFrame:
    """Per api of (api, started_ms, ended_ms, error_code): requests, errors, total_ms, and a count a bucket of duration."""
    ms = F.col("ended_ms") - F.col("started_ms")
    edges = (-1, *BUCKETS_MS)
    inside = [F.count_if((ms > lo) & (ms <= hi)).alias(f"le_{hi}") for lo, hi in zip(edges, BUCKETS_MS)]
    return requests.groupBy("api").agg(F.count("*").alias("requests"), F.count_if(F.col("error_code") != 0).alias("errors"), F.sum(ms).alias("total_ms"), *inside, F.count_if(ms > BUCKETS_MS[-1]).alias("le_inf"))


def busy(requests: DataFrame, slot_ms: int = 60_000) -> DataFrame:
    """Per slot of time the most requests at once that work and do not wait: in flight, less those parked.

    ``requests`` has started_ms, ended_ms, and parked_ms, how long a request waited before it went on (null or 0
    for none); it waits first and then works. A request is a step up where it works and down where it ends.
    Steps are summed up a slot, the sums run over slots, and each slot runs over its own steps.
    """
    begin = F.col("started_ms") + F.coalesce("parked_ms", F.lit(0))
    real = requests.select(begin.alias("a"), F.col("ended_ms").alias("b")).filter("a < b")
    steps = real.select(F.col("a").alias("at"), F.lit(1).alias("d")).unionAll(real.select(F.col("b").alias("at"), F.lit(-1).alias("d")))
    steps = steps.groupBy("at").agg(F.sum("d").alias("d")).withColumn("slot", F.floor(F.col("at") / slot_ms).cast("bigint"))
    sums = steps.groupBy("slot").agg(F.sum("d").alias("n"))
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")  # a row a slot
    level = F.sum("d").over(Window.partitionBy("slot").orderBy("at"))
    return steps.withColumn("level", level).join(before, "slot").groupBy("slot").agg(F.max(F.col("level") + F.col("before")).alias("most"))
