"""Mixing sources to target weights by entropy balancing.

The mix gives each document a rate, the expected number of its copies. Among all rates that meet
the word target of every source and stay at or below ``MOST``, it takes those nearest to one in
relative entropy. Their dual has one multiplier a source, and the rates are exponential tilts
min(MOST, exp(multiplier * size / mean size)). Newton steps on the dual, safeguarded by a bracket,
run over the distinct (source, size) classes of the whole table, each step one aggregation; an error
is raised if they don't settle.

Rates become copies by class: the classes of a source are rounded from the largest size down, each
step carrying what the last one left over, so a source misses its target by about the smallest
document it has. A class deals its copies to its documents in the order of a hash of their ids.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, with_row_ids

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2
#: Members of a class that one task ranks.
DEALT = 200


def n_words(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sizes: dict[str | None, int], *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words each source should give: ``share`` of all by repeating weights, none above ``most`` times its own.

    Sources are taken by code point, null last. What a source can't take goes to the others by weight.
    """
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    out, free, left = dict.fromkeys(order, 0.0), [s for s in order if sizes[s] > 0], share * sum(sizes.values())
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if weight[s] * unit >= most * sizes[s]]
        if not full:
            return out | {s: weight[s] * unit for s in free}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        free = [s for s in free if s not in full]
    return out


def multipliers(classes: DataFrame, plan: DataFrame, scratch: Scratch, *, most: float = MOST, steps: int = 60, near: float = 1e-6) -> DataFrame:
    """(key, m): the dual solution. ``classes`` has key, size, n; ``plan`` key, mean, target, total.

    One row a source holds its multiplier, its bracket and its error; a step joins that table to the
    classes and sums expected words and their slope.
    """
    state = scratch.save(plan.select("key", "mean", "target", "total", F.lit(0.0).alias("m"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), (F.col("target") <= 0).alias("done")), "dual")
    for _ in range(steps):
        x = F.col("size") / F.col("mean")
        tilt = F.exp(F.least(F.col("m") * x, F.lit(50.0)))
        sums = classes.join(state.filter("not done"), "key").groupBy("key").agg(
            F.sum(F.col("n") * F.col("size") * F.least(F.lit(float(most)), tilt)).alias("words"),
            F.sum(F.when(tilt < most, F.col("n") * F.col("size") * x * tilt).otherwise(0.0)).alias("slope"),
        )
        low = F.when(F.col("words") < F.col("target"), F.col("m")).otherwise(F.col("lo"))
        high = F.when(F.col("words") > F.col("target"), F.col("m")).otherwise(F.col("hi"))
        newton = F.col("m") - (F.col("words") - F.col("target")) / F.col("slope")
        half = F.when(F.col("b").isNull(), F.greatest(F.lit(1.0), 2 * F.col("m"))).when(F.col("a").isNull(), F.least(F.lit(-1.0), 2 * F.col("m"))).otherwise((F.col("a") + F.col("b")) / 2)
        inside = (F.col("slope") > 0) & (F.col("a").isNull() | (newton > F.col("a"))) & (F.col("b").isNull() | (newton < F.col("b"))) & (F.abs(newton - F.col("m")) < 20)
        done = F.col("done") | F.coalesce(F.abs(F.col("words") - F.col("target")) <= near * F.col("total"), F.lit(True))
        moved = state.join(sums, "key", "left").withColumn("a", low).withColumn("b", high).withColumn("done", done)
        moved = moved.select("key", "mean", "target", "total", F.when(F.col("done"), F.col("m")).when(inside, newton).otherwise(half).alias("m"), F.col("a").alias("lo"), F.col("b").alias("hi"), "done")
        old, state = state, scratch.save(moved, "dual")
        scratch.drop(old)
        if not state.filter("not done").limit(1).count():
            return state
    raise RuntimeError(f"the multipliers of some sources are not within {near} of their targets after {steps} steps")


def _round(most: int):
    """Copies of each class of one source, from the largest size down; bounded by its distinct sizes."""

    def kernel(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size", ascending=False).reset_index(drop=True)
        due, out = 0.0, np.zeros(len(group), np.int64)
        for i, (size, n, rate) in enumerate(zip(group["size"], group["n"], group["rate"])):
            due += size * n * rate
            out[i] = min(most * n, max(0, round(due / size)))
            due -= out[i] * size
        group["copies"] = out
        return group[["key", "size", "copies"]]

    return kernel


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (words), copies.

    A null text has size 0 and, as an empty one, no copies; a null source is a source of its own, last
    in order. Ids may be null or repeat: rows of one source and size are interchangeable but for
    the hash of their id, which orders them. Other columns are ignored; an empty table gives an empty one.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(text_col).alias("size"))
    rows = scratch.save(rows.withColumn("key", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source"))), "rows")
    classes = scratch.save(rows.groupBy("key", "size").agg(F.count("*").alias("n")), "classes")
    per_source = classes.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("total"), F.sum("n").alias("count"))
    plan = _planned(per_source, scratch)
    work = classes.filter("size > 0")
    dual = multipliers(work, plan.filter("total > 0").withColumn("mean", F.col("total") / F.col("count")), scratch)
    saturated = F.col("target") >= MOST * F.col("total")
    tilt = F.least(F.lit(float(MOST)), F.exp(F.least(F.col("m") * F.col("size") / F.col("mean"), F.lit(50.0))))
    rated = work.join(dual, "key").select("key", "size", "n", F.when(saturated, F.lit(float(MOST))).otherwise(tilt).alias("rate"))
    copies = scratch.save(rated.groupBy("key").applyInPandas(_round(MOST), "key string, size bigint, copies bigint"), "copies")
    shares = copies.join(classes, ["key", "size"]).select(F.col("key").alias("k"), F.col("size").alias("z"), "n", "copies", (1 + F.floor(F.col("n") / DEALT)).alias("parts"))
    placed = rows.filter("size > 0").join(shares, (F.col("key") == F.col("k")) & (F.col("size") == F.col("z")))
    order = F.xxhash64("doc_id", F.lit("mix"))
    placed = placed.select("doc_id", "key", "size", "n", "copies", F.pmod(order, F.col("parts")).alias("part"), order.alias("order"))
    return _dealt(rows, placed, plan, scratch)


def _planned(per_source: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds target to (key, total, count): water filling over the sources, which a driver holds as one number each."""
    found = per_source.collect()
    aim = targets({(None if r["key"] == "n" else r["key"][1:]): r["total"] for r in found})
    data = [(r["key"], int(r["total"]), int(r["count"]), float(aim[None if r["key"] == "n" else r["key"][1:]])) for r in found]
    return scratch.spark.createDataFrame(data, "key string, total bigint, count bigint, target double")


def _dealt(rows: DataFrame, placed: DataFrame, plan: DataFrame, scratch: Scratch) -> DataFrame:
    from pyspark.sql import Window

    placed = scratch.save(placed, "placed")
    parts = placed.groupBy("key", "size", "part").agg(F.count("*").alias("members"))
    before = Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = parts.withColumn("before", F.coalesce(F.sum("members").over(before), F.lit(0))).select(F.col("key").alias("k"), F.col("size").alias("z"), F.col("part").alias("p"), "before")
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("key", "size", "part").orderBy("order", "doc_id")) - 1)
    ranked = ranked.join(offset, (F.col("key") == F.col("k")) & (F.col("size") == F.col("z")) & (F.col("part") == F.col("p")))
    rank = F.col("before") + F.col("rank")
    own = F.expr("copies div n").cast("bigint") + (rank < F.expr("copies % n")).cast("bigint")
    named = plan.select("key", F.col("total").alias("source_size"), "target")
    full = ranked.select("doc_id", "key", "size", own.alias("copies"))
    rest = rows.filter("size = 0").select("doc_id", "key", "size", F.lit(0).cast("bigint").alias("copies"))
    out = full.union(rest).join(named, "key")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def with_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with their columns and size, source_size, target, taken and copies, which replace columns of these names.

    Ids may be null or repeat; every row gets what the mix gives to it.
    """
    added = ("size", "source_size", "target", "taken", "copies")
    docs = with_row_ids(docs.drop(*added), Scratch(docs.sparkSession, "mixing"))
    given = mix(docs, id_col="_row").withColumnRenamed("doc_id", "_mixed_id")
    return docs.join(given, docs["_row"] == given["_mixed_id"]).drop("_mixed_id", "_row")
