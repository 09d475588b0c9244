"""Benchmark decontamination, in DataFrame functions only.

Texts are read as lower-case runs of letters and digits. A window of a document, as long as a
benchmark item, leaks that item if their multisets of 5-word shingles have a weighted Jaccard
similarity (sum of smaller over sum of larger counts) of at least ``SIMILAR``.

1. Shingles of the documents that occur in some item mark where windows can lie. Of a window of n
   shingles that reaches the similarity at most one in nine is foreign, so one of its first and one of
   its last n/9 + 1 shingles is marked; all other windows are left out without loss.
2. Each window and item gets a 64-bit SimHash. The fingerprints are cut into ``RADIUS + 1`` blocks; two
   that differ in at most ``RADIUS`` bits agree on a whole block, so a join on (size, block, value)
   finds every pair within the radius. Fingerprints of a similarity of 0.8 differ in 10 bits on
   average, in more than 19 with a probability of 0.001. At this radius a block is three or four bits
   wide, so it narrows the items of a size little; what keeps the join small is that only windows of
   step 1 take part, and each distinct fingerprint once, however many documents share a passage.
3. The pairs left are compared exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, size_below

K, SIMILAR, RADIUS = 5, 0.8, 19
#: Widths of the RADIUS + 1 blocks of a 64-bit fingerprint.
BLOCKS = (4,) * 4 + (3,) * 16
#: Rows up to which a side is sent to all tasks; beyond, the join is shuffled.
SMALL = 200_000


def words_of(text: str | Column) -> Column:
    parts = F.split(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def _beside(name: str, step: int, other: str, f) -> Column:
    n = F.greatest(F.size(other) - step, F.lit(0))
    return F.zip_with(F.slice(name, F.lit(1), n), F.slice(other, F.lit(step + 1), n), f)


def with_shingles(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: 64-bit hashes of all shingles in order, repeats kept; fewer than K words make one."""
    turn = lambda x, n: F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n))
    df = df.withColumn("_w", words_of(text))
    df = df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    df = df.withColumn("_h2", _beside("_h", 1, "_h", lambda x, y: turn(x, 11).bitwiseXOR(y)))
    df = df.withColumn("_h4", _beside("_h2", 2, "_h2", lambda x, y: turn(x, 22).bitwiseXOR(y)))
    df = df.withColumn("_h5", _beside("_h4", 4, "_h", lambda x, y: F.xxhash64(x, y)))
    few = F.when(F.size("_w") > 0, F.array(F.xxhash64(F.concat_ws(" ", "_w"), F.size("_w")))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, F.when(F.size("_w") >= K, F.col("_h5")).otherwise(few)).drop("_h", "_h2", "_h4", "_h5")


def simhash(shingles: str) -> Column:
    """64 majority votes of the bits of the shingles, each as often as it occurs."""
    ones = lambda b: F.aggregate(shingles, F.lit(0).cast("bigint"), lambda n, x: n + F.getbit(x, b))
    vote = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(2 * ones(b) > F.size(shingles), F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(vote, F.lit(0).cast("bigint"), lambda v, b: F.shiftleft(v, 1).bitwiseOR(b))


def blocks(fingerprint: str) -> Column:
    """(number, value) of each block, as one number; their widths add up to 64."""
    out, at = [], 0
    for i, width in enumerate(BLOCKS):
        out.append(F.shiftrightunsigned(fingerprint, at).bitwiseAND((1 << width) - 1) * len(BLOCKS) + i)
        at += width
    return F.array(*out)


def shared_count(a: str, b: str) -> Column:
    """Size of the intersection of two multisets."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    exact = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(exact)


def _row_key() -> Column:
    """128 bits of a row's id and text."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit(""))).cast("binary")))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if size_below(df, SMALL) else df


def leaks(docs: DataFrame, benchmark: DataFrame, *, similar: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and item it leaks: doc_id, item_id, start_word, n_words, similarity.

    start_word counts from 0 and names the first of the windows with the greatest similarity; a document
    shorter than the item is one window. Items of fewer than five words leak where their words stand in
    a row. Null and empty texts leak nothing and are not leaked; items with a null id are left out,
    documents with one are reported with it. Repeated rows count once. Other columns are ignored.
    """
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("t")).filter("item_id is not null").distinct()
    items = with_shingles(items, "t", "item_shingles").withColumn("words", F.size("_w")).filter("words > 0").select("item_id", "words", "item_shingles")
    scratch = Scratch(docs.sparkSession, "decontam")
    items = scratch.save(items.withColumn("item_print", simhash("item_shingles")), "items")
    marks = _small(scratch.save(items.select(F.explode("item_shingles").alias("shingle"), "words").distinct(), "marks"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).withColumn("key", _row_key())
    short = [r[0] for r in items.filter(F.col("words") < K).select("words").distinct().collect()]  # at most four sizes

    marked = _marked(rows, marks, K)
    for size in sorted(short):
        marked = marked.unionByName(_marked(rows, marks, size))
    n = F.when(F.col("words") < K, F.lit(1)).otherwise(F.col("words") - K + 1)  # shingles of a full window
    slack = F.floor(n * ((1 - similar) / (1 + similar)) + 1e-9).cast("int")
    whole = F.col("size") <= n
    first = marked.select("key", "words", "size", F.explode(F.when(whole, F.array(F.lit(0))).otherwise(F.sequence(F.col("pos") - slack, F.col("pos")))).alias("start"), F.lit(1).alias("side"))
    last = marked.select("key", "words", "size", F.explode(F.when(whole, F.array(F.lit(0))).otherwise(F.sequence(F.col("pos") - n + 1, F.col("pos") - n + 1 + slack))).alias("start"), F.lit(2).alias("side"))
    starts = first.unionByName(last).filter((F.col("start") >= 0) & (F.col("start") <= F.greatest(F.lit(0), F.col("size") - n)))
    starts = starts.groupBy("key", "words", "start").agg(F.min("side").alias("lo"), F.max("side").alias("hi")).filter("lo < hi")
    windows = scratch.save(starts.groupBy("key").agg(F.collect_list(F.struct("words", "start")).alias("windows")), "windows")  # a list is bounded by its text

    found = windows.withColumnRenamed("key", "k")
    few = (windows.agg(F.sum(F.size("windows"))).first()[0] or 0) <= SMALL
    texts = rows.join(F.broadcast(found) if few else found, F.col("key") == F.col("k"))
    texts = with_shingles(texts.select("doc_id", "key", "text", "windows"), "text", "all")
    cut = lambda w: F.struct(w["words"].alias("words"), w["start"].alias("start"), _window_shingles(w))
    window = texts.select("doc_id", "key", F.explode(F.transform("windows", cut)).alias("w"))
    window = window.select("doc_id", "key", "w.words", "w.start", F.col("w.shingles").alias("window_shingles")).withColumn("print", simhash("window_shingles"))
    window = scratch.save(window, "prints")
    prints = window.select("words", "print").distinct().withColumn("block", F.explode(blocks("print")))
    index = items.withColumn("item_block", F.explode(blocks("item_print"))).select("item_id", "item_print", "item_block", F.col("words").alias("item_words"))
    near = (F.col("words") == F.col("item_words")) & (F.col("block") == F.col("item_block")) & (F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    close = scratch.save(prints.join(_small(index), near).select(F.col("words").alias("w"), F.col("print").alias("p"), "item_id").distinct(), "close")
    pairs = window.join(_small(close), (F.col("words") == F.col("w")) & (F.col("print") == F.col("p"))).select("doc_id", "words", "start", "item_id", F.col("window_shingles").alias("a"))
    pairs = pairs.join(_small(items.select(F.col("item_id").alias("i"), F.col("item_shingles").alias("b"), F.col("words").alias("iw"))), (F.col("item_id") == F.col("i")) & (F.col("words") == F.col("iw")))
    pairs = pairs.withColumn("both", shared_count("a", "b")).withColumn("similarity", F.col("both") / (F.size("a") + F.size("b") - F.col("both")))
    found = pairs.filter(F.col("similarity") >= similar).groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("before"), "words")).alias("best"))
    return found.select("doc_id", "item_id", (-F.col("best.before")).cast("bigint").alias("start_word"), F.col("best.words").cast("bigint").alias("n_words"), F.col("best.similarity").alias("similarity"))


def _marked(rows: DataFrame, marks: DataFrame, k: int) -> DataFrame:
    """(key, pos, size, words): where a shingle of ``k`` words occurs in an item of ``words`` words."""
    if k == K:
        found = with_shingles(rows, "text", "s").select("key", F.when(F.size("_w") >= K, F.col("s")).alias("s"))
        wanted = marks.filter(F.col("words") >= K)
    else:
        grams = F.transform(F.sequence(F.lit(0), F.size("_w") - k), lambda i: F.xxhash64(F.concat_ws(" ", F.slice("_w", i + 1, F.lit(k))), F.lit(k)))
        found = rows.withColumn("_w", words_of("text")).select("key", F.when(F.size("_w") >= k, grams).alias("s"))
        wanted = marks.filter(F.col("words") == k)
    # an outer explode: before an inner one the optimizer puts a filter that computes the array again
    found = found.withColumn("size", F.size("s")).select("key", "size", F.posexplode_outer("s").alias("pos", "h"))
    return found.join(wanted, found.h == wanted.shingle).select("key", "pos", "size", "words").distinct()


def _window_shingles(w: Column) -> Column:
    """Hashes of a window's shingles: a slice of the document's, or its few words as one."""
    few = F.array(F.xxhash64(F.concat_ws(" ", F.slice("_w", w["start"] + 1, F.greatest(w["words"], F.lit(1)))), w["words"]))
    return F.when(w["words"] < K, few).otherwise(F.slice("all", w["start"] + 1, F.greatest(w["words"] - K + 1, F.lit(1)))).alias("shingles")
