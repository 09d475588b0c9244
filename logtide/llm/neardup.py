"""Near-duplicate documents: universal-hash minima with banding, exact verification, components.

1. Each document becomes a digest of its word sequence, the number of its shingles and one hash a
   band (``BANDS`` bands of ``ROWS`` minima). Equal digests are one *class*, whose smallest id
   stands for it, so a group of exact copies costs one row from here on.
2. Classes that share a band hash are candidates. At the threshold 0.85 a pair shares none of 32
   bands of five minima with a probability of 10^-8. Buckets with the same members count once.
3. A bucket is verified on full shingle sets by one matrix product. A bucket above ``BLOCK`` members
   is dealt out in blocks: first each against one of them, which brings a group of near copies
   together in linear work, then what is not yet in the bucket's largest component against all.
   Tasks return spanning links only, never all pairs.
4. Components come from alternating large-star and small-star rounds over the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix, shingles, word_hashes

BANDS, ROWS, BLOCK = 32, 5, 192
_RNG = np.random.Generator(np.random.PCG64(7))
_A = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)


def minima(x: np.ndarray) -> np.ndarray:
    """The minimum of each universal hash over a shingle set."""
    out = np.full(len(_A), np.uint64(2**64 - 1))
    for i in range(0, len(x), 2048):
        out = np.minimum(out, (x[None, i : i + 2048] * _A[:, None] + _B[:, None]).min(1))
    return out


def band_hashes(x: np.ndarray) -> np.ndarray:
    sig = mix(minima(x)).reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + sig[:, r])
    return out.view(np.int64)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, n, digest, bands = batch.column(0), [], [], []
        for value in batch.column(1):
            words = word_hashes(value.as_buffer().to_pybytes()) if value.is_valid else np.empty(0, np.uint64)
            x = shingles(words)
            n.append(len(x))
            digest.append(xxhash.xxh3_128_digest(words.tobytes()) if len(x) else None)
            bands.append(band_hashes(x) if len(x) else None)
        yield pa.record_batch([ids, pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["id", "n", "digest", "bands"])


def _spanning(adjacent: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of a graph given as a boolean matrix."""
    out, left = [], np.ones(len(adjacent), bool)
    for i in range(len(adjacent)):
        if left[i]:
            left[i] = False
            queue = [i]
            while queue:
                v = queue.pop()
                new = np.flatnonzero(adjacent[v] & left)
                left[new] = False
                out += [(v, int(w)) for w in new]
                queue += new.tolist()
    return out


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a block of sets, by products of 0/1 matrices of few columns at a time."""
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df[column] > 1
    rows, column = rows[shared], column[shared]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    _, column = np.unique(column, return_inverse=True) if len(column) else (None, column)
    width = 2048
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for lo, hi in zip(edges[:-1], edges[1:]):
        if hi > lo:
            x = np.zeros((len(sets), width), np.float32)
            x[rows[lo:hi], column[lo:hi] % width] = 1
            out += x @ x.T
    return out


def _verify(percent: int):
    def kernel(group):
        sets = [shingles(word_hashes(t.encode())) for t in group["text"]]
        ids, block = group["id"].to_numpy(), group["block"].to_numpy()
        size = np.array([len(x) for x in sets])
        both = shared_counts(sets)
        near = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        if block.min() != block.max():  # pairs within a block are another task's
            near &= block[:, None] != block[None, :]
        np.fill_diagonal(near, False)
        found = [(min(ids[a], ids[b]), max(ids[a], ids[b])) for a, b in _spanning(near)]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return kernel


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label): the smallest node of each component of the undirected links (a, b).

    Large-star hangs larger neighbours below the smallest one, small-star does the same upwards; each
    round is written to the shared folder, and rounds end when the links no longer change.
    """
    edges = scratch.save(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        new = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()
        if new == state or new[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        state = new
        both = edges.union(edges.select("v", "u"))
        # the minima are written first, so that the join may split a node with very many links
        low = first = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")), "minima")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        large = scratch.save(large, "large")
        low = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).distinct()
        old, edges = edges, scratch.save(small, "links")
        scratch.drop(old, first, large, low)


def _apart(hot: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """Units of a large bucket's members that the first pass has not brought into its largest component, against all its members."""
    named = hot.select("band", "id").join(labels, F.col("id") == F.col("node"), "left").select("band", "id", F.coalesce("label", "id").alias("component"))
    sizes = named.groupBy("band", "component").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("band").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all")).filter("all > top.n")
    parts = lambda n: F.ceil(n / block).cast("int")
    sizes = sizes.select("band", F.col("top.component").alias("largest"), parts(F.col("all") - F.col("top.n")).alias("outer"), parts(F.col("all")).alias("inner"))
    placed = named.join(sizes, "band")
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.filter("component <> largest").select("band", "id", F.lit(0).alias("block"), deal("outer").alias("i"), every("inner").alias("j"))
    return left.union(placed.select("band", "id", F.lit(1).alias("block"), every("outer").alias("i"), deal("inner").alias("j")))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Rows whose 5-word shingle sets have 100 * intersection >= percent * union are linked; component_id
    is the smallest id reachable, kept marks the row that stands for its component.

    Null, empty or blank texts have no shingles and are linked with nothing. Rows that share an id
    are one document: a link of any is a link of all. A row with a null id is linked with nothing; its
    component_id is null and it is kept. Other columns are ignored. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    described = scratch.save(rows.mapInArrow(_describe, "id bigint, n bigint, digest binary, bands array<bigint>"), "described")
    known = described.filter("id is not null and digest is not null")
    classes = scratch.save(known.groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    bands = (
        known.join(classes.withColumnRenamed("digest", "d"), F.col("digest") == F.col("d")).filter("id = rep")
        .select("id", F.explode("bands").alias("band"))
    )
    bands = scratch.save(bands.repartition("band"), "bands")
    buckets = (
        bands.groupBy("band").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.bit_xor(F.xxhash64("id")).alias("x"))
        .filter("lo < hi").groupBy("n", "lo", "hi", "x").agg(F.min("band").alias("band"))
        .select("band", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    )
    members = bands.join(buckets, "band").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    members = scratch.save(members, "members")
    # texts of candidates only, so that the passes below do not move all texts again; a shuffle at any size
    texts = rows.filter("id is not null and text is not null").withColumnRenamed("id", "doc")
    texts = scratch.save(texts.join(members.select("id").distinct().hint("merge"), F.col("doc") == F.col("id"), "left_semi"), "texts")

    def verified(units: DataFrame) -> DataFrame:
        placed = units.join(texts, F.col("id") == F.col("doc")).select("band", "i", "j", "id", "block", "text")
        return scratch.save(placed.groupBy("band", "i", "j").applyInPandas(_verify(percent), "a bigint, b bigint"), "verified")

    to = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    links = verified(members.select("band", "id", "block", F.lit(0).alias("i"), F.explode(to).alias("j")))
    hot = members.filter("blocks > 1")
    if hot.limit(1).count():
        links = links.union(verified(_apart(hot, components(links, scratch), block)))
    labels = components(links, scratch)
    named = classes.join(labels, classes.rep == labels.node, "left").select(F.col("digest").alias("d"), F.coalesce("label", "rep").alias("component"))
    out = described.select("id", "n", "digest").join(named, F.col("digest") == F.col("d"), "left")
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
