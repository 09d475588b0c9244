"""What the operators of this package share: scratch tables, word hashing and column handling."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session may lack the setting; it then gets a temporary folder of this process.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = f"file://{tempfile.mkdtemp(prefix='logtide-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def trim_heap(spark: SparkSession) -> None:
    """Collects the driver's garbage once its heap has grown to half its limit.

    Finished queries leave plans, events of tasks and broadcasts. The heap would grow to its limit over them, and
    only a full collection gives memory back to the system.
    """
    runtime = spark.sparkContext._jvm.java.lang.Runtime.getRuntime()
    if 2 * runtime.totalMemory() > runtime.maxMemory():
        spark.sparkContext._jvm.System.gc()


class Scratch:
    """Tables in the shared folder that cut lineage: a lost executor costs a re-read, not a re-run."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def save(self, df: DataFrame, name: str, **options) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        trim_heap(self.spark)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Frees tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def in_fold(doc_id: str | Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id) % modulus == remainder, F.lit(False))


def size_below(df: DataFrame, limit: int) -> bool:
    """Whether a table has at most ``limit`` rows; reads no more than it must."""
    return df.limit(limit + 1).count() <= limit


def with_row_ids(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", name: str = "_row") -> DataFrame:
    """Adds a bigint that no two rows share, in the order of the ids: the id itself, where ids are distinct and not null.

    Else the rows are written in order of their ids, nulls last, and numbered.
    """
    ids = docs.select(F.col(id_col).cast("bigint").alias("id"))
    if not ids.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 or id is null").limit(1).count():
        return docs.withColumn(name, F.col(id_col).cast("bigint"))
    order = F.col(id_col).asc_nulls_last()
    return scratch.save(docs.repartitionByRange(order, F.rand(7)).sortWithinPartitions(order).withColumn(name, F.monotonically_increasing_id()), "numbered")


# --- words as numbers ---------------------------------------------------------------------------

_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grow(n: int) -> None:
    global _POWERS, _INVERSES
    if len(_POWERS) <= n:
        size = 1 << (n + 1).bit_length()
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        _POWERS = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, _BASE))])
        _INVERSES = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, inverse))])


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a UTF-8 text with A-Z in lower case, in order."""
    raw = _LOWER[np.frombuffer(text, np.uint8)]
    gap = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]])))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    _grow(len(raw))
    total = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[raw] * _POWERS[: len(raw)])])
    return mix((total[end] - total[start]) * _INVERSES[start] + (end - start).astype(np.uint64))


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words make one shingle, none none."""
    if not len(words):
        return words
    width = min(k, len(words))
    x = np.full(len(words) - width + 1, np.uint64(width), np.uint64)
    for i in range(width):
        x = x * _BASE + words[i : len(words) - width + 1 + i]
    return np.unique(mix(x))
