"""Token counts behind a digest cache.

The cache is a Parquet table of (content digest, tokenizer digest, count) in a shared folder. Content is
normalised first: where no token reaches across spaces and line ends, a run of them counts as one space
and those at the ends don't count. A run joins the digests of its texts to the cache, encodes one text of each digest that is missing, and appends
those counts, so a text is encoded once for a tokenizer however often it occurs or is asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Chunks between spaces and line ends that a worker remembers; beyond, it starts afresh.
REMEMBERED = 300_000
_LOADED: dict[str, object] = {}
_COUNTS: dict[str, dict[str, int]] = {}


def tokenizer_digest(path: str) -> str:
    """Names a tokenizer by its kind, library version and file content."""
    if path.endswith(".json"):
        import tokenizers as library
    elif path.endswith(".model"):
        import sentencepiece as library
    else:
        raise ValueError(f"a tokenizer file ends in .json or .model: {path}")
    return hashlib.sha256(f"{library.__name__} {library.__version__}\n".encode() + Path(path).read_bytes()).hexdigest()


def _load(path: str):
    if path not in _LOADED:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            made = Tokenizer.from_file(path)
            made.no_truncation()
            made.no_padding()
        else:
            import sentencepiece

            made = sentencepiece.SentencePieceProcessor(model_file=path)
        _LOADED[path] = made
    return _LOADED[path]


def _keeps_spaces(normalizer: dict | None) -> bool:
    """Whether a normalizer is known to change nothing beside spaces and line ends, and to add none."""
    if normalizer is None:
        return True
    if normalizer.get("type") == "Sequence":
        return all(map(_keeps_spaces, normalizer.get("normalizers", [])))
    if normalizer.get("type") == "Replace":  # of white space by a space
        return normalizer.get("pattern") == {"Regex": r"\s+"} and normalizer.get("content") == " "
    return normalizer.get("type") in ("NFC", "Lowercase")


def _splits_at_spaces(path: str) -> bool:
    """Whether no token of this tokenizer can reach across a space or line end."""
    import json

    if not path.endswith(".json"):
        return False
    made = json.loads(Path(path).read_text())
    if not _keeps_spaces(made.get("normalizer")):
        return False
    steps = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
    patterns = [s.get("pattern", {}).get("Regex", "") for s in steps if s.get("type") == "Split" and s.get("invert") and s.get("behavior") == "Removed"]
    flat = all(not (t["lstrip"] or t["rstrip"]) and " " not in t["content"] and "\n" not in t["content"] for t in made.get("added_tokens", []))
    return flat and any(all(x in p for x in (r"[^\s\p{L}\p{N}]+", r"[\p{L}]+")) and " " not in p for p in patterns)


def token_counts_of(texts: list[str], path: str) -> list[int]:
    """Counts as the library gives them, without special tokens being added.

    Where tokens never cross a space, counts of the chunks between spaces and line ends add up, and a
    worker keeps those of the chunks it has seen.
    """
    made = _load(path)
    if not path.endswith(".json"):
        return [len(x) for x in made.encode(texts, num_threads=1)]
    if path not in _COUNTS:
        _COUNTS[path] = {"": 0} if _splits_at_spaces(path) else {}
    known = _COUNTS[path]
    if not known:
        return [len(x) for x in made.encode_batch_fast(texts, add_special_tokens=False)]
    if len(known) > REMEMBERED:
        known.clear()
        known[""] = 0
    chunks = [t.replace("\n", " ").split(" ") for t in texts]
    new = list({c for cs in chunks for c in cs if c not in known})
    for i in range(0, len(new), 20_000):
        part = new[i : i + 20_000]
        known.update(zip(part, (len(x) for x in made.encode_batch_fast(part, add_special_tokens=False))))
    return [sum(map(known.__getitem__, cs)) for cs in chunks]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for batch in batches:
            counts, i = [], 0
            while i < batch.num_rows:  # slices of bounded size
                j, size = i, 0
                while j < batch.num_rows and (size < 4_000_000 or j == i):
                    size += len(batch.column(1)[j].as_buffer())
                    j += 1
                counts += token_counts_of(batch.column(1).slice(i, j - i).to_pylist(), path)
                i = j
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64())], ["digest", "n"])

    return run


def _cached(spark: SparkSession, cache_path: str, version: str) -> DataFrame | None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_path)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    rows = spark.read.schema("digest binary, tokenizer string, n bigint").parquet(cache_path)
    return rows.filter(F.col("tokenizer") == version).groupBy("digest").agg(F.min("n").alias("n"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, *, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as the empty one: no bytes, no tokens. Ids may be null or repeat; each row gets
    its own result. Other columns are ignored. An empty table gives an empty one and adds nothing to
    the cache.
    """
    spark, version = docs.sparkSession, tokenizer_digest(tokenizer_path)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if _splits_at_spaces(tokenizer_path):
        normal = F.trim(F.regexp_replace("text", "[ \\n]+", " "))
    else:
        normal = F.col("text")
    rows = rows.withColumn("normal", normal).withColumn("digest", F.unhex(F.sha2("normal", 256)))
    known, texts = _cached(spark, cache_path, version), rows.select("digest", F.col("normal").alias("text"))
    if known is not None:  # digests alone first, so that only texts of misses move
        missing = rows.select("digest").distinct().join(known, "digest", "left_anti")
        texts = texts.join(missing, "digest", "left_semi")
    wanted = texts.groupBy("digest").agg(F.first("text").alias("text"))
    new = wanted.select("digest", "text").mapInArrow(_encode(tokenizer_path), "digest binary, n bigint")
    new.select("digest", F.lit(version).alias("tokenizer"), "n").write.mode("append").parquet(cache_path)
    sizes = rows.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), "digest")
    # written first, so that the join below may split a digest that many rows share
    counts = Scratch(spark, "token-counts").save(_cached(spark, cache_path, version), "counts")
    return sizes.join(counts, "digest").select("doc_id", "n_bytes", F.col("n").alias("n_tokens"), (F.col("n") > limit).alias("over_limit"))
