"""The corpus pipeline: each stage reads what its predecessor kept, as Parquet.

Order: toxic documents go; one document of each near-duplicate group stays; documents that leak
benchmark items go; personal data is exchanged for surrogates; the mix to target weights decides how
often each document is taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm import decontam, mixing, neardup, surrogate, toxicity
from logtide.llm.common import Scratch, with_row_ids

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the toxicity model does not reject.

    The score is a function of the text alone, so it is computed beside the other columns of the row.
    """
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model).select(*COLUMNS)


def _without(docs: DataFrame, lost: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The rows whose _row is not among the ids of ``lost``."""
    lost = scratch.save(lost.select(F.col("doc_id").alias("_lost")).distinct(), name)
    return docs.join(lost, docs["_row"] == lost["_lost"], "left_anti").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group; rows without an id or with the same one count one by one, nulls last."""
    scratch = Scratch(spark, "pipeline")
    docs = with_row_ids(docs, scratch)
    return _without(docs, neardup.near_duplicates(docs, id_col="_row", percent=80).filter("not kept"), scratch, "duplicates")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that leak no benchmark item; each row is judged by its own text."""
    scratch = Scratch(spark, "pipeline")
    docs = with_row_ids(docs, scratch)
    return _without(docs, decontam.leaks(docs, _read(spark, sf_dir, "benchmark"), id_col="_row"), scratch, "leaks")


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exchanges personal data and secrets for surrogates; n_chars follows the text."""
    return surrogate.replace(docs, key="logtide").withColumn("n_chars", F.char_length("text").cast("bigint")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds size, source_size, target, taken and copies to each document; copies says how often it is used."""
    return mixing.with_copies(docs).select(*COLUMNS, "size", "source_size", "target", "taken", "copies")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("personal_data", replace_personal_data),
    ("mixing", mix_sources),
]

#: Trees, seating of minima and surrogates have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; each result is written and read again."""
    scratch = Scratch(spark, "corpus")
    docs = _read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        old, docs = docs, scratch.save(stage(spark, docs, sf_dir), name)
        if hasattr(old, "_scratch_path"):
            scratch.drop(old)
    return docs
