"""Language identification: known words first, then ever shorter character n-grams.

A word that the labelled sample holds is scored by its log frequency in each language. Any other
word is scored by the n-grams of the longest length, from five down to one, of which it has a known
one. The model holds all words and n-grams of the sample, so the sample's size bounds it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold

LONGEST = 5
#: Numbers that a worker remembers of words it has scored.
REMEMBERED = 2_000_000


#: A letter, then letters and marks; and the same in a text of ASCII only.
WORD, ASCII_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*+"), re.compile("[a-z]+")


def words_of(text: str) -> list[str]:
    """The words of a text in lower case."""
    return (ASCII_WORD if text.isascii() else WORD).findall(text.lower())


@dataclass
class Model:
    """Log frequencies of words and n-grams: an index for each, and a row of numbers a language."""

    langs: list[str]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: list[dict[str, int]]
    gram_logs: list[np.ndarray]
    prior: np.ndarray


def _logs(counts: np.ndarray, alpha: float = 0.5) -> np.ndarray:
    return np.log((counts + alpha) / (counts.sum(0) + alpha * (len(counts) + 1)))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts.update((lang, w) for w in words_of(text))
        yield pa.record_batch([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "w", "n"])


def model_of(rows: list[tuple[str, str, int]], sizes: dict[str, int]) -> Model:
    """The model of (language, word, count) rows and the number of documents of each language."""
    langs = sorted(sizes)
    column = {x: i for i, x in enumerate(langs)}
    words: dict[str, int] = {w: i for i, w in enumerate(sorted({r[1] for r in rows}))}
    counts = np.zeros((len(words), len(langs)))
    for lang, w, n in rows:
        counts[words[w], column[lang]] += n
    grams, gram_logs = [], []
    for n in range(1, LONGEST + 1):
        index: dict[str, int] = {}
        at, of = [], []
        for w, row in words.items():
            padded = f" {w} "
            for i in range(len(padded) - n + 1):
                at.append(index.setdefault(padded[i : i + n], len(index)))
                of.append(row)
        table = np.zeros((len(index), len(langs)))
        for k in range(len(langs)):
            table[:, k] = np.bincount(np.array(at, np.int64), counts[np.array(of, np.int64), k], len(index))
        grams.append(index)
        gram_logs.append(_logs(table))
    total = max(sum(sizes.values()), 1)
    return Model(langs, words, _logs(counts), grams, gram_logs, np.log(np.array([sizes[x] for x in langs], float) / total) if langs else np.zeros(0))


def fit(docs: DataFrame, *, sample_rows: int = 2_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns all words and n-grams of about ``sample_rows`` labelled rows, chosen by a hash of their ids.

    Rows with a null text, language or id teach nothing; an empty language is one like others. Without any
    row the model knows no language and predicts ``und``. A language is known where a row of the sample has it.
    """
    labelled = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter("id is not null and text is not null and lang is not null")
    share = min(1.0, sample_rows / max(labelled.count(), 1))
    sample = labelled.filter(F.pmod(F.xxhash64("id", F.lit("langid")), F.lit(1_000_000)) < math.ceil(share * 1_000_000))
    sizes = {r[0]: r[1] for r in sample.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    counted = sample.select("lang", "text").mapInArrow(_count_words, "lang string, w string, n bigint").groupBy("lang", "w").agg(F.sum("n").alias("n"))
    return model_of([tuple(r) for r in counted.collect()], sizes)  # both bounded by the sample


def word_scores(model: Model, word: str) -> np.ndarray:
    """Log frequencies of a word in each language: its own, or those of its longest known n-grams."""
    at = model.words.get(word)
    if at is not None:
        return model.word_logs[at]
    padded = f" {word} "
    for n in range(LONGEST, 0, -1):
        index = model.grams[n - 1]
        known = [index[g] for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) in index]
        if known:
            return model.gram_logs[n - 1].take(known, 0).sum(0) * (max(1.0, len(padded) / n) / len(known))
    return np.zeros(len(model.langs))


def classify(model: Model, text: str | None) -> tuple[str, float]:
    """The likeliest language and its posterior; ``und`` and 0 without a letter."""
    counts = Counter(words_of(text)) if text else None
    if not counts or not model.langs:
        return "und", 0.0
    total = model.prior + sum(k * word_scores(model, w) for w, k in counts.items())
    return _pick(model, total)


def _pick(model: Model, total: np.ndarray) -> tuple[str, float]:
    p = np.exp(total - total.max())
    best = int(np.argmax(p))
    return model.langs[best], float(p[best] / p.sum())


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        at: dict[str, int] = {}
        width = max(1, len(model.langs))
        table = np.zeros((1024, width))
        for batch in batches:
            names, scores = [], []
            for value in batch.column(1):
                counts = Counter(words_of(value.as_py())) if value.is_valid else None
                if not counts or not model.langs:
                    names.append("und")
                    scores.append(0.0)
                    continue
                if len(at) * width > REMEMBERED:
                    at.clear()
                for w in counts:
                    if w not in at:
                        if len(at) == len(table):
                            table = np.concatenate([table, np.zeros_like(table)])
                        table[len(at)] = word_scores(model, w)
                        at[w] = len(at)
                rows = np.fromiter(map(at.__getitem__, counts), np.int64, len(counts))
                name, score = _pick(model, model.prior + np.fromiter(counts.values(), float, len(counts)) @ table[rows])
                names.append(name)
                scores.append(score)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out (crc32 of the id mod 4 is 2), lang_pred, score.

    Null texts and texts without a letter are ``und`` with score 0; ties go to the first language by
    name. Ids may be null (never held out) or repeat. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), in_fold(id_col, 4, 2).alias("held_out"))
    return rows.mapInArrow(_predict(spark.sparkContext.broadcast(model)), "doc_id bigint, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, **fit_options) -> DataFrame:
    """Learns from the rows that are not held out and predicts all rows."""
    return predict(docs, fit(docs.filter(~in_fold("doc_id", 4, 2)), **fit_options))
