"""The registered queries of this package: thin shells that apply an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, htmlcut, langid, mixing, neardup, pitmanyor, surrogate, tokencount, toxicity, winnow
from .common import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.rate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlcut.extract(_table(spark, sf_dir, "pages"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_edited(_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cache = f"{Scratch(spark, 'token-counts').root}/cache"  # starts empty, so the run encodes every distinct text
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), cache)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitmanyor.score_all(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogate.pseudonymize(_table(spark, sf_dir, "documents"), key="logtide")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_benchmark_decontamination, op2_toxicity, op3_source_mixing, op4_minhash_near_dedup, op5_html_extraction, op6_fingerprints, op7_token_counts, op8_lm_scoring, op9_language_id, op10_pii_surrogates)
}

LEAKS_SQL = r"""
WITH item_words AS (
  SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
items AS (SELECT DISTINCT item_id, w, len(w) AS n FROM item_words WHERE len(w) > 0),
item_grams AS (
  SELECT item_id, n, greatest(n - 4, 1) AS total, gram, count(*) AS c FROM (
    SELECT item_id, n, unnest(CASE WHEN n < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, n - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS gram FROM items)
  GROUP BY ALL),
doc_words AS (SELECT DISTINCT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT DISTINCT least(n, 5) AS k FROM items),
doc_grams AS (
  SELECT doc_id, k, len(w) AS doc_n, unnest(range(0, len(w) - k + 1)) AS pos, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS gram
  FROM doc_words, sizes WHERE len(w) >= k),
hits AS (
  SELECT DISTINCT d.doc_id, i.item_id, i.n, i.total, d.k, d.doc_n, d.pos FROM doc_grams d JOIN item_grams i ON d.gram = i.gram AND d.k = least(i.n, 5)),
starts AS (
  SELECT DISTINCT doc_id, item_id, n, total, k, doc_n, unnest(CASE WHEN doc_n < n THEN [0] ELSE range(greatest(0, pos - total + 1), least(pos, doc_n - n) + 1) END) AS start_word FROM hits),
wide AS (
  SELECT s.doc_id, s.item_id, s.n, s.total, s.start_word, least(s.doc_n - s.k + 1, s.total) AS window_total, d.gram, count(*) AS c
  FROM starts s JOIN doc_grams d ON d.doc_id = s.doc_id AND d.k = s.k AND d.pos >= s.start_word AND d.pos < s.start_word + s.total
  GROUP BY ALL),
scored AS (
  SELECT w.doc_id, w.item_id, w.n, w.start_word, w.total, w.window_total, CAST(sum(least(w.c, i.c)) AS BIGINT) AS shared
  FROM wide w JOIN item_grams i ON i.item_id = w.item_id AND i.gram = w.gram GROUP BY ALL),
near AS (
  SELECT *, CAST(shared AS DOUBLE) / (total + window_total - shared) AS similarity FROM scored)
SELECT doc_id, item_id, CAST(start_word AS BIGINT) AS start_word, CAST(n AS BIGINT) AS n_words, similarity FROM near WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start_word) = 1
"""

NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM words),
texts AS (SELECT g, min(doc_id) AS rep, len(g) AS n FROM (SELECT doc_id, list_sort(g) AS g FROM grams) GROUP BY g),
single AS (SELECT rep, n, unnest(g) AS gram FROM texts),
pairs AS (
  SELECT a.rep AS a, b.rep AS b FROM single a JOIN single b ON a.gram = b.gram AND a.rep < b.rep
  GROUP BY a.rep, b.rep HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT rep, rep AS other FROM texts UNION SELECT r.rep, l.b FROM reach r JOIN links l ON l.a = r.other),
named AS (SELECT rep, min(other) AS component FROM reach GROUP BY rep)
SELECT d.doc_id, CAST(len(d.g) AS BIGINT) AS n_shingles, CASE WHEN len(d.g) = 0 THEN d.doc_id ELSE n.component END AS component_id, d.doc_id = (CASE WHEN len(d.g) = 0 THEN d.doc_id ELSE n.component END) AS kept
FROM grams d JOIN texts t ON list_sort(d.g) = t.g JOIN named n ON n.rep = t.rep
"""

#: The other operators have no SQL form; tests hold them against brute force, round trips or held-out accuracy.
ORACLE_SQL: dict[str, str] = {"op1_benchmark_decontamination": LEAKS_SQL, "op4_minhash_near_dedup": NEAR_DUPLICATES_SQL}
