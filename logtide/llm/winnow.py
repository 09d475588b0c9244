"""Document fingerprints by winnowing, in DataFrame functions only.

A text is read as pieces in lower case: up to ``PIECE`` characters of a word, or single characters of
the scripts that put no spaces between words and of runs longer than ``WORD``. A rolling (cyclic polynomial) hash
covers every ``K`` pieces; of every ``W`` neighbouring hashes the smallest is chosen, of equal ones
the rightmost, and its position is kept. So any run of ``K + W - 1`` pieces that two texts share is
found in both fingerprints.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, W, PIECE, WORD = 4, 4, 4, 16
#: From Thai to Hangul a character is a piece of its own, and in a run of more than WORD characters until WORD are left.
_LETTER = r"[^\x20\x09-\x0D\u0E00-\uD7FF]"
PIECES = rf"{_LETTER}{{1,{PIECE}}}(?!{_LETTER}{{{WORD - PIECE + 1}}})|[^\x20\x09-\x0D]"
_SPACES, _NO_GAPS = "\t\n\x0b\f\r", r"[\u0E00-\uD7FF]"
#: Documents that one task orders, until there are MOST buckets; keys that one task ranks.
BUCKET_ROWS, MOST, RANKED = 2_000, 16_384, 10_000


def _rotate(x: Column, bits: int) -> Column:
    return F.shiftleft(x, bits).bitwiseOR(F.shiftrightunsigned(x, 64 - bits))


def _beside(name: str, step: int, f) -> Column:
    """f of each element and the one ``step`` further on."""
    n = F.greatest(F.size(name) - step, F.lit(0))
    return F.zip_with(F.slice(name, F.lit(1), n), F.slice(name, F.lit(step + 1), n), f)


def _spaced(text: str | Column) -> Column:
    """A text with each white space character as a plain space, which cuts the same pieces."""
    return F.translate(text, _SPACES, " " * len(_SPACES))


def _word_hashes(word: Column) -> Column:
    """Hashes of the pieces of one word. Cut by position where that is what PIECES matches, which costs a fraction."""
    n = F.char_length(word)
    part = lambda i: F.xxhash64(F.substring(word, i, PIECE))
    cut = F.when(n <= PIECE, F.array(F.xxhash64(word)))
    for pieces in range(2, WORD // PIECE + 1):
        cut = cut.when(n <= PIECE * pieces, F.array(*(part(1 + PIECE * i) for i in range(pieces))))
    matched = F.transform(F.regexp_extract_all(word, F.lit(PIECES), F.lit(0)), lambda t: F.xxhash64(t))
    return F.when((n > WORD) | ((n != F.octet_length(word)) & F.rlike(word, F.lit(_NO_GAPS))), matched).otherwise(cut)


def piece_hashes(spaced: str | Column) -> Column:
    """Hashes of all pieces of a text whose white space is plain spaces. No piece reaches over a space, nor does its choice."""
    return F.flatten(F.transform(F.array_remove(F.split(F.lower(spaced), " "), F.lit("")), _word_hashes))


def fingerprint(df: DataFrame, text: str, out: str, hashes: str | None = None) -> DataFrame:
    """Adds ``out``: the chosen grams of a text column as (hash, pos), in order of position, and ``out``_set: their hashes.

    ``hashes`` names a column of the text's piece hashes, if there is one.
    """
    df = df.withColumn("_h", F.col(hashes) if hashes else piece_hashes(_spaced(text)))
    df = df.withColumn("_h2", _beside("_h", 1, lambda x, y: _rotate(x, 7).bitwiseXOR(y)))
    df = df.withColumn("_h4", _beside("_h2", 2, lambda x, y: _rotate(x, 14).bitwiseXOR(y)))
    few = F.when(F.size("_h") > 0, F.array(F.xxhash64(F.regexp_extract_all(F.lower(text), F.lit(PIECES), F.lit(0))))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_g", F.when(F.size("_h") >= K, F.col("_h4")).otherwise(few))
    # the place of the smallest of two neighbours, then of four; of equal ones the one further right
    df = df.withColumn("_p2", F.transform("_g", lambda x, i: F.when(F.get("_g", i + 1) <= x, i + 1).otherwise(i)))
    df = df.withColumn("_p4", _beside("_p2", 2, lambda i, j: F.when(F.get("_g", j) <= F.get("_g", i), j).otherwise(i)))
    whole = F.array(F.size("_g") - F.array_position(F.reverse("_g"), F.array_min("_g")).cast("int"))
    short = F.when(F.size("_g") > 0, whole).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_at", F.when(F.size("_g") >= W, F.array_distinct(F.slice("_p4", F.lit(1), F.greatest(F.size("_g") - W + 1, F.lit(0))))).otherwise(short))
    df = df.withColumn(out, F.transform("_at", lambda i: F.struct(F.get("_g", i).alias("hash"), i.alias("pos"))))
    df = df.withColumn(f"{out}_set", F.array_distinct(F.col(out)["hash"]))
    return df.drop("_h", "_h2", "_h4", "_g", "_p2", "_p4", "_at")


def shown(grams: str) -> Column:
    """A fingerprint as text: hash@position of each chosen gram."""
    return F.array_join(F.transform(grams, lambda x: F.concat(F.hex(x["hash"]), F.lit("@"), x["pos"].cast("string"))), " ")


def likeness(a: str, b: str) -> Column:
    """Dice's coefficient of two sets of hashes: 1 for two empty ones, 0 for one."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(2.0 * F.size(F.array_intersect(a, b)) / both)


def _bounds(keys: DataFrame) -> list[tuple[int | None, int]]:
    """Every so many-th key (doc_id, tie) in order: at most MOST and one for each task that ranks."""
    n = keys.count()
    step, tasks = max(BUCKET_ROWS, -(-n // MOST)), min(4_096, -(-n // RANKED))
    if not n:
        return []
    ranged = keys.repartitionByRange(tasks, "doc_id", "tie").withColumn("task", F.spark_partition_id())
    ranked = ranged.withColumn("rank", F.row_number().over(Window.partitionBy("task").orderBy("doc_id", "tie")))
    found = ranked.filter(F.col("rank") % step == 1 if step > 1 else F.lit(True)).select("doc_id", "tie").collect()
    return sorted(((r[0], r[1]) for r in found), key=lambda k: (k[0] is not None, k))


def with_next(rows: DataFrame) -> tuple[DataFrame, Window]:
    """Rows (doc_id, text) dealt into buckets of neighbouring ids, and the window that orders a bucket.

    Bounds of the buckets are keys of the table itself, so ids may lie anywhere. Every bucket also gets a
    ``ghost``: the first row of the next bucket, or of the first one after the last, so that each row's
    successor is in its own bucket and texts are shuffled once. Rows that repeat both id and text more often
    than a bucket holds are dealt over several buckets, where all but the last row's successor is its like.
    """
    rows = rows.withColumn("tie", F.xxhash64("text"))
    bounds = _bounds(rows.select("doc_id", "tie"))
    n, key = len(bounds), F.struct("doc_id", "tie")
    listed = F.from_json(F.lit(json.dumps([{"doc_id": d, "tie": t} for d, t in bounds])), "array<struct<doc_id:bigint,tie:bigint>>")
    steps = F.array(*(F.lit(1 << j) for j in reversed(range(max(1, n.bit_length())))))
    last = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step < n) & (F.get(listed, at + step) <= key), at + step).otherwise(at))
    rows = rows.withColumn("bucket", last if n else F.lit(0))
    repeats = {b: bounds.index(b) for i, b in enumerate(bounds) if i and bounds[i - 1] == b}
    ghosts = rows.filter(F.get(listed, "bucket") == key) if n else rows
    if repeats:
        some = F.from_json(F.lit(json.dumps([{"doc_id": d, "tie": t, "first": i} for (d, t), i in repeats.items()])), "array<struct<doc_id:bigint,tie:bigint,first:int>>")
        first = F.get(F.filter(some, lambda x: F.struct(x["doc_id"].alias("doc_id"), x["tie"].alias("tie")) == key), F.lit(0))["first"]
        like = ghosts.filter(first.isNotNull()).groupBy("doc_id", "tie").agg(F.first("text").alias("text")).withColumn("bucket", first).select(*rows.columns)
        ghosts = ghosts.filter(first.isNull()).unionByName(like)
        rows = rows.withColumn("bucket", F.when(first.isNotNull(), first + F.pmod(F.monotonically_increasing_id(), F.col("bucket") - first + 1).cast("int")).otherwise(F.col("bucket")))
    ghosts = ghosts.withColumn("bucket", F.pmod(F.col("bucket") - 1, F.lit(max(n, 1)))).withColumn("ghost", F.lit(1))
    return rows.withColumn("ghost", F.lit(0)).unionByName(ghosts), Window.partitionBy("bucket").orderBy("ghost", "doc_id", "tie")


def compare_edited(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 4) code points replaced by the first as
    many of the next row's text by ascending doc_id; after the last comes the first. A null text is the
    empty one: no fingerprint, and 1.0 near another empty one. Null ids come first; rows that share an
    id follow one another by a hash of their text. Ids may lie anywhere in their type's range. Other
    columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows, order = with_next(rows)
    df = rows.withColumn("n_chars", F.char_length("text").cast("bigint")).withColumn("next", F.coalesce(F.lead("text").over(order), "text"))
    cut = F.expr("n_chars div 4").cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substring("next", F.lit(1), cut))
    # both texts begin with the same words: up to the last space before the cut they are hashed once
    kept = _spaced(F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int")))
    df = df.withColumn("edited", edited).withColumn("_last", F.char_length(F.substring_index(kept, " ", -1)))
    df = df.withColumn("_same", (F.col("n_chars") - cut - F.col("_last")).cast("int"))
    rest = lambda c: piece_hashes(_spaced(F.substring(c, F.col("_same") + 1, F.char_length(c))))
    df = df.withColumn("_head", piece_hashes(_spaced(F.substring("text", F.lit(1), F.col("_same")))))
    df = df.withColumn("own_h", F.concat("_head", rest("text"))).withColumn("other_h", F.concat("_head", rest("edited")))
    df = fingerprint(fingerprint(df, "text", "own", "own_h"), "edited", "other", "other_h")
    df = df.select("bucket", "ghost", "doc_id", "tie", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "other", "own_set", "other_set")
    df = df.withColumn("next_set", F.coalesce(F.lead("own_set").over(order), "own_set")).filter("ghost = 0")
    return df.select(
        "doc_id", "n_chars", "edited_sha256", shown("own").alias("fingerprint"), shown("other").alias("edited_fingerprint"),
        likeness("own_set", "other_set").alias("near_edited"), likeness("own_set", "next_set").alias("near_next"),
    )
