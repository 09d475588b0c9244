"""Toxicity: gradient-boosted trees over dense features of a text, calibrated by isotonic regression.

Features are densities of a fixed and of a learned lexicon, closeness of their hits to second-person
words, capitals, punctuation and obfuscation. The learned lexicon holds words and word beginnings
that labelled toxic documents use and others do not, found by document counts over a bounded sample.
The features of a training row come from a lexicon learned without that row's fold, and the
calibration sees predictions of trees that did not see the row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, in_fold

# Insults and second-person words.
INSULTS = frozenset(
    """asshole bastard bitch clown coward creep crap cretin damn degenerate disgusting dumb dumbass
    dunce filth filthy fool freak garbage hate hideous idiot idiotic imbecile jerk kill lame liar
    loser lowlife maggot moron moronic nasty parasite pathetic pervert pig rat rotten scum scumbag
    shit shut sick slime sucker stupid swine thug trash troll ugly vermin vile weirdo wimp worthless
    wretch abruti connard connasse crétin débile imbécile merde ordure salaud salope stupide
    arsch arschloch dummkopf idiota idioten mistkerl scheiße schwachkopf trottel cabrón estúpido
    gilipollas imbécil mierda pendejo tonto basura escoria abschaum dumm""".split()
)
SECOND_PERSON = frozenset(
    """you your yours yourself yourselves u ur youre du dich dir dein deine deinen deiner ihr euch
    euer tu te toi ton tes vous votre vos tú ti usted ustedes vosotros os su""".split()
)
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "€": "e", "|": "l"})

EDGE = re.compile(r"^[\W_]+|[\W_]+$")
NOT_LETTER = re.compile(r"[\W\d_]+")
RUN = re.compile(r"(.)\1\1")
#: Of each byte: 1 for A-Z, 2 for ASCII marks, else 0.
KIND = np.array([1 if 65 <= b <= 90 else 2 if 33 <= b <= 126 and not chr(b).isalnum() else 0 for b in range(256)])
FOLDS, PREFIXES, REMEMBERED, NEAR = 5, (4, 5, 6), 300_000, 5
FEATURES = (
    "insult_density", "insult_count", "word_density", "word_count", "stem_density", "stem_count", "top_log_odds",
    "sum_log_odds", "hit_near_you", "you_density", "capitals", "upper_words", "exclamations", "punctuation",
    "repeats", "obfuscated", "decorated", "log_words",
)


def core(token: str) -> str:
    """A token without marks at its ends, in lower case."""
    return EDGE.sub("", token).lower()


def plain(token: str) -> str:
    """A token with look-alike digits and marks read as letters."""
    return NOT_LETTER.sub("", token.lower().translate(LEET))


def terms(token: str) -> list[str]:
    """What a lexicon may hold of a token: the word itself and its beginnings."""
    w = core(token)
    return [w, *(f"{w[:n]}~" for n in PREFIXES if len(w) > n)] if w else []


@dataclass
class Lexicon:
    """Learned terms with their log odds."""

    odds: dict[str, float] = field(default_factory=dict)

    def token(self, token: str) -> list[float]:
        """insult, learned word, learned stem, log odds, second person, upper case, obfuscated, decorated, repeats."""
        w = core(token)
        bare = token.rstrip(".,;:!?\"')").lstrip("\"'(").lower()
        p = plain(bare)
        whole = self.odds.get(w, 0.0)
        odds = max([whole, *(self.odds.get(f"{w[:n]}~", 0.0) for n in PREFIXES if len(w) > n)])
        inner = w != "" and bool(NOT_LETTER.search(w)) and any(c.isalpha() for c in w)
        disguised = inner or bare != w
        if odds == 0.0 and disguised and p:
            odds = self.odds.get(p, 0.0)
        return [
            float(w in INSULTS or (disguised and p in INSULTS)), float(whole > 0), float(odds > 0 and whole <= 0), odds, float(w in SECOND_PERSON),
            float(len(w) > 2 and token.isupper()), float(inner), float(len(token) - len(w) > 2), float(bool(RUN.search(w))),
        ]


class Describer:
    """Dense features of texts; remembers the tokens it has seen, up to a bound."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.at, self.table = lexicon, {}, np.zeros((1024, 9))

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        tokens = text.split()
        if len(self.at) > REMEMBERED:
            self.at.clear()
        at = self.at
        for t in set(tokens):
            if t not in at:
                if len(at) == len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[len(at)] = self.lexicon.token(t)
                at[t] = len(at)
        rows = self.table[np.fromiter(map(at.__getitem__, tokens), np.int64, len(tokens))]
        n, chars = max(1, len(tokens)), max(1, len(text))
        sums = rows.sum(0)
        hits = (rows[:, 0] > 0) | (rows[:, 3] > 0)
        near = 0.0
        if hits.any() and sums[4]:
            you = np.flatnonzero(rows[:, 4])
            where = np.flatnonzero(hits)
            right = np.searchsorted(you, where)
            gap = np.minimum(np.abs(you[np.minimum(right, len(you) - 1)] - where), np.abs(you[np.maximum(right - 1, 0)] - where))
            near = float((gap <= NEAR).mean())
        kinds = np.bincount(KIND[np.frombuffer(text.encode(), np.uint8)], minlength=3)
        upper, marks = int(kinds[1]), int(kinds[2])
        return np.array([
            sums[0] / n, min(sums[0], 20), sums[1] / n, min(sums[1], 20), sums[2] / n, min(sums[2], 20), rows[:, 3].max(initial=0.0), min(sums[3], 60.0),
            near, sums[4] / n, upper / chars, sums[5] / n, text.count("!") / chars, marks / chars, sums[8] / n, sums[6] / n, sums[7] / n, math.log1p(len(tokens)),
        ])


def learn_lexicon(positive: dict[str, int], negative: dict[str, int], n_pos: int, n_neg: int, *, least: int = 3, odds: float = 2.5) -> Lexicon:
    """Terms in at least ``least`` toxic documents whose smoothed log odds are at least ``odds``."""
    out = {}
    for term, p in positive.items():
        if p >= least:
            x = math.log((p + 0.5) / (n_pos + 1)) - math.log((negative.get(term, 0) + 0.5) / (n_neg + 1))
            if x >= odds:
                out[term] = x
    return Lexicon(out)


@dataclass
class Trees:
    """Boosted regression trees for the logistic loss; every node tests feature <= cut."""

    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, *, rounds: int = 50, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Fits trees on histograms of quantile bins with second-order gains."""
    p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    model = Trees(math.log(p / (1 - p)), [], depth)
    cuts = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], 1)
    width, columns = bins + 1, x.shape[1]
    raw = np.full(len(y), model.base)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-raw))
        grad, hess = y - q, q * (1 - q) + 1e-9
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            key = ((node - first)[:, None] * columns + np.arange(columns)) * width + binned
            shape = (count, columns, width)
            g = np.bincount(key.ravel(), np.repeat(grad, columns), count * columns * width).reshape(shape).cumsum(2)
            h = np.bincount(key.ravel(), np.repeat(hess, columns), count * columns * width).reshape(shape).cumsum(2)
            G, H = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (G - g) ** 2 / (H - h + ridge) - G**2 / (H + ridge)
            gain[(h < least / 4) | (H - h < least / 4)] = -1
            best = gain.reshape(count, -1).argmax(1)
            for k in range(count):
                f, b = divmod(int(best[k]), width)
                if gain[k, f, b] > 1e-9 and b < len(cuts[f]):
                    feature[first + k], cut[first + k] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
        at = node - (2**depth - 1)
        leaf = rate * np.bincount(at, grad, 2**depth) / (np.bincount(at, hess, 2**depth) + ridge)
        model.trees.append((feature, cut, leaf))
        raw = raw + leaf[at]
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: points of a non-decreasing map from scores to label means."""
    order = np.argsort(score, kind="stable")
    values, first = np.unique(score[order], return_index=True)
    weight = np.diff(np.append(first, len(score))).astype(float)
    mean = np.add.reduceat(y[order].astype(float), first) / weight
    blocks: list[list[float]] = []
    for v, w, m in zip(values, weight, mean):
        blocks.append([v, v, w, m])
        while len(blocks) > 1 and blocks[-2][3] >= blocks[-1][3]:
            _, hi, w2, m2 = blocks.pop()
            lo, _, w1, m1 = blocks[-1]
            blocks[-1] = [lo, hi, w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2)]
    xs = [v for b in blocks for v in ((b[0], b[1]) if b[0] < b[1] else (b[0],))]
    ys = [b[3] for b in blocks for _ in range(2 if b[0] < b[1] else 1)]
    return np.array(xs), np.array(ys)


def centred(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The isotonic fit with each step's value at the mean of its scores, so that it rises between steps too."""
    fitted = np.interp(score, *isotonic(score, y))
    values, step = np.unique(fitted, return_inverse=True)
    return np.bincount(step, score) / np.bincount(step), values


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    points: tuple[np.ndarray, np.ndarray] | None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(x):
            return np.clip(x[:, 1] / 4, 0, 1)
        raw = self.trees.raw(x)
        return np.clip(np.interp(raw, *self.points), 0, 1)


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def flush():
        keys = list(counts)
        out = pa.record_batch([pa.array([k[0] for k in keys]), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], ["term", "fold", "toxic", "n"])
        counts.clear()
        return out

    for batch in batches:
        for text, fold, toxic in zip(*(c.to_pylist() for c in batch.columns)):
            counts.update((t, fold, toxic) for t in {t for token in set(text.split()) for t in terms(token)})
            if len(counts) > 400_000:
                yield flush()
    if counts:
        yield flush()


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 8_000) -> Model:
    """Learns from about ``sample_rows`` labelled documents chosen by a hash of their ids; the lexicon has all their telling terms.

    ``docs`` has doc_id and text, ``labels`` has doc_id and toxic. Rows with a null id, text or label
    teach nothing. With labels of one kind only, the score is the capped count of fixed insults.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    total = max(1, known.count())
    share = min(1.0, sample_rows / total)
    chosen = known.filter(F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1_000_000)) < math.ceil(share * 1_000_000))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc"), F.col("text").alias("text")).filter("doc is not null and text is not null")
    sample = texts.join(F.broadcast(chosen), texts.doc == chosen.id).select("text", F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int").alias("fold"), F.least("toxic", F.lit(1)).alias("toxic"))
    scratch = Scratch(spark, "toxicity")
    sample = scratch.save(sample, "sample")
    counted = sample.mapInArrow(_term_counts, "term string, fold int, toxic int, n bigint").groupBy("term").agg(
        *(F.sum(F.when((F.col("fold") == f) & (F.col("toxic") == t), F.col("n")).otherwise(0)).alias(f"n{f}{t}") for f in range(FOLDS) for t in (0, 1))
    )
    pos = sum(F.col(f"n{f}1") for f in range(FOLDS))
    neg = sum(F.col(f"n{f}0") for f in range(FOLDS))
    rows = counted.filter((pos >= 3) & (pos * 3 >= neg)).orderBy("term").collect()  # bounded by the sample
    size = {(r["fold"], r["toxic"]): r["n"] for r in sample.groupBy("fold", "toxic").agg(F.count("*").alias("n")).collect()}

    def lexicon(without: int | None) -> Lexicon:
        use = [f for f in range(FOLDS) if f != without]
        part = [{r["term"]: n for r in rows if (n := sum(r[f"n{f}{t}"] for f in use))} for t in (0, 1)]
        return learn_lexicon(part[1], part[0], *(sum(size.get((f, t), 0) for f in use) for t in (1, 0)))

    described = sample.mapInArrow(_features_of([lexicon(f) for f in range(FOLDS)]), "fold int, toxic int, x array<double>").toPandas()
    scratch.drop(sample)
    everything = lexicon(None)
    y = described["toxic"].to_numpy(float) if len(described) else np.zeros(0)
    if not 0 < y.sum() < len(y):
        return Model(everything, None, None)
    x, fold = np.stack(described["x"].to_numpy()), described["fold"].to_numpy()
    order = np.lexsort([*x.T, y, fold])  # so that reruns agree
    x, y, fold = x[order], y[order], fold[order]
    held = np.zeros(len(y))
    for f in range(FOLDS):
        train = fold != f
        if (fold == f).any() and 0 < y[train].sum() < train.sum():
            held[fold == f] = boost(x[train], y[train]).raw(x[fold == f])
    return Model(everything, boost(x, y), centred(held, y))


def _features_of(lexicons: list[Lexicon]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        describers = [Describer(x) for x in lexicons]
        for batch in batches:
            x = [describers[f](t).tolist() for t, f in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.record_batch([batch.column(1), batch.column(2), pa.array(x, pa.list_(pa.float64()))], ["fold", "toxic", "x"])

    return run


def _score(shared, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        describe = Describer(model.lexicon)
        for batch in batches:
            x = np.array([describe(v.as_py()) for v in batch.column(1)]).reshape(batch.num_rows, len(FEATURES))
            score = model.scores(x)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model, *, threshold: float = 0.3) -> DataFrame:
    """Per row: doc_id, held_out (crc32 of the id mod 4 is 2), score, predicted (score >= threshold).

    A null text scores as the empty one. Ids may be null (never held out) or repeat; equal texts have
    equal scores. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"), in_fold("doc_id", 4, 2).alias("held_out"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample and the trees
    return rows.mapInArrow(_score(shared, threshold), "doc_id bigint, held_out boolean, score double, predicted int")


def _keep(shared, threshold: float, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        describe = Describer(model.lexicon)
        for batch in batches:
            x = np.array([describe(v.as_py()) for v in batch.column(at)]).reshape(batch.num_rows, len(FEATURES))
            yield batch.filter(pa.array(model.scores(x) < threshold))

    return run


def keep_clean(docs: DataFrame, model: Model, *, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores below the threshold; null texts score as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_keep(shared, threshold, docs.columns.index("text")), docs.schema)


def rate(docs: DataFrame, labels: DataFrame, **fit_options) -> DataFrame:
    """Learns from the labelled rows that are not held out and scores all rows."""
    return score(docs, fit(docs.filter(~in_fold("doc_id", 4, 2)), labels, **fit_options))
