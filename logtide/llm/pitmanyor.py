"""Scores of texts under a hierarchical Pitman-Yor language model.

Every word is seated in the restaurant of its context, the word before it or a text's start, whatever that
word's frequency; all contexts share one parent restaurant, whose base is uniform over the vocabulary and
one unseen word. Given how many customers a dish has, predictions depend on its number of tables only,
so the sampler is a collapsed Gibbs sampler of table numbers: P(t) is proportional to S(c, t) x^t, with
generalized Stirling numbers S and the mass x of a new table.

A word seen once in a context has one table there, in every sample, so a round samples the cells (word, context,
count) of two customers and more, with the number of the others a word and a context. Cells and tokens are dealt
out to parts by word; those of the most frequent words (``contexts``) by word and context. Between rounds, what
tasks must know of these words is summed, and parts send the tables of all other contexts to owners that sum them
and answer. Probabilities are averaged over the last rounds. Each part scores its own tokens, and owners sum texts.

A part is one row; its numbers are packed columns, so Spark moves few rows, and numpy does the work on them.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, in_fold, mix, word_hashes

#: Frequent words whose totals all tasks know, words listed by a model, and words with short codes.
CONTEXTS, LOCAL, SHORT = 1_023, 16_384, 131_072
#: Rounds of sampling, of which the last ones are averaged; sweeps of a task within a round.
ROUNDS, KEPT, SWEEPS = 4, 2, 2
#: Tokens of a small table's part; tokens of a part; steps in which parts are scored, so that fewer files are on disk at once.
CELLS, TOKENS, STEPS = 200_000, 1_400_000, 2
#: Texts of the sample that tells which words are frequent (less than twice as many are read).
TEXTS = 16_384
#: Seconds that py4j gets to let go of dropped plans.
PAUSE = 1.2
THETA = 1.0
END = np.int64(-7046029254386353131)
EXACT = 64
#: Customers up to which weights are multiplied rather than added as logarithms.
FEW = 12
#: Customers and tables up to which the Stirling numbers come from their recurrence.
CUSTOMERS, TABLES = 4_096, 256
#: Points at which a contour integral is taken; between them its logarithm is a polynomial in log(t + 1).
NODES = 56
#: Share of the customers up to which numbers of tables are left to the integrals.
NEAR = 0.8


def tokens_of(text: bytes | None) -> np.ndarray:
    """Hashes of the words of a text, then the one of its end."""
    return np.append(word_hashes(text).view(np.int64) if text else np.empty(0, np.int64), END)


@dataclass
class Codes:
    """Numbers of words: 2 and up by rank for the most frequent ones, else negative, by the hash.

    As contexts, a text's start is 0; 1 stands for no context.
    """

    hashes: np.ndarray  # sorted
    codes: np.ndarray

    def of(self, words: np.ndarray) -> np.ndarray:
        out = words | np.iinfo(np.int64).min
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == words, self.codes[at], out)
        return out


def numbered(texts: list[bytes | None], codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The codes of the words of some texts, after a 0; per token, the places of its word's and its context's; where each text starts."""
    parts = [tokens_of(t) for t in texts]
    start = np.concatenate([[0], np.cumsum([len(x) for x in parts])[:-1]]).astype(np.int64)
    words, which = np.unique(np.concatenate(parts), return_inverse=True)
    which += 1
    before = np.concatenate([[0], which[:-1]])
    before[start] = 0
    return np.concatenate([[0], codes.of(words)]), which, before, start


def _texts(column: pa.Array) -> Iterator[bytes | None]:
    for v in column:
        yield v.as_buffer().to_pybytes() if v.is_valid else None


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in _slices(_texts(batch.column(0))):
            words, n = np.unique(np.concatenate([tokens_of(t) for t in some]), return_counts=True)
            yield pa.record_batch([pa.array(words), pa.array(n)], ["h", "n"])


def _slices(texts: Iterator[bytes | None], size: int = 8_000_000) -> Iterator[list[bytes | None]]:
    some, total = [], 0
    for t in texts:
        some.append(t)
        total += len(t or b"")
        if total >= size:
            yield some
            some, total = [], 0
    if some:
        yield some


# --- packed columns -----------------------------------------------------------------------------


def pack(*columns: np.ndarray) -> bytes:
    """Columns of numbers as one compressed value: what is shuffled are few rows of many numbers each.

    Whole numbers are stored as differences from the least one, in as few bytes as they need, a byte's place after another.
    """
    head, planes = [], []
    for x in columns:
        low, kind, size = 0, 1, 8
        if x.dtype.kind in "ib":
            x = x.astype(np.int64, copy=False)
            low, high = (int(x.min()), int(x.max())) if len(x) else (0, 0)
            kind, size = 0, next((k for k in (1, 2, 4) if high - low < 1 << 8 * k), 8)
            low = 0 if size == 8 else low
            x = (x - low).astype(f"u{size}") if size < 8 else x
        head += [kind, size, len(x), low]
        planes.append(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), size).T).ravel())
    raw = np.concatenate(planes)
    return np.array([len(raw), len(columns), *head], np.int64).tobytes() + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpack(value: bytes) -> list[np.ndarray]:
    total, n = np.frombuffer(value, np.int64, 2).tolist()
    raw = np.frombuffer(pa.Codec("zstd").decompress(memoryview(value)[16 + 32 * n :], decompressed_size=total), np.uint8)
    out, at = [], 0
    for kind, size, length, low in np.frombuffer(value, np.int64, 4 * n, 16).reshape(-1, 4).tolist():
        x = np.ascontiguousarray(raw[at : at + length * size].reshape(size, length).T).reshape(-1)
        out.append(x.view(float) if kind else x.view(np.int64) if size == 8 else x.view(f"u{size}").astype(np.int64) + low)
        at += length * size
    return out


#: Rows between tasks: the part they go to, the one they come from, what they are, and columns.
PACKED = "part int, src int, kind int, value binary"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    part, src, kind, value = zip(*rows) if rows else ([], [], [], [])
    return pa.record_batch([pa.array(x, t) for x, t in ((part, pa.int32()), (src, pa.int32()), (kind, pa.int32()), (value, pa.binary()))], ["part", "src", "kind", "value"])


def _each(kernel):
    """Runs a kernel on rows of PACKED, a batch at a time; it yields rows of PACKED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(4))):
                yield _packed(list(kernel(*(x.as_py() for x in row))))

    return run


def _of_part(kernel):
    """Runs a kernel on all rows of a part, in an order that no shuffle changes; it yields record batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                parts.setdefault(row[0], []).append(row[1:])
        for part in sorted(parts):
            yield from kernel(part, sorted(parts.pop(part)))

    return run


def _split_by(part: np.ndarray, parts: int, kind: int, *columns: np.ndarray, src: int = -1) -> Iterator[tuple]:
    """Rows of PACKED of what goes to each part."""
    order = np.argsort(part.astype(np.uint16) if parts <= 65_536 else part, kind="stable")
    columns = [x[order] for x in columns]
    found, first = np.unique(part[order], return_index=True)
    for to, a, b in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(part)]):
        yield int(to), src, kind, pack(*(x[a:b] for x in columns))


def _owner(code: np.ndarray, parts: int) -> np.ndarray:
    return (mix(code.view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _frequent(code: np.ndarray, wide: int) -> np.ndarray:
    return (code >= 0) & (code < wide)


def _tokens(codes: Codes, wide: int, parts: int):
    """The tokens of texts, by the part of their word; those of the most frequent words by word and context.

    A row a text, word and context (kind 0), and a row a text (kind 1).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for some in _slices(_texts(batch.column(3)), 2_000_000):
                rows = batch.slice(done, len(some))
                done += len(some)
                row, held = rows.column(0).to_numpy(), rows.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                words, which, before, start = numbered(some, codes)
                text = np.repeat(np.arange(len(some)), np.diff(np.append(start, len(which))))
                code, n = _counted((text * np.int64(len(words)) + which) * len(words) + before)
                of, h, g = code // len(words) ** 2, words[code // len(words) % len(words)], words[code % len(words)]
                hot = _frequent(h, wide)
                part = _owner(np.where(hot, mix(h.view(np.uint64)).view(np.int64) ^ g, h), parts)
                out = list(_split_by(part, parts, 0, h, g, row[of], 2 * n + held[of]))
                ids = rows.column(1)
                null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
                out += _split_by(_owner(row >> 10, _owners(parts)), parts, 1, row, ids.fill_null(0).to_numpy(), 2 * null + held)
                yield _packed(out)

    return run


def _counted(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct numbers and how often each occurs."""
    return np.unique(code, return_counts=True)


# --- sampling -----------------------------------------------------------------------------------


@lru_cache(8)
def log_stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """Logs of the generalized Stirling numbers S(c, t), c and t from 0 to ``most``."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(most):
        t = np.arange(most + 1)
        stay = c - t * discount
        with np.errstate(divide="ignore", invalid="ignore"):
            kept = out[c] + np.log(np.where(stay > 0, stay, 0.0))
        kept[(t > c) | (t == 0)] = -np.inf
        out[c + 1] = np.logaddexp(np.concatenate([[-np.inf], out[c, :-1]]), kept)
    return out


@lru_cache(4)
def stirling_rows(discount: float) -> np.ndarray:
    """Logs of S(c, t) for c up to CUSTOMERS and t up to TABLES, by the recurrence in c."""
    out = np.full((CUSTOMERS + 1, TABLES + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(TABLES + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(CUSTOMERS):
            kept = out[c] + np.log(np.maximum(c - t * discount, 0.0))
            kept[0] = -np.inf
            out[c + 1] = kept
            out[c + 1, 1:] = np.logaddexp(kept[1:], out[c, :-1])
    return out


def log_stirling_at(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """Logs of S(c, t) t!, but for a term that all t of a c share; ``t`` may lie between whole numbers.

    S(c, t) t!/c! is the coefficient of z^c in ((1 - (1 - z)^d) / d)^t. Its contour integral, with z = e^-p,
    runs along a parabola through the saddle point, or around the branch point where the saddle is too near.
    """
    u = np.linspace(0.0, 1.0, 97)

    def log_q(p):  # of 1 - e^-p
        near = np.abs(p) < 1
        return np.where(near, np.log(-np.expm1(-np.where(near, p, 0.5))), np.log1p(-np.exp(-np.where(near, 2.0, p))))

    low, high = np.full(t.shape, -700.0), np.full(t.shape, np.log(40.0))
    for _ in range(50):
        p = np.exp((low + high) / 2)
        q = log_q(p)
        above = t * discount * np.exp((discount - 1) * q - p) > -c * np.expm1(discount * q)
        low, high = np.where(above, (low + high) / 2, low), np.where(above, high, (low + high) / 2)
    mu = np.maximum(np.exp(high), 6.0 / c)[..., None]
    step = np.minimum(np.sqrt(40.0 / (c[..., None] * mu * (2 - 2 * discount))), np.pi / (2 * mu))
    turn = 1 + 1j * u * step
    k = lambda p: c[..., None] * p + t[..., None] * np.log(-np.expm1(discount * log_q(p)))
    top = k(mu)
    f = (np.exp(k(mu * turn**2) - top) * turn).real
    total = (f.sum(-1) - f[..., 0] / 2) * (step * mu)[..., 0]
    with np.errstate(divide="ignore"):
        return top[..., 0] + np.log(np.maximum(total, 0.0)) - t * np.log(discount)


def log_factorial(t: np.ndarray) -> np.ndarray:
    """Logs of t! for whole t from 1 on, by Stirling's series from 16 on."""
    few = np.cumsum(np.log(np.arange(1.0, 16.0)))
    x = np.maximum(t, 16).astype(float)
    series = x * np.log(x) - x + np.log(2 * np.pi * x) / 2 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(t < 16, few[np.minimum(t, 15) - 1], series)


def stirling_curves(c: np.ndarray, most: np.ndarray, discount: float) -> np.ndarray:
    """A Chebyshev series in log(t + 1) for each c: the smooth part of log S(c, t), t from 1 to its ``most``."""
    x = np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES)
    t = np.expm1(np.log(2.0) + (x + 1) / 2 * np.log((most[:, None] + 1) / 2))
    values = log_stirling_at(np.broadcast_to(c[:, None].astype(float), t.shape), t, discount)
    turns = np.cos(np.pi * np.outer(np.arange(NODES) + 0.5, np.arange(NODES)) / NODES) * (2 / NODES)
    turns[:, 0] /= 2
    return values @ turns


def log_stirling_on(curve: np.ndarray, t: np.ndarray, most: int) -> np.ndarray:
    """Logs of S(c, t) at whole t, but for a term that all share, from one c's series."""
    x = 2 * np.log((t + 1) / 2) / np.log((most + 1) / 2) - 1
    return np.polynomial.chebyshev.chebval(x, curve) - log_factorial(t)


def _draw_far(c: np.ndarray, x: np.ndarray, most: np.ndarray, discount: float, rng: np.random.Generator, known: dict) -> np.ndarray:
    """Numbers of tables of dishes beyond the table of the recurrence, by exact weights in reach of each one's peak.

    A number of tables varies no more than a Poisson number of its mean, so all but e^-40 of its weight is in
    reach. Integrals are exact while t is not near c; a dish whose reach comes near it has its own recurrence, or,
    beyond CUSTOMERS, integrals whose logs err by 1e-5 at 0.9 c and by less than one at c - 1.
    """
    out = np.empty(len(c), np.int64)
    most = 1 << np.ceil(np.log2(most)).astype(np.int64)  # so that curves of a sweep serve the next
    end = np.minimum(most, (NEAR * c).astype(np.int64))
    draw = lambda t, logs: t[min(len(t) - 1, np.searchsorted(p := np.exp(logs - logs.max()).cumsum(), rng.random() * p[-1], "right"))]
    full = []
    for rows in np.array_split(np.arange(len(c)), len(c) // 256 + 1):
        new = np.unique([(a, b) for a, b in zip(c[rows].tolist(), end[rows].tolist()) if (discount, a, b) not in known], axis=0).reshape(-1, 2).astype(np.int64)
        if len(new):
            known.update(((discount, *pair), curve) for pair, curve in zip(new.tolist(), stirling_curves(new[:, 0], new[:, 1], discount)))
        for i in rows:
            curve = known[discount, int(c[i]), int(end[i])]
            some = np.unique(np.geomspace(1, end[i], 256).astype(np.int64))
            peak = int((log_stirling_on(curve, some, end[i]) + some * np.log(x[i])).argmax())
            low, high = some[max(0, peak - 1)], some[min(len(some) - 1, peak + 1)]
            wide = int(40 + 12 * np.sqrt(high))
            if min(most[i], high + wide) > end[i]:
                if c[i] <= CUSTOMERS:
                    full.append(i)
                else:
                    out[i] = _draw_full(int(c[i]), x[i], discount, draw)
                continue
            t = np.arange(max(1, low - wide), min(end[i], high + wide) + 1)
            out[i] = draw(t, log_stirling_on(curve, t, end[i]) + t * np.log(x[i]))
    if full:
        sizes = np.unique(c[full])
        whole = dict(zip(sizes.tolist(), _whole_rows(sizes, discount)))
        for i in full:
            t = np.arange(1, c[i] + 1)
            out[i] = draw(t, whole[int(c[i])] + t * np.log(x[i]))
    return out


def _draw_full(c: int, x: float, discount: float, draw) -> int:
    """A number of tables of many customers most of whom may have their own."""
    logs = lambda t: log_stirling_at(np.full(len(t), float(c)), t.astype(float), discount) - log_factorial(t) + t * np.log(x)
    some = np.unique(np.linspace(1, c - 1, 512).astype(np.int64))
    peak = int(logs(some).argmax())
    low, high = some[max(0, peak - 1)], some[min(len(some) - 1, peak + 1)]
    wide = int(40 + 12 * np.sqrt(c - low))
    t = np.arange(max(1, low - wide), min(c - 1, high + wide) + 1)
    return draw(t, logs(t))


def _whole_rows(sizes: np.ndarray, discount: float) -> list[np.ndarray]:
    """Logs of S(c, t), t from 1 to c, for some sorted sizes c, by the recurrence in c."""
    out, wanted = [], set(sizes.tolist())
    t = np.arange(1, sizes[-1] + 1)
    row = np.full(len(t), -np.inf)
    row[0] = 0.0
    for c in range(1, sizes[-1] + 1):
        if c in wanted:
            out.append(row[:c].copy())
        new = np.full(len(t), -np.inf)
        new[:c] = row[:c] + np.log(c - t[:c] * discount)
        new[1 : c + 1] = np.logaddexp(new[1 : c + 1], row[: min(c, len(t) - 1)])
        row = new
    return out


def _draw_few(weights: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Numbers of tables of dishes with as many customers as there are weights, few enough that no power of a mass overflows."""
    t, part = np.ones(len(x), np.int64), np.full(len(x), weights[0])
    upto = [part]
    for ratio in weights[1:] / weights[:-1]:
        part = part * (ratio * x)
        upto.append(upto[-1] + part)
    drawn = rng.random(len(x)) * upto[-1]
    for some in upto[:-1]:
        t += some < drawn
    return t


def sample_tables(c: np.ndarray, x: np.ndarray, discount: float, stirling: np.ndarray, rng: np.random.Generator, curves: dict | None = None) -> np.ndarray:
    """Numbers of tables of dishes with ``c`` customers each and masses ``x`` of a new table.

    As c grows, t - 1 tends to a Poisson number of mean x / discount, so beyond EXACT customers t is looked
    for as far as such a number can practically come. The recurrence gives the Stirling numbers of up to
    CUSTOMERS customers at up to TABLES tables, a contour integral all others.
    """
    t = np.minimum(c, 1)
    mean = x / discount
    most = np.minimum(c, np.ceil(40 + mean + 12 * np.sqrt(mean))).astype(np.int64)
    far = (c > EXACT) & ((c > CUSTOMERS) | (most > TABLES))
    if far.any():
        t[far] = _draw_far(c[far], x[far], most[far], discount, rng, {} if curves is None else curves)
    near = np.flatnonzero((c > 1) & ~far)
    near = near[np.argsort(c[near], kind="stable")]
    sizes, first = np.unique(c[near], return_index=True)
    for size, rows in zip(sizes, np.split(near, first[1:])):
        if size <= FEW:
            t[rows] = _draw_few(np.exp(stirling[size, 1 : size + 1] - stirling[size, 1]), x[rows], rng)
            continue
        end = int(size) if size <= EXACT else int(most[rows].max())
        known = stirling[size, 1 : end + 1] if size <= EXACT else stirling_rows(discount)[size, 1 : end + 1]
        k = np.arange(1, end + 1)
        for part in np.array_split(rows, len(rows) * end // 2_000_000 + 1):
            logs = known + k * np.log(x[part])[:, None]
            p = np.exp(logs - logs.max(1, keepdims=True)).cumsum(1)
            t[part] = 1 + (p < rng.random(len(part))[:, None] * p[:, -1:]).sum(1)
    return t


@dataclass
class Totals:
    """What all tasks must know of the restaurants: bounded by the number of frequent words."""

    d1: float
    d0: float
    tokens: int
    words: int
    customers: np.ndarray  # of each frequent context, by code
    tables: np.ndarray  # of each frequent context
    parent_tables: int
    all_tables: int  # of all contexts, frequent or not
    seats: np.ndarray  # tables of each frequent word, over all contexts
    dishes: np.ndarray  # tables of each frequent word in the parent restaurant

    def base(self) -> float:
        return (THETA + self.d0 * self.parent_tables) / (self.words + 1)

    def parent(self, t, s):
        """Probability of a word in the parent restaurant."""
        return (t - self.d0 * s + self.base()) / (THETA + self.all_tables)

    def share(self) -> np.ndarray:
        """Of each frequent context, what goes to the parent."""
        return (THETA + self.d1 * self.tables) / (THETA + self.customers)


# --- tables of parts ----------------------------------------------------------------------------

#: Sums over parts: single numbers, then four numbers a frequent code.
ONE, TWO, W1, W2, ONCE, EVERY, PARENTS, SEEN, ALL, FIRST = range(10)
PART = pa.schema([("part", pa.int32()), ("tokens", pa.binary()), ("cells", pa.binary()), ("seats", pa.binary()), ("texts", pa.binary()), ("sums", pa.binary())])
STATE = pa.schema([("part", pa.int32()), ("seats", pa.binary()), ("sums", pa.binary())])


def _row(schema: pa.Schema, *values) -> pa.RecordBatch:
    return pa.record_batch([pa.array([v], t) for v, t in zip(values, schema.types)], schema=schema)


def _add(sums: np.ndarray, wide: int, k: int, code: np.ndarray, value: np.ndarray) -> None:
    """Adds to the k-th number of each frequent code."""
    ok = _frequent(code, wide)
    sums[FIRST + k * wide : FIRST + (k + 1) * wide] += np.bincount(code[ok], value[ok], wide).astype(np.int64)


def _sum_of(table: DataFrame, wide: int) -> np.ndarray:
    """The sums of all parts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FIRST + 4 * wide, np.int64)
        for batch in batches:
            for v in batch.column(0).to_pylist():
                total += unpack(v)[0]
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], ["i", "v"])

    found = table.select("sums").mapInArrow(add, "i bigint, v bigint").groupBy("i").agg(F.sum("v").alias("v")).toArrow()  # a row a sum
    out = np.zeros(FIRST + 4 * wide, np.int64)
    out[found.column("i").to_numpy()] = found.column("v").to_numpy()
    return out


def _cells(wide: int):
    """What a part keeps: its tokens ordered by word and context, its cells, their seating with a table each, its texts."""

    def kernel(part: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        texts = pack(*map(np.concatenate, zip(*(unpack(v) for _, kind, v in rows if kind == 1)))) if any(k == 1 for _, k, _ in rows) else None
        found = [unpack(v) for _, kind, v in rows if kind == 0]
        none = [np.empty(0, np.int64)] * 4
        h, g, row, n = (np.concatenate(x) for x in zip(*found)) if found else none
        del found
        rows.clear()
        words, h = np.unique(h, return_inverse=True)
        contexts, g = np.unique(g, return_inverse=True)
        key = h * np.int64(max(1, len(contexts))) + g
        order = np.argsort(key)
        del h, g
        key, row, n = key[order], row[order], n[order]
        del order
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        length = np.diff(np.append(first, len(key)))
        word, g = key[first] // max(1, len(contexts)), contexts[key[first] % max(1, len(contexts))]
        c = np.add.reduceat(np.where(n & 1, 0, n >> 1), first) if len(first) else np.empty(0, np.int64)
        of = lambda x: np.bincount(word, x, len(words)).astype(np.int64)
        size, total, alone, several, seen = of(np.ones(len(word))), of(c), of(c == 1), of(c > 1), of(c > 0)
        hot, many = _frequent(words, wide), c > 1
        # words of one customer have one table
        listed = hot | (total > 1)
        at = np.unique(g[many & ~_frequent(g, wide)])
        seats = [words[listed], alone[listed], several[listed], np.ones(listed.sum(), np.int64), g[many], c[many], np.ones(many.sum(), np.int64), np.zeros(len(at), np.int64)]
        sums = np.zeros(FIRST + 4 * wide, np.int64)
        sums[[ONE, TWO, W1, W2, ONCE, EVERY, SEEN, ALL]] = [(c == 1).sum(), (c == 2).sum(), (seen[~hot] == 1).sum(), (seen[~hot] == 2).sum(), (total[~hot] == 1).sum(), (c > 1).sum(), (total[~hot] > 0).sum(), c.sum()]
        for k, (code, value) in enumerate(((g, c), (g, c == 1), (words, alone), (words, total))):
            _add(sums, wide, k, code, value)
        yield _row(PART, part, pack(length, row, n >> 1), pack(words, size, g, c), pack(*seats), texts, pack(sums))

    return _of_part(kernel)


def _owners(parts: int) -> int:
    """Tasks that sum what parts send them of contexts and of texts: fewer than parts, as each part sends to each."""
    return -(-parts // 3)


def _context_counts(wide: int, parts: int, whole: bool):
    """From the cells of a part, sums of its contexts that are not frequent: customers, cells of one customer, others.

    Asks (kind 0) for the sums of those with a cell of several customers, or of all, held out ones too.
    """
    owners = _owners(parts)

    def kernel(part: int, src: int, kind: int, value: bytes) -> Iterator[tuple]:
        _, _, g, c = unpack(value)
        rare = ~_frequent(g, wide) & (whole | (c > 0))
        g, at = np.unique(g[rare], return_inverse=True)
        count = lambda x: np.bincount(at, x[rare], len(g)).astype(np.int64)
        customers, alone, several = count(c), count(c == 1), count(c > 1)
        if whole:
            yield from _split_by(_owner(g, owners), owners, 0, g, customers, *[alone] * KEPT, src=part)
        else:
            asks = several > 0
            yield from _split_by(_owner(g[asks], owners), owners, 0, g[asks], alone[asks], several[asks], src=part)
            yield from _split_by(_owner(g[~asks], owners), owners, 1, g[~asks], alone[~asks], several[~asks], src=part)

    return _each(kernel)


def _context_tables(wide: int, parts: int, kept: bool):
    """From the seating of a part, the tables of its contexts that are not frequent, now or in all kept samples."""
    owners = _owners(parts)

    def kernel(part: int, src: int, kind: int, value: bytes) -> Iterator[tuple]:
        _, _, _, _, g, _, now, _, *old = unpack(value)
        rare = ~_frequent(g, wide)
        g, at = np.unique(g[rare], return_inverse=True)
        tables = [np.bincount(at, t[rare], len(g)).astype(np.int64) for t in ([*old[1::2], now] if kept else [now])]
        yield from _split_by(_owner(g, owners), owners, 1 if kept else 0, g, *([np.zeros(len(g), np.int64)] if kept else []), *tables, src=part)

    return _each(kernel)


def _answers(part: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Sums a context over all parts, for those that ask, in the order in which they ask."""
    found = [(src, kind, unpack(v)) for src, kind, v in rows]
    rows.clear()
    _, at = np.unique(np.concatenate([x[0] for _, _, x in found]), return_inverse=True)
    sums = [np.bincount(at, np.concatenate([x[k] for _, _, x in found])).astype(np.int64) for k in range(1, len(found[0][2]))]
    end = np.cumsum([len(x[0]) for _, _, x in found]).tolist()
    for (src, kind, x), b in zip(found, end):
        if kind == 0:
            mine = at[b - len(x[0]) : b]
            yield _packed([(src, part, 9, pack(*(v[mine] for v in sums)))])


def _answered(contexts: np.ndarray, parts: int, rows: list[tuple], n: int) -> list[np.ndarray]:
    """Sums of sorted contexts from the answers of their owners."""
    order = np.argsort(_owner(contexts, _owners(parts)), kind="stable")
    found = [unpack(v) for _, kind, v in rows if kind == 9]  # rows are in the order of their owners
    out = [np.zeros(len(contexts), np.int64) for _ in range(n)]
    for k in range(n if found else 0):
        out[k][order] = np.concatenate([x[k] for x in found])
    return out


def _sweep(now: Totals, seed: int, parts: int, first: bool, keep: bool):
    """Samples the table numbers of the dishes of one part, given the totals; all cells of a word are in it.

    Only those of a frequent word are spread over parts; its totals are the round's. Cells of one customer are only
    numbers, of a word and of a context. A seating that is kept stays beside the new one.
    """

    def kernel(part: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        rng, wide = np.random.default_rng([seed, part]), len(now.tables)
        words, alone, several, s, g, c, t, lone, *old = unpack(next(v for _, kind, v in rows if kind == 2))
        near, hot = _frequent(g, wide), _frequent(words, wide)
        contexts, at = np.unique(g[~near], return_inverse=True)
        lone, tables = _answered(contexts, parts, rows, 2) if first else (lone, *_answered(contexts, parts, rows, 1))
        kept = [*old, s, t] if keep else old
        word, s, code = np.repeat(np.arange(len(words)), several), s.copy(), np.where(hot, words, 0)
        mass = np.empty(len(g))
        mass[near], mass[~near] = now.tables[g[near]], (lone + tables)[at]
        mass = THETA + now.d1 * mass
        one, zero = log_stirling(now.d1), log_stirling(now.d0)
        curves: dict = {}  # of this task's dishes with many customers
        count = lambda: alone + np.bincount(word, t, len(words)).astype(np.int64)
        for _ in range(SWEEPS):
            p0 = np.maximum(now.parent(np.where(hot, now.seats[code], count()), np.where(hot, now.dishes[code], s)), 1e-300)
            t = sample_tables(c, mass * p0[word], now.d1, one, rng, curves)
            total = count()[~hot]
            s[~hot] = sample_tables(total, np.full(len(total), now.base()), now.d0, zero, rng, curves)
        sums = np.zeros(FIRST + 4 * wide, np.int64)
        sums[[EVERY, PARENTS]] = t.sum(), s[~hot].sum()
        _add(sums, wide, 1, g, t)
        _add(sums, wide, 2, words, count() - alone)
        yield _row(STATE, part, pack(words, alone, several, s, g, c, t, lone, *kept), pack(sums))

    return _of_part(kernel)


@dataclass
class Model:
    codes: Codes
    top: pd.DataFrame  # hashes and counts of the most frequent words
    n_local: int
    known: np.ndarray  # customers of each frequent word
    samples: list[Totals]
    parts: int
    table: DataFrame  # a row a part: its tokens, cells, texts
    state: DataFrame  # a row a part: its seating, with the kept samples

    @property
    def base_floor(self) -> float:
        return self.samples[0].tokens + 0.1 * (self.samples[0].words + 1)

    def _by_part(self, kernel, schema: str) -> DataFrame:
        rows = _rows(self.table, "cells", 3).union(_rows(self.state, "seats", 2))
        return rows.repartitionById(self.parts, "part").mapInArrow(_of_part(kernel), schema)

    @cached_property
    def words(self) -> DataFrame:
        """h, c, p (parent probability a sample), u and own (frequent contexts and probabilities of its cells) of the words."""
        found = self._by_part(_word_rows(self.samples, self.known), "h bigint, c bigint, p array<double>, u int, own double")
        cell = F.when(F.col("u").isNotNull(), F.struct("u", "own"))
        return found.groupBy("h").agg(F.max("c").alias("c"), F.max("p").alias("p"), F.sort_array(F.collect_list(cell)).alias("x")).select("h", "c", "p", F.col("x.u").alias("u"), F.col("x.own").alias("own"))

    @cached_property
    def cells(self) -> DataFrame:
        """h, g, c and tables a sample of all seen cells whose context is not frequent."""
        return self._by_part(_cell_rows(self.samples), ", ".join(["h bigint, g bigint, c bigint", *(f"t{j} bigint" for j in range(len(self.samples)))]))

    @cached_property
    def local(self) -> np.ndarray:
        """Sorted codes of the most frequent words."""
        return np.sort(self.codes.of(self.top["h"].to_numpy()[: self.n_local]))

    @cached_property
    def _mine(self) -> pd.DataFrame:
        close = F.broadcast(self.table.sparkSession.createDataFrame(pd.DataFrame({"w": self.local})))  # ``local`` rows at most
        return self.words.join(close, F.col("h") == F.col("w"), "left_semi").orderBy("h").toPandas()

    @cached_property
    def parents(self) -> np.ndarray:
        """Parent probabilities of the local words, a column a sample."""
        return np.stack(self._mine["p"].to_list())

    @cached_property
    def cell_keys(self) -> np.ndarray:
        """Numbers of the seen cells (local word, frequent context)."""
        return np.concatenate([i * np.int64(len(self.known)) + np.asarray(u, np.int64) for i, u in enumerate(self._mine["u"])])

    @cached_property
    def cell_logs(self) -> np.ndarray:
        """Their log10 probabilities."""
        return np.log10(np.concatenate([np.asarray(x, float) for x in self._mine["own"]]))


def _rows(table: DataFrame, column: str, kind: int) -> DataFrame:
    """A column of a table of parts as rows of PACKED."""
    return table.filter(F.col(column).isNotNull()).select("part", F.lit(-1).alias("src"), F.lit(kind).alias("kind"), F.col(column).alias("value"))


def fit(docs: DataFrame, scratch: Scratch, *, contexts: int = CONTEXTS, local: int = LOCAL, rounds: int = ROUNDS, seed: int = 11) -> Model | None:
    """Counts all words of the texts that are not held out and samples the seating; None without such a row.

    ``docs`` has a text, and may have a doc_id and held_out. Every word is a context with a restaurant of its own.
    ``contexts`` only says of how many words all tasks know the totals, ``local`` how many ``Model.parents`` lists.
    """
    held = F.coalesce("held_out", F.lit(False)) if "held_out" in docs.columns else F.lit(False)
    ids = F.col("doc_id") if "doc_id" in docs.columns else F.lit(None)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), ids.cast("bigint").alias("doc_id"), held.alias("held_out"), "text")
    train = rows.filter("not held_out")
    n = train.count()
    if not n:
        return None
    # which words are frequent, and so how work is dealt out, is read off a sample; nothing else is
    every = max(1, n // TEXTS)
    some = train.filter(F.pmod(F.xxhash64("doc_id" if "doc_id" in docs.columns else "text"), F.lit(every)) == 0).select("text")
    counts = scratch.save(some.mapInArrow(_count_words, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("c")), "counts")
    tokens = every * (counts.agg(F.sum("c")).first()[0] or 0)
    top = counts.orderBy(F.desc("c"), "h").limit(max(local, contexts, SHORT)).toPandas()
    scratch.drop(counts)
    _free_shuffles(docs, tokens)
    hashes = top["h"].to_numpy()[: max(contexts, SHORT)]
    order = np.argsort(hashes)
    codes = Codes(hashes[order], order + 2)
    wide = min(contexts, len(top)) + 2
    # parts grow in number with the table
    parts = max(1, -(-tokens // TOKENS), min(12, -(-tokens // CELLS)))
    split = rows.mapInArrow(_tokens(codes, wide, parts), PACKED).repartitionById(parts, "part")
    table = scratch.save(split.mapInArrow(_cells(wide), _ddl(PART)), "parts", compression="uncompressed")
    _free_shuffles(docs, tokens)
    sums = _sum_of(table, wide)
    customers, alone, alone_of, known = sums[FIRST:].reshape(4, wide)
    # the few cells of frequent words and contexts that have a table each at first
    several, several_of = _several(table, wide)
    d1 = _discount(sums[ONE], sums[TWO])
    cells_of = alone_of + several_of
    d0 = _discount(sums[W1] + (cells_of == 1).sum(), sums[W2] + (cells_of == 2).sum())
    fixed = {"tokens": int(sums[ALL]), "words": int(sums[SEEN] + (known > 0).sum()), "customers": customers, "alone": alone, "alone_of": alone_of, "one": int(sums[ONE]), "once": int(sums[ONCE])}
    now = _totals(np.concatenate([sums[:FIRST], customers, several, several_of, known]), d1, d0, fixed, None, seed)
    samples, state = [], table
    for r in range(rounds):
        # from the first sample that counts on, a round carries the samples before its own
        j = r - max(0, rounds - KEPT)
        asks = _rows(table, "cells", 3).mapInArrow(_context_counts(wide, parts, False), PACKED) if r == 0 else _rows(state, "seats", 2).mapInArrow(_context_tables(wide, parts, False), PACKED)
        answers = asks.repartitionById(_owners(parts), "part").mapInArrow(_of_part(_answers), PACKED)
        both = _rows(state, "seats", 2).union(answers).repartitionById(parts, "part")
        old, state = state, scratch.save(both.mapInArrow(_sweep(now, seed + r, parts, r == 0, j > 0), _ddl(STATE)), "seating", compression="uncompressed")
        if r:
            scratch.drop(old)
        del asks, answers, both
        _free_shuffles(docs, tokens)
        now = _totals(_sum_of(state, wide), d1, d0, fixed, now, seed + r)
        if j >= 0:
            samples.append(now)
    return Model(codes, top, local, known, samples, parts, table, state)


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'binary'}" for f in schema)


def _discount(a: int, b: int) -> float:
    return float(min(0.95, max(0.1, a / (a + 2 * b) if a else 0.5)))


def _several(table: DataFrame, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each frequent context and of each frequent word, the cells of several customers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for v in batch.column(0).to_pylist():
                words, _, several, _, g, *_ = unpack(v)
                sums = np.zeros(FIRST + 4 * wide, np.int64)
                _add(sums, wide, 0, g, np.ones(len(g)))
                _add(sums, wide, 1, words, several)
                yield pa.record_batch([pa.array([pack(sums)], pa.binary())], ["sums"])

    return tuple(_sum_of(table.select("seats").mapInArrow(count, "sums binary"), wide)[FIRST:].reshape(4, wide)[:2])


def _totals(sums: np.ndarray, d1: float, d0: float, fixed: dict, before: Totals | None, seed: int) -> Totals:
    """Sums over the seating, with the cells of one customer; samples the parent's tables of frequent words, one each at first."""
    wide = len(fixed["customers"])
    _, tables, seats, _ = sums[FIRST:].reshape(4, wide)
    tables, seats, every, parents = tables + fixed["alone"], seats + fixed["alone_of"], fixed["one"] + sums[EVERY], fixed["once"] + sums[PARENTS]
    if before is None:
        dishes, parents = np.minimum(seats, 1), fixed["words"]
    else:
        dishes = sample_tables(seats, np.full(wide, before.base()), d0, log_stirling(d0), np.random.default_rng([seed]))
        parents += int(dishes.sum())
    return Totals(d1, d0, fixed["tokens"], fixed["words"], fixed["customers"].astype(float), tables.astype(float), int(parents), int(every), seats, dishes)


# --- scoring ------------------------------------------------------------------------------------


@dataclass
class Part:
    """The cells of a part, also held out ones, and its words."""

    words: np.ndarray
    counts: np.ndarray  # customers of the words
    parents: np.ndarray  # their parent probabilities, a column a sample
    word: np.ndarray  # of each cell
    g: np.ndarray
    c: np.ndarray
    tables: np.ndarray  # of each cell, a column a sample


def _part(samples: list[Totals], known: np.ndarray, rows: list[tuple]) -> Part:
    words, size, g, c = unpack(next(v for _, kind, v in rows if kind == 3))
    _, alone, _, s, _, _, t, _, *old = unpack(next(v for _, kind, v in rows if kind == 2))
    word = np.repeat(np.arange(len(words)), size)
    hot = _frequent(words, len(known))
    code = np.where(hot, words, 0)
    own = np.bincount(word, c, len(words)).astype(np.int64)
    listed = hot | (own > 1)
    tables, parents = np.empty((len(c), len(samples)), np.int64), np.empty((len(words), len(samples)))
    for j, (x, sj, tj) in enumerate(zip(samples, [*old[::2], s], [*old[1::2], t])):
        tables[:, j] = c == 1
        tables[c > 1, j] = tj
        dishes = np.minimum(own, 1)
        dishes[listed] = sj
        parents[:, j] = x.parent(np.where(hot, x.seats[code], np.bincount(word, tables[:, j], len(words))), np.where(hot, x.dishes[code], dishes))
    return Part(words, np.where(hot, known[code], own), parents, word, g, c, tables)


def _word_rows(samples: list[Totals], known: np.ndarray):
    def kernel(part: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        x = _part(samples, known, rows)
        listed = np.flatnonzero(_frequent(x.g, len(known)) & (x.c > 0))
        word, u, c = x.word[listed], x.g[listed], x.c[listed]
        p = np.mean([(c - y.d1 * x.tables[listed, j] + (THETA + y.d1 * y.tables[u]) * x.parents[word, j]) / (THETA + y.customers[u]) for j, y in enumerate(samples)], 0)
        rest = np.flatnonzero(x.counts > 0)
        at = np.concatenate([rest, word])
        none = np.concatenate([np.ones(len(rest), bool), np.zeros(len(word), bool)])
        each = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * len(samples), pa.int32()), pa.array(x.parents[at].ravel()))
        null = lambda v, kind: pa.array(np.concatenate([np.zeros(len(rest), v.dtype), v]), kind, mask=none)
        yield pa.record_batch([pa.array(x.words[at]), pa.array(x.counts[at]), each, null(u, pa.int32()), null(p, pa.float64())], ["h", "c", "p", "u", "own"])

    return kernel


def _cell_rows(samples: list[Totals]):
    def kernel(part: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        wide = len(samples[0].tables)
        x = _part(samples, np.zeros(wide, np.int64), rows)
        at = np.flatnonzero(~_frequent(x.g, wide) & (x.c > 0))
        columns = {"h": x.words[x.word[at]], "g": x.g[at], "c": x.c[at], **{f"t{j}": x.tables[at, j] for j in range(len(samples))}}
        yield pa.record_batch([pa.array(v) for v in columns.values()], list(columns))

    return kernel


def _score_part(model: dict, parts: int):
    """Sums a text over the tokens of a part."""
    samples, known, floor = model["samples"], model["known"], model["floor"]

    def kernel(part: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        wide, x = len(known), _part(samples, known, rows)
        near = _frequent(x.g, wide)
        contexts, at = np.unique(x.g[~near], return_inverse=True)
        customers, *tables = _answered(contexts, parts, rows, 1 + len(samples))
        mean, count, total = np.zeros(len(x.g)), np.empty(len(x.g)), np.empty(len(x.g))
        for j, y in enumerate(samples):
            count[near], count[~near] = y.customers[x.g[near]], customers[at]
            total[near], total[~near] = y.tables[x.g[near]], tables[j][at]
            mean += (x.c - y.d1 * x.tables[:, j] + (THETA + y.d1 * total) * x.parents[x.word, j]) / (THETA + count)
        logs = np.log10(mean / len(samples))
        length, row, n = unpack(next(v for _, kind, v in rows if kind == 4))
        rows.clear()
        cell = np.repeat(np.arange(len(x.g)), length)
        word = x.word[cell]
        found, back = np.unique(row, return_inverse=True)
        add = lambda v: np.bincount(back, v, len(found))
        sums = [add(n).astype(np.int64), add(n * (x.counts > 0)[word]).astype(np.int64), add(n * np.log10((x.counts + 0.1) / floor)[word]), add(n * logs[cell])]
        yield _packed(list(_split_by(_owner(found >> 10, _owners(parts)), parts, 0, found, *sums)))

    return _of_part(kernel)


def _sum_texts(part: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    row, ids, flags = unpack(next(v for _, kind, v in rows if kind == 1))
    order = np.argsort(row)
    row, ids, flags = row[order], ids[order], flags[order]
    sums = [np.zeros(len(row), kind) for kind in (np.int64, np.int64, float, float)]
    for _, kind, v in rows:
        if kind == 0:
            found, *values = unpack(v)
            at = np.searchsorted(row, found)
            for total, x in zip(sums, values):
                total[at] += x
    yield pa.record_batch([pa.array(ids, mask=flags >= 2), pa.array(flags % 2 == 1), *map(pa.array, sums)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def _free_shuffles(df: DataFrame, tokens: int) -> None:
    """Spark removes the shuffle files of finished queries once the driver has collected their plans as garbage.

    A plan may hang on a cycle of Python's, and py4j takes up to a second to let go of what Python has dropped; small
    tables don't wait for it.
    """
    gc.collect()
    if tokens > CELLS:
        time.sleep(PAUSE)
    df.sparkSession.sparkContext._jvm.System.gc()
    if tokens > CELLS:
        time.sleep(PAUSE / 4)  # another thread removes the files


def score(model: Model, scratch: Scratch) -> DataFrame:
    """Per row of the table that was given to ``fit``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    now, parts, wide = model.samples, model.parts, len(model.known)
    asks = _rows(model.table, "cells", 3).mapInArrow(_context_counts(wide, parts, True), PACKED).union(_rows(model.state, "seats", 2).mapInArrow(_context_tables(wide, parts, True), PACKED))
    answers = scratch.save(asks.repartitionById(_owners(parts), "part").mapInArrow(_of_part(_answers), PACKED), "contexts", compression="uncompressed")
    del asks
    _free_shuffles(model.table, now[0].tokens)
    # parts are scored in steps, so that fewer files are on disk at once
    shared = {"samples": now, "known": model.known, "floor": model.base_floor}
    found, steps = [], min(STEPS, parts)
    for step in range(steps):
        rows = _rows(model.table, "cells", 3).union(_rows(model.table, "tokens", 4)).union(_rows(model.state, "seats", 2)).union(answers.select("part", "src", "kind", "value"))
        size = -(-parts // steps)
        mine = rows.filter(F.col("part") % steps == step).repartitionById(size, F.floor(F.col("part") / steps).cast("int"))
        found.append(scratch.save(mine.mapInArrow(_score_part(shared, parts), PACKED), "sums", compression="uncompressed"))
        del rows, mine
        _free_shuffles(model.table, now[0].tokens)
    scratch.drop(answers)
    every = _rows(model.table, "texts", 1)
    for some in found:
        every = every.union(some)
    sums = every.repartitionById(_owners(parts), "part").mapInArrow(_of_part(_sum_texts), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    return sums.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(now[0].tokens).cast("bigint").alias("train_tokens"), F.round("base_score", 8).alias("base_score"), F.round("score", 8).alias("score"))


def score_all(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Learns from the rows whose id's crc32 mod 10 is not 0 and scores all rows.

    A null text is the empty one: its end is its only token. A null id is never held out; rows may share
    ids. Without a training row nothing is known, and every token has probability 1. Other columns are
    ignored; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "pitmanyor")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), in_fold(id_col, 10, 0).alias("held_out"))
    model = fit(rows, scratch, **options)
    if model is None:
        n = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint") + 1
        zero = F.lit(0).cast("bigint")
        return rows.select("doc_id", "held_out", n.alias("n_tokens"), zero.alias("n_known"), zero.alias("train_tokens"), F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"))
    return score(model, scratch)
