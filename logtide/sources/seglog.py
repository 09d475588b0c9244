"""``seglog``: a data source over folders of segments, for batch reads, writes and streams.

    spark.dataSource.register(SegmentLog)
    spark.read.format("seglog").load(path)
    spark.readStream.format("seglog").load(path)
    df.write.format("seglog").mode("append").save(path)

A task takes whole files: it reads a file's last 64 KiB for the footer and then only the regions that the
filters leave. Options of reads: ``mode`` (PERMISSIVE: a damaged region becomes a row with an error;
FAILFAST); of streams: ``startingOffsets`` (earliest, latest, or JSON {topic: {partition: offset}}) and
``startingTimestamp`` (milliseconds); of writes: ``codec``, ``recordsPerBatch`` and ``segmentBytes``.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from .. import model as M
from ..functions import codec
from . import segment

SCHEMA = (
    "topic string, partition int, offset bigint, timestamp_ms bigint, key binary, value binary, headers array<struct<key: binary, value: binary>>, producer_id bigint, producer_epoch int, "
    "sequence int, is_transactional boolean, is_control boolean, prefix string, seq bigint, error string"
)
FIELDS = [c.strip().split(" ")[0] for c in re.split(r",(?![^<]*>)", SCHEMA)]
NAME = re.compile(r"(?:(?P<prefix>.*)/)?(?P<seq>\d{20})\.seg$")
#: Sequence numbers of a producer start again at 0 behind this many.
SEQUENCES = 2**31
#: What a row held by a writer costs beside its key, value and headers.
ROW_BYTES = 200


@dataclass
class Files(InputPartition):
    paths: tuple[tuple[str, str, int, int], ...]  # path, prefix, seq, size

    def __init__(self, paths) -> None:
        self.paths = tuple(paths)


@dataclass
class Written(WriterCommitMessage):
    staged: tuple[tuple[str, str, int], ...]  # staged path, prefix, nonce


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the path within it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def listing(path: str) -> list[tuple[str, str, int, int]]:
    """All segments below a path: path, prefix, sequence, size, in order."""
    fs, root = open_path(path)
    out = []
    for info in fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
        relative = info.path[len(root.rstrip("/")) + 1 :]
        m = NAME.fullmatch(relative)
        if info.is_file and m and not relative.startswith("_"):
            out.append((info.path, m["prefix"] or "", int(m["seq"]), info.size))
    return sorted(out, key=lambda x: (x[1], x[2]))


def dealt(files: list, most: int = 64 * 1024 * 1024) -> list[Files]:
    """Files put together up to a size, one task each."""
    out, some, size = [], [], 0
    for f in files:
        if some and size + f[3] > most:
            out.append(Files(some))
            some, size = [], 0
        some.append(f)
        size += f[3]
    return out + ([Files(some)] if some else [])


class Wanted:
    """What pushed filters leave of topics, partitions, offsets and times; a superset of what they match."""

    def __init__(self) -> None:
        self.topics: set | None = None
        self.partitions: set | None = None
        self.low, self.high, self.since = 0, 2**63 - 1, -(2**63)

    def take(self, f: Filter) -> bool:
        """Whether a filter narrows the scan. Spark applies all filters again."""
        name = getattr(f, "attribute", ("",))[0]
        if isinstance(f, (EqualTo, In)) and name in ("topic", "partition"):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            kept = "topics" if name == "topic" else "partitions"
            old = getattr(self, kept)
            setattr(self, kept, values if old is None else old & values)
            return True
        if name == "offset" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
            if not isinstance(f, (LessThan, LessThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
            return True
        if name == "timestamp_ms" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.since = max(self.since, f.value)
            return True
        return False

    def entry(self, e: segment.Entry) -> bool:
        return (
            (self.topics is None or e.topic in self.topics) and (self.partitions is None or e.partition in self.partitions)
            and e.base_offset + e.record_count > self.low and e.base_offset <= self.high and e.max_timestamp >= self.since
        )


def read_footer(fs: pafs.FileSystem, path: str, size: int) -> segment.Footer | None:
    """One read of the suffix, and another only for a footer that is larger."""
    with fs.open_input_file(path) as f:
        tail = f.read_at(min(size, segment.SUFFIX), max(0, size - segment.SUFFIX))
        found = segment.trailer_of(tail)
        if found and found[0] + segment.TRAILER.size > len(tail):
            whole = found[0] + segment.TRAILER.size
            if whole > size:
                raise codec.CorruptBatch("the footer is larger than its file")
            tail = f.read_at(whole, size - whole)
    return segment.decode_footer(tail)


def rows_of(region: bytes, declared: int, topic: str | None, partition: int | None, base: int | None, prefix: str, seq: int, strict: bool) -> Iterator[tuple]:
    """The records of a region; offsets run on from the footer's base."""
    at = base
    try:
        for raw in codec.walk(region, declared):
            b = codec.decode(raw)
            first = b.base_offset if at is None else at
            for r in codec.records_of(b):
                sequence = (b.base_sequence + r.offset_delta) % SEQUENCES if b.base_sequence >= 0 else -1
                yield (topic, partition, first + r.offset_delta, b.base_timestamp + r.timestamp_delta, r.key, r.value, [{"key": k, "value": v} for k, v in r.headers], b.producer_id, b.producer_epoch, sequence, b.transactional, b.control, prefix, seq, None)
            at = first + b.last_offset_delta + 1
    except (codec.CorruptBatch, OSError, pa.ArrowException) as e:
        if strict:
            raise
        yield (topic, partition, at, None, None, None, None, None, None, None, None, None, prefix, seq, f"{type(e).__name__}: {e}")


class _Reading:
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.strict = options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.wanted = Wanted()

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, _ = open_path(self.path)
        for path, prefix, seq, size in partition.paths:
            try:
                footer = read_footer(fs, path, size)
            except (codec.CorruptBatch, segment.UnknownVersion) as e:
                if self.strict:
                    raise
                yield (*(None,) * 12, prefix, seq, f"{type(e).__name__}: {e}")
                continue
            with fs.open_input_file(path) as f:
                if footer is None:  # an object of one topic from before there were footers
                    yield from rows_of(f.read(), size, None, None, None, prefix, seq, self.strict)
                    continue
                for e in footer.entries:
                    if self.wanted.entry(e):
                        yield from rows_of(f.read_at(e.byte_len, e.byte_start), e.byte_len, e.topic, e.partition, e.base_offset, prefix, seq, self.strict)


class SegmentReader(_Reading, DataSourceReader):
    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            self.wanted.take(f)
            yield f

    def partitions(self) -> list[Files]:
        return dealt(listing(self.path)) or [Files(())]


class SegmentStreamReader(_Reading, DataSourceStreamReader):
    """New segments of each prefix by sequence; an offset is the last sequence of each.

    A start by offset leaves out the records of the named topitions before it. A start by time begins at the
    first segment of each prefix that holds a record at or after it, and reads everything from there on.
    """

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        start = options.get("startingOffsets", options.get("startingoffsets", "earliest"))
        self.latest = start == "latest"
        self.floors = {} if start in ("latest", "earliest") else {(t, int(p)): o for t, ps in json.loads(start).items() for p, o in ps.items()}
        since = options.get("startingTimestamp", options.get("startingtimestamp"))
        self.since = None if since is None else int(since)
        self._seen: list = []

    def _now(self) -> dict:
        out: dict = {}
        self._seen = listing(self.path)
        for _, prefix, seq, _ in self._seen:
            out[prefix] = max(seq, out.get(prefix, -1))
        return out

    def initialOffset(self) -> dict:
        if self.latest:
            return self._now()
        if self.since is None:
            return {}
        fs, _ = open_path(self.path)
        out: dict = {}
        found = set()
        for path, prefix, seq, size in listing(self.path):  # by prefix and sequence; a footer each, up to the first that counts
            if prefix not in found:
                try:
                    footer = read_footer(fs, path, size)
                except (codec.CorruptBatch, segment.UnknownVersion):
                    footer = None  # the read shows what is wrong with it
                if footer is None or any(e.max_timestamp >= self.since for e in footer.entries):
                    found.add(prefix)
                else:
                    out[prefix] = seq
        return out

    def latestOffset(self) -> dict:
        return self._now()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        if any(end[prefix] > max((x[2] for x in self._seen if x[1] == prefix), default=-1) for prefix in end):
            self._now()  # after a restart
        new = [x for x in self._seen if start.get(x[1], -1) < x[2] <= end.get(x[1], -1)]
        return dealt(new) or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        for row in super().read(partition):
            if row[2] is None or row[2] >= self.floors.get((row[0], row[1]), 0):
                yield row

    def commit(self, end: dict) -> None:
        """Nothing to free: segments stay."""


def create(fs: pafs.FileSystem, staged: str, target: str) -> bool:
    """Gives a staged file its name unless the name is taken.

    A local folder decides that in one step, by a hard link. Elsewhere a name that is seen is never
    overwritten, but two commits in the same moment need a store whose moves refuse an existing target.
    """
    if isinstance(fs, pafs.LocalFileSystem):
        try:
            os.link(staged, target)
        except FileExistsError:
            return False
        os.unlink(staged)
        return True
    if fs.get_file_info(target).type != pafs.FileType.NotFound:
        return False
    fs.move(staged, target)
    return True


class SegmentWriter(DataSourceWriter):
    """Tasks stage segments; the commit names them, one sequence of a prefix after the other.

    Rows need topic, partition, offset and timestamp_ms (null: -1); key, value, headers, producer_id,
    producer_epoch, sequence, is_transactional and is_control are kept where they are given, other columns are
    not. Reading gives the same rows, gaps between offsets included. Staged files of failed tasks are never
    seen by readers.

    A task holds ``segmentBytes`` of rows at most and stages the largest prefix when they are full. Rows sorted
    by topic, partition and offset within tasks make segments that don't overlap.

    A name is only ever created. A commit that finds it taken takes the next one; one that is run again knows
    by the nonce in the footer which segments are in place. The highest sequence of a prefix is kept under
    ``_sequences``, so names of segments that are gone are not used again.
    """

    def __init__(self, options: dict, schema) -> None:
        self.path, self.codec = options["path"], options.get("codec", "zstd")
        self.most = int(options.get("recordsperbatch", options.get("recordsPerBatch", 500)))
        self.room = int(options.get("segmentbytes", options.get("segmentBytes", 32 * 1024 * 1024)))
        self.names = schema.names
        missing = {"topic", "partition", "offset", "timestamp_ms"} - set(self.names)
        if missing:
            raise ValueError(f"rows of a log need {', '.join(sorted(missing))}")

    def write(self, rows: Iterator) -> Written:
        fs, root = open_path(self.path)
        held: dict[str, list] = {}
        sizes: dict[str, int] = {}
        staged, size = [], 0
        fs.create_dir(f"{root}/_staging", recursive=True)
        for row in rows:
            if row["topic"] is None or row["partition"] is None or row["offset"] is None:
                raise ValueError("a record without topic, partition or offset")
            r = self._record(row)
            prefix = ".".join(r[0].split(".")[:3])
            held.setdefault(prefix, []).append(r)
            cost = ROW_BYTES + len(r[4] or b"") + len(r[5] or b"") + sum(len(k or b"") + len(v or b"") for k, v in r[6])
            sizes[prefix] = sizes.get(prefix, 0) + cost
            size += cost
            if size >= self.room:
                full = max(sizes, key=sizes.__getitem__)
                staged.append(self._stage(fs, root, full, held.pop(full)))
                size -= sizes.pop(full)
        staged += [self._stage(fs, root, prefix, held.pop(prefix)) for prefix in sorted(held)]
        return Written(tuple(staged))

    def _record(self, row) -> tuple:
        def of(name: str, otherwise):
            value = row[name] if name in self.names else None
            return otherwise if value is None else value

        plain = lambda x: None if x is None else bytes(x)
        headers = [(plain(h["key"]), plain(h["value"])) for h in of("headers", [])]
        bits = M.TRANSACTIONAL_BIT * bool(of("is_transactional", False)) | M.CONTROL_BIT * bool(of("is_control", False))
        producer = (of("producer_id", -1), of("producer_epoch", -1), bits)
        return row["topic"], row["partition"], row["offset"], of("timestamp_ms", -1), plain(of("key", None)), plain(of("value", None)), headers, producer, of("sequence", -1)

    def _stage(self, fs: pafs.FileSystem, root: str, prefix: str, rows: list) -> tuple[str, str, int]:
        rows.sort(key=lambda r: r[:3])
        batches: list[list] = []
        for r in rows:
            if not batches or len(batches[-1]) == self.most or not self._continues(batches[-1], r):
                batches.append([])
            batches[-1].append(r)
        regions: list = []
        for i, some in enumerate(batches):
            topic, partition, base = some[0][:3]
            last = some[-1][2]
            after = batches[i + 1][0] if i + 1 < len(batches) and batches[i + 1][0][:2] == some[0][:2] else None
            gap = after is not None and after[2] > last + 1
            # a plain batch spans the offsets up to the next one; a producer's keeps its own span, as sequences hang on it
            if gap and some[0][7][0] < 0 and after[2] - base < 2**31:
                last, gap = after[2] - 1, False
            made = self._batch(some, last)
            if regions and regions[-1][:2] == (topic, partition) and regions[-1][3] == base:
                regions[-1][2].append(made)
                regions[-1] = (*regions[-1][:3], last + 1)
            else:  # behind a gap a topition gets another entry, which has a base of its own
                regions.append((topic, partition, [made], last + 1))
        nonce, path = uuid.uuid4().int & (2**64 - 1), f"{root}/_staging/{uuid.uuid4().hex}"
        with fs.open_output_stream(path) as f:
            f.write(segment.build([r[:3] for r in regions], nonce=nonce))
        return path, prefix, nonce

    @staticmethod
    def _continues(batch: list, r: tuple) -> bool:
        """Whether a record can join a batch: of its topition and producer, in its sequence, within its span."""
        first, last = batch[0], batch[-1]
        if r[:2] != first[:2] or r[7] != first[7] or r[2] <= last[2] or r[2] - first[2] >= 2**31 - 1:
            return False
        if (r[8] < 0) != (first[8] < 0):
            return False
        return r[8] < 0 or (first[8] + r[2] - first[2]) % SEQUENCES == r[8]

    def _batch(self, rows: list, last: int) -> codec.Batch:
        _, _, base, when, _, _, _, (producer, epoch, bits), sequence = rows[0]
        records = [codec.Record(r[2] - base, r[3] - when, r[4], r[5], r[6]) for r in rows]
        return codec.build(records, base_offset=base, base_timestamp=when, codec=self.codec, attributes=bits, span=last - base, producer_id=producer, producer_epoch=epoch, base_sequence=sequence)

    def commit(self, messages: list) -> None:
        fs, root = open_path(self.path)
        live: dict = {}
        for path, prefix, seq, size in listing(self.path):
            live.setdefault(prefix, []).append((path, seq, size))
        todo: dict = {}
        for message in messages:
            for staged, prefix, nonce in message.staged if message else ():
                todo.setdefault(prefix, []).append((staged, nonce))
        for prefix, some in todo.items():
            floor = highest_used(fs, root, prefix)
            there = live.get(prefix, [])
            waiting = {x.path for x in fs.get_file_info([staged for staged, _ in some]) if x.type != pafs.FileType.NotFound}
            if len(waiting) < len(some):  # this commit ran before
                placed = {f.nonce for f in (read_footer(fs, path, size) for path, _, size in there) if f}
                lost = [staged for staged, nonce in some if staged not in waiting and nonce not in placed]
                if lost:
                    raise FileNotFoundError(f"neither staged nor in place: {lost}")
            seq = max([floor, *(seq for _, seq, _ in there)], default=-1)
            fs.create_dir(f"{root}/{prefix}", recursive=True)
            for staged, _ in some:
                if staged in waiting:
                    seq += 1
                    while not create(fs, staged, f"{root}/{prefix}/{seq:020d}.seg"):
                        seq += 1
            remember_used(fs, root, prefix, seq)

    def abort(self, messages: list) -> None:
        fs, _ = open_path(self.path)
        for message in messages:
            for staged, _, _ in message.staged if message else ():
                if fs.get_file_info(staged).type != pafs.FileType.NotFound:
                    fs.delete_file(staged)


def _marks(fs: pafs.FileSystem, root: str, prefix: str) -> list[tuple[int, str]]:
    found = fs.get_file_info(pafs.FileSelector(f"{root}/_sequences/{prefix}", allow_not_found=True))
    return sorted((int(x.base_name), x.path) for x in found if x.is_file and x.base_name.isdigit())


def highest_used(fs: pafs.FileSystem, root: str, prefix: str) -> int:
    """The highest sequence that a prefix is known to have used, -1 if none."""
    return max((seq for seq, _ in _marks(fs, root, prefix)), default=-1)


def remember_used(fs: pafs.FileSystem, root: str, prefix: str, seq: int) -> None:
    """Marks a sequence as used, then drops the lower marks."""
    fs.create_dir(f"{root}/_sequences/{prefix}", recursive=True)
    with fs.open_output_stream(f"{root}/_sequences/{prefix}/{seq:020d}"):
        pass
    for old, path in _marks(fs, root, prefix):
        if old < seq:
            fs.delete_file(path)


class SegmentLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "seglog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SegmentReader:
        return SegmentReader(self.options)

    def streamReader(self, schema) -> SegmentStreamReader:
        return SegmentStreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> SegmentWriter:
        if overwrite:
            raise ValueError("a log is appended to, never overwritten")
        return SegmentWriter(self.options, schema)


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SegmentLog)


def manifest(spark, path: str):
    """The footers below a path as a table, read by tasks: one row a topition and segment."""
    files = listing(path)
    schema = (
        "prefix string, seq bigint, writer_epoch bigint, nonce decimal(20,0), version int, topic string, partition int, base_offset bigint, record_count bigint, byte_start bigint, byte_len bigint, max_timestamp bigint, "
        "producers array<struct<producer_id: bigint, producer_epoch: int, base_sequence: int, last_sequence: int, offset_delta: bigint, flags: int>>"
    )

    def footers(parts):
        import pandas as pd

        fs, _ = open_path(path)
        for part in parts:
            out = []
            for p, prefix, seq, size in part.itertuples(index=False):
                footer = read_footer(fs, p, size)
                for e in footer.entries if footer else ():
                    out.append((prefix, seq, footer.writer_epoch, footer.nonce, footer.version, e.topic, e.partition, e.base_offset, e.record_count, e.byte_start, e.byte_len, e.max_timestamp, [vars(c) for c in e.producers]))
            frame = pd.DataFrame(out, columns=["prefix", "seq", "writer_epoch", "nonce", "version", "topic", "partition", "base_offset", "record_count", "byte_start", "byte_len", "max_timestamp", "producers"])
            from decimal import Decimal

            frame["nonce"] = frame["nonce"].map(Decimal)
            yield frame

    table = spark.createDataFrame(files, "path string, prefix string, seq bigint, size bigint")
    return table.repartition(max(1, len(files) // 64)).mapInPandas(footers, schema)
