"""The binary layout of a segment: regions of batches, a footer that lists them, a trailer."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from ..functions import codec

MAGIC, VERSIONS, SUFFIX = 0x54534547, (1, 2, 3), 64 * 1024
TRAILER = struct.Struct(">QIHI")
_ENTRY = struct.Struct(">iqqQQq")
_COORDINATE = {2: struct.Struct(">qhiiI"), 3: struct.Struct(">qhiiIB")}
TRANSACTIONAL, CONTROL = 1, 2


class UnknownVersion(ValueError):
    """A footer of a version this reader does not know."""


@dataclass
class Coordinate:
    producer_id: int
    producer_epoch: int
    base_sequence: int
    last_sequence: int
    offset_delta: int
    flags: int = 0


@dataclass
class Entry:
    topic: str
    partition: int
    base_offset: int
    record_count: int
    byte_start: int
    byte_len: int
    max_timestamp: int
    producers: list[Coordinate] = field(default_factory=list)


@dataclass
class Footer:
    writer_epoch: int
    nonce: int
    entries: list[Entry]
    version: int = 3


def encode_footer(footer: Footer) -> bytes:
    """Footer and trailer."""
    if footer.version not in VERSIONS:
        raise UnknownVersion(footer.version)
    out = bytearray(struct.pack(">q", footer.writer_epoch))
    if footer.version > 1:
        out += struct.pack(">Q", footer.nonce)
    for e in footer.entries:
        name = e.topic.encode()
        out += struct.pack(">H", len(name)) + name + _ENTRY.pack(e.partition, e.base_offset, e.record_count, e.byte_start, e.byte_len, e.max_timestamp)
        if footer.version > 1:
            out += struct.pack(">H", len(e.producers))
            for p in e.producers:
                values = (p.producer_id, p.producer_epoch, p.base_sequence, p.last_sequence, p.offset_delta)
                out += _COORDINATE[footer.version].pack(*values, *((p.flags,) if footer.version == 3 else ()))
    return bytes(out) + TRAILER.pack(len(out), len(footer.entries), footer.version, MAGIC)


def trailer_of(tail: bytes) -> tuple[int, int, int] | None:
    """(footer length, entries, version), or None for an object without a trailer."""
    if len(tail) < TRAILER.size:
        return None
    size, count, version, magic = TRAILER.unpack(tail[-TRAILER.size :])
    if magic != MAGIC:
        return None
    if version not in VERSIONS:
        raise UnknownVersion(version)
    return size, count, version


def decode_footer(tail: bytes) -> Footer | None:
    """The footer from an object's last bytes; None without a trailer. The bytes must hold all of it."""
    found = trailer_of(tail)
    if found is None:
        return None
    size, count, version = found
    if size + TRAILER.size > len(tail):
        raise codec.CorruptBatch("the footer reaches past what was read")
    data = tail[len(tail) - TRAILER.size - size : len(tail) - TRAILER.size]
    try:
        (epoch,) = struct.unpack_from(">q", data)
        at, nonce = 8, 0
        if version > 1:
            (nonce,) = struct.unpack_from(">Q", data, at)
            at += 8
        entries = []
        for _ in range(count):
            (n,) = struct.unpack_from(">H", data, at)
            topic = data[at + 2 : at + 2 + n].decode()
            at += 2 + n
            entry = Entry(topic, *_ENTRY.unpack_from(data, at))
            at += _ENTRY.size
            if version > 1:
                (k,) = struct.unpack_from(">H", data, at)
                at += 2
                for _ in range(k):
                    entry.producers.append(Coordinate(*_COORDINATE[version].unpack_from(data, at)))
                    at += _COORDINATE[version].size
            entries.append(entry)
    except (struct.error, UnicodeDecodeError) as e:
        raise codec.CorruptBatch(f"the footer can't be read: {e}") from e
    if at != len(data):
        raise codec.CorruptBatch("the footer does not end where it says")
    return Footer(epoch, nonce, entries, version)


def coordinate_of(batch: codec.Batch, entry_base: int) -> Coordinate | None:
    """What the footer keeps of a batch that is idempotent, transactional or control."""
    if not (batch.idempotent or batch.transactional or batch.control):
        return None
    last = -1 if batch.base_sequence < 0 else (batch.base_sequence + batch.last_offset_delta) % 2**31
    return Coordinate(batch.producer_id, batch.producer_epoch, batch.base_sequence, last, batch.base_offset - entry_base, TRANSACTIONAL * batch.transactional + CONTROL * batch.control)


def build(regions: list[tuple[str, int, list[codec.Batch]]], *, writer_epoch: int = 0, nonce: int = 0, version: int = 3) -> bytes:
    """A segment of (topic, partition, batches in order); base offsets are those of the batches."""
    body, entries = bytearray(), []
    for topic, partition, batches in regions:
        start, base = len(body), batches[0].base_offset
        for b in batches:
            body += codec.encode(b)
        count = batches[-1].base_offset + batches[-1].last_offset_delta + 1 - base
        kept = [c for c in (coordinate_of(b, base) for b in batches) if c]
        entries.append(Entry(topic, partition, base, count, start, len(body) - start, max(b.max_timestamp for b in batches), kept))
    return bytes(body) + encode_footer(Footer(writer_epoch, nonce, entries, version))
