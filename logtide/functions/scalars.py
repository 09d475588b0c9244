"""Scalar columns of the log model, all JVM-side but the CRC-32C."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .. import model as M


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def prefix_of(topic: str | Column) -> Column:
    """The first three dotted components of a topic."""
    return F.array_join(F.slice(F.split(_col(topic), r"\."), 1, 3), ".")


def topition_text(topic: str | Column, partition: str | Column) -> Column:
    """topic-0000000007"""
    return F.concat(_col(topic), F.lit("-"), F.lpad(_col(partition).cast("string"), 10, "0"))


def topition_topic(text: str | Column) -> Column:
    """Topics may hold dashes: the last ten characters are the partition, one separator precedes them."""
    t = _col(text)
    return F.when(F.length(t) > 11, F.substr(t, F.lit(1), F.length(t) - 11))


def topition_partition(text: str | Column) -> Column:
    t = _col(text)
    return F.when(F.length(t) > 11, F.substr(t, F.length(t) - 9).try_cast("int"))


def user_of(principal: str | Column) -> Column:
    return F.regexp_replace(_col(principal), "^User:", "")


def compression(attributes: str | Column) -> Column:
    code = _col(attributes).bitwiseAND(M.COMPRESSION_MASK)
    return F.get(F.array(*map(F.lit, ("none", "gzip", "snappy", "lz4", "zstd"))), code.cast("int"))  # null for codes that name none


def has_bit(attributes: str | Column, bit: int) -> Column:
    return _col(attributes).bitwiseAND(bit) == bit


def is_transactional(attributes: str | Column) -> Column:
    return has_bit(attributes, M.TRANSACTIONAL_BIT)


def is_control(attributes: str | Column) -> Column:
    return has_bit(attributes, M.CONTROL_BIT)


def is_idempotent(producer_id: str | Column, base_sequence: str | Column) -> Column:
    return (_col(producer_id) != -1) & (_col(base_sequence) != -1)


def next_sequence(sequence: str | Column) -> Column:
    """Sequences wrap from the largest 32-bit number to 0."""
    s = _col(sequence)
    return F.when(s == M.I32_MAX, F.lit(0)).otherwise(s + 1).cast("int")


def max_offset(base_offset: str | Column, last_offset_delta: str | Column) -> Column:
    return _col(base_offset) + _col(last_offset_delta)


def clamp(x: str | Column, low, high) -> Column:
    return F.least(F.greatest(_col(x), F.lit(low)), F.lit(high))


def padded_sequence(seq: str | Column) -> Column:
    return F.lpad(_col(seq).cast("string"), 20, "0")


def control_kind(key: str | Column) -> Column:
    """``abort``, ``commit`` or null, from a control record's key of two 16-bit numbers."""
    kind = F.conv(F.hex(F.substring(_col(key), 3, 2)), 16, 10).cast("int")
    return F.when(F.octet_length(_col(key)) >= 4, F.when(kind == 0, F.lit("abort")).when(kind == 1, F.lit("commit")))


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0x82F63B78), table >> 1)
    return table


_CRC = _crc_table()
_CRC_LIST = _CRC.tolist()


def _behind_zeros(powers: int) -> np.ndarray:
    """Tables, one a power of two, of what a register becomes behind that many zero bytes: 4 x 256 numbers each."""
    one = np.uint32(1) << np.arange(32, dtype=np.uint32)
    out = []
    for _ in range(powers):
        step = _CRC[one & 0xFF] ^ (one >> np.uint32(8)) if not out else _apply(out[-1], _apply(out[-1], np.uint32(1) << np.arange(32, dtype=np.uint32)))
        table = np.zeros((4, 256), np.uint32)
        for bit in range(32):
            has = (np.arange(256) >> (bit % 8)) & 1 == 1
            table[bit // 8, has] ^= step[bit]
        out.append(table)
    return np.array(out)


def _apply(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[0][x & 0xFF] ^ table[1][(x >> 8) & 0xFF] ^ table[2][(x >> 16) & 0xFF] ^ table[3][x >> 24]


_ZEROS = _behind_zeros(34)
#: Fewer bytes go one by one; more are cut in lanes that are read side by side and put together by twos.
_LEAST = 4096


def crc32c_bytes(data: bytes) -> int:
    """CRC-32C of bytes, by table."""
    crc, at = 0xFFFFFFFF, 0
    while len(data) - at >= _LEAST:
        power = ((len(data) - at).bit_length() - 1) // 2
        lanes = 1 << (((len(data) - at) >> power).bit_length() - 1)
        columns = np.ascontiguousarray(np.frombuffer(data, np.uint8, lanes << power, at).reshape(lanes, 1 << power).T)
        at += lanes << power
        register = np.zeros(lanes, np.uint32)
        register[0] = crc
        for column in columns:
            register = _CRC[(register ^ column) & 0xFF] ^ (register >> 8)
        while len(register) > 1:
            register = _apply(_ZEROS[power], register[::2]) ^ register[1::2]
            power += 1
        crc = int(register[0])
    table = _CRC_LIST
    for b in data[at:]:
        crc = table[(crc ^ b) & 0xFF] ^ (crc >> 8)
    return crc ^ 0xFFFFFFFF


def _crc_of(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else crc32c_bytes(bytes(b))).astype("Int64")


def crc32c(data: str | Column) -> Column:
    """CRC-32C of binary values; Spark has CRC-32 only."""
    return F.pandas_udf(_crc_of, LongType())(_col(data))


def batch_digest_crc(data: str | Column) -> Column:
    """The checksum of a batch is over its bytes from the attributes to the end."""
    return crc32c(data)
