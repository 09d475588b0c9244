"""Segments: bytes, the data source, streams."""

import struct

import pytest
from hypothesis import given
from hypothesis import strategies as st

from logtide.functions import codec
from logtide.sources import segment, seglog, stores

RECORDS = [codec.Record(i, i * 10, None if i == 2 else f"k{i}".encode(), None if i == 1 else b"v" * i, [(b"h", None)] * (i % 2)) for i in range(5)]


@pytest.mark.parametrize("name", ["none", "gzip", "lz4", "zstd"])
def test_batches_round_trip(name):
    b = codec.build(RECORDS, base_offset=7, base_timestamp=1000, codec=name, producer_id=3, producer_epoch=1, base_sequence=4)
    again = codec.decode(codec.encode(b))
    assert again == b and codec.records_of(again) == RECORDS and codec.produce_error(again) is None
    assert (b.last_offset_delta, b.max_timestamp, codec.codec_of(b.attributes)) == (4, 1040, name)
    again.data = again.data[:-1] + bytes([again.data[-1] ^ 1])
    assert codec.produce_error(again) == "corrupt_message"
    again.magic = 1
    assert codec.produce_error(again) == "unsupported_for_message_format"


def test_snappy_is_read_in_chunks():
    import pyarrow as pa

    plain = codec.encode_records(RECORDS)
    one = pa.compress(plain[:20], codec="snappy", asbytes=True)
    two = pa.compress(plain[20:], codec="snappy", asbytes=True)
    framed = b"\x82SNAPPY\x00" + struct.pack(">ii", 1, 1) + b"".join(struct.pack(">i", len(x)) + x for x in (one, two))
    assert codec.inflate(framed, "snappy") == plain and codec.inflate(pa.compress(plain, codec="snappy", asbytes=True), "snappy") == plain
    with pytest.raises(ValueError):
        codec.deflate(plain, "snappy")


@given(st.integers(-(2**63), 2**63 - 1))
def test_varints_round_trip(x):
    out = bytearray()
    codec.put_varint(out, x)
    assert codec.get_varint(bytes(out), 0) == (x, len(out))


@pytest.mark.parametrize("version", [1, 2, 3])
def test_footers_round_trip(version):
    made = segment.Footer(5, 9 if version > 1 else 0, [segment.Entry("tøpic", 1, 10, 3, 0, 99, 77, [segment.Coordinate(1, 2, 3, 4, 0, 3 if version == 3 else 0)] if version > 1 else [])], version)
    data = segment.encode_footer(made)
    assert segment.decode_footer(b"records" + data) == made
    assert struct.unpack(">QIHI", data[-18:])[1:] == (1, version, 0x54534547)


def test_footers_that_can_not_be_read():
    data = bytearray(segment.encode_footer(segment.Footer(0, 0, [])))
    assert segment.decode_footer(b"x" * 40) is None
    data[-5] = 9
    with pytest.raises(segment.UnknownVersion):
        segment.decode_footer(bytes(data))


def test_damaged_regions():
    good = codec.encode(codec.build(RECORDS))
    assert len(list(codec.walk(good + good))) == 2
    for bad in (good + struct.pack(">qi", 0, -1), good + struct.pack(">qi", 0, 10_000), b"\xff" * 64):
        with pytest.raises(codec.CorruptBatch):
            list(codec.walk(bad))
    assert len(list(codec.walk((good + good)[:-3], 2 * len(good)))) == 1


def data(spark, n=300):
    return spark.createDataFrame([(f"o.e.t{i % 3}.x", i % 2, i // 6, 1000 + i, f"k{i}".encode(), None if i % 7 == 0 else f"v{i}".encode()) for i in range(n)], "topic string, partition int, offset bigint, timestamp_ms bigint, key binary, value binary")


def plain(df):
    return sorted((r.topic, r.partition, r.offset, r.timestamp_ms, bytes(r.key), r.value and bytes(r.value)) for r in df.collect())


def test_the_source_reads_what_it_wrote(spark, tmp_path):
    seglog.register(spark)
    path, df = str(tmp_path / "log"), data(spark)
    df.coalesce(1).write.format("seglog").mode("append").save(path)
    got = spark.read.format("seglog").load(path)
    assert plain(got) == plain(df)
    few = got.filter("topic = 'o.e.t1.x' and offset >= 20 and offset < 30")
    assert plain(few) == plain(df.filter("topic = 'o.e.t1.x' and offset >= 20 and offset < 30"))
    m = seglog.manifest(spark, path)
    assert {(r.topic, r.partition, r.base_offset, r.record_count) for r in m.collect()} == {(f"o.e.t{t}.x", p, 0, 50) for t in range(3) for p in range(2)}
    df.coalesce(1).write.format("seglog").mode("append").save(path)
    assert [(p, s) for _, p, s, _ in seglog.listing(path)] == [(f"o.e.t{t}", s) for t in range(3) for s in range(2)]


def test_damage_is_a_row_or_an_error(spark, tmp_path):
    seglog.register(spark)
    good = codec.build([codec.Record(0, 0, b"k", b"v")])
    raw = bytearray(segment.build([("a", 0, [good]), ("b", 0, [good])]))
    raw[8:12] = struct.pack(">i", -5)
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / f"{0:020d}.seg").write_bytes(raw)
    got = spark.read.format("seglog").load(str(tmp_path)).select("topic", "error").collect()
    assert sorted((r[0], r[1] is not None) for r in got) == [("a", True), ("b", False)]
    with pytest.raises(Exception, match="CorruptBatch|batch of"):
        spark.read.format("seglog").option("mode", "FAILFAST").load(str(tmp_path)).collect()
    (tmp_path / "p" / f"{1:020d}.seg").write_bytes(codec.encode(good))  # from before footers
    assert spark.read.format("seglog").load(str(tmp_path)).filter("topic is null and error is null").count() == 1


def test_stream_reads_new_segments_once(spark, tmp_path):
    seglog.register(spark)
    path, out, df = str(tmp_path / "log"), str(tmp_path / "out"), data(spark, 60)

    def run():
        q = spark.readStream.format("seglog").load(path).select("topic", "partition", "offset", "timestamp_ms", "key", "value").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", out).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(out)

    df.coalesce(1).write.format("seglog").mode("append").save(path)
    assert plain(run()) == plain(df)
    df.coalesce(1).write.format("seglog").mode("append").save(path)
    assert run().count() == 120 and run().count() == 120


FULL = "topic string, partition int, offset bigint, timestamp_ms bigint, key binary, value binary, headers array<struct<key: binary, value: binary>>, producer_id bigint, producer_epoch int, sequence int, is_transactional boolean, is_control boolean"


def full(spark):
    """Producers that take turns, gaps, a sequence that starts again, marks of transactions, headers, nulls, offsets beyond an int."""
    rows, end = [], 2**31 - 1
    for i in range(40):
        producer = i // 10 % 2
        rows.append(("o.e.a.x", 0, 3 * i if i > 20 else i, 5000 - i, None, b"v" * i, [(b"h", None), (b"", b"w")] * (i % 3), 7 + producer, 1, (end - 12 + i) % 2**31, i % 10 > 5, False))
    rows.append(("o.e.a.x", 0, 1000, 1, b"\0\0\0\1", None, [], 7, 1, -1, True, True))
    rows += [("o.e.a.x", 1, i * i, i, b"k", None, [], -1, -1, -1, False, False) for i in range(30)]
    rows += [("o.e.b.x", 0, 2**31 * i + 5, -1, b"", b"", [], -1, -1, -1, False, False) for i in range(4)]
    return spark.createDataFrame(rows, FULL)


def everything(df):
    plain = lambda x: None if x is None else bytes(x)
    return sorted((r.topic, r.partition, r.offset, r.timestamp_ms, plain(r.key) or b"", r.key is None, plain(r.value) or b"", r.value is None, str([(plain(h.key), plain(h.value)) for h in r.headers]), r.producer_id, r.producer_epoch, r.sequence, r.is_transactional, r.is_control) for r in df.select(FIELDS).collect())


FIELDS = ["topic", "partition", "offset", "timestamp_ms", "key", "value", "headers", "producer_id", "producer_epoch", "sequence", "is_transactional", "is_control"]


@pytest.mark.parametrize("options", [{}, {"recordsPerBatch": "4", "codec": "none"}, {"segmentBytes": "2000"}])
def test_nothing_is_lost_between_write_and_read(spark, tmp_path, options):
    seglog.register(spark)
    path, df = str(tmp_path / "log"), full(spark)
    df.coalesce(1).write.format("seglog").options(**options).mode("append").save(path)
    got = spark.read.format("seglog").load(path)
    assert got.filter("error is not null").count() == 0 and everything(got) == everything(df)
    again = str(tmp_path / "again")
    got.coalesce(1).write.format("seglog").mode("append").save(again)
    assert everything(spark.read.format("seglog").load(again)) == everything(df)
    assert got.filter("topic = 'o.e.a.x' and partition = 1 and offset = 841").count() == 1
    if "segmentBytes" in options:
        assert len(seglog.listing(path)) > 5


def writer(path, **options):
    return seglog.SegmentWriter({"path": str(path), **options}, type("S", (), {"names": FIELDS[:6]}))


def staged(path, n=1):
    row = dict(topic="a.b.c.d", partition=0, offset=0, timestamp_ms=0, key=b"k", value=b"v")
    return [writer(path).write(iter([row])) for _ in range(n)]


def names(path):
    return [s for _, _, s, _ in seglog.listing(str(path))]


def test_a_commit_that_runs_again_adds_nothing(tmp_path):
    messages = staged(tmp_path, 3)
    writer(tmp_path).commit(messages)
    writer(tmp_path).commit(messages)
    assert names(tmp_path) == [0, 1, 2]
    half = staged(tmp_path, 2)
    writer(tmp_path).commit(half[:1])  # as if the first commit broke off
    writer(tmp_path).commit(half)
    assert names(tmp_path) == [0, 1, 2, 3, 4]
    with pytest.raises(FileNotFoundError):
        writer(tmp_path).commit([seglog.Written(((str(tmp_path / "_staging" / "none"), "a.b.c", 1),))])


def test_writers_at_the_same_time_do_not_overwrite(tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    jobs = [staged(tmp_path, 5) for _ in range(6)]
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda m: writer(tmp_path).commit(m), jobs))
    assert len(names(tmp_path)) == len(set(names(tmp_path))) == 30
    nonces = {n for m in jobs for w in m for _, _, n in w.staged}
    fs, _ = seglog.open_path(str(tmp_path))
    assert {seglog.read_footer(fs, p, size).nonce for p, _, _, size in seglog.listing(str(tmp_path))} == nonces


def test_names_of_segments_that_are_gone_are_not_used_again(tmp_path):
    import os

    writer(tmp_path).commit(staged(tmp_path, 3))
    for path, *_ in seglog.listing(str(tmp_path)):
        os.unlink(path)
    writer(tmp_path).commit(staged(tmp_path))
    assert names(tmp_path) == [3]


def test_streams_start_by_offset_or_time(spark, tmp_path):
    seglog.register(spark)
    path = str(tmp_path / "log")
    for part in range(3):
        spark.range(10).selectExpr("'a.b.c.d' topic", "cast(id % 2 as int) partition", f"id div 2 + {5 * part} offset", f"id + {100 * part} timestamp_ms", "cast('k' as binary) key", "cast('v' as binary) value").coalesce(1).write.format("seglog").mode("append").save(path)

    def run(name, **options):
        q = spark.readStream.format("seglog").options(**options).load(path).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r.partition, r.offset) for r in spark.table(name).collect())

    assert run("by_offset", startingOffsets='{"a.b.c.d": {"0": 7}}') == [(0, o) for o in range(7, 15)] + [(1, o) for o in range(15)]
    assert run("by_time", startingTimestamp="105") == [(p, o) for p in range(2) for o in range(5, 15)]
    assert run("after_all", startingTimestamp="1000") == []


def test_checksums_in_lanes_are_those_by_byte():
    import random

    from logtide.functions.scalars import crc32c_bytes

    def by_bit(data):
        crc = 0xFFFFFFFF
        for b in data:
            crc ^= b
            for _ in range(8):
                crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
        return crc ^ 0xFFFFFFFF

    rng = random.Random(3)
    for n in (0, 1, 4095, 4096, 4097, 9001, 70_001):
        data = rng.randbytes(n)
        assert crc32c_bytes(data) == by_bit(data)


def test_append_time_control_records_and_lz4_blocks():
    b = codec.build(RECORDS, base_timestamp=5, codec="lz4")
    assert (codec.log_append_time(b, 99).base_timestamp, b.max_timestamp) == (5, 45)
    b = codec.build(RECORDS, base_timestamp=5, attributes=8)
    assert (codec.log_append_time(b, 99).base_timestamp, b.max_timestamp) == (99, 99) and codec.produce_error(b) is None
    for committed in (False, True):
        r = codec.control_record(committed, 4)
        assert struct.unpack(">hh", r.key) == (0, committed) and struct.unpack(">hi", r.value) == (0, 4)
    frame = lambda flags: codec.Batch(attributes=3, data=b"\x04\x22\x4d\x18" + bytes([flags]) + b"\x40")
    assert codec.dependent_lz4_blocks(frame(0x40)) and not codec.dependent_lz4_blocks(frame(0x60))
    assert not codec.dependent_lz4_blocks(codec.build(RECORDS, codec="zstd"))


def test_store_urls():
    s = stores.parse("s3://bucket/path?coalesce_bytes=4m&coalesce_linger=250ms&auto_create_topics=true")
    assert s.options == {"coalesce_bytes": 4 << 20, "coalesce_linger": 250, "auto_create_topics": True} and s.url == "s3a://bucket/path"
    assert stores.parse("memory://x").url is None
    with pytest.warns(UserWarning):
        assert stores.parse("s3://b?coalesce_bytes=many").options == {}
    with pytest.warns(DeprecationWarning):
        stores.parse("s3://b?lease_ttl=1")
    with pytest.raises(ValueError, match="unknown store"):
        stores.parse("ftp://x")
