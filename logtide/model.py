"""Schemas, in DDL, of the tables that make up a log. Keys and values are opaque bytes; unsigned numbers are widened."""

from __future__ import annotations

HEADER = "array<struct<key: binary, value: binary>>"
RECORD = f"key binary, value binary, headers {HEADER}, offset_delta int, timestamp_delta bigint, attributes tinyint"
BATCH = (
    "base_offset bigint, batch_length int, partition_leader_epoch int, magic tinyint, crc bigint, attributes smallint, last_offset_delta int, base_timestamp bigint, "
    "max_timestamp bigint, producer_id bigint, producer_epoch smallint, base_sequence int, record_count bigint, record_data binary"
)
PRODUCERS = "array<struct<producer_id: bigint, producer_epoch: smallint, base_sequence: int, last_sequence: int, offset_delta: bigint, flags: tinyint>>"
SEGMENT_ENTRY = (
    "prefix string, seq bigint, writer_epoch bigint, nonce decimal(20,0), version smallint, topic string, partition int, base_offset bigint, record_count bigint, "
    f"byte_start bigint, byte_len bigint, max_timestamp bigint, producers {PRODUCERS}"
)
STAGE = "topic string, partition int, log_start bigint, last_stable bigint, high_watermark bigint, aborted array<struct<producer_id: bigint, first_offset: bigint>>"
TRUNCATION = "topic string, partition int, floor bigint, high bigint, served_end bigint, served_at_high bigint"
TOPIC = "topic string, topic_id string, partitions int, replication_factor smallint, incarnation bigint"
TOPIC_CONFIG = "topic string, name string, value string"
TXN = "transactional_id string, producer_id bigint, producer_epoch smallint, state string, topic string, partition int, first_offset bigint, last_offset bigint"
COMMITTED_OFFSET = "group string, topic string, partition int, offset bigint, committed_at timestamp_ntz"
GROUP_MEMBER = "group string, member_id string, seq bigint, last_contact_ms bigint, session_timeout_ms int, rebalance_timeout_ms int, group_instance_id string, topics array<string>"
GROUP_GENERATION = (
    "group string, generation_id int, leader string, members map<string,string>, members_changed_at_ms bigint, state_since_ms bigint, swept_at_ms bigint, protocol_type string, protocol_name string"
)
GROUP_ASSIGNMENT = "group string, generation_id int, leader string, assignments map<string,binary>"
ACL = "resource_type string, resource_name string, pattern string, principal string, host string, operation string, permission string"
QUOTA = "entity_user string, producer_byte_rate double, consumer_byte_rate double, request_rate double"

# Fixed values of the record format.
HEADER_BYTES = 61
COMPRESSION_MASK, TIMESTAMP_TYPE_BIT, TRANSACTIONAL_BIT, CONTROL_BIT = 7, 8, 16, 32
EARLIEST, LATEST = -2, -1
DEFAULT_MAX_BYTES = 5 * 1024 * 1024
I32_MAX = 2_147_483_647
