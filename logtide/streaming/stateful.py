"""Stateful streams: producer admission, throttling, group membership, windows, and an exactly-once sink."""

from __future__ import annotations

import json
import math
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.access import charge
from ..operators.producers import REMEMBERED, Tail

# --- producers ----------------------------------------------------------------------------------


def _tail_state(tail: Tail) -> tuple:
    return tail.epoch, tail.expected if tail.expected is not None else -1, json.dumps([[int(x) for x in r] for r in tail.recent])


def _admit(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    tail = Tail()
    if state.exists:
        epoch, expected, recent = state.get
        tail = Tail(epoch, None if expected < 0 else expected, deque(map(tuple, json.loads(recent)), maxlen=REMEMBERED))
    rows = pd.concat(list(parts), ignore_index=True).sort_values("position", ignore_index=True)
    out = [tail.offer(*x) for x in zip(rows["epoch"], rows["base_sequence"], rows["last_sequence"], rows["base_offset"])]
    state.update(_tail_state(tail))
    producer, topic, partition = key
    yield pd.DataFrame({"producer_id": producer, "topic": topic, "partition": partition, "position": rows["position"], "outcome": [o for o, _ in out], "admitted_offset": pd.array([None if a is None else int(a) for _, a in out], "Int64")})


def admit_producers(batches: DataFrame) -> DataFrame:
    """Judges a stream of producer batches; the state of a producer of a topition is its epoch, the sequence
    it expects and its last five batches."""
    return batches.groupBy("producer_id", "topic", "partition").applyInPandasWithState(
        _admit, "producer_id bigint, topic string, partition int, position bigint, outcome string, admitted_offset bigint", "epoch int, expected bigint, recent string", "append", GroupStateTimeout.NoTimeout
    )


# --- throttling ---------------------------------------------------------------------------------


def _wait(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    tokens, last = state.get if state.exists else (math.inf, 0.0)
    rows = pd.concat(list(parts), ignore_index=True).sort_values(["at_s", "cost"], ignore_index=True)
    waits = []
    for at, cost, rate in zip(rows["at_s"], rows["cost"], rows["rate"]):
        tokens, wait = charge(tokens, last, at, rate, cost)
        last = at
        waits.append(wait)
    state.update((float(tokens), float(last)))
    yield pd.DataFrame({"principal": key[0], "at_s": rows["at_s"], "wait_s": waits})


def throttle(charges: DataFrame) -> DataFrame:
    """Waits of a stream of charges (principal, at_s, cost, rate)."""
    return charges.groupBy("principal").applyInPandasWithState(_wait, "principal string, at_s double, wait_s double", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


# --- groups -------------------------------------------------------------------------------------

# Answers of the group protocol.
OK, ILLEGAL_GENERATION, UNKNOWN_MEMBER, REBALANCING = "ok", "illegal_generation", "unknown_member_id", "rebalance_in_progress"


@dataclass
class Group:
    """A consumer group as a fold over its requests: who is in it, since when, and what it was assigned."""

    generation: int = -1
    leader: str | None = None
    members: dict[str, dict] = field(default_factory=dict)  # id -> topics, session_ms, seen_ms
    changed_ms: int = 0
    assignment: dict[str, str] | None = None
    minted: int = 0

    def state(self) -> str:
        if not self.members:
            return "Empty"
        if self.assignment is not None:
            return "Stable"
        return "CompletingRebalance" if self.leader else "Assigning"

    def _rebalance(self, now: int) -> None:
        self.generation, self.assignment, self.changed_ms = self.generation + 1, None, now
        if self.leader not in self.members:
            self.leader = None

    def sweep(self, now: int) -> list[str]:
        """Members not heard of within their session leave; a new generation begins without a leader."""
        gone = [m for m, d in self.members.items() if now - d["seen_ms"] > d["session_ms"]]
        for m in gone:
            del self.members[m]
        if gone:
            self._rebalance(now)
            self.leader = None
        return gone

    def join(self, now: int, member: str, topics: list[str], session_ms: int) -> tuple[str, str]:
        """A member without an id is given one and changes nothing; the first one in leads."""
        if not member:
            self.minted += 1
            return "member_id_required", f"member-{self.minted}"
        self.sweep(now)
        old = self.members.get(member)
        self.members[member] = {"topics": sorted(topics), "session_ms": session_ms, "seen_ms": now}
        if old is None or old["topics"] != sorted(topics):
            self._rebalance(now)
        if self.leader is None:
            self.leader = member
        return OK, member

    def _known(self, now: int, member: str, generation: int) -> str:
        self.sweep(now)
        if member not in self.members:
            return UNKNOWN_MEMBER
        if generation != self.generation:
            return ILLEGAL_GENERATION
        self.members[member]["seen_ms"] = now
        return OK

    def sync(self, now: int, member: str, generation: int, assignment: dict[str, str] | None) -> tuple[str, str | None]:
        """The leader's first assignment of a generation counts, and must cover the leader."""
        code = self._known(now, member, generation)
        if code != OK:
            return code, None
        if member == self.leader and self.assignment is None and assignment and member in assignment:
            self.assignment = dict(assignment)
        if self.assignment is None:
            return REBALANCING, None
        return OK, self.assignment.get(member, "")

    def heartbeat(self, now: int, member: str, generation: int) -> str:
        code = self._known(now, member, generation)
        return REBALANCING if code == OK and self.assignment is None else code

    def leave(self, now: int, member: str) -> str:
        if member not in self.members:
            return UNKNOWN_MEMBER
        del self.members[member]
        self._rebalance(now)
        return OK

    def answer(self, r) -> tuple[str, str | None]:
        now, member = int(r.at_ms), r.member_id or ""
        if r.kind == "join":
            return self.join(now, member, list(r.topics) if r.topics is not None else [], int(r.session_ms))
        if r.kind == "sync":
            return self.sync(now, member, int(r.generation), json.loads(r.assignment) if r.assignment else None)
        if r.kind == "heartbeat":
            return self.heartbeat(now, member, int(r.generation)), None
        if r.kind == "leave":
            return self.leave(now, member), None
        return "unsupported", None


REQUEST = "group string, at_ms bigint, kind string, member_id string, topics array<string>, session_ms int, generation int, assignment string"
ANSWER = "group string, at_ms bigint, kind string, member_id string, code string, answer string, generation int, leader string, state string"


def _answers(name: str, group: Group, rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for r in rows.sort_values("at_ms", kind="stable").itertuples(index=False):
        code, answer = group.answer(r)
        out.append((name, r.at_ms, r.kind, r.member_id, code, answer, group.generation, group.leader, group.state()))
    return pd.DataFrame(out, columns=[c.split(" ")[0] for c in ANSWER.split(", ")])


def _coordinate(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    group = Group(**json.loads(state.get[0])) if state.exists else Group()
    yield _answers(key[0], group, pd.concat(list(parts), ignore_index=True))
    state.update((json.dumps(asdict(group)),))


def coordinate(requests: DataFrame) -> DataFrame:
    """Answers a stream of group requests; a group's state holds its members, not its history."""
    return requests.groupBy("group").applyInPandasWithState(_coordinate, ANSWER, "group string", "append", GroupStateTimeout.NoTimeout)


def coordinate_batch(requests: DataFrame) -> DataFrame:
    """The same over a table of requests."""
    return requests.groupBy("group").applyInPandas(lambda rows: _answers(rows["group"].iloc[0], Group(), rows), ANSWER)


def _expire(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        (seen, session) = state.get
        state.remove()
        yield pd.DataFrame({"group": [key[0]], "member_id": [key[1]], "last_contact_ms": [seen]})
        return
    seen, session = state.get if state.exists else (0, 0)
    for part in parts:
        for at, ms in zip(part["at_ms"], part["session_ms"]):
            if at >= seen:
                seen, session = int(at), int(ms)
    state.update((seen, session))
    state.setTimeoutTimestamp(max(seen + session, state.getCurrentWatermarkMs() + 1))


def expired_members(heartbeats: DataFrame, *, late: str = "0 seconds") -> DataFrame:
    """Members whose session ran out: a row once the watermark of a stream (group, member_id, at, at_ms, session_ms) has passed their last contact and session."""
    return heartbeats.withWatermark("at", late).groupBy("group", "member_id").applyInPandasWithState(_expire, "group string, member_id string, last_contact_ms bigint", "seen bigint, session bigint", "append", GroupStateTimeout.EventTimeTimeout)


# --- windows and sinks --------------------------------------------------------------------------


def window_counts(events: DataFrame, *, time: str = "ts", key: str = "topic", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts a tumbling window; rows later than ``late`` behind the newest are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("records")).select(F.col("w.start").alias("window_start"), key, "records")


def append_once(path: str, prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: a batch that is run again replaces what it wrote before, so each counts once."""

    def put(df: DataFrame, batch_id: int) -> None:
        prepare(df).write.mode("overwrite").parquet(f"{path}/batch={batch_id:020d}")

    return put
