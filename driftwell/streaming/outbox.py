"""A leased outbox as keyed state with timers: messages are enqueued once, claimed for a time, and acknowledged by the claim that holds.

Every claim has a fencing token, one more than the claim before. An acknowledgement of another token than the current
one comes too late and is refused, whatever its sender believes; a lease that lapses lets the message be claimed
again. Delivery is at least once: a receiver must know a message's key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

STATE = "status string, digest string, attempts long, token long, owner string, lease_until long"
RESULT = "key string, at timestamp, action string, result string, token long, attempts long"
LEASE_MS = 60_000


@dataclass(frozen=True)
class Message:
    """status: pending or sent; lease_until in milliseconds, 0 without a lease."""

    status: str
    digest: str
    attempts: int = 0
    token: int = 0
    owner: str = ""
    lease_until: int = 0


def step(message: Message | None, at: int, action: str, digest: str | None, owner: str | None, token: int | None, lease: int = LEASE_MS) -> tuple[Message | None, str]:
    """The message after one command at ``at``, and what became of the command."""
    if action == "enqueue":
        if message is None:
            return Message("pending", digest or ""), "pending"
        return message, "idempotent" if message.digest == (digest or "") else "conflict"
    if message is None:
        return None, "unknown"
    if action == "claim":
        if message.status == "sent":
            return message, "done"
        if message.lease_until > at:
            return message, "held"
        return replace(message, attempts=message.attempts + 1, token=message.token + 1, owner=owner or "", lease_until=at + lease), "leased"
    if action not in ("ack", "fail"):
        return message, "unknown"
    if message.status == "sent":
        return message, "done"
    if token is None or token != message.token or not message.lease_until:
        return message, "refused"
    if action == "ack":
        return replace(message, status="sent", owner="", lease_until=0), "sent"
    return replace(message, owner="", lease_until=0), "released"


def expire(message: Message, now: int) -> tuple[Message, str | None]:
    """A lapsed lease is taken away, so that what its holder still sends is refused."""
    if message.status == "pending" and message.lease_until and message.lease_until <= now:
        return replace(message, owner="", lease_until=0), "expired"
    return message, None


class Outbox(StatefulProcessor):
    """One message for each key; a timer at the end of its lease."""

    def __init__(self, lease: int = LEASE_MS):
        self.lease = lease

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("message", STATE)

    def _get(self) -> Message | None:
        return Message(*self.state.get()) if self.state.exists() else None

    def _put(self, m: Message) -> None:
        self.state.update((m.status, m.digest, m.attempts, m.token, m.owner, m.lease_until))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A micro-batch's commands of one message; they come in no order.
        given = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable")
        before = message = self._get()
        out = []
        for r in given.itertuples():
            at = int(r.at.value // 1_000_000)
            if message is not None:
                message, lapsed = expire(message, at)
                if lapsed:
                    out.append((key[0], r.at, "timer", lapsed, message.token, message.attempts))
            message, result = step(message, at, r.action, _text(r.digest), _text(r.owner), None if pd.isna(r.token) else int(r.token), self.lease)
            out.append((key[0], r.at, r.action, result, message.token if message else 0, message.attempts if message else 0))
        if message is not None:
            self._put(message)
            was, until = before.lease_until if before else 0, message.lease_until
            if was != until:
                if was:
                    self.handle.deleteTimer(was)
                if until:
                    self.handle.registerTimer(until)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        message, out = self._get(), []
        if message is not None:
            message, lapsed = expire(message, now)
            if lapsed:
                self._put(message)
                out.append((key[0], pd.Timestamp(now, unit="ms"), "timer", lapsed, message.token, message.attempts))
        yield _frame(out)

    def close(self) -> None:
        pass


def _text(x) -> str | None:
    return None if x is None or pd.isna(x) else str(x)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["key", "at", "action", "result", "token", "attempts"])
    return out.astype({"token": "int64", "attempts": "int64"}) if rows else out.astype({"at": "datetime64[ns]", "token": "int64", "attempts": "int64"})


def outbox(commands: DataFrame, late: str = "10 seconds", lease: int = LEASE_MS) -> DataFrame:
    """What becomes of a stream of commands (key, at, seq, action, digest, owner, token), and leases that lapse: (key, at, action, result, token, attempts).

    Actions are enqueue, claim, ack and fail. Times are the commands' own, so a replay gives the same results; a
    lease lapses when the watermark, ``late`` behind the newest command, passes its end, or when a later command of
    its key comes. State is kept for each key in RocksDB, which the session must name as its state store.
    """
    marked = commands.where(F.col("key").isNotNull()).withWatermark("at", late)
    return marked.groupBy("key").transformWithStateInPandas(Outbox(lease), RESULT, "append", "eventTime")


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def settled(commands: DataFrame, lease: int = LEASE_MS) -> DataFrame:
    """(key, status, attempts, token, refused): where the messages of a finished log of commands stand, the same rules over each key in order."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, message, refused = None, None, 0
        for b in batches:
            out = []
            for r in b.itertuples():
                if r.key != key:
                    if message is not None:
                        out.append((key, message.status, message.attempts, message.token, refused))
                    key, message, refused = r.key, None, 0
                at = int(r.at.value // 1_000_000)
                message = expire(message, at)[0] if message is not None else None
                message, result = step(message, at, r.action, _text(r.digest), _text(r.owner), None if pd.isna(r.token) else int(r.token), lease)
                refused += result == "refused"
            yield pd.DataFrame(out, columns=["key", "status", "attempts", "token", "refused"])
        if message is not None:
            yield pd.DataFrame([(key, message.status, message.attempts, message.token, refused)], columns=["key", "status", "attempts", "token", "refused"])

    rows = commands.where(F.col("key").isNotNull()).select("key", "at", "seq", "action", "digest", "owner", "token").repartition("key").sortWithinPartitions("key", "at", "seq")
    return rows.mapInPandas(scan, "key string, status string, attempts long, token long, refused long")
