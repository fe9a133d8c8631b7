"""Keyed state with a lifetime in streams: rate limits in order of events, user states, bounded conversations, live sets.

Each is a stateful processor over named state variables in the RocksDB state store, which only opens what a key's rows
need. Rows stream through one by one, so a key's batch is never gathered in memory. Where the order of events matters
they wait in a map by event time until the watermark has passed them; what arrives later than the watermark allows is
dropped by Spark and counts nowhere. Lifetimes by event time end by timers, lifetimes by the clock by the state's own.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from bookloom.operators.state import CONTEXT_BYTES, MESSAGE_BYTES, PER_USER, STATE_SECONDS, WINDOW_SECONDS

#: How long a conversation and a session live without a change, in milliseconds.
CONVERSATION_TTL, SESSION_TTL = 7 * 24 * 3600 * 1000, 24 * 3600 * 1000
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Queries that begin after this keep their state in RocksDB, as the processors here need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)


class _Processor(StatefulProcessor):
    def close(self) -> None:
        pass


class OrderedWindows(_Processor):
    """A window begins at the first event after the last one ended; events are counted in order of time."""

    def __init__(self, seconds: int, limit: int):
        self.span, self.limit = seconds * 1_000_000, limit

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "us long", "n long")
        self.window = handle.getValueState("window", "start long, n long")
        self.settled = handle.getValueState("settled", "ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in rows:
            at = (r["us"],)
            there = self.waiting.getValue(at)
            if there is None:
                self.handle.registerTimer(r["us"] // 1000 + 1)
            self.waiting.updateValue(at, ((there[0] if there else 0) + 1,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs()
        done = self.settled.get() if self.settled.exists() else (-(1 << 62),)
        if done[0] >= until:  # an earlier timer of this batch has settled all
            return
        self.settled.update((until,))
        start, n = self.window.get() if self.window.exists() else (None, 0)
        passed = sorted(k[0] for k in self.waiting.keys() if k[0] < until * 1000)
        for us in passed:
            (many,) = self.waiting.getValue((us,))
            for _ in range(many):
                if start is None or us >= start + self.span:
                    start, n = us, 0
                n += 1
                yield Row(key=key[0], us=us, start_us=start, count=n, allowed=n <= self.limit)
            self.waiting.removeKey((us,))
        if start is not None and start + self.span <= until * 1000:
            self.window.clear()
            if not self.waiting.exists():
                self.settled.clear()
        elif start is not None:
            self.window.update((start, n))
            self.handle.registerTimer(-(-(start + self.span) // 1000))  # to forget the window


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def rate_limit(events: DataFrame, key: str = "key", seconds: int = WINDOW_SECONDS, limit: int = PER_USER, delay: str = "10 minutes") -> DataFrame:
    """key, ts, window_start, count, allowed, as fixed_windows() has them for all events in order, whatever order they arrive in.

    An event comes out once the watermark has passed it. State goes when its window has ended.
    """
    use_state_store(events.sparkSession)
    rows = events.select(F.col(key).alias("key"), "ts").withWatermark("ts", delay).withColumn("us", _micros("ts"))
    kind = dict(rows.dtypes)["key"]
    out = rows.groupBy("key").transformWithState(OrderedWindows(seconds, limit), f"key {kind}, us long, start_us long, count long, allowed boolean", "append", "eventTime")
    return out.select("key", F.timestamp_micros("us").alias("ts"), F.timestamp_micros("start_us").alias("window_start"), "count", "allowed")


class LastStates(_Processor):
    """The latest state of a key by event time, until its lifetime ends."""

    def __init__(self, seconds: int):
        self.life = seconds * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long, state string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.last.get() if self.last.exists() else None
        best = max(((r["us"], r["state"] or "") for r in rows), default=None)
        if before is not None and (best is None or tuple(before) >= best):
            return
        if before is not None:
            self.handle.deleteTimer(-(-(before[0] + self.life) // 1000))
        self.last.update(best)
        self.handle.registerTimer(-(-(best[0] + self.life) // 1000))
        if best[1] or (before is not None and before[1]):
            yield Row(key=key[0], us=best[0], state=best[1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        us, state = self.last.get()
        self.last.clear()
        if state:
            yield Row(key=key[0], us=us, state="")


def user_states(events: DataFrame, key: str = "key", seconds: int = STATE_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """key, ts, state whenever a key's state changes (events: key, ts, state); '' once it is cleared or has lived so long.

    The last row of each key is what the batch operator of this name gives at the watermark.
    """
    use_state_store(events.sparkSession)
    rows = events.select(F.col(key).alias("key"), "ts", "state").withWatermark("ts", delay).withColumn("us", _micros("ts"))
    kind = dict(rows.dtypes)["key"]
    out = rows.groupBy("key").transformWithState(LastStates(seconds), f"key {kind}, us long, state string", "update", "eventTime")
    return out.select("key", F.timestamp_micros("us").alias("ts"), "state")


class BoundedConversations(_Processor):
    """The latest messages of a conversation that fit; what has fallen out never comes back."""

    def __init__(self, limit: int, ttl: int | None):
        self.limit, self.ttl = limit, ttl

    def init(self, handle) -> None:
        self.kept = handle.getListState("kept", "turn long, role string, text string", self.ttl)
        self.fallen = handle.getValueState("fallen", "turn long", self.ttl)

    @staticmethod
    def cost(message: tuple) -> int:
        return len((message[1] or "").encode()) + len((message[2] or "").encode()) + MESSAGE_BYTES

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept = [tuple(m) for m in self.kept.get()] if self.kept.exists() else []
        (floor,) = self.fallen.get() if self.fallen.exists() else (None,)
        size = sum(map(self.cost, kept))
        for r in rows:
            if floor is not None and r["turn"] <= floor:
                continue
            message = (r["turn"], r["role"], r["text"])
            kept.insert(bisect.bisect_right([m[0] for m in kept], r["turn"]), message)
            size += self.cost(message)
            while size > self.limit and len(kept) > 1:
                first = kept.pop(0)
                size, floor = size - self.cost(first), first[0]
        if kept:
            self.kept.put(kept)
        if floor is not None:
            self.fallen.update((floor,))
        for turn, role, text in kept:
            yield Row(conv_id=key[0], turn=turn, role=role, text=text)


def bounded_conversations(messages: DataFrame, limit: int = CONTEXT_BYTES, ttl_ms: int | None = CONVERSATION_TTL) -> DataFrame:
    """conv_id, turn, role, text: after each batch, all messages that a conversation with new ones keeps.

    As trim_conversations() has them for all messages so far, in any order of arrival; turns of a conversation differ.
    """
    use_state_store(messages.sparkSession)
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    kind = dict(rows.dtypes)["conv_id"]
    return rows.groupBy("conv_id").transformWithState(BoundedConversations(limit, ttl_ms), f"conv_id {kind}, turn long, role string, text string", "update", "processingTime")


class LiveSets(_Processor):
    """A set for each key, whose members live so long after they were last added."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle) -> None:
        self.members = handle.getMapState("members", "member string", "value string", self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: r["nth"]):
            member = (r["member"],)
            if r["action"] == "add":
                self.members.updateValue(member, (r["value"] or "",))
            elif r["action"] == "remove":
                self.members.removeKey(member)
            elif r["action"] == "clear":
                self.members.clear()
            else:
                found = self.members.getValue(member) if self.members.exists() else None
                yield Row(key=key[0], nth=r["nth"], member=r["member"], live=found is not None, value=found[0] if found is not None else None)


def live_sets(requests: DataFrame, ttl_ms: int = SESSION_TTL) -> DataFrame:
    """key, nth, member, live, value for each request that asks (requests: key, nth, action, member, value).

    Actions are add (again: the lifetime begins anew), remove, clear (all members of the key) and has; requests of a
    batch are taken in order of nth. Sessions of users, tokens for a change of password and revoked tokens are such sets.
    """
    use_state_store(requests.sparkSession)
    rows = requests.select("key", F.col("nth").cast("long").alias("nth"), "action", "member", "value")
    kind = dict(rows.dtypes)["key"]
    return rows.groupBy("key").transformWithState(LiveSets(ttl_ms), f"key {kind}, nth long, member string, live boolean, value string", "append", "processingTime")
