"""Keyed state that lives with the stream: a cache with expiry and step machines, by arbitrary state of Spark's second version.

State is kept in RocksDB, which :func:`with_state_store` asks for; a key's state is a few values, forgotten by Spark itself
when its time to live has passed, and restored from the checkpoint when a query starts again."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, GroupedData, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.constants import TRANSITIONS

STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TERMINAL, ERROR = ("succeeded", "failed", "cancelled", "skipped"), ("failed", "failed_partial")
STEP = "seq long, was string, asked string, status string, legal boolean, attempts long, entered long, terminal boolean, can_retry boolean"
STEP_ROW = Row("key", *(c.split()[0] for c in STEP.split(", ")))
ANSWER = "seq long, data string, origin string"


@contextmanager
def with_state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that start within use RocksDB; what the session had set comes back afterwards."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


class Steps(StatefulProcessor):
    """A step's status and retries (a value), and how often it has entered each status (a map)."""

    def __init__(self, allowed: dict[str, list[str]], first: str, most: int, strict: bool, ttl_ms: int | None):
        self.allowed, self.first, self.most, self.strict, self.ttl_ms = allowed, first, most, strict, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", "status string, attempts long", self.ttl_ms)
        self.entered = handle.getMapState("entered", "status string", "n long", self.ttl_ms)

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        self.current.update((initialState.status, int(initialState.attempts)))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        """Every access to state is a message to Spark: a key's is read before its rows of a batch and written after them."""
        known = self.current.exists()
        was, attempts = self.current.get() if known else (self.first, 0)
        entered = {k[0]: v[0] for k, v in self.entered.iterator()} if known else {}  # statuses live no longer than the value
        seen = set()
        for r in sorted(rows, key=lambda r: r.seq):  # of one batch
            asked = r.asked
            legal = asked == was or asked in self.allowed.get(was, [])
            now = asked if legal or not self.strict else was
            attempts += asked == "retrying" and (legal or not self.strict)
            n = entered[now] = entered.get(now, 0) + (now != was)
            seen.add(now)
            yield STEP_ROW(key[0], r.seq, was, asked, now, legal, attempts, n, now in TERMINAL, now in ERROR and attempts < self.most)
            was = now
        for status in seen:
            self.entered.updateValue((status,), (entered[status],))
        self.current.update((was, attempts))


def step_stream(stream: DataFrame, key: str, status: str, seq: str = "seq", allowed: dict[str, list[str]] = TRANSITIONS, first: str = "pending", most: int = 3, strict: bool = True, ttl_ms: int | None = None, initial: GroupedData | None = None) -> DataFrame:
    """Each row that asks for a status, with the step's status before and after, whether the move is allowed (staying is), the
    retries so far, how often this status was entered, whether it is a last one and whether a retry is possible.

    With ``strict`` a move that isn't allowed leaves the step as it is; else it is only marked. A step that is left alone
    for ``ttl_ms`` begins anew. ``initial``: (key, status, attempts) by key, from which steps start in the first batch.
    Rows of a batch are taken in the order of ``seq``; null statuses are never allowed."""
    rows = stream.select(F.col(key).alias("key"), F.col(seq).cast("long").alias("seq"), F.col(status).alias("asked"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").transformWithState(Steps(allowed, first, most, strict, ttl_ms), f"key {kind}, {STEP}", "Append", "ProcessingTime" if ttl_ms else "None", initial)


class Cache(StatefulProcessor):
    """What a key's last answer was, twice: until it is no longer fresh, and until it is forgotten."""

    def __init__(self, ttl_ms: int, keep_ms: int, notices: bool):
        self.ttl_ms, self.keep_ms, self.notices = ttl_ms, keep_ms, notices

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fresh = handle.getValueState("fresh", "data string", self.ttl_ms)
        self.stale = handle.getValueState("stale", "data string", self.keep_ms)

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        """A stored answer; whether it is still fresh is not known, so it is stale."""
        self.stale.update((initialState.data,))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        for r in sorted(rows, key=lambda r: r.seq):
            if self.fresh.exists():
                data, origin = self.fresh.get()[0], "fresh"
            elif r.fetched is not None:
                data, origin = r.fetched, "fetched"
                self.fresh.update((data,))
                self.stale.update((data,))
                if self.notices:
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms)
            elif self.stale.exists():
                data, origin = self.stale.get()[0], "stale"
            else:
                data, origin = None, "error"
            yield Row(key=key[0], seq=r.seq, data=data, origin=origin)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if not self.fresh.exists() and self.stale.exists():
            yield Row(key=key[0], seq=-1, data=self.stale.get()[0], origin="expired")


def cache_stream(stream: DataFrame, key: str, fetched: str, seq: str = "seq", ttl_ms: int = 86_400_000, keep_ms: int = 7 * 86_400_000, notices: bool = False, initial: GroupedData | None = None) -> DataFrame:
    """Each request (its ``fetched`` column has the network's answer, null if that failed) with an answer and where it is from: the fresh
    cached one, else the fetched one, which is cached, else the stale cached one, else an error.

    Answers are fresh for ``ttl_ms`` and forgotten after ``keep_ms``; with ``notices`` a timer gives a row (origin expired, seq -1) when
    an answer is no longer fresh. ``initial``: (key, data) by key, answers that are known but stale."""
    rows = stream.select(F.col(key).alias("key"), F.col(seq).cast("long").alias("seq"), F.col(fetched).cast("string").alias("fetched"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").transformWithState(Cache(ttl_ms, keep_ms, notices), f"key {kind}, {ANSWER}", "Append", "ProcessingTime", initial)
