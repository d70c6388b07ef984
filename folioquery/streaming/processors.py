"""Stateful processors: events of a key in order of time, with named state, timers and time-to-live.

A processor takes a key's events as they come, or, where a delay is given, holds them until the stream's time has
passed them by it, and then takes them in order of time, each event number once. A timer is set for each time that is
waited for. What a processor knows of a key lies in state variables that Spark keeps in its state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: The state store that state variables need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_variables(spark: SparkSession) -> None:
    """Let the session's streams keep state variables."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


#: Nanoseconds that a millisecond has, and the number that stands for no time.
MILLI, NEVER = 1_000_000, np.iinfo(np.int64).min
#: Buckets that owners are dealt to where no event waits.
BUCKETS = 512


def millis(ts: pd.Timestamp) -> int:
    return int(ts.value // MILLI)


class Ordered(StatefulProcessor):
    """owner: the column of the key that events belong to; fields: the other columns of an event, ts and number first.

    Subclasses turn an event into rows of `columns` by `take`, which is given what is known of its owner (None: nothing)
    and gives it back. A call has the events of one owner, or of all owners of a bucket; what is known of them is read
    and written once a call, as numbers or texts of `kept`. Times are whole nanoseconds; `times` names those in results.
    """

    owner: str
    fields: list[tuple[str, str]]
    kept: str
    columns: list[str]
    times: tuple[str, ...] = ()

    def __init__(self, held: bool, kind: str) -> None:
        self.held, self.kind = held, kind

    def take(self, known: tuple | None, event: tuple) -> tuple[tuple | None, list[tuple]]:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getListState("known", f"owner {self.kind}, {self.kept}")
        if self.held:
            # an event is kept under its time and number, so a repeated one is the same entry
            self.waiting = handle.getMapState("waiting", "at long, number string", ", ".join(f"{n} {kind}" for n, kind in self.fields))

    def _follow(self, events: list[tuple]) -> Iterator[pd.DataFrame]:
        """The rows that events (owner, ts, number, ...) make in order of time; what is known of owners is kept."""
        made: list[tuple] = []
        if events:
            before = {owner: tuple(rest) for owner, *rest in self.known.get()} if self.known.exists() else {}
            known = dict(before)
            for owner, *event in sorted(events, key=lambda e: e[1:3]):
                known[owner], rows = self.take(known.get(owner), tuple(event))
                made += [(owner, *row) for row in rows]
            now = {owner: value for owner, value in known.items() if value is not None}
            if now and now != before:
                self.known.put([(owner, *value) for owner, value in now.items()])
            elif before and not now:
                self.known.clear()
        told = dict(zip(self.columns, zip(*made))) if made else dict.fromkeys(self.columns, ())
        as_times = lambda x: np.array([NEVER if v is None else v for v in x], np.int64).view("datetime64[ns]")
        yield pd.DataFrame({c: as_times(x) if c in self.times else pd.Series(x, dtype=object) for c, x in told.items()})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        frame = frames[0] if len(frames) == 1 else pd.concat(frames)
        plain = lambda c: [None if v is None or v != v else v for v in frame[c].tolist()]
        events = list(zip(plain(self.owner), *(frame[n].to_numpy("datetime64[ns]").astype(np.int64).tolist() if kind == "timestamp" else plain(n) for n, kind in self.fields)))
        if not self.held:
            yield from self._follow(events)
            return
        for _, at, *rest in events:
            self.waiting.updateValue((at // MILLI, str(rest[0])), (pd.Timestamp(at), *rest))
        for at in {e[1] // MILLI for e in events}:
            self.handle.registerTimer(at + 1)
        yield from self._follow([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        due = [(place, (key[0], pd.Timestamp(at).value, *rest)) for place, (at, *rest) in self.waiting.iterator() if place[0] < until]
        for place, _ in due:
            self.waiting.removeKey(place)
        yield from self._follow([event for _, event in due])

    def close(self) -> None:
        pass


class Block(Ordered):
    """A session's block: since when, and its last event's time, until an event lifts it."""

    owner, kept = "sid", "since long, last long"
    fields = [("ts", "timestamp"), ("event_id", "long"), ("flagged", "boolean"), ("control", "string")]
    columns = ["sid", "event_id", "ts", "blocked", "since"]
    times = ("ts", "since")

    def __init__(self, held: bool, kind: str, ttl_ms: int | None) -> None:
        super().__init__(held, kind)
        self.ttl_ms = ttl_ms

    def take(self, known: tuple | None, event: tuple) -> tuple[tuple | None, list[tuple]]:
        (since, last), (ts, number, flagged, control) = known or (None, None), event
        if self.ttl_ms and last is not None and ts // MILLI - last // MILLI > self.ttl_ms:
            since = None
        if control == "unblock":
            since = None
        elif flagged and since is None:
            since = ts
        return None if since is None else (since, ts), [(number, ts, since is not None, since)]


class Jobs(Ordered):
    """The job that runs for a key; others are refused until it is done. Ends come after starts of their time."""

    owner, kept = "key", "job string"
    fields = [("ts", "timestamp"), ("rank", "string"), ("job_id", "string"), ("done", "boolean")]
    columns = ["key", "job_id", "accepted", "running"]

    def take(self, known: tuple | None, event: tuple) -> tuple[tuple | None, list[tuple]]:
        _, _, job, done = event
        if done:
            return (None if known == (job,) else known), []
        running = known or (job,)
        return running, [(job, known is None, *running)]


def ordered_stream(events: DataFrame, processor: Ordered, schema: str, delay: str | None) -> DataFrame:
    """What the processor makes of the events of each owner; with delay, in order of time once no earlier one can come.

    Without delay owners are taken a bucket at a time, since a call to a processor costs far more than an event. With
    delay each is a key of its own, since a timer looks through all that waits for its key.
    """
    keep_variables(events.sparkSession)
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if delay:
        return timed.withWatermark("ts", delay).groupBy(processor.owner).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
    dealt = timed.withColumn("bucket", F.pmod(F.xxhash64(processor.owner), F.lit(BUCKETS)))
    return dealt.groupBy("bucket").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="None")
