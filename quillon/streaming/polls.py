"""Polls of live sources as a keyed stream: guards against polls too soon or in flight, kept rows, staleness timers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Microseconds after a poll in which another is skipped, and after which a result counts as stale.
GUARD, STALE = 60 * 1_000_000, 30 * 60 * 1_000_000
OUT = "key string, event string, us long, seq long, value string"


@dataclass(frozen=True)
class State:
    """A key's polls so far, times in microseconds: the last one that ran, until when it runs, and the last success."""

    last: int | None = None
    until: int = 0
    checked: int | None = None
    seq: int | None = None
    value: str | None = None
    stale: bool = False

    def expired(self, now: int, stale: int = STALE) -> bool:
        return self.checked is not None and not self.stale and now - self.checked > stale


def step(s: State, at: int, seq: int, ok: bool, force: bool, busy: int, value: str | None, guard: int = GUARD, stale: int = STALE) -> tuple[State, list[tuple]]:
    """(new state, events (event, at, seq, value)) of one poll.

    A poll before the last one's start is late, one before its end in_flight (both even if forced), one within the
    guard after its start soon unless forced; these change nothing. A success is fresh; a failure starts the guard too,
    and the row of the last success is kept. A result that grew stale before the poll says so first, at that time.
    """
    out = []
    if s.expired(at, stale):
        out.append(("stale", s.checked + stale, s.seq, s.value))
        s = replace(s, stale=True)
    if s.last is not None and at < s.last:
        return s, [*out, ("late", at, seq, value)]
    if at < s.until:
        return s, [*out, ("in_flight", at, seq, value)]
    if s.last is not None and not force and at - s.last < guard:
        return s, [*out, ("soon", at, seq, value)]
    if ok:
        s = State(at, at + busy, at, seq, value)
        return s, [*out, ("fresh", at, seq, value)]
    return replace(s, last=at, until=at + busy), [*out, ("kept", at, seq, s.value)]


def poll_processor(guard: int = GUARD, stale: int = STALE):
    """StatefulProcessor over polls (key, us, seq, ok, force, busy_ms, value): step() in the order of (us, seq), with
    one value state a key and one timer, at which a result that no poll replaced becomes stale."""
    from pyspark.sql.streaming import StatefulProcessor

    class Polls(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("polls", "last long, until long, checked long, seq long, value string, stale boolean")

        def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            s, out = self._get(), []
            before, waited = s.checked, s.checked is not None and not s.stale
            for r in sorted(rows, key=lambda r: (r.us, r.seq)):
                s, events = step(s, r.us, r.seq, bool(r.ok), bool(r.force), 1000 * r.busy_ms, r.value, guard, stale)
                out += events
            self._put(s)
            if s.checked != before or s.stale:
                if waited:  # else the key has no timer
                    for t in list(self.handle.listTimers()):
                        self.handle.deleteTimer(t)
                if s.checked is not None and not s.stale:
                    self.handle.registerTimer(-(-(s.checked + stale) // 1000))
            return self._rows(key, out)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
            s, out = self._get(), []
            if s.checked is not None and not s.stale and -(-(s.checked + stale) // 1000) <= expiredTimerInfo.getExpiryTimeInMs():
                out = [("stale", s.checked + stale, s.seq, s.value)]
                self._put(replace(s, stale=True))
            return self._rows(key, out)

        def close(self) -> None:
            pass

        def _get(self) -> State:
            return State(*self.state.get()) if self.state.exists() else State()

        def _put(self, s: State) -> None:
            self.state.update((s.last, s.until, s.checked, s.seq, s.value, s.stale))

        def _rows(self, key, out: list[tuple]) -> Iterator[Row]:
            return iter([Row(key=key[0], event=event, us=us, seq=seq, value=value) for event, us, seq, value in out])

    return Polls()


def stream_polls(polls: DataFrame, time_mode: str = "EventTime", delay: str = "0 seconds", guard: int = GUARD, stale: int = STALE) -> DataFrame:
    """Streaming polls (key string, at timestamp, seq long, ok boolean, force boolean, busy_ms long, value string) ->
    events (key, event, at, seq, value): fresh, kept, soon, in_flight, late and stale; see step().

    EventTime replays landed polls: timers follow the watermark of `at`, `delay` behind the newest poll. ProcessingTime
    follows the clock, for polls that come in live. Null flags are false; a null key is a key. State is one row a key;
    a micro-batch's rows of one key are sorted in one task, so bound micro-batches (maxFilesPerTrigger) where a
    key's backlog is long. Needs the RocksDB state store (rocksdb()).
    """
    rows = polls.select("key", "at", F.unix_micros("at").alias("us"), "seq", "ok", "force", "busy_ms", "value")
    if time_mode == "EventTime":
        rows = rows.withWatermark("at", delay)
    events = rows.groupBy("key").transformWithState(statefulProcessor=poll_processor(guard, stale), outputStructType=OUT, outputMode="Append", timeMode=time_mode)
    return events.select("key", "event", F.timestamp_micros("us").alias("at"), "seq", "value")


@contextmanager
def rocksdb(spark: SparkSession):
    """The session with the RocksDB state store, as it was before afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def start_polls(polls: DataFrame, path: str, checkpoint: str, trigger: dict, **how):
    """A running query (inside rocksdb()) whose events of micro-batch n go to path/b=n; a batch that runs again
    overwrites them. With ProcessingTime it has no end: timers of the clock need further micro-batches."""
    def write(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/b={batch_id}")

    return stream_polls(polls, **how).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def run_polls(polls: DataFrame, path: str, checkpoint: str, **how) -> None:
    """Run all available landed polls by event time; see start_polls."""
    with rocksdb(polls.sparkSession):
        start_polls(polls, path, checkpoint, {"availableNow": True}, **how).awaitTermination()
