"""State that a stream keeps: counters of model calls that a start sets back, and a bounded cache of sessions.

Both keep one small value a key and forget it by timers of event time, so a stream's state is bounded by
what is open, whatever it has seen.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tracewell.config import Config
from tracewell.sources.shared import new_path, written
from tracewell.sources.sink import BatchTable

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_store(spark: SparkSession):
    """The state store that stateful processors need, while a query starts."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def replay(rows: DataFrame, name: str, files: int, by: str) -> DataFrame:
    """``rows`` as a stream of ``files`` batches in the order of ``by``: a table played back as it might have come in.
    A stream takes files by their age, so the parts are written one after another."""
    spark, path = rows.sparkSession, new_path(rows.sparkSession, name)
    parts = written(rows.repartitionByRange(files, by).withColumn("_part", F.spark_partition_id()), f"{name}-parts")
    for part in range(files):
        parts.where(F.col("_part") == part).drop("_part").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run_to(table: BatchTable, stream: DataFrame, name: str, mode: str = "append", each=lambda rows: rows, checkpoint: str | None = None, trigger: dict | None = None) -> None:
    """Run a stream over what is there and write each batch once: ``each(rows)`` under the batch's number. With the
    ``checkpoint`` of an earlier run it goes on where that one ended."""
    spark = stream.sparkSession
    with state_store(spark):
        query = (
            stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or new_path(spark, f"{name}-checkpoint"))
            .foreachBatch(lambda rows, number: (table.write(each(rows), number), None)[1]).trigger(**(trigger or {"availableNow": True})).start()
        )
        query.awaitTermination()


# -- counters ---------------------------------------------------------------------------------------

COUNTERS = "session_id string, request_id string, version long, chunk_count long, reasoning_chars long, text_chars long"


#: Buckets that calls are dealt to. A bucket's calls are one state, as a state a call costs several messages a call and batch. The
#: number is fixed for the life of a checkpoint.
BUCKETS = 256


class CallCounters(StatefulProcessor):
    """Counters of a bucket of calls. What came after a call's last start (by ``event_id``) counts, once each; events that
    precede a start that comes late are dropped when it comes. A call is forgotten by
    the first batch whose watermark is ``ttl_ms`` past its last event. The bucket has one timer, at or before
    the first time that any of its calls is due."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("calls", "value string")

    def _load(self) -> tuple[int, dict[tuple[str, str], list]]:
        """The bucket's timer (0: none) and its calls: start, version, when it is due, and its deltas."""
        known = self.state.get()
        timer, calls = json.loads(known[0]) if known else (0, [])
        return timer, {(session, request): call for session, request, *call in calls}

    def _keep(self, timer: int, calls: dict[tuple[str, str], list]) -> None:
        self.state.update((json.dumps([timer, [[*k, *c] for k, c in calls.items()]], separators=(",", ":")),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer, calls = self._load()
        changed: set[tuple[str, str]] = set()
        for batch in rows:
            times = batch["ts"].astype("datetime64[us]").astype("int64") // 1000
            columns = (batch["session_id"], batch["request_id"], times, batch["event_id"], batch["kind"], batch["chars"])
            for session, request, at, number, kind, chars in zip(*columns, strict=True):
                call = calls.setdefault((session, request), [None, 0, 0, {}])
                changed.add((session, request))
                call[2] = max(call[2], at + self.ttl_ms)
                if kind == "start":
                    call[0] = int(number) if call[0] is None else max(call[0], int(number))
                else:
                    call[3][str(int(number))] = [kind, 0 if pd.isna(chars) else int(chars)]
        out = []
        for name in changed:
            call = calls[name]
            if call[0] is not None:
                call[3] = {n: d for n, d in call[3].items() if int(n) > call[0]}
            call[1] += 1
            total = lambda kind: sum(c for k, c in call[3].values() if k == kind)  # noqa: B023, E731
            out.append((*name, call[1], len(call[3]), total("reasoning"), total("text")))
        due = min(c[2] for c in calls.values())
        if not timer or due < timer:
            if timer:
                self.handle.deleteTimer(timer)
            timer = due
            self.handle.registerTimer(timer)
        self._keep(timer, calls)
        yield pd.DataFrame(out, columns=["session_id", "request_id", "version", "chunk_count", "reasoning_chars", "text_chars"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, (_, calls) = timerValues.getCurrentWatermarkInMs(), self._load()
        calls = {k: c for k, c in calls.items() if c[2] > now}
        if calls:
            timer = min(c[2] for c in calls.values())
            self.handle.registerTimer(timer)
            self._keep(timer, calls)
        else:
            self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def counted_stream(deltas: DataFrame, lateness: str = "30 minutes", ttl_ms: int = 1_800_000) -> DataFrame:
    """Counters of a stream of deltas (``session_id, request_id, event_id, ts, kind, chars``), a row with the next
    ``version`` whenever a call's change. Events may come in any order and more than once within ``lateness``;
    what is later is dropped. :func:`newest` gives the current ones."""
    bucket = F.pmod(F.xxhash64("session_id", "request_id"), F.lit(BUCKETS)).cast("int")
    keyed = deltas.withColumn("bucket", bucket).withWatermark("ts", lateness).groupBy("bucket")
    return keyed.transformWithStateInPandas(CallCounters(ttl_ms), COUNTERS, "Update", "EventTime")


def newest(rows: DataFrame) -> DataFrame:
    """The current counters of calls that have any: the last version of each."""
    last = rows.groupBy("session_id", "request_id").agg(F.max_by(F.struct("chunk_count", "reasoning_chars", "text_chars"), F.struct("batch", "version")).alias("v"))
    return last.select("session_id", "request_id", "v.*").where("chunk_count > 0")


# -- the cache of sessions --------------------------------------------------------------------------

LIVES = "shard int, session_id string, event_id long, ts timestamp, what string"


#: Uses of a shard that are taken at once, as values.
USES = 100_000


class Sessions:
    """Which sessions are held, and when each was used last. A session that is silent for longer than ``ttl_us`` is
    forgotten, and so is the one used least recently if there are more than ``most``. Times are microseconds."""

    def __init__(self, ttl_us: int, most: int, held: dict[str, list[int]] | None = None) -> None:
        self.ttl_us, self.most, self.held = ttl_us, most, held or {}

    def use(self, session: str, at: int, number: int) -> list[tuple[str, str]]:
        """What a use brings about: ``(session, what)``, with ``what`` one of new, age, number."""
        out = []
        if session in self.held:
            if at - self.held[session][0] <= self.ttl_us:
                self.held[session] = max(self.held[session], [at, number])
                return out
            del self.held[session]
            out.append((session, "age"))
        self.held[session] = [at, number]
        out.append((session, "new"))
        if len(self.held) > self.most:
            oldest = min(self.held, key=self.held.get)
            del self.held[oldest]
            out.append((oldest, "number"))
        return out

    def sweep(self, now: int) -> list[str]:
        """Sessions that have been silent for too long at ``now``; they go."""
        old = [s for s, (at, _) in self.held.items() if now - at > self.ttl_us]
        for s in old:
            del self.held[s]
        return old


class SessionCache(StatefulProcessor):
    """:class:`Sessions` of one shard, swept by a timer every ``sweep_ms`` of event time while it holds any."""

    def __init__(self, ttl_us: int, most: int, sweep_ms: int) -> None:
        self.ttl_us, self.most, self.sweep_ms = ttl_us, most, sweep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("sessions", "value string")

    def _load(self) -> Sessions:
        return Sessions(self.ttl_us, self.most, json.loads(self.state.get()[0]) if self.state.exists() else None)

    def _keep(self, sessions: Sessions, now: int) -> None:
        if sessions.held:
            self.state.update((json.dumps(sessions.held),))
            if not any(True for _ in self.handle.listTimers()):
                self.handle.registerTimer(now + self.sweep_ms)
        elif self.state.exists():
            self.state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # A shard's uses of a batch are ordered as numbers, 20 bytes each, and names by their first appearance.
        sessions, names, parts = self._load(), {}, []
        for batch in rows:
            codes, own = pd.factorize(batch["session_id"])
            places = np.array([names.setdefault(name, len(names)) for name in own], np.int32)
            parts.append((places[codes], batch["event_id"].to_numpy(np.int64), batch["ts"].astype("datetime64[us]").to_numpy().astype(np.int64)))
        code, number, ts = (np.concatenate([p[i] for p in parts]) for i in range(3))
        del parts
        order, name_of, shard = np.lexsort((number, ts)), list(names), int(key[0])
        for i in range(0, len(order), USES):
            some, out = order[i : i + USES], []
            for c, n, at in zip(code[some].tolist(), number[some].tolist(), ts[some].tolist(), strict=True):
                out += [(shard, other, n, at, what) for other, what in sessions.use(name_of[c], at, n)]
            found = pd.DataFrame(out, columns=["shard", "session_id", "event_id", "ts", "what"])
            yield found.assign(ts=pd.to_datetime(found["ts"], unit="us"))
        self._keep(sessions, max(int(ts.max() // 1_000), timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, sessions = expiredTimerInfo.getExpiryTimeInMs(), self._load()
        gone = sessions.sweep(timerValues.getCurrentWatermarkInMs() * 1_000)
        if sessions.held:
            self.state.update((json.dumps(sessions.held),))
            self.handle.registerTimer(max(now, timerValues.getCurrentWatermarkInMs()) + self.sweep_ms)
        elif self.state.exists():
            self.state.clear()
        at = pd.Timestamp(now, unit="ms")
        yield pd.DataFrame([(int(key[0]), s, -1, at, "age") for s in gone], columns=["shard", "session_id", "event_id", "ts", "what"])

    def close(self) -> None:
        pass


def session_lives(uses: DataFrame, config: Config = Config(), most: int = 50, sweep_s: int = 300, lateness: str = "30 minutes") -> DataFrame:
    """Beginnings and ends of what a stream holds of sessions: ``shard, session_id, event_id, ts, what``.

    ``uses`` has ``shard, session_id, event_id, ts``. Each shard holds at most ``most`` sessions, each for as long
    as ``config.session_ttl_s`` after its last use. ``what`` is ``new``, or why one went: ``age`` or ``number``; what a
    sweep finds has the event -1. Uses of a batch are taken in order of time.
    """
    keyed = uses.withWatermark("ts", lateness).groupBy("shard")
    # Times are whole microseconds within, so that ties are those of the events.
    return keyed.transformWithStateInPandas(SessionCache(config.session_ttl_s * 1_000_000, most, sweep_s * 1000), LIVES, "Append", "EventTime")
