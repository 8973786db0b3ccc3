"""Structured Streaming: events into memories, timelines, freshness and expiry, and state in versions: synapses, energies, shared accesses, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.functions import text as X
from tessera.sources import extract


def events(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """Raw events from JSON files as they come."""
    return spark.readStream.schema(extract.EVENT).option("maxFilesPerTrigger", per_trigger).json(path)


def memories(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event's memories once: an event that comes again within the watermark is dropped."""
    return extract.extracted(stream.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["event_id"]))


def into(rows: DataFrame, path: str, checkpoint: str, embedder=None):
    """Starts a query that appends to a Parquet table what is there, and ends. A batch that is repeated after a failure is written under
    its own number again, so it takes the place of what was half written."""
    from tessera.operators.vector import embedded_by

    def write(batch: DataFrame, number: int):
        done = embedded_by(batch, embedder) if embedder is not None else batch
        done.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def timeline(stream: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Events and approximate sessions by window of event time."""
    return stream.withWatermark("timestamp", late).groupBy(F.window("timestamp", width).alias("w")).agg(F.count("*").alias("n"), F.approx_count_distinct("session_id").alias("sessions")).select(F.col("w.start").alias("start"), "n", "sessions")


def fresh(stream: DataFrame, kind: str, late: str = "1 hour") -> DataFrame:
    """Events with the time until which they are valid for a type of query."""
    hours = X.VALID_HOURS.get(kind, X.VALID_HOURS["default"])
    return stream.withWatermark("timestamp", late).withColumn("valid_until", F.col("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600)))


def latest(stream: DataFrame, ttl_hours: float = 24.0) -> DataFrame:
    """session_id, n, last: running counts of a session's events, kept as state until the session has been silent for ttl_hours."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, frames, state: GroupState):
        import pandas as pd

        if state.hasTimedOut:
            n, last = state.get
            state.remove()
            yield pd.DataFrame({"session_id": [key[0]], "n": [n], "last": [pd.Timestamp(last, unit="us")], "ended": [True]})
            return
        n, last = state.get if state.exists else (0, 0)
        for f in frames:
            n += len(f)
            if len(f):
                last = max(last, int(f["timestamp"].max().value // 1000))
        state.update((n, last))
        state.setTimeoutTimestamp(int(last // 1000 + ttl_hours * 3600_000))
        yield pd.DataFrame({"session_id": [key[0]], "n": [n], "last": [pd.Timestamp(last, unit="us")], "ended": [False]})

    out, held = "session_id string, n long, last timestamp, ended boolean", "n long, last long"
    return stream.withWatermark("timestamp", "1 hour").groupBy("session_id").applyInPandasWithState(step, out, held, "update", GroupStateTimeout.EventTimeTimeout)


def upserts(stream: DataFrame, versions, embedder=None, threshold: int = extract.MULTI, name: str = "events", extractor=None):
    """A query's writer that puts each event's memories into versions of a table: a batch is a change of its rows only, and of an event that comes again,
    within a batch or later, the last by its time takes the place of what was there. The version names the batch, so one that is repeated after a failure or
    a restart counts once."""

    def write(batch: DataFrame, number: int):
        if number <= versions.done(name) or batch.isEmpty():
            return
        versions.change(extract.stored(extract.last_of_each(batch), threshold, embedder, extractor), "created_at", batch=(name, number))

    return stream.writeStream.foreachBatch(write)


def expiries(stream: DataFrame, hours: dict[str, float] | None = None, late: str = "1 hour") -> DataFrame:
    """memory_id, kind, at, event: what becomes of memories (memory_id, kind, timestamp) that age by their kind: a row `valid` with the time at which
    a memory will have aged, whenever that moves, and a row `expired` when event time has passed it. hours by kind are the fixed ones unless they are given.

    Each memory is a value of the state store, with a timer at its end of validity; a later mention moves the timer, an earlier one changes nothing. When
    the timer fires the memory's state goes, so the state holds the valid memories only. Needs the RocksDB state store (see stateful())."""
    valid = hours or X.VALID_HOURS
    return _timed(stream.select("memory_id", "kind", "timestamp"), late, _Expiry(valid), "memory_id", "memory_id string, kind string, at timestamp, event string")


def recent_accesses(stream: DataFrame, days: float = 7.0, late: str = "1 hour") -> DataFrame:
    """memory_id, n, at: how many accesses (memory_id, timestamp) of a memory lie within the days up to its latest one, whenever that changes, also when old ones
    go by a timer; 0 is the memory's last row, after which its state is gone. Accesses are kept as counts by second, so a hot memory's state is bounded by the time span."""
    return _timed(stream.select("memory_id", "timestamp"), late, _Accesses(days), "memory_id", "memory_id string, n long, at timestamp")


def stateful(spark: SparkSession) -> None:
    """Sets the state store that timers and values of several states need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _timed(stream: DataFrame, late: str, processor, key: str, out: str) -> DataFrame:
    rows = stream.withWatermark("timestamp", late).groupBy(key)
    return rows.transformWithStateInPandas(processor, out, "Update", "EventTime")


def _milliseconds(times) -> list[int]:
    return [int(t.timestamp() * 1000) for t in times]


class _Expiry(StatefulProcessor):
    """State of a memory: its kind and the millisecond at which it will have aged."""

    def __init__(self, hours: dict[str, float]):
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.held = handle, handle.getValueState("held", "kind string, until long")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        kind, until = self.held.get() if self.held.exists() else (None, -1)
        before = until
        for frame in rows:
            for k, t in zip(frame["kind"], _milliseconds(frame["timestamp"])):
                hours = self.hours.get(k, self.hours["default"])
                end = t + int(hours * 3_600_000)
                if end > until or (end == until and str(k) < str(kind)):
                    kind, until = k, end
        if until != before:
            if before >= 0:
                self.handle.deleteTimer(before)
            self.held.update((kind, until))
            self.handle.registerTimer(until)
            yield pd.DataFrame({"memory_id": [key[0]], "kind": [kind], "at": [pd.Timestamp(until, unit="ms")], "event": ["valid"]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd

        kind, until = self.held.get()
        self.held.clear()
        yield pd.DataFrame({"memory_id": [key[0]], "kind": [kind], "at": [pd.Timestamp(until, unit="ms")], "event": ["expired"]})

    def close(self) -> None:
        pass


class _Accesses(StatefulProcessor):
    """State of a memory: accesses by second, and the timer that will drop the oldest."""

    def __init__(self, days: float):
        self.span = int(days * 86_400_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seconds, self.timer = handle.getMapState("seconds", "second long", "n long"), handle.getValueState("timer", "at long")

    def _rows(self, key, times: list[int], passed: int):
        """The counts at these times. What is older than the days before passed, which event time has reached, goes; the rest is left to a timer."""
        import pandas as pd

        held = {k[0]: v[0] for k, v in self.seconds.iterator()}
        n = [sum(v for s, v in held.items() if now - self.span < s * 1000 <= now) for now in times]
        for s in [s for s in held if s * 1000 <= passed - self.span]:
            self.seconds.removeKey((s,))
            del held[s]
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if held:
            at = min(held) * 1000 + self.span
            self.timer.update((at,))
            self.handle.registerTimer(at)
        return pd.DataFrame({"memory_id": [key[0]] * len(n), "n": n, "at": [pd.Timestamp(t, unit="ms") for t in times]})

    def handleInputRows(self, key, rows, timerValues):
        now = max([0, *(k[0] * 1000 for k, _ in self.seconds.iterator())])
        for frame in rows:
            for t in _milliseconds(frame["timestamp"]):
                s = (t // 1000,)
                n = self.seconds.getValue(s)[0] if self.seconds.containsKey(s) else 0
                self.seconds.updateValue(s, (n + 1,))
                now = max(now, t)
        yield self._rows(key, [now], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        ends = {k[0] * 1000 + self.span for k, _ in self.seconds.iterator()}  # all that event time has passed, at once
        mark = timerValues.getCurrentWatermarkInMs()
        passed = sorted(t for t in ends if t <= mark)
        self.timer.clear()
        yield self._rows(key, passed or [expiredTimerInfo.getExpiryTimeInMs()], mark)

    def close(self) -> None:
        pass


def updates(stream: DataFrame, versions, first: str, step, touched=None, name: str = "state"):
    """A query's writer that keeps keyed state in versions of a table. step(state, batch) gives the new rows of those keys of the state that a batch changes;
    first is the schema of an empty state. touched(batch) gives the batch's keys: step then sees the state's rows of these only, and what is written is a change,
    which grows with the batch and not with the state; after a number of changes the versions fold them into a snapshot. Without touched the step is of the
    whole state, and a snapshot is written. The version names the batch, so one that is repeated after a failure is skipped: it counts once."""

    def write(batch: DataFrame, number: int):
        if number <= versions.done(name):
            return
        batch = batch.persist()  # read for its keys and by the step
        try:
            state = versions.read() if versions.numbers() else batch.sparkSession.createDataFrame([], first)
            if touched is None:
                versions.write(step(state, batch), batch=(name, number))
            else:
                own = state.join(touched(batch).distinct(), versions.keys, "left_semi")
                versions.change(step(own, batch), batch=(name, number))
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write)


def synapses(stream: DataFrame, versions, key: str = "activation_id", rate: float = 0.01):
    """Activations (key, memory_id) into synapses (m1, m2, weight), keyed by both ends; only pairs that are active together are read and written."""
    from tessera.operators import graph

    return updates(stream, versions, "m1 string, m2 string, weight double", lambda old, batch: graph.hebbian(old, batch, key, rate), lambda batch: graph.all_pairs(batch, key).select("m1", "m2"))


def energies(stream: DataFrame, versions, clusters: DataFrame):
    """Accesses (memory_id) into the energy of clusters (memory_id, cluster): each batch is one step, in which all clusters fall, so the whole state is written: a row for each
    cluster."""
    from tessera.operators import graph

    return updates(stream, versions, "cluster long, energy double", lambda old, batch: graph.cluster_energy(old, clusters, batch))


def co_access(stream: DataFrame, versions, key: str = "activation_id"):
    """Access lists (key, memory_id) into numbers of shared accesses (m1, m2, n), keyed by both ends."""
    from tessera.operators import graph

    add = lambda old, batch: old.unionByName(graph.all_pairs(batch, key)).groupBy("m1", "m2").agg(F.sum("n").alias("n"))
    return updates(stream, versions, "m1 string, m2 string, n long", add, lambda batch: graph.all_pairs(batch, key).select("m1", "m2"))


def drifts(stream: DataFrame, versions, momentum: float = 0.95):
    """Contexts (memory_id, at, context) into drift vectors (memory_id, drift)."""
    from tessera.operators import graph

    return updates(stream, versions, "memory_id string, drift array<double>", lambda old, batch: graph.drift(batch, momentum, old), lambda batch: batch.select("memory_id"))
