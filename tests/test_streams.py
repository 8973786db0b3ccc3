"""Streams against batch models: upserts, state by change, expiry and recent accesses."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import scoring as S, text as X
from tessera.plans.engine import MemoryStore
from tessera.sources import extract, sinks
from tessera.streaming import ingest

AT = dt.datetime(2024, 1, 1)


def lines(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps(r, default=str) for r in rows))


def test_upserts_of_events_across_a_restart(spark, tmp_path):
    event = lambda i, text, minute: {"event_id": f"e{i}", "session_id": "chat_1", "event_type": "user_message", "timestamp": AT + dt.timedelta(minutes=minute), "actor": "user:1", "content": text, "metadata": {}}
    lines(tmp_path / "in", "a", [event(1, "first", 0), event(1, "second", 5), event(2, "other", 1), event(None, "nameless", 1) | {"event_id": None}])
    lines(tmp_path / "in", "b", [event(1, "third", 9), event(3, "more", 2)])
    store = MemoryStore(spark, str(tmp_path / "store"))

    def run(checkpoint):
        stream = ingest.events(spark, str(tmp_path / "in"), 1)
        q = store.ingest_stream(stream).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
        return {r.source_event_id: r.raw_text for r in store.memories().collect()}

    want = {"e1": "third", "e2": "other", "e3": "more"}
    assert run("c") == want and store.table.done("events") == 1
    assert run("c") == want  # nothing new
    versions = store.table.numbers()
    assert run("lost") == want and store.table.numbers() == versions  # a lost checkpoint: the batches are known
    lines(tmp_path / "in", "c", [event(2, "late news", 20)])
    assert run("c") == want | {"e2": "late news"} and len(store.table.read(versions[0]).collect()) in (2, 3)
    again = spark.read.schema(extract.EVENT).json(str(tmp_path / "in" / "a.json"))
    store.ingest(again.where("event_id = 'e1'"))
    assert {r.source_event_id: r.raw_text for r in store.memories().collect()}["e1"] == "second"  # a later write of an older text stands, as in the store


def test_state_is_written_by_change(spark, tmp_path):
    """What a batch writes doesn't grow with the state, and the state is that of all batches at once."""
    rng = random.Random(3)
    kind = "m1 string, m2 string, weight double"
    v = sinks.Versions(spark, str(tmp_path / "v"), ["m1", "m2"])
    big = spark.range(60_000).select(F.concat(F.lit("a"), "id").alias("m1"), F.concat(F.lit("b"), "id").alias("m2"), (F.col("id") % 90 / 100.0).alias("weight"))
    v.write(big)
    size = lambda n: sum(p.stat().st_size for p in (tmp_path / "v" / v.entry(n)["folder"]).glob("*.parquet"))
    batches = [[(f"k{i}{j}", f"{rng.choice('ab')}{rng.randrange(30)}") for j in range(6) for _ in range(4)] for i in range(3)]
    for i, rows in enumerate(batches):
        lines(tmp_path / "in", str(i), [{"activation_id": k, "memory_id": m} for k, m in rows])
    stream = spark.readStream.schema("activation_id string, memory_id string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    ingest.synapses(stream, v).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    assert v.numbers() == [0, 1, 2, 3] and all(v.entry(n)["change"] and size(n) < size(0) / 20 for n in (1, 2, 3))
    from tessera.operators import graph

    want = graph.hebbian(big, spark.createDataFrame([r for b in batches for r in b], "activation_id string, memory_id string"), "activation_id")
    one = lambda d: d.select("m1", "m2", F.round("weight", 9).alias("w"))
    assert one(v.read()).exceptAll(one(want)).count() == 0 and v.read().count() == want.count()
    assert v.read().schema.simpleString() == spark.createDataFrame([], kind).schema.simpleString()


@pytest.fixture
def store_of_state(spark):
    ingest.stateful(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def run_all(spark, tmp_path, files, schema, of):
    for i, rows in enumerate(files):
        lines(tmp_path / "in", f"{i:03d}", rows)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(tmp_path / "in"))
    got = []
    q = of(stream).writeStream.outputMode("update").foreachBatch(lambda b, n: got.append([r.asDict() for r in b.collect()])).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(300)
    return [r for b in got for r in b]


def test_expiry_of_memories(spark, tmp_path, store_of_state):
    rng = random.Random(7)
    kinds = [k for k in X.VALID_HOURS if k != "default"][:5] + ["no_such_kind"]
    rows = [{"memory_id": f"m{rng.randrange(12)}", "kind": rng.choice(kinds), "timestamp": AT + dt.timedelta(minutes=rng.randrange(60 * 72))} for _ in range(80)]
    rows.sort(key=lambda r: r["timestamp"])
    files = [rows[i : i + 20] for i in range(0, 80, 20)] + [[{"memory_id": "end", "kind": "news", "timestamp": AT + dt.timedelta(days=4000)}], [{"memory_id": "end2", "kind": "news", "timestamp": AT + dt.timedelta(days=4000)}]]
    got = run_all(spark, tmp_path, files, "memory_id string, kind string, timestamp timestamp", ingest.expiries)
    until = {}
    for i, rows in enumerate(files[:4]):  # the batch model: the latest end of validity; a memory that expired before a later mention has two lives
        for r in rows:
            until.setdefault(r["memory_id"], []).append(r["timestamp"] + dt.timedelta(hours=X.VALID_HOURS.get(r["kind"], X.VALID_HOURS["default"])))
    expired = [r for r in got if r["event"] == "expired"]
    valid = [r for r in got if r["event"] == "valid"]
    assert {r["memory_id"] for r in expired} == set(until)
    for m, ends in until.items():
        own = [r["at"] for r in expired if r["memory_id"] == m]
        assert max(own) == max(ends) and set(own) <= set(ends) and len(own) == len(set(own))
        assert max(r["at"] for r in valid if r["memory_id"] == m) == max(ends)
    assert {r["memory_id"] for r in valid} == set(until) | {"end", "end2"}


def test_accesses_of_the_last_days(spark, tmp_path, store_of_state):
    rng = random.Random(8)
    rows = [{"memory_id": f"m{rng.randrange(4)}", "timestamp": AT + dt.timedelta(hours=i * 3)} for i in range(120)]
    files = [rows[i : i + 30] for i in range(0, 120, 30)] + [[{"memory_id": f"end{k}", "timestamp": AT + dt.timedelta(days=300 + k)}] for k in range(2)]
    got = run_all(spark, tmp_path, files, "memory_id string, timestamp timestamp", ingest.recent_accesses)
    times = {}
    for r in rows:
        times.setdefault(r["memory_id"], []).append(r["timestamp"])
    for m, ts in times.items():
        own = [r for r in got if r["memory_id"] == m]
        for r in own:  # the batch model: accesses in the seven days up to the row's time
            seen = [t for t in ts if r["at"] - dt.timedelta(days=7) < t <= r["at"]]
            assert r["n"] == len(seen), (m, r)
        assert own[-1]["n"] == 0 and max(r["n"] for r in own) > 1


class Parser:
    def parse(self, text, as_of):
        if "fail" in text:
            raise ConnectionError
        return {"first": "2024-01-02"} if "that day" in text else None


class Decomposer:
    def decompose(self, text):
        return {"who": {"id": "user:2"}, "where": {"value": "rome"}, "why": "planning"}


def test_parsers_and_settings_act_on_a_search(spark, tmp_path):
    from tessera.plans.config import Config

    rows = [(f"e{i}", "chat_1", "user_message", AT + dt.timedelta(days=i), f"user:{i % 3}", f"notes on topic {i}", {"location": "rome" if i % 2 else "oslo"}) for i in range(6)]
    store = MemoryStore(spark, str(tmp_path / "s"), parser=Parser(), decomposer=Decomposer())
    store.ingest(spark.createDataFrame(rows, extract.EVENT))
    store.config.set("grouping", "off")
    mems = store.memories().collect()
    day = {r.memory_id: r.when_ts[:10] for r in mems}

    def hit(signal, text="topic of that day"):
        only = dict.fromkeys(S.WEIGHTS, 0.0) | {signal: 1.0}
        return {r.memory_id for r in store.search(text, 6, "2024-01-07T00:00:00", weights=only).collect() if r.score > 0}

    assert hit("temporal") == {m for m, d in day.items() if d == "2024-01-02"}
    assert hit("actor") == {r.memory_id for r in mems if r.who_id == "user:2"} and hit("spatial") == {r.memory_id for r in mems if r.where_value == "rome"}
    assert store.search("will fail", 6, "2024-01-07T00:00:00").count() == 6  # the rule in place of the parser
    said = store.decompose("Where is Anna?")
    assert said["who"] == {"id": "user:2"} and said["why"] == "planning" and "Anna" in said["entities"][0] and said["how"] == "message"
    c = Config()
    c.set("w_semantic", 0.0)
    c.set("w_recency", 1.0)
    c.set("grouping", "off")
    store.config, store.decomposer = c, None
    newest = store.search("topic", 6, "2024-01-07T00:00:00").orderBy("rank").collect()
    assert day[newest[0].memory_id] == "2024-01-06"
