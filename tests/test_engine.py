"""Functions against literal tables, operators against plain models, sources, sinks, streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import chunks, scoring as S, temporal, text as X
from tessera.operators import blocks, graph, legacy, liquid, retrieval, store, vector
from tessera.plans.config import Config, Settings
from tessera.plans.engine import MemoryStore
from tessera.sources import conversations, extract, readers, sinks
from tessera.streaming import ingest

AS_OF = "2024-01-31T00:00:00"


def one(spark, values, column, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").select("i", column(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows, key=lambda r: r.i)]


def test_recency(spark):
    got = one(spark, [None, "now", "2025", "2024-01-31T00:00:00", "2024-01-24", "2030-01-01", "10:30", "yesterday", "2024-13-45"], lambda c: S.recency(c, AS_OF))
    assert got == [0.5, 0.5, 0.5, 1.0, 0.5, 1.0, 0.5, 0.5, 0.5]
    falling = one(spark, [f"2024-01-{d:02d}" for d in range(1, 31)], lambda c: S.recency(c, AS_OF))
    assert falling == sorted(falling)


def test_json_list(spark):
    assert one(spark, ['["a","b"]', "[]", None, "x", '["a"] x', "['a']", '{"a":1}'], S.json_list) == [["a", "b"], [], [], [], [], [], []]


def test_weights_are_completed():
    assert abs(sum(S.completed({"semantic": 3.0}).values()) - 1) < 1e-9
    assert S.completed({}) == S.WEIGHTS


def test_entities(spark):
    got = one(spark, ['["x","y"]', "The Growth Hormone and IGF-1 of John Smith, john smith", None, "", "That IBM"], X.entities)
    assert got == [["x", "y"], ["The Growth Hormone", "John Smith", "IGF-1"], [], [], ["IBM"]]
    got = one(spark, ["Use Python3 and 'red hat' in Docker API", ""], X.rule_entities)
    assert got == [["Use", "Docker", "API", "Python3", "red hat", "Python"], []]


def test_memory_entities(spark):
    rows = spark.createDataFrame([('["A","b"]', "why now then"), ("Plain text, of it", None), (None, "why not")], "w string, y string")
    got = [set(r[0]) for r in rows.select(X.memory_entities(F.col("w"), F.col("y"))).collect()]
    assert got == [{"a", "b", "then"}, {"plain", "text"}, set()]


def test_tool_calls(spark):
    t = ["a <tool_call>{'name': 'web_search', 'arguments': {'query': 'x'}}</tool_call> b", '```json\n{"tool": "t", "arguments": {}}\n```', "none", "<tool_call>bad</tool_call>"]
    assert [[c["name"] for c in r] for r in one(spark, t, X.tool_calls)] == [["web_search"], ["t"], [], []]


def test_temporal(spark):
    got = one(spark, ["3 days ago", "2 weeks ago", "1 month ago", "5 years ago", "on 2023-05-06", "I know", "", None], lambda c: temporal.hint(c, AS_OF))
    assert [g and (g["kind"], g["value"], g["first"], g["last"]) for g in got] == [("date", None, "2024-01-28", "2024-01-28"), ("range", None, "2024-01-17", "2024-01-24"), ("range", None, "2024-01-01", "2024-01-31"), None, ("date", None, "2023-05-06", "2023-05-06"), ("relative", "today", None, None), None, None]
    assert one(spark, ["what happened 3 days ago in Rome", "recently we met someone", "yesterday"], temporal.cleaned) == ["what happened 3 days in Rome", "ly we met someone", "yesterday"]


def test_chunkers():
    rnd = random.Random(1)
    text = " ".join(" ".join("w" * rnd.randint(1, 9) for _ in range(rnd.randint(3, 30))) + rnd.choice(".!?") for _ in range(200))
    plain = chunks.Sentences(500, 0, 1).chunk(text)
    assert " ".join(plain) == text and all(len(c) <= 500 for c in plain)
    lapped = chunks.Sentences(500, 5, 1).chunk(text)
    assert [b == " ".join(a.split()[-5:]) + " " + c for a, b, c in zip(plain, lapped[1:], plain[1:])] == [True] * (len(plain) - 1)
    assert chunks.Sentences(50, 0, 1).chunk("x" * 10 + " " + "y" * 60 + " z") == ["x" * 10, "y" * 60, "z"]
    assert chunks.Paragraphs(20, 0, 1).chunk("aa\n\nbb\n \ncc" + "d" * 16) == ["aa\n\nbb", "cc" + "d" * 16]
    assert chunks.Sections(100, 0, 1).chunk("# One\ntext\n## Two\nmore") == ["One\ntext", "Two\nmore"]
    assert chunks.Sentences().chunk("") == [] and chunks.Paragraphs().chunk(None) == [] and chunks.Sections().chunk("short") == []


def _rows(spark, n=30, q=2):
    rnd = random.Random(4)
    rows = [(k, f"m{i:03d}", rnd.random(), rnd.choice([0, 5, 40, 200, 900])) for k in range(q) for i in range(n)]
    return rows, spark.createDataFrame(rows, "query_id int, memory_id string, score double, token_count int")


@pytest.mark.parametrize("limit", [0, 3, 100, 1000, 10**6])
def test_knapsack(spark, limit):
    rows, df = _rows(spark)
    got = blocks.knapsack(df, limit).collect()
    for k in (0, 1):
        used, want = 0, []
        for _, i, s, t in sorted((r for r in rows if r[0] == k), key=lambda r: (-r[2] / max(1, r[3]), r[1])):
            if used + t <= limit:
                used += t
                want.append(i)
        mine = sorted((r for r in got if r.query_id == k), key=lambda r: r.pick)
        assert [r.memory_id for r in mine] == want and (not mine or mine[-1].used == used)


def test_block_chain_holds_each_candidate_once(spark):
    rows, df = _rows(spark)
    got = blocks.chain(df, 300).collect()
    assert sorted((r.query_id, r.memory_id) for r in got) == sorted((r[0], r[1]) for r in rows)
    for r in got:
        assert r.block_tokens <= 300 or sum(x.block == r.block and x.query_id == r.query_id for x in got) == 1
        assert (r.next_block is None) == (not r.has_more)


def _model(rows, literal):
    groups, out = [], {}
    for r in sorted(rows, key=lambda r: (-r["semantic"], r["memory_id"])):
        for g, members in enumerate(groups):
            if any(_related(r, m, literal) for m in members[:3]):
                members.append(r)
                out[r["memory_id"]] = g
                break
        else:
            out[r["memory_id"]] = len(groups)
            groups.append([r])
    return out


def _related(a, b, literal):
    x, y = a["e"], b["e"]
    if literal and a["who"]:
        return True
    return bool(a["who"] and a["who"] == b["who"] and len(x & y) > 3 or x | y and len(x & y) / len(x | y) > 0.4 or a["semantic"] > 0.7 and b["semantic"] > 0.7 and len(x & y) > 2)


@pytest.mark.parametrize("literal", [False, True])
def test_grouping(spark, literal):
    rnd = random.Random(2)
    rows = []
    for i in range(60):
        e = rnd.sample([f"ent{k}" for k in range(14)], rnd.randint(1, 6))
        who = rnd.choice([None, "u1", "u2"])
        rows.append({"query_id": 0, "memory_id": f"m{i}", "semantic": round(rnd.random(), 1), "who_list": json.dumps([who]) if who else None, "what": json.dumps(e), "why": None, "who": who, "e": set(e)})
    df = spark.createDataFrame([tuple(r[c] for c in ("query_id", "memory_id", "semantic", "who_list", "what", "why")) for r in rows], "query_id int, memory_id string, semantic double, who_list string, what string, why string")
    got = {r.memory_id: r.group_id for r in retrieval.grouped(df, literal).collect()}
    assert got == _model(rows, literal)


def test_pages(spark):
    df = spark.range(53).select(F.format_string("m%03d", "id").alias("memory_id"), F.col("id").cast("string").alias("when_ts"))
    seen = [r.memory_id for n in range(1, 7) for r in store.page(df, "memory_id; drop", True, n, 10).collect()]
    assert len(seen) == len(set(seen)) == 53
    last = store.page(df, number=6, size=10).first()
    assert (last.total, last.total_pages, last.has_prev, last.has_next) == (53, 6, True, False)


def test_pairs_of_long_lists(spark):
    n = graph.MOST_ACTIVE + 100
    acts = spark.range(n).selectExpr("'a' as act", "lpad(id, 6, '0') as memory_id").union(spark.range(3).selectExpr("'b'", "lpad(id, 6, '0')"))
    got = graph.hebbian(spark.createDataFrame([], "m1 string, m2 string, weight double"), acts, "act")
    assert got.where("m1 < m2").count() == got.count() == n * (n - 1) // 2
    assert got.where("weight > 0.015").count() == 3
    few = acts.where("memory_id < '000050'")
    assert sorted(graph.all_pairs(few, "act", block=7).collect()) == sorted(graph.all_pairs(few, "act").collect())


def test_flow_and_merge(spark):
    v = spark.createDataFrame([(f"m{i}", [1.0, i / 100]) for i in range(6)] + [("z", [-1.0, 0.0])], "memory_id string, embedding array<double>")
    c = spark.createDataFrame([(f"m{i}", i % 2) for i in range(6)] + [("z", 5)], "memory_id string, cluster long")
    e = spark.createDataFrame([(0, 0.2), (1, 0.9)], "cluster long, energy double")
    assert {r.memory_id: r.cluster for r in liquid.merged(v, c, e).collect()} == {f"m{i}": 1 for i in range(6)} | {"z": 5}


def test_knn_ties_and_missing(spark):
    m = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", None), ("d", [0.0, 1.0])], "memory_id string, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query array<float>")
    assert [r.memory_id for r in vector.knn(m, q, 10).orderBy("rank").collect()] == ["a", "b", "d"]


def test_optional_scores(spark):
    m = spark.createDataFrame([("a", [1.0, 0.0], [0.5, 0.5], 3)], "memory_id string, embedding array<float>, query array<float>, accesses int")
    assert 0 < legacy.attention(m, 2).first().attention < 1
    v = legacy.adaptive(m, 2).first().embedding
    assert abs(sum(x * x for x in v) - 1) < 1e-5
    rows = m.selectExpr("memory_id", "0.5D as semantic", "1D as actor", "0D as temporal", "accesses")
    assert abs(legacy.additive(rows, F.lit(True)).first().score - 0.90225) < 1e-9


def test_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text('raw_text,who_type,who_id\n"hi, ""you""\nthere",llm,gpt\nplain,,\n')
    got = readers.dispatched(readers.any_records(spark, str(tmp_path / "a.csv"))).collect()
    assert [(r.content, r.event_type, r.actor, r.is_memory) for r in got] == [('hi, "you"\nthere', "llm_message", "llm:gpt", False), ("plain", "user_message", "user:unknown", False)]
    (tmp_path / "b.json").write_text(json.dumps({"memories": [{"memory_id": "m1", "who_type": "user", "raw_text": "x"}], "count": 1}))
    assert [(r.content, r.is_memory) for r in readers.dispatched(readers.any_records(spark, str(tmp_path / "b.json"))).collect()] == [("x", True)]
    (tmp_path / "c.json").write_text(json.dumps([{"text": "one"}, {"content": "two"}]))
    assert sorted(r.content for r in readers.dispatched(readers.any_records(spark, str(tmp_path / "c.json"))).collect()) == ["one", "two"]
    (tmp_path / "d.txt").write_text("just text")
    assert readers.any_records(spark, str(tmp_path / "d.txt")).first().raw_text == "just text"


def test_documents(spark, tmp_path):
    files = {"a.html": "<title>T</title><script>x</script><p>Hello  world</p>", "b.md": "---\nauthor: me\n---\n# H\nbody", "c.json": '{"k": 1}', "bad.json": "{", "d.ini": "[s]\nk=1", "e.unknown": "q", "big.txt": "x" * 200, "f.csv": "a,b\n1,2", "g.xml": "<r><a>t</a></r>", "h.log": "ERROR x\ninfo y"}
    (tmp_path / "sub").mkdir()
    for n, t in files.items():
        (tmp_path / ("sub" if n[0] > "d" else ".") / n).write_text(t)
    got = {r.path.rsplit("/", 1)[1]: r for r in readers.document_files(spark, str(tmp_path), None, most_bytes=100).collect()}
    assert set(got) == set(files)
    assert got["a.html"].text == "THello\nworld" and got["a.html"].metadata["title"] == "T"
    assert got["b.md"].text == "# H\nbody" and got["b.md"].metadata == {"author": "me"}
    assert got["bad.json"].error and got["bad.json"].text is None and got["big.txt"].error and got["e.unknown"].text == "q"
    assert got["h.log"].metadata["ERROR"] == "1" and got["g.xml"].metadata["root"] == "r" and got["f.csv"].metadata["columns"] == "a,b"
    assert "unknown" not in {r.suffix for r in readers.document_files(spark, str(tmp_path)).collect()}


def test_conversations(spark):
    rows = spark.createDataFrame([("c1", "[{'role': 'user', 'content': 'hi'}\n {'role': 'system', 'content': 's'}\n {'role': 'assistant', 'content': 'yo'}]"), ("c2", '[{"role": "user", "content": ""}]')], "conversation_id string, conversation string")
    got = conversations.memories(conversations.exploded(rows)).collect()
    assert [(r.who_type, r.raw_text, r.why) for r in got] == [("user", "hi", "conversation exchange"), ("llm", "yo", "conversation exchange")]


EVENTS = [{"event_id": f"e{i}", "session_id": f"s{i % 2}", "event_type": t, "timestamp": f"2024-01-0{1 + i % 3}T10:00:00", "actor": "user:a", "content": c, "metadata": m} for i, (t, c, m) in enumerate([("user_message", "Do you remember Rome trip", {}), ("llm_message", "An answer", {"intent": "help"}), ("tool_call", "look at API2 now", {"tool_name": "web"}), ("user_message", "x" * 300, {})])]


def _events(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, EVENTS[:3])))
    (tmp_path / "in" / "2.json").write_text("\n".join(map(json.dumps, [EVENTS[0], EVENTS[3]])))
    return str(tmp_path / "in")


def test_extraction(spark, tmp_path):
    got = {r.source_event_id: r for r in extract.extracted(spark.read.schema(extract.EVENT).json(_events(spark, tmp_path)).dropDuplicates(["event_id"])).collect()}
    assert set(got) == {"e0", "e1_part0", "e2", "e3_part0"}
    assert got["e0"].why == "memory_recall: Rome trip" and got["e2"].where_value == "web" and got["e2"].who_type == "tool" and got["e1_part0"].why == "help"
    assert len(got["e3_part0"].what) == 160


def test_stream_equals_batch(spark, tmp_path):
    path = _events(spark, tmp_path)
    out = str(tmp_path / "out")
    q = ingest.into(ingest.memories(ingest.events(spark, path)), out, str(tmp_path / "cp"), vector.HashingEmbedder(8))
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    want = extract.extracted(spark.read.schema(extract.EVENT).json(path).dropDuplicates(["event_id"]))
    cols = want.columns
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.collect()))
    assert {len(r.embedding) for r in got.collect()} == {8}


def test_stream_timeline_and_state(spark, tmp_path):
    path = _events(spark, tmp_path)
    for name, df, mode in (("tl", ingest.timeline(ingest.events(spark, path)), "complete"), ("st", ingest.latest(ingest.events(spark, path)), "update")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sum(r.n for r in spark.table("tl").collect()) == 5
    assert max(r.n for r in spark.table("st").collect()) >= 2


def test_store_round_trip(spark, tmp_path):
    events = spark.read.schema(extract.EVENT).json(_events(spark, tmp_path)).dropDuplicates(["event_id"])
    s = MemoryStore(spark, str(tmp_path / "db"))
    s.ingest(events)
    s.ingest(events)
    assert s.memories().count() == 4 and s.table.numbers() == [0, 1]
    found = s.search("Rome trip", 3, "2024-01-05T00:00:00", budget=True).collect()
    assert found and found[0].rank == 1 and s.context("Rome trip")
    assert s.tools.run("search_memories", text="API2", k=2).count() == 2 and s.tools.about()[0]["name"] == "search_memories"
    assert s.needs_fresh("weather now", "2030-01-01T00:00:00") and not s.needs_fresh("define x", "2024-01-05T00:00:00")
    s.delete(session="s0")
    assert {r.session_id for r in s.memories().collect()} == {"s1"}
    s.export(str(tmp_path / "exp"), "json", "t")
    assert sinks.import_json(spark, str(tmp_path / "exp"), s.memories().drop("embedding").schema).count() == 2
    s.ingest_records(spark.createDataFrame([("new text",)], "text string"), "imp", "2024-02-01")
    assert s.memories().where("session_id = 'imp'").count() == 1 and s.stats().first().memories == 3


def test_blocks_and_repairs(spark, tmp_path):
    _, df = _rows(spark)
    b = blocks.chain(df, 300)
    sinks.save_blocks(b, str(tmp_path / "b"))
    got = {(r.query_id, r.block): r.member_ids for r in sinks.load_blocks(spark, str(tmp_path / "b")).collect()}
    assert got == {(r.query_id, r.block): r.member_ids for r in blocks.members(b).collect()}
    m = spark.createDataFrame([("a", "w", None, "h", "r", [0.0, 0.0]), ("b", "w", "y", "h", "r", None), ("c", "w", "y", "h", "r", [1.0, 0.0])], "memory_id string, what string, why string, how string, raw_text string, embedding array<float>")
    fixed = sinks.repaired(m, vector.HashingEmbedder(2))
    assert vector.audit(fixed).where("status = 'valid'").count() == 3 and sinks.repaired(m, None, True).count() == 1


def test_config():
    c = Config()
    c.set("topk_semantic", "80", why="more")
    assert c.get("topk_semantic") == 80 and c.history()[0]["old"] == 60
    for name, bad in (("topk_semantic", 0), ("grouping", "x"), ("cluster_flow_rate", 2)):
        with pytest.raises(ValueError):
            c.set(name, bad)
    c.reset()
    assert c.get("topk_semantic") == 60 and abs(sum(c.weights().values()) - 1) < 1e-9
    s = Settings({"a": {"b": 1, "c": 2}})
    s.set("a.b", 5)
    s.merge({"a": {"d": 3}})
    assert s.get("a.b") == 5 and s.get("a.x.y", 9) == 9
    t = Settings({"a": {"b": 1}})
    t.loads(s.dumps())
    assert t.data == s.data
    s.reset("a")
    assert s.data == {"a": {"b": 1, "c": 2}}


def test_import_jobs():
    from tessera.sources.jobs import Jobs

    jobs = Jobs()
    a = jobs.create("a.csv", 30)

    def bad():
        raise ValueError("broken")

    jobs.run(a, [lambda: (10, 0), bad, lambda: (15, 5)])
    assert a.status() == {"number": 1, "state": "completed", "total": 30, "processed": 25, "failed": 5, "percent": 83.3, "errors": ["ValueError: broken"]}
    b = jobs.run(jobs.create("b"), [bad] * 12)
    assert b.state == "failed" and len(b.status()["errors"]) == 10
    c = jobs.create("c", 2)
    jobs.run(c, [lambda: (1, 0), lambda: (jobs.cancel(3), 0), lambda: (1, 0)])
    assert c.state == "cancelled" and not jobs.cancel(3) and not jobs.cancel(99)
    assert [j["number"] for j in jobs.latest(2)] == [3, 2]
    assert jobs.clean(24, now=b.ended + 25 * 3600) == 3 and not jobs.known


def test_stored_synapses(spark):
    s = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.2)], "m1 string, m2 string, weight double")
    more = spark.createDataFrame([("b", "a", 0.5), ("d", "c", 1.5)], "m1 string, m2 string, weight double")
    got = {(r.m1, r.m2): r.weight for r in graph.stored(s, more).collect()}
    assert got == {("a", "b"): 1.0, ("a", "c"): 0.2, ("c", "d"): 1.5}


def test_date_windows(spark):
    said = ["yesterday", "last week", "past month", "last year", "3 days ago", "2 weeks ago", "on 2023-05-06", "nothing"]
    got = one(spark, said, lambda c: temporal.window(temporal.hint(c, AS_OF), AS_OF))
    want = [("2024-01-30", "2024-01-30", 200), ("2024-01-24", "2024-01-31", 300), ("2024-01-01", "2024-01-31", 500), ("2023-01-31", "2024-01-31", 1000), ("2024-01-28", "2024-01-28", 500), ("2024-01-17", "2024-01-24", 500), ("2023-05-06", "2023-05-06", 500), (None, None, 500)]
    assert [(g["first"] and str(g["first"]), g["last"] and str(g["last"]), g["cap"]) for g in got] == want


def test_search_takes_relative_dates_and_settings(spark, tmp_path):
    rows = [{"event_id": f"e{i}", "session_id": "s", "event_type": "user_message", "timestamp": f"2024-01-{1 + i:02d}T10:00:00", "actor": "user:a", "content": "we spoke of Rome", "metadata": {}} for i in range(30)]
    (tmp_path / "e.json").write_text("\n".join(map(json.dumps, rows)))
    s = MemoryStore(spark, str(tmp_path / "db"))
    s.ingest(spark.read.schema(extract.EVENT).json(str(tmp_path / "e.json")))
    day = lambda r: int(r.when_ts[8:10])
    found = s.search("what did we say about Rome last week", 30, "2024-01-30T12:00:00").collect()
    assert [r.rank for r in found] == list(range(1, 31)) and {day(r) for r in found[:8]} == set(range(23, 31))  # the eight days of the hint come first
    found = s.search("what did we say 2 weeks ago about Rome", 30, "2024-01-30T12:00:00").collect()
    assert {day(r) for r in found[:8]} == set(range(16, 24))
    s.config.set("topk_semantic", 3)
    s.config.set("grouping", "literal")
    assert s.search("Rome", as_of="2024-01-30T12:00:00").count() == 3
    s.config.set("weight_semantic", 0.0)
    s.config.set("weight_temporal", 1.0)
    assert all(r.score > 0 for r in s.search("Rome 5 days ago", as_of="2024-01-30T12:00:00").collect()[:1])
    s.config.set("context_window", 2048)
    assert s.search("Rome", 30, "2024-01-30T12:00:00", budget=True, overhead=100000).count() < 30


def test_candidates_take_500_of_an_actor_and_a_day(spark):
    m = spark.range(1300).selectExpr("format_string('m%05d', id) as memory_id", "if(id < 600, 'a', 'b') as who_id", "if(id >= 600, '2024-01-05', '2024-01-04') as when_ts", "array(1.0F, id / 1300.0F) as embedding")
    q = spark.createDataFrame([(1, [1.0, 0.0], "a", "2024-01-05", 500), (2, [1.0, 0.0], None, None, 500)], "query_id int, query array<float>, actor string, day string, cap int").selectExpr("*", "to_date(day) as first", "to_date(day) as last")
    got = retrieval.candidates(m, q, 10).collect()
    assert sum(r.actor for r in got if r.query_id == 1) == 500 and sum(r.temporal for r in got if r.query_id == 1) == 500
    assert sum(r.query_id == 2 for r in got) == 10


def test_calls_are_taken_out_and_broken_ones_stay(spark):
    t = ["a <tool_call>{'name': 'x', 'arguments': {}}</tool_call> b", 'say\n\n\n```json\n{"tool": "t", "arguments": {"q": 1}}\n```\n\n\nend ', "<tool_call>bad</tool_call> c", '```json\n{"a": 1}\n```', None, " plain "]
    assert one(spark, t, X.without_tool_calls) == ["a  b", "say\n\nend", "<tool_call>bad</tool_call> c", '```json\n{"a": 1}\n```', None, "plain"]


def test_bulk_conversations_as_literals(spark):
    texts = {
        "json": '[{"role": "user", "content": "it\'s \\u00e9"}]',
        "python": "[{'role': 'user', 'content': None}, {'role': 'assistant', 'content': \"it's 'so'\\n\", 'redacted': True}]",
        "torn": "[{'role': 'user', 'content': 'a'}\r\n {'role': 'assistant', 'content': 'b'}\n{'role': 'user', 'content': 'c'}]",
        "bad": "[{'role': 'user', 'content': ",
        "other": "{'role': 'user'}",
        "null": None,
    }
    rows = spark.createDataFrame(list(texts.items()), "conversation_id string, conversation string")
    got = {}
    for r in conversations.exploded(rows).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {"json": [("user", "it's é")], "python": [("user", None), ("assistant", "it's 'so'\n")], "torn": [("user", "a"), ("assistant", "b"), ("user", "c")]}


def test_files_of_mixed_kinds_and_large_json(spark, tmp_path):
    many = [{"text": f"record {i} " + "x" * 100, "more": {"a": i}} for i in range(15000)]  # over 1 MiB
    (tmp_path / "a.json").write_text(json.dumps(many))
    (tmp_path / "b.csv").write_text("raw_text,who_type\nhello,llm\n")
    (tmp_path / "c.txt").write_text("just text")
    (tmp_path / "d.json").write_text(json.dumps({"other": "field", "n": 1}))
    rows = readers.any_records(spark, str(tmp_path))
    assert rows.count() == 15003
    said = {r.content for r in readers.dispatched(rows).collect()}
    assert {"hello", "just text"} <= said and any('"other":"field"' in x for x in said)
    assert rows.where("text like 'record 7 %'").first().extra == {"more": '{"a":7}'}


def test_several_parts_of_an_event(spark, tmp_path):
    events = spark.read.schema(extract.EVENT).json(_events(spark, tmp_path)).dropDuplicates(["event_id"])

    def three(batch):
        assert len(batch) <= 2
        if any(e["event_id"] == "e2" for e in batch):
            raise ValueError("broken")
        return [[] if e["event_id"] == "e0" else [{"what": "one", "who": {"type": "llm", "id": "llm:x"}}, {"what": " "}, {"what": "three", "why": "w", "where": {"value": "v"}}] for e in batch]

    got = {r.source_event_id: r for r in extract.parts_by(events.repartition(1).sortWithinPartitions("event_id"), three, 2).collect()}
    assert {"e0_part0", "e2_part0"} <= set(got) and len({r.memory_id for r in got.values()}) == len(got)
    several = [x for x in got if x.endswith("_part2")]
    assert several or len(got) == 4
    lone = events.where("event_id = 'e1'")
    e1 = sorted(extract.parts_by(lone, three, 2).collect(), key=lambda r: r.part_index)
    assert [(r.what, r.raw_text, r.total_parts, r.who_id) for r in e1] == [("one", "An answer", 3, "llm:x"), ("Part 2 of An answer", "[Part 2] Part 2 of An answer", 3, "user:a"), ("three", "[Part 3] three", 3, "user:a")]
    assert e1[2].where_value == "v" and e1[0].why == "unspecified" and e1[0].embed_text == "WHAT: one\nWHY: unspecified\nHOW: message"


def test_settings_are_stored(spark, tmp_path):
    from tessera.plans import config as C

    assert sum(not n.startswith("weight_") and n not in ("topk_semantic", "half_life_hours", "grouping") for n in C.SETTINGS) == 52
    c = Config()
    c.set("use_attention", "off", "me", "test")
    c.set("w_actor", 0.2)
    c.set("w_actor", 0.3)
    for name, bad in (("db_path", "x"), ("embed_model", "other"), ("api_port", 80), ("cache_ttl", "soon")):
        with pytest.raises(ValueError):
            c.set(name, bad)
    a, b = sinks.Versions(spark, str(tmp_path / "o")), sinks.Versions(spark, str(tmp_path / "h"))
    c.save(a, b)
    d = Config.load(a, b)
    assert d.values == c.values == {"use_attention": False, "w_actor": 0.3} and d.history() == c.history()
    rows = C.history(b.read(), "w_actor", 1).collect()
    assert [(r.old_value, r.new_value, r.id) for r in rows] == [("0.2", "0.3", 3)]
    e = Config()
    assert e.loads(c.dumps()) == {"use_attention": None, "w_actor": None} and e.values == c.values
    e.reset("w_actor")
    assert e.get("w_actor") == 0.07 and e.history()[0]["why"] == "reset"
    assert Config.load(sinks.Versions(spark, str(tmp_path / "n")), sinks.Versions(spark, str(tmp_path / "n"))).values == {}


def test_versions_of_two_writers_and_an_index(spark, tmp_path):
    v = sinks.Versions(spark, str(tmp_path / "v"))
    assert v.write(spark.range(3)) == 0
    with pytest.raises(FileExistsError):
        v.write(spark.range(5), 0)
    assert v.read().count() == 3 and [v.write(spark.range(n)) for n in (4, 5)] == [1, 2]
    assert v.clean(1) == [0, 1] and v.numbers() == [2]
    x = sinks.VectorIndex(spark, str(tmp_path / "x"))
    x.add(spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.0]), ("c", [0.0, 1.0])], "memory_id string, embedding array<float>"))
    x.remove(spark.createDataFrame([("a",), ("z",)], "memory_id string"))
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query array<float>")
    assert [r.memory_id for r in x.search(q, 2).orderBy("rank").collect()] == ["b", "c"]
    x.rebuild()
    assert x.table.read().count() == 2
    x.reset()
    assert x.rows().count() == 0
    s = spark.createDataFrame([("a", "b", 0.5)], "m1 string, m2 string, weight double")
    i = graph.importance(spark.createDataFrame([("a",), ("b",), ("c",)], "memory_id string"), s)
    state = sinks.Versions(spark, str(tmp_path / "s"))
    sinks.save_state(s, i, state)
    s2, i2 = sinks.load_state(state)
    assert s2.collect() == s.collect() and sorted(i2.collect()) == sorted(i.collect())


def test_changes_are_written_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "MOST_CHANGES", 3)
    v, now, held, rng = sinks.Versions(spark, str(tmp_path / "v")), {}, {}, random.Random(5)
    kind = "memory_id string, x int, created_at string"
    for step in range(7):
        if step % 3 == 2:
            gone = [f"m{i}" for i in rng.sample(range(14), 5)]
            n = v.remove(spark.createDataFrame([(x,) for x in [*gone, gone[0], None, "none"]], "memory_id string"))
            now = {k: x for k, x in now.items() if k not in gone}
        else:
            ids = [f"m{i}" for i in rng.sample(range(12), 8)]
            rows = [(k, 10 * step + t, f"2024-01-0{t}") for k in ids for t in (1, 2)]  # the later one of a key stays
            n = v.change(spark.createDataFrame(rows, kind), "created_at")
            now = now | {k: 10 * step + 2 for k in ids}
        held[n] = dict(now)
    for n, want in held.items():
        got = v.read(n).collect()
        assert {r.memory_id: r.x for r in got} == want and len(got) == len(want)
    whole = [n for n in held if not v.entry(n)["change"]]
    assert whole == [0, 4] and spark.read.parquet(f"{v.path}/{v.entry(1)['folder']}").count() == 8
    with pytest.raises(FileExistsError):  # a writer that has seen less
        v._changed(spark.createDataFrame([("a", 1, "", False)], kind + ", _gone boolean"), v.numbers()[:-1])
    with pytest.raises(ValueError):
        v.change(spark.createDataFrame([("a",)], "memory_id string"))
    with pytest.raises(Exception, match="a row without memory_id"):
        v.change(spark.createDataFrame([(None, 1, "")], kind))
    assert v.numbers() == list(range(7)) and v.clean(1) == [0, 1, 2, 3]
    assert {r.memory_id: r.x for r in v.read().collect()} == now


def test_repeated_batches_count_once(spark, tmp_path):
    acts = [("x", "a"), ("x", "b"), ("y", "a"), ("y", "b")]
    (tmp_path / "in").mkdir()
    for i, part in enumerate((acts[:2], acts[2:])):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"activation_id": k, "memory_id": m}) for k, m in part))
    v, held = sinks.Versions(spark, str(tmp_path / "v"), ["m1", "m2"]), []
    for run in range(2):  # the second run knows nothing of the first's progress, as after a lost checkpoint
        stream = spark.readStream.schema("activation_id string, memory_id string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        ingest.synapses(stream, v).option("checkpointLocation", str(tmp_path / f"cp{run}")).trigger(availableNow=True).start().awaitTermination(120)
        held.append([(r.m1, r.m2, round(r.weight, 6)) for r in v.read().collect()])
    assert held == [[("a", "b", 0.02)]] * 2 and v.numbers() == [0, 1]


def test_drift_goes_on_from_what_was(spark):
    rows = [("m", i, [float(i), 1.0]) for i in range(5)] + [("n", 0, [2.0, 2.0])]
    make = lambda x: spark.createDataFrame(x, "memory_id string, at long, context array<float>")
    whole = sorted(graph.drift(make(rows)).collect())
    steps = sorted(graph.drift(make(rows[3:]), before=graph.drift(make(rows[:3]))).collect())
    assert [(r.memory_id, [round(x, 9) for x in r.drift]) for r in whole] == [(r.memory_id, [round(x, 9) for x in r.drift]) for r in steps]


def test_knn_of_many_equal_rows(spark):
    rng = random.Random(5)
    rows = [(f"m{i:05d}", [1.0, 0.0] if i % 3 else [rng.random(), rng.random()]) for i in range(9000)]
    m = spark.createDataFrame(rows, "memory_id string, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(3)] + [(9, None)], "query_id int, query array<float>")
    import numpy as np

    f = lambda v: np.array(v, np.float32).astype(float)
    for k in (7, 5000):
        got = {}
        for r in vector.knn(m, q, k).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.memory_id)
        assert got == {i: [x for _, x in sorted((-float(f(v) @ f([1.0, float(i)])), x) for x, v in rows)[:k]] for i in range(3)}


def test_of_many_writers_of_a_version_one_wins(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    v = sinks.Versions(spark, str(tmp_path / "v"))

    def claim(n, who):
        try:
            v._claim(n, {"folder": f"data-{who}", "change": False})
            return who
        except FileExistsError:
            return None

    with ThreadPoolExecutor(8) as pool:
        for n in range(12):
            won = [w for w in pool.map(lambda who, n=n: claim(n, who), range(8)) if w is not None]
            assert len(won) == 1 and v.entry(n)["folder"] == f"data-{won[0]}"
    assert not list((tmp_path / "v").glob("_made*"))

    t = sinks.Versions(spark, str(tmp_path / "t"), tries=20)
    t.write(spark.createDataFrame([("m", -1)], "memory_id string, x int"))
    rows = [spark.createDataFrame([(f"m{i}", i)], "memory_id string, x int") for i in range(6)]
    with ThreadPoolExecutor(6) as pool:  # each begins again on what another one wrote; none is lost
        assert sorted(pool.map(t.change, rows)) == [1, 2, 3, 4, 5, 6]
    assert sorted((r.memory_id, r.x) for r in t.read().collect()) == [("m", -1)] + [(f"m{i}", i) for i in range(6)]
    (tmp_path / "t" / "data-lost").mkdir()
    assert t.sweep(1) == [] and t.sweep(-1) == ["data-lost"] and t.read().count() == 7
