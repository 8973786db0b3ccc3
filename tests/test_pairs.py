"""Pairs of memories against plain models: what is shuffled, and what is not."""

import datetime as dt
import itertools
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from tessera.operators import graph, pairing


def _lists(rng):
    own = {f"l{k}": {f"m{rng.randrange(40):02d}" for _ in range(12)} for k in range(5)}
    for i in range(40, 60):  # items of one list
        own[f"l{i % 5}"].add(f"m{i}")
    return own


def test_pairs_of_items_of_one_list_and_of_many(spark, monkeypatch):
    monkeypatch.setattr(graph, "PAIRS", 50)
    own = _lists(random.Random(3))
    rows = spark.createDataFrame([(k, m) for k, ms in own.items() for m in ms], "act string, memory_id string")
    want = Counter(p for ms in own.values() for p in itertools.combinations(sorted(ms), 2))
    some = {"m01", "m07", "m45", "m46", "none"}
    asked = spark.createDataFrame([(m,) for m in some], "memory_id string")
    for block in (4, 500):
        assert {(r.m1, r.m2): r.n for r in graph.all_pairs(rows, "act", block=block).collect()} == want
        got = graph.all_pairs(rows, "act", block=block, asked=asked).collect()
        assert len(got) == len({(r.m1, r.m2) for r in got})
        assert {(r.m1, r.m2): r.n for r in got} == {p: n for p, n in want.items() if some & set(p)}
    assert graph.many_pairs(rows, "act") == sum(want.values())


def test_pairs_of_items_of_one_list_are_not_shuffled(spark):
    rows = spark.range(300).selectExpr("concat('a', id % 7) as act", "lpad(id, 4, '0') as memory_id")
    plan = graph.all_pairs(rows, "act")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(m1" not in plan and "one#" in plan


def test_synapses_are_shuffled_in_parts_of_a_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(graph, "PAIRS", 100)
    rows = spark.range(200).selectExpr("concat('a', id % 4) as act", "lpad(id, 4, '0') as memory_id")
    none = spark.createDataFrame([], "m1 string, m2 string, weight double")
    got = graph.hebbian(none, rows, "act")
    assert got.rdd.getNumPartitions() == -(-4 * 50 * 49 // 2 // 100) and got.count() == 4 * 50 * 49 // 2
    assert graph.stored(none, got, known=1000).rdd.getNumPartitions() == 10


def test_affinity_equals_a_plain_model(spark, monkeypatch):
    monkeypatch.setattr(graph, "PAIRS_AT_ONCE", 64)
    monkeypatch.setattr("tessera.operators.pairing.paired.__defaults__", (None, None, 11, 4))
    monkeypatch.setattr(graph, "ASKED_BLOCK", 5)
    rng = random.Random(8)
    v = {f"m{i:02d}": None if i % 9 == 4 else [0.0, 0.0] if i % 9 == 5 else [1.0] if i % 9 == 6 else [rng.gauss(0, 1), rng.gauss(0, 1)] for i in range(40)}
    t = {m: dt.datetime(2024, 1, 1, microsecond=7) + dt.timedelta(minutes=rng.randrange(9000)) for m in v if rng.random() < 0.8}
    co = {(a, b): rng.randrange(1, 14) for a in v for b in v if a < b and rng.random() < 0.2}
    some = [m for m in v if m < "m13"]

    def cosine(a, b):
        size = math.hypot(*a) * math.hypot(*b)
        return sum(x * y for x, y in zip(a, b)) / size if size and len(a) == len(b) else 0.0

    want = {}
    for a in some:
        for b in v:
            if a != b:
                time = math.exp(-abs((t[a] - t[b]).total_seconds()) / 86400) if a in t and b in t else 0.5
                want[a, b] = 0.4 * min(1, co.get((min(a, b), max(a, b)), 0) / 10) + 0.3 * time + 0.3 * ((cosine(v[a], v[b]) + 1) / 2 if v[a] and v[b] else 0.5)
    make = spark.createDataFrame
    got = graph.affinity(make(list(v.items()), "memory_id string, embedding array<double>"), make([(*p, n) for p, n in co.items()], "m1 string, m2 string, n long"), make(list(t.items()), "memory_id string, last_access timestamp"), make([(m,) for m in some] * 2, "memory_id string"))
    plan = got._jdf.queryExecution().toString()
    assert "CoGroups" not in plan and "FlatMapGroupsInArrow" in plan
    rows = got.collect()
    assert len(rows) == len(want) and all(abs(r.affinity - want[r.m1, r.m2]) < 1e-12 for r in rows)


def _numbered(spark, n, asked):
    """What affinity() takes, of n memories of which the first ones are asked for, with vectors and times by formulas."""
    rng = random.Random(5)
    rows = [(f"mem_{i:012d}", [rng.gauss(0, 1) for _ in range(64)], dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(43200))) for i in range(n)]
    all_rows = spark.createDataFrame(rows, "memory_id string, embedding array<double>, last_access timestamp")
    co = spark.createDataFrame([(rows[i][0], rows[i + 1][0], 1 + i % 12) for i in range(0, n - 1, 3)], "m1 string, m2 string, n long")
    return all_rows.select("memory_id", "embedding"), co, all_rows.select("memory_id", "last_access"), spark.createDataFrame([(r[0],) for r in rows[:asked]], "memory_id string")


def test_pairs_that_are_written_take_little_room(spark, tmp_path):
    got = graph.affinity(*_numbered(spark, 2000, 500)).withColumn("affinity", F.round("affinity", 6))
    got.write.parquet(str(tmp_path / "pairs"))
    n = 500 * 1999
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == n
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 5 * n


def test_pairs_are_the_same_however_blocks_and_pieces_are_cut(spark, monkeypatch):
    args = _numbered(spark, 300, 70)
    whole = graph.affinity(*args)
    want = {(r.m1, r.m2): r.affinity for r in whole.collect()}
    assert len(want) == 70 * 299 and whole.rdd.getNumPartitions() == pairing.SPREAD
    monkeypatch.setattr(graph, "PAIR_BLOCK", 40)
    monkeypatch.setattr(graph, "PAIRS_AT_ONCE", 100)
    monkeypatch.setattr(graph, "PAIRS_IN_ORDER", 500)
    parts = graph.affinity(*args)
    assert parts.rdd.getNumPartitions() == pairing.SPREAD * 8 * 2  # few of the blocks share a task
    rows = parts.collect()
    assert len(rows) == len(want) and all(abs(r.affinity - want[r.m1, r.m2]) < 1e-12 for r in rows)
