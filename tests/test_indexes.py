"""Trigrams against scans, sketches against exact counts, and embedders that fail."""

import random

from pyspark.sql import functions as F

from tessera.operators import analytics, trigrams, vector
from tessera.sources import fixtures as fx, sinks


def test_trigram_search_equals_a_scan(spark, sf_dir, tmp_path):
    rng = random.Random(1)
    rows = fx.memories(spark, sf_dir).select("memory_id", "raw_text", "what", "why", "how").orderBy("memory_id").limit(60)
    rows = rows.unionByName(spark.createDataFrame([("odd1", "İstanbul STRASSE straße", None, "", "50%_done"), ("odd2", None, "x", None, None)], rows.schema)).persist()
    t = trigrams.TrigramTable(spark, str(tmp_path / "t"))
    t.build(rows)
    texts = [r.raw_text for r in rows.collect() if r.raw_text]
    patterns = ["a", "th", "%", "_", "x", "stras", "STRASSE", "straße", "İst", "intent", "no such text", "50\\%", "click%src1", "e_t", ""]
    for _ in range(14):
        s = rng.choice(texts)
        at = rng.randrange(max(1, len(s) - 12))
        patterns.append(s[at : at + rng.randrange(1, 9)].replace("\\", "") or "q")
    for p in patterns:
        want = {r.memory_id for r in rows.where(trigrams.contains(p)).collect()}
        assert {r.memory_id for r in t.search(rows, p).collect()} == want, p
    assert t.candidates("th") is None and t.candidates("zzzqqq").count() == 0
    new = spark.createDataFrame([("odd2", "brand new zebra", None, None, None)], rows.schema)
    t.add(new)
    now = rows.where("memory_id <> 'odd2'").unionByName(new)
    assert [r.memory_id for r in t.search(now, "w zeb").collect()] == ["odd2"]
    assert "PushedFilters: [In(gram" in t.table.read(where=F.col("gram").isin(["abc", "bcd"]))._jdf.queryExecution().toString()


def test_sketches_merge_within_their_error(spark):
    rows = spark.range(60_000).select(F.concat(F.lit("s"), F.pmod(F.xxhash64("id"), F.lit(20_000))).alias("session_id"), F.concat(F.lit("u"), F.col("id") % 50).alias("who_id"), F.lit(None).cast("string").alias("who_list"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 60).cast("int")), "yyyy-MM-dd").alias("when_ts"))
    days = analytics.daily_sketches(rows)
    for unit in ("week", "month"):
        exact = {r.period: r for r in rows.groupBy(F.trunc(F.to_date("when_ts"), unit).alias("period")).agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("s"), F.countDistinct("who_id").alias("w")).collect()}
        got = analytics.sketched(days, unit).collect()
        assert {r.period for r in got} == set(exact)
        for r in got:
            assert r.n == exact[r.period].n and r.who_id == exact[r.period].w
            assert abs(r.session_id / exact[r.period].s - 1) < 4 * 0.83 / 2 ** (analytics.LG_K / 2)  # four standard errors


class Flaky:
    """Fails for some texts, always or the first times; a process of its own counts its calls."""

    def __init__(self, dim=None):
        self.calls = 0
        if dim:
            self.dim = dim

    def encode(self, texts):
        self.calls += 1
        if "short" in texts:
            return [[1.0, 2.0]] * (len(texts) - 1)
        if "bad" in texts or ("late" in texts and self.calls % 3):
            raise ConnectionError("no service")
        return [[float(len(t)), 1.0] for t in texts]


def test_embedders_that_fail(spark):
    rows = spark.createDataFrame([(f"m{i}", t) for i, t in enumerate(["good", "bad", "late", "short", "fine"])], "memory_id string, embed_text string").coalesce(1)
    lost = spark.sparkContext.accumulator(0)
    got = vector.embedded_by(rows, Flaky(2), tries=3, pause=0.01, batch=1, failures=lost).persist()
    assert {r.memory_id: list(r.embedding) for r in got.collect()} == {"m0": [4.0, 1.0], "m1": [0.0, 0.0], "m2": [4.0, 1.0], "m3": [0.0, 0.0], "m4": [4.0, 1.0]}
    assert lost.value == 2
    assert {r.memory_id: r.status for r in vector.audit(got).collect() if r.status != "valid"} == {"m1": "zero", "m3": "zero"}
    mem = got.select("memory_id", F.col("embed_text").alias("what"), F.lit("w").alias("why"), F.lit("h").alias("how"), F.lit(None).cast("string").alias("raw_text"), "embedding")
    assert {r.status for r in vector.audit(sinks.repaired(mem, vector.HashingEmbedder(2))).collect()} == {"valid"}
    bare = vector.embedded_by(rows.where("memory_id = 'm1'"), Flaky(), tries=2, pause=0.01).collect()
    assert bare[0].embedding is None  # nothing says how long a vector is
