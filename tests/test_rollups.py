"""Roll-ups, chunks and postings whose pieces stay small."""

from pyspark.sql import functions as F

from tessera.functions import chunks
from tessera.operators import analytics, trigrams
from tessera.plans import registry


def test_values_of_days_merge_exactly(spark):
    rows = spark.range(60_000).select(F.concat(F.lit("s"), F.pmod(F.xxhash64("id"), F.lit(20_000))).alias("session_id"), F.when(F.col("id") % 9 > 0, F.col("id") % 50).alias("who_id"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 60).cast("int")), "yyyy-MM-dd").alias("when_ts"))
    for unit in ("week", "month"):
        want = rows.groupBy(F.trunc(F.to_date("when_ts"), unit).alias("period")).agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("session_id"), F.countDistinct("who_id").alias("who_id"))
        assert sorted(analytics.merged(analytics.daily_values(rows), unit).collect()) == sorted(want.collect())


def test_timeline_of_many_actors_is_exact(spark):
    from tessera.sources import fixtures

    sf = "/root/testdata/sf0.1"  # over 400 actors a week, which a sketch estimates
    m = fixtures.memories(spark, sf)
    want = m.groupBy(F.trunc(F.to_date(F.substring("when_ts", 1, 10)), "week").alias("period")).agg(F.count("*").alias("n"), F.countDistinct("session_id").alias("session_id"), F.countDistinct("who_id").alias("who_id"))
    assert sorted(registry.queries()["timeline_sketched"](spark, sf).collect()) == sorted(want.collect())


def test_chunks_leave_python_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(chunks, "AT_ONCE", 500)
    texts = [None, "", *["word " * (30 + i) for i in range(40)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    kind = chunks.Paragraphs(most=200, overlap=3, least=10)
    got = chunks.chunked(docs, kind)
    assert "MapInArrow" in got._jdf.queryExecution().toString() and "ArrowEvalPython" not in got._jdf.queryExecution().toString()
    want = [(i, k, c) for i, t in enumerate(texts) for k, c in enumerate(kind.chunk(t or ""))]
    assert [(r.doc_id, r.chunk_index, r.chunk) for r in got.orderBy("doc_id", "chunk_index").collect()] == want


def test_postings_are_in_parts_of_a_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trigrams, "LETTERS", 1000)
    rows = spark.range(400).select(F.concat(F.lit("m"), "id").alias("memory_id"), F.sha2(F.col("id").cast("string"), 256).alias("raw_text"), F.lit(None).cast("string").alias("what"), F.lit("y").alias("why"), F.lit("h").alias("how"))
    t = trigrams.TrigramTable(spark, str(tmp_path / "t"))
    t.build(rows)
    assert len(t.table.read().inputFiles()) >= 20
    assert {r.memory_id for r in t.search(rows, "abc").collect()} == {r.memory_id for r in rows.where(trigrams.contains("abc")).collect()}
