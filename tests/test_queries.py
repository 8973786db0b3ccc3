"""Every registered query on the smallest tables; those with SQL against DuckDB."""

import math

import duckdb
import pytest

from tessera.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _tables(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def con(sf_dir):
    return _tables(sf_dir)


def _same(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return None if math.isnan(v) else round(float(v), 5) + 0.0
    return str(v)


def _rows(rows, at):
    return sorted((tuple(_same(r[i]) for i in at) for r in rows), key=lambda t: [(x is None, str(type(x)), x if x is not None else 0) for x in t])


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, sf_dir, con):
    _compare(name, spark, sf_dir, con)


def _compare(name, spark, sf_dir, con):
    got = registry.queries()[name](spark, sf_dir)
    rows = got.collect()
    if name not in registry.oracles():
        return
    want = con.sql(registry.oracles()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert _rows(rows, [got.columns.index(c) for c in columns]) == _rows(want.fetchall(), [want.columns.index(c) for c in columns])


def test_merge_clusters_takes_all_memories(spark, sf_dir):
    rows = registry.queries()["merge_clusters"](spark, sf_dir).select("memory_id").collect()
    assert len(rows) == len(set(rows)) == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()


def test_tool_calls_reads_all_messages(spark, sf_dir):
    got = registry.queries()["tool_calls"](spark, sf_dir)
    want = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    keys = lambda rows: sorted((r.conv_id, r.turn) for r in rows.select("conv_id", "turn").collect())
    assert keys(got) == keys(want)


def test_entry_gives_cards(spark):
    assert registry.flagship(spark, "/root/testdata/sf0.001").count() > 0


#: Messages with what the rules for texts look for, which the tables' made-up prose lacks.
PHRASES = ("Do you remember the trip to Rome?", "what was said about IGF-1 yesterday", "Recall MEMORY of Acme Corp, and memories", "nothing here", "weather now in Oslo", "snow tonight", "will it rain", "stock of tea", "ethereum", "latest headlines", "news today", "headlines", "match", "commute", "concert", "how much", "cinema", "what is love", "how to bake", "when did it end", "a study", "plain", "it was 3 days ago at noon or so", "2 weeks ago we met somewhere", "1 month ago in the big house", "4 years ago on 2020-05-06 it was", "on 2023-12-24 we had dinner", "last month there was some talk", "past year was a good one for us", "yday", "recently", "I know that", 'say {"a": 1, "b": "x"} end', 'list [{"a": 2}] ok', 'Use <tool_call>{"name": "web_search"}</tool_call> now', "find out the price", 'two lines\n{"a":\n 3}')
CODE = "import os\nfrom a import b\ndef f():\n  def g():\nclass A:\nfunction z() {\nletter = 1\nstruct S {"


@pytest.fixture(scope="module")
def phrases(spark, sf_dir, tmp_path_factory):
    """The smallest tables with PHRASES for conversations, and code for documents."""
    import os

    at = tmp_path_factory.mktemp("phrases")
    for t in TABLES:
        if t not in ("conversations", "documents"):
            os.symlink(f"{sf_dir}/{t}.parquet", at / f"{t}.parquet")
    spark.createDataFrame([(0, i, "user", t) for i, t in enumerate(PHRASES)], "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{at}/conversations")
    spark.createDataFrame([(0, CODE, "en", "src0", len(CODE)), (1, "no code", "en", "src1", 7)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{at}/documents")
    for t in ("conversations", "documents"):
        part = next(x for x in os.listdir(at / t) if x.endswith(".parquet"))
        os.rename(at / t / part, at / f"{t}.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["recall_topic", "query_type", "freshness", "json_salvage", "temporal_rule", "temporal_clean", "code_outline"])
def test_query_of_texts_on_phrases(name, spark, phrases):
    con = _tables(phrases)
    _compare(name, spark, phrases, con)
    want = con.sql(registry.oracles()[name])
    rows = want.fetchall()
    assert len(rows) == (2 if name == "code_outline" else len(PHRASES)) and len({r[1:] for r in rows}) > 1


def test_entities_of_all_memories(spark, sf_dir):
    """network_what, entity_cooccur and entity_cloud against a plain model over the latest 1000 memories, plain texts among them."""
    from collections import Counter

    from pyspark.sql import functions as F

    from tessera.functions import text as X
    from tessera.sources import fixtures

    rows = fixtures.memories(spark, sf_dir).select("memory_id", "created_at", "what", X.entities(F.col("what")).alias("xs")).collect()
    rows = sorted(sorted(rows, key=lambda r: r.memory_id), key=lambda r: r.created_at, reverse=True)[:1000]
    assert any(not r.what.startswith("[") and r.xs for r in rows)
    count = Counter(x for r in rows for x in r.xs if x)
    top = sorted(count.items(), key=lambda x: (-x[1], x[0]))
    assert sorted(map(tuple, registry.queries()["network_what"](spark, sf_dir).collect())) == sorted(top[:50])
    most = top[0][1]
    assert sorted(map(tuple, registry.queries()["entity_cloud"](spark, sf_dir).collect())) == sorted((x, n, round(min(2.0, 0.8 + 1.2 * n / most), 6)) for x, n in top[:20])
    order = list(dict.fromkeys(x for r in rows for x in r.xs if x))
    place, weight = {x: i for i, x in enumerate(order)}, Counter()
    for r in rows:
        own = sorted({place[x] for x in r.xs if x})
        weight.update((a, b) for a in own if a < 50 for b in own if a < b <= a + 19)
    want = [(order[a], order[b], n) for (a, b), n in sorted(weight.items())[:100]]
    assert sorted(map(tuple, registry.queries()["entity_cooccur"](spark, sf_dir).collect())) == sorted(want)
