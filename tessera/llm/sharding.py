"""Two-pass external shuffle into shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import documents, texts, written

#: Buckets that one window of running sums covers; sums over these windows are a second, short level.
LEVEL = 4096

#: Partitions of the scatter, at most.
MOST_PARTITIONS = 4096


def scattered(docs: DataFrame, seed: int, n: int) -> DataFrame:
    """doc_id, text and bucket of each row of texts: a seeded hash of the row, so that the same rows go to the same buckets in whatever order they
    come. Rows of which over a 100,000th of all are the same, and 1000 at least, are counted and spread by a number of their own each."""
    key = F.xxhash64(F.lit(seed), "doc_id", "text")
    keyed = docs.withColumn("_key", key)
    total = docs.count()
    hot = written(keyed.groupBy("_key").count().where(F.col("count") > max(1000, total // 100_000)).select("_key"), "hot-rows")
    cold = keyed.join(F.broadcast(hot), "_key", "left_anti").select("doc_id", "text", F.pmod("_key", F.lit(n)).alias("bucket"))
    if hot.isEmpty():
        return cold
    each = keyed.join(F.broadcast(hot), "_key").groupBy("doc_id", "text").count()  # 100,000 hot rows at most, counted in part before the shuffle
    each = each.select("doc_id", "text", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("_copy"))
    spread = each.select("doc_id", "text", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text", "_copy"), F.lit(n)).alias("bucket"))
    return cold.unionByName(spread)


def starts(counts: DataFrame) -> DataFrame:
    """bucket and before, the rows in all buckets before it, from (bucket, count): running sums within LEVEL buckets, and over these."""
    level = F.expr(f"bucket div {LEVEL}").alias("level")
    own = counts.select("bucket", "count", level)
    up_to = Window.unboundedPreceding, -1
    high = own.groupBy("level").agg(F.sum("count").alias("all"))
    high = high.select("level", F.coalesce(F.sum("all").over(Window.orderBy("level").rowsBetween(*up_to)), F.lit(0)).alias("base"))  # a row for LEVEL buckets
    within = F.coalesce(F.sum("count").over(Window.partitionBy("level").orderBy("bucket").rowsBetween(*up_to)), F.lit(0))
    return own.withColumn("within", within).join(high, "level").select("bucket", (F.col("base") + F.col("within")).alias("before"))


def shuffled(docs: DataFrame, seed: int, bucket_bytes: int) -> tuple[DataFrame, int]:
    """Both passes: doc_id, text, bucket and row, its place in the whole shuffle, written in the shared folder in that order; and the number of rows.

    Pass 1 scatters rows into as many buckets as keep each near bucket_bytes, a partition for each up to MOST_PARTITIONS, beyond which buckets share
    partitions and are sorted apart there, on disk if need be: a task holds a bucket at a time, and the shuffle has a bounded number of partitions. What
    stands before a bucket goes to it as a row among its rows, so nothing is collected or broadcast. Pass 2 puts a bucket in an order
    of its own (id, text), so that the result doesn't depend on how rows came, then shuffles it by Fisher and Yates with a generator
    seeded by seed and bucket, and writes it.
    """
    docs = texts(docs)
    size, rows = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)), F.count("*")).first()
    n = max(1, -(-size // bucket_bytes))
    dealt = scattered(docs, seed, n)

    def one(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        before = table.column("before")
        base = next(x for x in before.to_pylist() if x is not None)
        table = table.filter(before.is_null()).sort_by([("doc_id", "ascending"), ("text", "ascending")])
        rng = np.random.Generator(np.random.PCG64([seed, bucket]))
        order = np.arange(table.num_rows)
        for i, j in zip(range(len(order) - 1, 0, -1), rng.integers(0, np.arange(len(order), 1, -1))):
            order[i], order[j] = order[j], order[i]
        table = table.take(pa.array(order))
        return table.select(["doc_id", "text", "bucket"]).append_column("row", pa.array(base + np.arange(len(order), dtype=np.int64)))

    def shuffle(batches):
        held, now = [], None
        for b in batches:  # a partition's buckets come one after the other
            bucket = b.column("bucket").to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(bucket)) + 1), len(bucket)]
            for i, j in zip(cut, cut[1:]):
                if j > i:
                    if held and bucket[i] != now:
                        yield from one(pa.Table.from_batches(held)).to_batches()
                        held = []
                    now = bucket[i]
                    held.append(b.slice(i, j - i))
        if held:
            yield from one(pa.Table.from_batches(held)).to_batches()

    head = starts(dealt.groupBy("bucket").count()).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"), "bucket", "before")
    both = dealt.withColumn("before", F.lit(None).cast("long")).unionByName(head)
    parts = min(n, MOST_PARTITIONS)
    dealt_out = both.repartitionById(parts, F.pmod("bucket", F.lit(parts)).cast("int"))
    placed = (dealt_out.sortWithinPartitions("bucket") if n > parts else dealt_out).mapInArrow(shuffle, "doc_id long, text string, bucket long, row long")
    return written(placed, "shuffled"), rows


def shard(docs: DataFrame, shards: int = 8, seed: int = 17, bucket_bytes: int = 16 << 20) -> DataFrame:
    """doc_id, text, bucket, shard and slot of each row of docs: row counts of shards differ by one at most (law `rows`).

    The shuffled order is bucket after bucket; row i of N goes to shard i * shards // N. Null texts are empty. Rows
    that repeat keep a slot each, and many equal ones spread over the buckets. A null doc_id stays null. An empty table gives no rows. Other
    columns are ignored. The driver holds two numbers, of bytes and of rows.
    """
    out, total = shuffled(docs, seed, bucket_bytes)
    out = out.withColumn("shard", F.expr(f"(row * {shards}L) div {max(1, total)}L").cast("int"))
    begin = F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")
    return out.withColumn("slot", F.col("row") - begin).drop("row")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shard() of all documents by the law `rows`; nulls, ties and repeated rows as there."""
    rows = shard(documents(spark, sf_dir))
    return rows.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32(F.encode("text", "UTF-8")).cast("long").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
