"""Memory rows from the event, embedding and document tables, as DataFrames and as the same SQL for the oracle."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The time that stands for now, as events end a day before.
AS_OF = "2024-01-31T00:00:00"
#: The query set of searches: every memory whose number this divides.
QUERY_STEP = 20
#: Where each session's memories of a folder lie, by (application, folder).
_made: dict[tuple[str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(text):
    """Estimated tokens of a text: a token for 3.5 characters, one at least, none for an empty text."""
    return F.when(F.length(text) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 3.5))).cast("int")


def shared(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a temporary one where it is unset and the master is local."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memory table of a folder: joined() written once a session, and read, as a store's memories are."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _made:
        path = f"{shared(spark)}/memories-{uuid.uuid4().hex}"
        joined(spark, sf_dir).write.parquet(path)
        _made[key] = path
    return spark.read.parquet(_made[key])


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One memory for each embedding: its event is every stride-th, its document the one of its number."""
    v, e, d = (table(spark, sf_dir, n) for n in ("embeddings", "events", "documents"))
    n_docs = d.count()
    stride = e.count() // max(1, v.count())
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    joined = v.join(e, F.col("event_id") == F.col("vec_id") * stride).join(d, F.col("doc_id") == F.col("vec_id") % n_docs)
    listed = lambda *c: F.concat(F.lit('["'), F.concat_ws('","', *c), F.lit('"]'))
    user = F.concat(F.lit("user:"), F.col("user_id"))
    return joined.select(
        "vec_id",
        F.concat(F.lit("mem_"), F.lpad(F.col("vec_id").cast("string"), 12, "0")).alias("memory_id"),
        F.concat(F.lit("chat_"), F.col("user_id") % 20).alias("session_id"),
        F.concat(F.lit("evt_"), F.col("event_id")).alias("source_event_id"),
        F.lit("user").alias("who_type"),
        user.alias("who_id"),
        F.lit(None).cast("string").alias("who_label"),
        F.when(F.col("vec_id") % 10 != 0, listed(user)).alias("who_list"),
        F.when(F.col("vec_id") % 7 == 0, F.substring("text", 1, 160)).otherwise(listed("event_type", "source", "lang")).alias("what"),
        ts.alias("when_ts"),
        F.when(F.col("vec_id") % 11 == 0, None).when(F.col("vec_id") % 5 == 0, '["yesterday"]').otherwise(listed(ts)).alias("when_list"),
        F.lit("digital").alias("where_type"),
        F.col("source").alias("where_value"),
        listed("source").alias("where_list"),
        F.concat(F.lit("intent "), F.col("event_type")).alias("why"),
        F.concat(F.lit("via "), F.col("lang")).alias("how"),
        F.col("text").alias("raw_text"),
        tokens(F.col("text")).alias("token_count"),
        "embedding",
        F.lit('{"metadata":{"role":"user"}}').alias("extra_json"),
        ts.alias("created_at"),
        F.get_json_object("props", "$.k").cast("int").alias("accesses"),
    )


MEM = """
WITH k AS (SELECT (SELECT count(*) FROM events) // greatest(1, (SELECT count(*) FROM embeddings)) AS stride, (SELECT count(*) FROM documents) AS n_docs),
memories AS (
  SELECT vec_id, 'mem_' || lpad(vec_id::VARCHAR, 12, '0') AS memory_id, 'chat_' || (user_id % 20) AS session_id, 'evt_' || event_id AS source_event_id,
    'user' AS who_type, 'user:' || user_id AS who_id, NULL::VARCHAR AS who_label,
    CASE WHEN vec_id % 10 <> 0 THEN '["user:' || user_id || '"]' END AS who_list,
    CASE WHEN vec_id % 7 = 0 THEN substring(text, 1, 160) ELSE '["' || event_type || '","' || source || '","' || lang || '"]' END AS what,
    strftime(ts, '%Y-%m-%dT%H:%M:%S') AS when_ts,
    CASE WHEN vec_id % 11 = 0 THEN NULL WHEN vec_id % 5 = 0 THEN '["yesterday"]' ELSE '["' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '"]' END AS when_list,
    'digital' AS where_type, source AS where_value, '["' || source || '"]' AS where_list,
    'intent ' || event_type AS why, 'via ' || lang AS how, text AS raw_text,
    CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(length(text) / 3.5))::INT END AS token_count,
    embedding, '{"metadata":{"role":"user"}}' AS extra_json, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created_at,
    (props::JSON ->> '$.k')::INT AS accesses
  FROM embeddings v CROSS JOIN k JOIN events e ON e.event_id = v.vec_id * k.stride JOIN documents d ON d.doc_id = v.vec_id % k.n_docs)
"""


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")
