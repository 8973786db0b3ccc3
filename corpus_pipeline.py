"""A corpus pipeline of five stages: quality rules, near-duplicates, benchmark decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns rows for the next; all but the last return the columns of docs, whatever else they are,
also such as differ from doc_id or text by case only. Texts and other columns may be null, rows may repeat, tables may be empty; the
stages' and the operators' docstrings say what comes of each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import delete, documents, flattened, scratch, written
from tessera.llm.decontamination import contamination
from tessera.llm.neardup import near_duplicates
from tessera.llm.packing import pack
from tessera.llm.quality import passing
from tessera.llm.secrets import redact

#: Ids that are sent to all executors, at most; more go by a shuffled join.
BROADCAST_IDS = 200_000


def without(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """docs without the rows of ids (doc_id); rows without an id stay. ids are counted before they are broadcast."""
    ids = written(ids.select(F.col("doc_id").alias("_gone")).distinct(), name)
    flat, at = flattened(docs)
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return flat.join(ids, F.col(at["doc_id"]).cast("long") == F.col("_gone"), "left_anti").toDF(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the plain rules and lie in their language's perplexity band. Null and empty texts fail; a null language is one of its
    own; rows that repeat, and rows without doc_id, are judged each; an empty table stays empty."""
    return passing(docs)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the least id; of rows with the same id the one with the least text (null first), then the least hash of
    the row. Rows without doc_id, which no class can name, stay, as do texts without a word. An empty table stays empty."""
    left = without(docs, near_duplicates(docs).where("doc_id <> class_id"), "copies")
    flat, at = flattened(left)
    key = F.col(at["doc_id"]).cast("long")
    twice = written(flat.groupBy(key.alias("_id")).agg(F.count("*").alias("n")).where("n > 1 and _id is not null").select("_id"), "repeated")
    if twice.isEmpty():
        return left
    plain = [c for c, t in flat.dtypes if "map<" not in t and "variant" not in t]
    first = F.min_by(F.struct(*flat.columns), F.struct(F.col(at["text"]).cast("string"), F.xxhash64(*plain)))
    once = flat.join(twice, key == F.col("_id"), "left_semi").groupBy(key.alias("_id")).agg(first.alias("row")).select("row.*")
    return flat.join(twice, key == F.col("_id"), "left_anti").unionByName(once).toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of benchmark. Null and empty texts hold none; all rows of an id go if one holds an item; rows without doc_id,
    which the operator's result can't name, stay; an empty table stays empty."""
    return without(docs, contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "contaminated")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked, and n_chars counted anew. Null texts stay null; rows that repeat are masked each; an empty table stays empty."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences. Null and empty texts are one token; rows that repeat are packed each; an empty table has no pieces."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicate), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: Perplexities, signatures and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; each stage's rows are written to the shared folder and read again. When they are, the tables
    that its operator wrote and the rows of the stage before are deleted; the last stage's stay for the caller."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        with scratch(spark) as tables:
            docs = written(stage(spark, docs, sf_dir), name)
            own = tables.pop()
        if before:
            delete(spark, [before])
        before = own
    return docs
