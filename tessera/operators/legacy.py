"""Optional scores: candidates by one hint, the additive reranker, the attention head, adaptive embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import scoring as S
from tessera.operators import store

#: Phrases after which the reranker counts its sum half as much again.
RECALL_BOOST = 1.5
ASPECTS = ("semantic", "temporal", "actor", "spatial", "intent")


def hinted(mem: DataFrame, as_of: str, actor: str | None = None, place: str | None = None, limit: int = 100) -> DataFrame:
    """Memories of an actor or a place, scored by recency alone."""
    rows = store.by_actor(mem, actor, limit) if actor is not None else store.by_location(mem, place, limit)
    return rows.select("memory_id", S.recency(F.col("when_ts"), as_of).alias("score"))


def additive(rows: DataFrame, recalls: Column) -> DataFrame:
    """semantic, plus a tenth each for the actor and the date; half as much again where recalls holds; usage counts to a hundred."""
    base = F.col("semantic") + 0.1 * (F.col("actor") > 0).cast("int") + 0.1 * (F.col("temporal") > 0).cast("int") + 0.05 * S.usage(F.col("accesses"), 100.0)
    return rows.withColumn("score", F.least(F.lit(1.0), base * F.when(recalls, RECALL_BOOST).otherwise(1.0)))


def _layers(dim: int, seed: int):
    rng = np.random.default_rng(seed)
    return [rng.normal(0, dim**-0.5, (dim, dim)) for _ in ASPECTS], rng.normal(0, 1, len(ASPECTS))


def attention(pairs: DataFrame, dim: int, seed: int = 0) -> DataFrame:
    """pairs (query, embedding and other columns) with attention: five projections' sigmoid of the scaled product, averaged by softmax
    weights. Weights are random but seeded, as nothing trains them."""

    def run(batches):
        mats, w = _layers(dim, seed)
        soft = np.exp(w - w.max()) / np.exp(w - w.max()).sum()
        for b in batches:
            q, m = (np.array(b.column(b.schema.get_field_index(c)).to_pylist(), float).reshape(-1, dim) for c in ("query", "embedding"))
            each = [1 / (1 + np.exp(-2 * ((q @ x) * (m @ x)).sum(axis=1) / np.sqrt(dim))) for x in mats]
            yield pa.record_batch([*b.columns, pa.array(np.tensordot(soft, each, 1), pa.float64())], names=[*b.schema.names, "attention"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.mapInArrow(run, f"{kinds}, attention double")


def adaptive(mem: DataFrame, dim: int, seed: int = 0) -> DataFrame:
    """memory_id, embedding: the embedding beside 64 features of usage, through two seeded random layers with a norm between; length one."""

    def run(batches):
        rng = np.random.default_rng(seed)
        one, two = rng.normal(0, (dim + 64) ** -0.5, (dim + 64, 2 * dim)), rng.normal(0, (2 * dim) ** -0.5, (2 * dim, dim))
        for b in batches:
            e = np.array(b.column(1).to_pylist(), float).reshape(-1, dim)
            use = np.zeros((len(e), 64))
            use[:, 0], use[:, 1] = np.array(b.column(2).to_pylist(), float) / 100, 0.5
            h = np.concatenate([e, use], axis=1) @ one
            h = (h - h.mean(axis=1, keepdims=True)) / (h.std(axis=1, keepdims=True) + 1e-5)
            v = np.maximum(h, 0) @ two
            v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-8
            yield pa.record_batch([b.column(0), pa.array(v.astype(np.float32).tolist(), pa.list_(pa.float32()))], names=["memory_id", "embedding"])

    return mem.select("memory_id", "embedding", F.coalesce("accesses", F.lit(0)).alias("accesses")).mapInArrow(run, "memory_id string, embedding array<float>")
