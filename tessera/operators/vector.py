"""Vector search and audits over stored embeddings. The search is exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scoring as S
from tessera.operators.pairing import paired

#: Query vectors that one pass sends to all executors, and passes at most; more queries meet the rows in blocks of both, by a shuffle.
QUERY_BLOCK, PASSES = 1024, 4
#: Queries whose products with 4096 rows a task holds at once: 8 MB.
ASKED_PRODUCTS = 256


def knn(mem: DataFrame, queries: DataFrame, k: int, key: str = "memory_id", vector: str = "embedding", query_key: str = "query_id", query_vector: str = "query") -> DataFrame:
    """For each query its k nearest rows by inner product in doubles: query, key, similarity, rank. Ties go to the lesser key; rows without a
    vector are left out; a vector of another length than a query's is an error."""
    w = Window.partitionBy(query_key).orderBy(F.col("similarity").desc(), key)
    near = nearest(mem, queries, k, key, vector, query_key, query_vector)
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(mem: DataFrame, queries: DataFrame, k: int, key: str = "memory_id", vector: str = "embedding", query_key: str = "query_id", query_vector: str = "query") -> DataFrame:
    """query, key, similarity of the k nearest rows of each partition or block, so all that knn() chooses among.

    Queries are a given set. Up to PASSES times QUERY_BLOCK of them go to the rows in blocks, each with a scan of the table, so what is broadcast is bounded by
    block size times dimension. With more, blocks of queries and of rows are paired in one shuffle: scans, tasks' memory and the plan don't grow with
    the queries. Products are of Arrow batches; each partition or block keeps k rows of each query before the shuffle.
    """
    base = mem.select(key, F.col(vector).alias("_v")).where("_v is not null")
    asked = queries.select(query_key, query_vector).where(F.col(query_vector).isNotNull())
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    if blocks > PASSES:
        return nearest_in_blocks(base.withColumnRenamed("_v", vector), asked, k, key, vector, query_key, query_vector)
    kinds = f"{query_key} {queries.schema[query_key].dataType.simpleString()}, {key} {mem.schema[key].dataType.simpleString()}, similarity double"
    out = None
    for b in range(blocks):
        rows = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == b)).toArrow()
        near = base.mapInArrow(_nearest(rows, k), kinds)
        out = near if out is None else out.unionByName(near)
    return out


def nearest_in_blocks(rows: DataFrame, asked: DataFrame, k: int, key: str = "memory_id", vector: str = "embedding", query_key: str = "query_id", query_vector: str = "query", at: list[str] | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """query, key, similarity of the k nearest rows of each block; see paired() for at and sizes."""
    kinds = f"{query_key} {asked.schema[query_key].dataType.simpleString()}, {key} {rows.schema[key].dataType.simpleString()}, similarity double"

    def meet(left, right):
        import pyarrow as pa

        made = list(_nearest(right.select([query_key, query_vector]), k)(left.select([key, vector]).to_batches()))
        yield pa.Table.from_batches(made).rename_columns([query_key, key, "similarity"])

    at = at or []
    return paired(rows.select(*at, key, vector), key, asked.select(*at, query_key, query_vector), query_key, meet, kinds, at, sizes)


def _matrix(column):
    """A column of equally long vectors as doubles, a row each."""
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _promising(rows, at, least):
    """Of each query of which a row reaches its least product: its number and the rows' products. A few queries' products are held at once."""
    import numpy as np

    for a in range(0, len(at), ASKED_PRODUCTS):
        product = rows @ at[a : a + ASKED_PRODUCTS].T
        for j in np.flatnonzero(product.max(axis=0) >= least[a : a + ASKED_PRODUCTS]):
            yield a + j, product[:, j]


def _nearest(asked, k: int):
    """For mapInArrow: the k best rows of a partition for each of the queries (id, vector)."""
    import numpy as np
    import pyarrow as pa

    ids, at = asked.column(0).combine_chunks(), _matrix(asked.column(1).combine_chunks())

    def run(batches):
        n = len(ids)
        best = [(np.zeros(0), np.zeros(0, object))] * n
        least = np.full(n, -np.inf)
        kind = None
        for whole in batches:
            kind = whole.column(0).type
            for i in range(0, whole.num_rows if n else 0, 4096):
                b = whole.slice(i, 4096)
                names = np.array(b.column(0).to_pylist(), object)
                rows = _matrix(b.column(1))
                for j, own in _promising(rows, at, least):
                    take = own >= max(least[j], np.partition(own, -k)[-k] if len(own) > k else -np.inf)
                    scores, keys = np.append(best[j][0], own[take]), np.append(best[j][1], names[take])
                    order = np.lexsort((keys, -scores))[:k]
                    best[j] = scores[order], keys[order]
                    if len(order) == k:
                        least[j] = scores[order[-1]]
        if kind is not None:
            size = [len(s) for s, _ in best]
            yield pa.record_batch([ids.take(pa.array(np.repeat(np.arange(n), size))), pa.array([x for _, ks in best for x in ks], kind), pa.array(np.concatenate([s for s, _ in best]) if n else [], pa.float64())], names=["query", "key", "similarity"])

    return run


def vectors(mem: DataFrame, limit: int | None = None, vector: str = "embedding") -> DataFrame:
    """memory_id and vector of the first limit places of the index, which is in order of ids; places without a vector count, but give no row."""
    rows = mem.select("memory_id", vector).orderBy("memory_id")
    return (rows if limit is None else rows.limit(limit)).where(F.col(vector).isNotNull())


def vector_of(mem: DataFrame, memory_id: str, vector: str = "embedding") -> DataFrame:
    """The vector of a memory, or no row."""
    return mem.where((F.col("memory_id") == memory_id) & F.col(vector).isNotNull()).select("memory_id", vector)


def raw_search(index: DataFrame, store: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest of the index with the store's rows, scores as they are; an id that the store lacks is shown without data."""
    return knn(index, queries, k).join(store.drop("embedding"), "memory_id", "left")


def audit(mem: DataFrame, vector: str = "embedding") -> DataFrame:
    """Each memory's embedding as missing, zero or valid."""
    v = F.col(vector)
    return mem.select("memory_id", F.when(v.isNull(), "missing").when(F.forall(v, lambda x: F.abs(x) <= 1e-8), "zero").otherwise("valid").alias("status"))


def consistency(mem: DataFrame, embeddings: DataFrame, index: DataFrame) -> DataFrame:
    """Counts of the three tables, and of memories without an embedding."""
    one = lambda d, n: d.agg(F.count("*").alias(n))
    missing = one(mem.join(embeddings, "memory_id", "left_anti"), "missing")
    return one(mem, "memories").crossJoin(one(embeddings, "embeddings")).crossJoin(one(index, "indexed")).crossJoin(missing)  # single rows


def embedded_by(rows: DataFrame, embedder, text: str = "embed_text", tries: int = 3, pause: float = 0.5, batch: int = 32, failures=None) -> DataFrame:
    """rows with the vectors that embedder.encode(list of texts) gives, by lists of `batch` texts.

    A call that fails, or gives another number of vectors, is made again up to `tries` times, after pauses that double. Texts whose last try fails get vectors of
    zeros, as long as embedder.dim or the vectors before them say, or none if nothing says it: audit() finds either, and repaired() makes them anew. failures: an
    accumulator that is added the number of such texts; a task that runs twice adds twice."""
    import pyarrow as pa

    def run(batches):
        import time

        dim = getattr(embedder, "dim", None)
        for b in batches:
            said, out = b.column(b.schema.get_field_index(text)).to_pylist(), []
            for i in range(0, len(said), batch):
                own, made = said[i : i + batch], None
                for k in range(tries):
                    try:
                        made = [list(map(float, x)) for x in embedder.encode(own)]
                    except Exception:  # whatever a service raises; the texts are told by their vectors
                        made = None
                    if made is not None and len(made) == len(own):
                        break
                    made = None
                    if k < tries - 1:
                        time.sleep(pause * 2**k)
                if made is None:
                    made = [None if dim is None else [0.0] * dim] * len(own)
                    if failures is not None:
                        failures.add(len(own))
                else:
                    dim = len(made[0])
                out += made
            yield pa.record_batch([*b.columns, pa.array(out, pa.list_(pa.float32()))], names=[*b.schema.names, "embedding"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, embedding array<float>")


class HashingEmbedder:
    """A deterministic embedder that needs no model: signed counts of hashed words, length one."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts):
        import zlib

        import numpy as np

        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % self.dim] += 1 if h >> 16 & 1 else -1
        return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-8)
