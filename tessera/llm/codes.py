"""Vector code compression: product codes from integer k-means, whose codebooks are searched by kd-trees."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import in_small_batches, pick, spread_join, written

#: Parts of a vector, entries of a codebook, rounds of k-means; components become floor(SCALE * x).
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries of a leaf of a tree; vectors that go down a tree at once.
LEAF, AT_ONCE = 16, 4096


class Tree:
    """A kd-tree over the entries (n, w) of a codebook, in integers. Each node has the box of its entries; a leaf lists them by index."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.asarray(entries, np.int64).reshape(len(entries), -1)
        self.root = self._node(np.arange(len(self.entries)))

    def _node(self, index: np.ndarray) -> tuple:
        e = self.entries[index]
        low, high = e.min(axis=0), e.max(axis=0)
        if len(index) <= LEAF or (low == high).all():
            return low, high, np.sort(index), None, None
        order = index[np.argsort(e[:, int((high - low).argmax())], kind="stable")]
        half = len(order) // 2
        return low, high, None, self._node(order[:half]), self._node(order[half:])

    @staticmethod
    def _bound(node: tuple, x: np.ndarray) -> np.ndarray:
        """Squared distances to the node's box: none of its entries is nearer."""
        off = np.maximum(np.maximum(node[0] - x, x - node[1]), 0)
        return np.einsum("ij,ij->i", off, off)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row of x, of equally near ones that of the least index, and its squared distance.

        Branch and bound, many rows at a time: a row goes to the nearer child first, and to the other one unless its box is
        farther than the best entry so far. A box that is just as far is visited, as it may hold an equally near entry of a lesser index.
        """
        best, at = np.full(len(x), np.iinfo(np.int64).max), np.full(len(x), len(self.entries))

        def visit(node: tuple, rows: np.ndarray, bound: np.ndarray) -> None:
            rows = rows[bound <= best[rows]]
            if not len(rows):
                return
            own, (_, _, index, left, right) = x[rows], node
            if index is not None:
                off = own[:, None, :] - self.entries[index][None]
                d = np.einsum("ijk,ijk->ij", off, off)
                k = d.argmin(axis=1)  # the first, so the least index
                d, k = d[np.arange(len(rows)), k], index[k]
                better = (d < best[rows]) | ((d == best[rows]) & (k < at[rows]))
                best[rows[better]], at[rows[better]] = d[better], k[better]
                return
            to_left, to_right = self._bound(left, own), self._bound(right, own)
            first = to_left <= to_right
            visit(left, rows[first], to_left[first])
            visit(right, rows[~first], to_right[~first])
            visit(right, rows[first], to_right[first])
            visit(left, rows[~first], to_left[~first])

        for i in range(0, len(x), AT_ONCE):
            rows = np.arange(i, min(i + AT_ONCE, len(x)))
            visit(self.root, rows, np.zeros(len(rows), np.int64))
        return at, best


def _integers(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(SCALE * x) of those vectors of a list column that have dim components, none so large that a distance might not fit in a long; and which these are."""
    flat, cut = np.floor(column.flatten().to_numpy(zero_copy_only=False) * SCALE), column.value_lengths().to_numpy(zero_copy_only=False)
    if (cut == dim).all():
        rows, ok = flat.reshape(-1, dim), np.ones(len(cut), bool)
    else:
        ok = cut == dim
        rows = flat[np.repeat(ok, cut)].reshape(-1, dim)
    fits = (np.abs(rows) < math.isqrt((1 << 63) // max(1, 4 * dim))).all(axis=1)
    ok[ok] = fits
    return rows[fits].astype(np.int64), ok


def kept_vectors(df: DataFrame) -> DataFrame:
    """vec_id, embedding as doubles and label of the rows whose vector is not null and holds no null, NaN or infinity."""
    v = F.col("embedding")
    return pick(df, "vec_id", "embedding", "label").withColumn("embedding", v.cast("array<double>")).where(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _sums(vectors: DataFrame, trees, dim: int, parts: int) -> DataFrame:
    """(part, entry, n, s0, s1, ...): of each entry the number of vectors nearest to it and the sums of their components. Each task adds
    up what it reads, so a task sends a row for each entry at most, however often a vector repeats."""
    width = dim // parts

    def run(batches):
        total, count = {}, {}
        for b in batches:
            rows, _ = _integers(b.column(0), dim)
            for p, tree in enumerate(trees.value):
                x = rows[:, p * width : (p + 1) * width]
                at, _ = tree.nearest(x)
                n = len(tree.entries)
                if p not in total:
                    total[p], count[p] = np.zeros((n, width), np.int64), np.zeros(n, np.int64)
                order = np.argsort(at, kind="stable")
                if len(order):
                    first = np.flatnonzero(np.append(True, np.diff(at[order]) > 0))
                    total[p][at[order[first]]] += np.add.reduceat(x[order], first, axis=0)
                    count[p] += np.bincount(at, minlength=n)
        for p in total:
            some = np.flatnonzero(count[p])
            yield pa.record_batch([pa.array(np.full(len(some), p), pa.int32()), pa.array(some, pa.int32()), pa.array(count[p][some]), *[pa.array(total[p][some, k]) for k in range(width)]], names=["part", "entry", "n", *[f"s{k}" for k in range(width)]])

    made = vectors.select("embedding").mapInArrow(run, "part int, entry int, n long" + "".join(f", s{k} long" for k in range(width)))
    return made.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col(f"s{k}").cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)])


def codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray] | None:
    """A codebook (entries, width) of integers for each part of kept_vectors(); None if there are none.

    It starts with the vectors of the least ids, of rows with the same id that with the least vector first; rows without an id come last. Each
    round sends the trees, whose size is parts * entries * width numbers whatever the input, adds up the vectors of each entry in the tasks, and
    replaces each entry that has any by their floored mean. Only these sums, a row for each entry, come to the driver.
    """
    spark = vectors.sparkSession
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").toArrow().column(0).combine_chunks()
    if not len(first):
        return None
    dim = len(first[0])
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    rows, _ = _integers(first, dim)
    if not len(rows):
        return None
    books = [rows[:, p * dim // parts : (p + 1) * dim // parts].copy() for p in range(parts)]
    for _ in range(rounds):
        trees = spark.sparkContext.broadcast([Tree(b) for b in books])
        for part, entry, n, *sums in _sums(vectors, trees, dim, parts).collect():
            books[part][entry] = [int(s) // n for s in sums]
        trees.destroy()
    return books


def codes(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code and error of each of kept_vectors(): the index of the nearest entry of each part, in hex, and the sum of the squared distances."""
    trees, dim = vectors.sparkSession.sparkContext.broadcast([Tree(b) for b in books]), sum(b.shape[1] for b in books)
    digits = max(2, *[f"{len(b) - 1:x}".__len__() for b in books])

    def run(batches):
        for b in batches:
            rows, ok = _integers(b.column(2), dim)
            found, error, width = [], np.zeros(len(rows), np.int64), dim // len(books)
            for p, tree in enumerate(trees.value):
                at, d = tree.nearest(rows[:, p * width : (p + 1) * width])
                found.append(at)
                error += d
            code, errors = np.full(len(ok), None, object), np.zeros(len(ok), np.int64)
            code[ok] = ["".join(f"{i:0{digits}x}" for i in x) for x in zip(*[f.tolist() for f in found])]
            errors[ok] = error
            yield pa.record_batch([b.column(0), b.column(1), pa.array(code.tolist(), pa.string()), pa.array(errors, pa.int64(), mask=~ok)], names=["vec_id", "label", "code", "error"])

    kinds = dict(vectors.dtypes)
    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def sha256_of(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compressed(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for each row of df that kept_vectors() keeps.

    Rows that repeat give a row each and weigh as often as they stand there; null labels are one label, and null ids are kept. A vector of another length than the first
    one's, or with a component so large that a distance might not fit in a long (185,000 with 64 components), has null code and error and moves no
    entry. No vectors give no rows. Other columns are ignored. The sums of labels reach the rows by spread_join(), so a hot label is no hot task.
    """
    in_small_batches(df.sparkSession)
    vectors = kept_vectors(df)
    books = codebooks(vectors, parts, entries, rounds)
    if books is None:
        return vectors.select("vec_id", F.lit(None).cast("string").alias("code"), *[F.lit(None).cast("long").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256"))
    coded = written(codes(vectors, books).withColumn("key", F.coalesce(F.concat(F.lit("v"), F.col("label").cast("string")), F.lit("null"))).drop("label"), "codes")
    labels = coded.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    return spread_join(coded, written(labels, "labels"), ["key"], "n", coded.count()).select("vec_id", "code", "error", "label_error", F.lit(sha256_of(books)).alias("codebooks_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """compressed() of all embeddings; nulls, ties and repeated rows as there."""
    return compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    sql = """WITH kept AS MATERIALIZED (SELECT vec_id, label, row_number() OVER () AS row, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT row, vec_id, part, v[part * (len(v) // 4) + 1 : (part + 1) * (len(v) // 4)] AS x FROM kept, range(4) AS t(part)),
book0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id, row) - 1 AS entry, x AS e FROM parts QUALIFY entry < 256)"""
    for k in range(ROUNDS + 1):
        sql += f""",
near{k} AS MATERIALIZED (SELECT row, part, any_value(x) AS x, min(256 * (list_inner_product(x, x) - 2 * list_inner_product(x, e) + list_inner_product(e, e))::BIGINT + entry) AS best FROM parts JOIN book{k} USING (part) GROUP BY row, part)"""
        if k < ROUNDS:
            sql += f""",
mean{k} AS (SELECT part, entry, list(m ORDER BY i) AS e FROM (SELECT part, best % 256 AS entry, i, floor(sum(x[i]) / count(*)) AS m FROM near{k}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY ALL) GROUP BY ALL),
book{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.e, b.e) AS e FROM book{k} b LEFT JOIN mean{k} m USING (part, entry))"""
    return (
        sql
        + f""",
digest AS (SELECT sha256(string_agg(list_aggregate(list_transform(e, lambda x: x::BIGINT::VARCHAR), 'string_agg', ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{ROUNDS}),
coded AS (SELECT row, string_agg(lower(printf('%02x', best % 256)), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM near{ROUNDS} GROUP BY row)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (row), digest"""
    )


ORACLE = _oracle()
