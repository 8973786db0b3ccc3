"""An inverted-file index: vectors stored by the cell of their nearest coarse centroid, and searches that read the nearest cells only."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.minibatch import STATE, assigned, moved, started, sums
from tessera.operators.vector import _matrix, knn, nearest_in_blocks
from tessera.sources.sinks import Versions

#: Cells at most; vectors for each cell that the centroids are fitted on, so the sample is bounded by CELLS * SAMPLE rows.
CELLS, SAMPLE = 4096, 64
#: Cells that a search reads.
PROBES = 8


class InvertedIndex:
    """Vectors (memory_id, embedding) in versions of a table that is partitioned by cell.

    build() fits the centroids on a sample of at most SAMPLE vectors for each cell and places all vectors; add() and remove() write changes only: a removed vector is a
    tombstone until the next snapshot. search() sends each query to its `probes` nearest cells, and the scan of the snapshot is of these cells' folders; what
    it gives are true inner products of some of the nearest vectors. exact() holds the queries against all vectors. Cells are by distance, so inner products that
    are led by long vectors need more probes; with vectors of length one, nearest and greatest product agree.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.centers, self.rows_of = Versions(spark, f"{path}/centroids", "cluster"), Versions(spark, f"{path}/rows", partition="cell")

    def build(self, vectors: DataFrame, cells: int | None = None, rounds: int = 8, seed: int = 42) -> int:
        """Fits the centroids and places all vectors; gives the version. cells: about twice the root of the number of vectors unless given, CELLS at most."""
        own = vectors.select("memory_id", F.col("embedding").cast("array<float>").alias("embedding")).where("embedding is not null")
        n = own.count()
        cells = min(CELLS, cells or max(1, int(2 * n**0.5)))
        sample = own.orderBy(F.xxhash64("memory_id", F.lit(seed))).limit(cells * SAMPLE).persist()  # the least hashes: a sample that doesn't depend on partitions
        try:
            self.centers.write(_fitted(sample, cells, rounds, seed))
        finally:
            sample.unpersist()
        return self.rows_of.write(self._placed(own))

    def _placed(self, rows: DataFrame) -> DataFrame:
        at = assigned(rows, self.centers.read()).withColumnRenamed("cluster", "cell")
        return rows.join(at, "memory_id")

    def add(self, rows: DataFrame) -> int:
        """rows (memory_id, embedding) in place of those with their ids, in the cells that are there."""
        own = rows.select("memory_id", F.col("embedding").cast("array<float>").alias("embedding")).where("embedding is not null").dropDuplicates(["memory_id"])
        return self.rows_of.change(self._placed(own).select("memory_id", "embedding", "cell"))

    def remove(self, ids: DataFrame) -> int:
        return self.rows_of.remove(ids)

    def rows(self) -> DataFrame:
        return self.rows_of.read().select("memory_id", "embedding")

    def exact(self, queries: DataFrame, k: int) -> DataFrame:
        return knn(self.rows(), queries, k)

    def probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """query_id, query, cell: the nearest cells of each query, nearest first, ties to the lesser cell."""
        got = self.centers.read().select("cluster", "centroid").orderBy("cluster").toArrow()  # CELLS rows at most
        number, c = got.column(0).to_numpy(), _matrix(got.column(1).combine_chunks())
        most, kinds = min(probes, len(number)), queries.schema

        def run(batches):
            for b in batches:
                x = _matrix(b.column(1))
                off = (c * c).sum(axis=1) - 2 * (x @ c.T) if len(x) else np.zeros((0, len(number)))
                near = np.argsort(off, axis=1, kind="stable")[:, :most]
                rows = pa.array(np.repeat(np.arange(b.num_rows), most))
                yield pa.record_batch([b.column(0).take(rows), b.column(1).take(rows), pa.array(number[near].ravel(), pa.int32())], names=["query_id", "query", "cell"])

        asked = queries.select("query_id", "query").where("query is not null")
        return asked.mapInArrow(run, f"query_id {kinds['query_id'].dataType.simpleString()}, query {kinds['query'].dataType.simpleString()}, cell int")

    def search(self, queries: DataFrame, k: int, probes: int = PROBES) -> DataFrame:
        """query_id, memory_id, similarity, rank as knn() gives them, among the vectors of each query's nearest cells. Frequent cells, of rows or of queries, are cut
        into blocks, so none is one task's."""
        asked = self.probed(queries, probes).persist()
        try:
            hit = [r[0] for r in asked.select("cell").distinct().collect()]  # CELLS at most
            rows = self.rows_of.read(where=F.col("cell").isin(hit)).select("cell", "memory_id", "embedding")
            sizes = rows.groupBy("cell").agg(F.count("*").alias("n")).join(asked.groupBy("cell").agg(F.count("*").alias("m")), "cell")
            near = nearest_in_blocks(rows, asked, k, at=["cell"], sizes=sizes)
            w = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "memory_id")
            return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        finally:
            asked.unpersist()


    def tuned(self, queries: DataFrame, k: int, target: float = 0.9) -> int:
        """The least power of two of probes, or all cells, whose search finds the target share of what exact() finds for these queries: a sample of what will be asked."""
        exact, cells, probes = self.exact(queries, k).persist(), self.centers.read().count(), 1
        try:
            while probes < cells and recall(self.search(queries, k, probes), exact) < target:
                probes *= 2
        finally:
            exact.unpersist()
        return min(probes, cells)


def _fitted(sample: DataFrame, cells: int, rounds: int, seed: int) -> DataFrame:
    """Centroids of a bounded sample, by rounds of k-means whose sums are Spark's; a centroid that no vector is nearest to stays where it is."""
    now = started(sample, cells, seed, most=cells * 4)
    for _ in range(rounds):
        nxt = moved(now.withColumn("n", F.lit(0).cast("long")), sums(sample, now))
        now = sample.sparkSession.createDataFrame([tuple(r) for r in nxt.collect()], STATE)  # a row for each cell
    return now


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact results that were found."""
    both = exact.select("query_id", "memory_id").join(found.select("query_id", "memory_id"), ["query_id", "memory_id"], "left_semi")
    return both.count() / max(1, exact.count())
