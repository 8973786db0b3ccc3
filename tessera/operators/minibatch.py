"""Mini-batch k-means: centroids with counts, which batches move by their sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.vector import _matrix

#: Clusters; vectors of a batch, which is what a first batch is chosen from.
CLUSTERS, BATCH = 64, 2048
STATE = "cluster int, centroid array<double>, n long"


def _rows(centroids: DataFrame):
    """Centroids in order of their numbers, of which there are as many as clusters: numbers and a matrix."""
    import numpy as np

    got = centroids.select("cluster", "centroid").orderBy("cluster").toArrow()
    return got.column(0).to_numpy(), _matrix(got.column(1).combine_chunks()) if got.num_rows else np.zeros((0, 0))


def _closest(x, c):
    """The place of the nearest centroid to each row, of equally near ones the first."""
    import numpy as np

    return np.argmin((c * c).sum(axis=1) - 2 * (x @ c.T), axis=1)


def assigned(vectors: DataFrame, centroids: DataFrame | None, key: str = "memory_id", vector: str = "embedding") -> DataFrame:
    """key, cluster: the number of the nearest centroid; 0 for all if there are none yet, and for a row without a vector."""
    kind = vectors.schema[key].dataType.simpleString()
    if centroids is None or centroids.isEmpty():
        return vectors.select(key, F.lit(0).alias("cluster"))
    numbers, c = _rows(centroids)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(numbers[_closest(_matrix(b.column(1)), c)], pa.int32())], names=[key, "cluster"])

    have = vectors.where(F.col(vector).isNotNull()).select(key, vector).mapInArrow(run, f"{key} {kind}, cluster int")
    return have.unionByName(vectors.where(F.col(vector).isNull()).select(key, F.lit(0).alias("cluster")))


def sums(vectors: DataFrame, centroids: DataFrame, vector: str = "embedding") -> DataFrame:
    """cluster, sum, n of the vectors nearest to each centroid: a row for each cluster and task. Such rows of any batches add up."""
    numbers, c = _rows(centroids)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total, count = np.zeros_like(c), np.zeros(len(c), np.int64)
        for b in batches:
            x = _matrix(b.column(0))
            if len(x):
                at = _closest(x, c)
                np.add.at(total, at, x)
                count += np.bincount(at, minlength=len(c))
        some = np.flatnonzero(count)
        yield pa.record_batch([pa.array(numbers[some], pa.int32()), pa.array(total[some].tolist(), pa.list_(pa.float64())), pa.array(count[some])], names=["cluster", "sum", "n"])

    return vectors.where(F.col(vector).isNotNull()).select(vector).mapInArrow(run, "cluster int, sum array<double>, n long")


def moved(centroids: DataFrame, parts: DataFrame) -> DataFrame:
    """Centroids (cluster, centroid, n) after the sums of a batch: the mean of all vectors that each has taken so far."""
    before = centroids.select("cluster", F.transform("centroid", lambda x: x * F.col("n")).alias("sum"), "n")
    rows = before.unionByName(parts.select("cluster", "sum", "n")).select("cluster", "n", F.posexplode("sum").alias("i", "x"))
    place = rows.groupBy("cluster", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    whole = place.groupBy("cluster").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s"))
    # a centroid that was chosen but has taken nothing yet weighs nothing, and stays where it is
    now = whole.select("cluster", F.transform("s", lambda e: F.try_divide(e["x"], F.col("n"))).alias("mean"), "n").join(centroids.select("cluster", "centroid"), "cluster", "left")
    return now.select("cluster", F.when(F.col("n") > 0, F.col("mean")).otherwise(F.col("centroid")).alias("centroid"), "n")


def started(batch: DataFrame, k: int, seed: int = 42, key: str = "memory_id", vector: str = "embedding", most: int = BATCH) -> DataFrame:
    """The first k centroids, by k-means++ among at most `most` vectors of the batch, those of the least keys; fewer if there are fewer distinct ones."""
    import numpy as np

    some = batch.where(F.col(vector).isNotNull()).orderBy(key).limit(most).select(vector).toArrow()
    x = _matrix(some.column(0).combine_chunks()) if some.num_rows else np.zeros((0, 0))
    rng, chosen = np.random.default_rng(seed), []
    far = np.full(len(x), np.inf)
    while len(chosen) < min(k, len(x)):
        tried = rng.integers(len(x), size=1) if not chosen else rng.choice(len(x), size=2 + int(np.log(k)), p=far / far.sum())
        left = [np.minimum(far, ((x - x[at]) ** 2).sum(axis=1)) for at in tried]
        best = int(np.argmin([f.sum() for f in left]))  # of a few candidates the one that leaves the least
        chosen.append(int(tried[best]))
        far = left[best]
        if not far.sum() > 0:
            break
    return batch.sparkSession.createDataFrame([(i, x[at].tolist(), 0) for i, at in enumerate(chosen)], STATE)


class MiniBatch:
    """k-means that goes on from batch to batch; its centroids are versions of a table (sources.sinks.Versions, keyed by cluster), so a new session goes on
    too. What a batch brings is a sum and a count for each cluster, so the model is the same however a batch is cut into tasks."""

    def __init__(self, versions, k: int = CLUSTERS, seed: int = 42):
        self.versions, self.k, self.seed = versions, k, seed

    def centroids(self) -> DataFrame | None:
        return self.versions.read() if self.versions.numbers() else None

    def partial_fit(self, batch: DataFrame, name: str | None = None, number: int = -1) -> int:
        """Moves the centroids by a batch (memory_id, embedding). name, number: of a stream's batch, which counts once. Gives the version."""
        if name is not None and number <= self.versions.done(name):
            return self.versions.numbers()[-1]
        now = self.centroids()
        if now is None:
            now = started(batch, self.k, self.seed)
        return self.versions.write(moved(now, sums(batch, now)).coalesce(1), batch=None if name is None else (name, number))

    def fit_stream(self, stream: DataFrame, name: str = "kmeans"):
        """The writer of a query whose batches move the centroids."""
        return stream.writeStream.foreachBatch(lambda batch, number: self.partial_fit(batch, name, number))

    def assign(self, vectors: DataFrame) -> DataFrame:
        return assigned(vectors, self.centroids())

    def inertia(self, vectors: DataFrame) -> float:
        """The sum of squared distances to the nearest centroids."""
        own = self.assign(vectors).join(vectors, "memory_id").join(self.centroids(), "cluster")
        off = F.aggregate(F.zip_with("embedding", "centroid", lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda s, x: s + x)
        return own.agg(F.sum(off)).first()[0] or 0.0
