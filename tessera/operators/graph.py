"""Synapses, importance, clusters and drift of memories: pure functions from state and events to the next state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.pairing import paired

#: Members of one activation or access list that meet in one group, at most; longer lists are cut.
MOST_ACTIVE = 1000


#: Pairs of one partition, about, where pairs are shuffled: the partitions grow in number with the pairs and not in size.
PAIRS = 500_000


def cut(pairs: DataFrame, n: int) -> DataFrame:
    """pairs (m1, m2, ...), of which there are about n, in as many partitions by their keys as that takes."""
    return pairs.repartition(-(-n // PAIRS), "m1", "m2") if n > PAIRS else pairs


def many_pairs(lists: DataFrame, key: str, item: str = "memory_id") -> int:
    """The pairs of items in all lists; such as stand in several lists count for each."""
    size = lists.where(F.col(item).isNotNull()).groupBy(key).agg(F.countDistinct(item).cast("double").alias("n"))
    return int(size.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0)


def all_pairs(lists: DataFrame, key: str, item: str = "memory_id", block: int = MOST_ACTIVE // 2, asked: DataFrame | None = None) -> DataFrame:
    """How often two items stand in the same list: m1 < m2, n. Lists are of any length: long ones are cut into blocks of about block items, of
    which each two meet in a group of their own. An item of one list only has each of its pairs in it once, so these are whole where they are made; the
    others are added up by a shuffle. asked (a column of that item's name): only the pairs with one of these items."""
    own = lists.select(F.col(key).alias("k"), F.col(item).alias("x")).where("x is not null").distinct()
    own = own.withColumn("l", F.count("*").over(Window.partitionBy("x")) == 1)
    own = own.withColumn("a", F.lit(True)) if asked is None else own.join(asked.select(F.col(item).alias("x"), F.lit(True).alias("a")).distinct(), "x", "left").withColumn("a", F.coalesce("a", F.lit(False)))
    often = own.where("not l")
    n = many_pairs(often, "k", "x")
    whole = _met(own, block, asked is not None).where("one.l or two.l").select("m1", "m2", F.lit(1).cast("long").alias("n"))
    if not n:
        return whole
    return whole.unionByName(cut(_met(often, block, asked is not None).select("m1", "m2"), n).groupBy("m1", "m2").agg(F.count("*").alias("n")))


def _met(own: DataFrame, block: int, some: bool) -> DataFrame:
    """A row (one, two, m1, m2) for each two items x of a list k; some: of which one is asked for (a)."""
    size = own.groupBy(F.col("k").alias("long")).agg(F.count("*").alias("n")).where(F.col("n") > block)
    cuts = own.join(size, F.col("k").eqNullSafe(F.col("long")) & F.col("n").isNotNull(), "left").drop("long").withColumn("n", F.ceil(F.coalesce("n", F.lit(1)) / block).cast("int"))
    rows = cuts.withColumn("b", F.pmod(F.xxhash64("x"), F.col("n")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    met = rows.groupBy("k", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi")).agg(F.array_sort(F.collect_list(F.struct("x", "b", "l", "a"))).alias("xs"))
    if some:
        one = met.select("lo", "hi", "xs", F.explode(F.filter("xs", lambda s: s["a"])).alias("one"))
        two = one.select("lo", "hi", "one", F.explode("xs").alias("two")).where("one.x <> two.x and (not two.a or one.x < two.x)")
    else:
        one = met.select("lo", "hi", "xs", F.posexplode("xs").alias("i", "one"))
        two = one.select("lo", "hi", "one", F.explode(F.slice("xs", F.col("i") + 2, F.size("xs"))).alias("two"))
    return two.where("lo = hi or one.b <> two.b").select("one", "two", F.least("one.x", "two.x").alias("m1"), F.greatest("one.x", "two.x").alias("m2"))


def hebbian(synapses: DataFrame, activations: DataFrame, key: str, rate: float = 0.01, known: int = 0) -> DataFrame:
    """Each list two memories are active in adds rate to their weight, 1 at most. known: about how many synapses there are, by which the shuffle is cut."""
    more = all_pairs(activations, key).select("m1", "m2", (F.col("n") * rate).alias("weight"))
    both = cut(synapses.select("m1", "m2", "weight").unionByName(more), known + many_pairs(activations, key))
    return both.groupBy("m1", "m2").agg(F.least(F.lit(1.0), F.sum("weight")).alias("weight"))


def decay(synapses: DataFrame, rate: float = 0.001, least: float = 0.01) -> DataFrame:
    return synapses.withColumn("weight", F.col("weight") * (1 - rate)).where(F.col("weight") >= least)


def ends(synapses: DataFrame) -> DataFrame:
    """A row for each end of each synapse."""
    return synapses.select(F.explode(F.array("m1", "m2")).alias("memory_id"), "weight")


def importance(memories: DataFrame, synapses: DataFrame) -> DataFrame:
    """Mean weight times the root of the number of synapses; 0 without one."""
    own = ends(synapses).groupBy("memory_id").agg(F.avg("weight").alias("w"), F.count("*").alias("connections"))
    return memories.select("memory_id").join(own, "memory_id", "left").select("memory_id", F.coalesce(F.col("w") * F.sqrt("connections"), F.lit(0.0)).alias("importance"), F.coalesce("connections", F.lit(0)).alias("connections"))


def related(synapses: DataFrame, memory_id: str, threshold: float = 0.1) -> DataFrame:
    """Neighbours over the threshold, strongest first, whichever way the synapse is stored."""
    one = synapses.where((F.col("m1") == memory_id) & (F.col("weight") >= threshold)).select(F.col("m2").alias("memory_id"), "weight")
    two = synapses.where((F.col("m2") == memory_id) & (F.col("weight") >= threshold)).select(F.col("m1").alias("memory_id"), "weight")
    return one.union(two).distinct().orderBy(F.col("weight").desc(), "memory_id")


def keep_or_forget(scores: DataFrame, budget: int) -> DataFrame:
    """Whether a memory is among the budget most important; the cut is found by a top-k, not by one task's sort of all."""
    kept = scores.orderBy(F.col("importance").desc(), "memory_id").limit(budget).select("memory_id", F.lit(True).alias("_k"))
    return scores.join(kept, "memory_id", "left").select("memory_id", "importance", F.coalesce("_k", F.lit(False)).alias("keep"))


#: Memories of a block of the asked ones, which are small, and pairs that a task holds at once.
ASKED_BLOCK, PAIRS_AT_ONCE = 32_768, 1 << 18
#: Where all pairs are the result: memories of a block of either side, of which a hash seldom makes over 4096, and pairs that are put in order, a block's.
PAIR_BLOCK, PAIRS_IN_ORDER = 3900, 1 << 24


def affinity(vectors: DataFrame, co: DataFrame, last: DataFrame, asked: DataFrame) -> DataFrame:
    """m1, m2, affinity of each memory m1 of a given set (asked: memory_id) to all others of vectors (memory_id, embedding): 0.4 of shared accesses
    up to ten (co: m1 < m2, n), 0.3 of nearness of their last accesses, 0.3 of cosine; 0.5 where a time or vector is missing. Blocks of the set and of all
    rows meet with the shared accesses of their memories, and give their pairs piece by piece, so no pair is shuffled. A block's pairs leave in the order of
    their affinities: rounded ones then stand in runs, and all take about a third of the room in Parquet files."""
    v = vectors.where("memory_id is not null").join(last.select("memory_id", F.unix_micros("last_access").alias("t")), "memory_id", "left").select("memory_id", "embedding", "t")
    some = asked.select("memory_id").distinct()
    own = v.join(some, "memory_id", "left_semi").toDF("m1", "e1", "t1")
    each = co.select("m1", "m2", "n").union(co.select(F.col("m2").alias("m1"), F.col("m1").alias("m2"), "n")).join(some.toDF("m1"), "m1", "left_semi")

    def meet(left, right, links):
        import numpy as np
        import pyarrow as pa

        m1, m2 = right.column("m1").combine_chunks(), left.column("m2").combine_chunks()
        at = pa.table([m1, pa.array(np.arange(len(m1)))], names=["m1", "i"])
        to = pa.table([m2, pa.array(np.arange(len(m2)))], names=["m2", "j"])
        link = links.join(at, "m1", join_type="inner", use_threads=False).join(to, "m2", join_type="inner", use_threads=False).sort_by("i")
        i, j, n = (link.column(c).to_numpy() for c in ("i", "j", "n"))
        same = at.join(to, "m1", "m2", join_type="inner", use_threads=False).sort_by("i")
        own_i, own_j = same.column("i").to_numpy(), same.column("j").to_numpy()
        first, held = 0, []
        for _, z, near in nearness(right.column("e1"), right.column("t1"), left.column("embedding"), left.column("t")):
            held.append(near)
            if z < len(m1) and (z - first) * len(m2) < PAIRS_IN_ORDER:
                continue
            each, held = np.concatenate(held), []
            s = slice(*np.searchsorted(i, (first, z)))
            each[i[s] - first, j[s]] += 0.4 * np.minimum(1.0, n[s] / 10.0)
            other = np.ones(each.shape, bool)
            s = slice(*np.searchsorted(own_i, (first, z)))
            other[own_i[s] - first, own_j[s]] = False
            each, other = each.ravel(), other.ravel()
            order = np.argsort(each)
            for k in range(0, len(order), PAIRS_AT_ONCE):
                at = order[k : k + PAIRS_AT_ONCE]
                at = at[other[at]]
                x, y = np.divmod(at, len(m2))
                yield pa.table([m1.take(pa.array(x + first)), m2.take(pa.array(y)), pa.array(each[at])], names=["m1", "m2", "affinity"])
            first = z

    kind = v.schema["memory_id"].dataType.simpleString()
    return paired(v.withColumnRenamed("memory_id", "m2"), "m2", own, "m1", meet, f"m1 {kind}, m2 {kind}, affinity double", row_block=PAIR_BLOCK, asked_block=PAIR_BLOCK, links=each)


def nearness(e1, t1, e2, t2, most: int | None = None):
    """Piece by piece (first, end, values): 0.3 of nearness of times in microseconds and 0.3 of cosine of Arrow columns of vectors and times, each of the first two columns
    with all of the others; 0.5 where one is missing. A piece has about most values, PAIRS_AT_ONCE unless it is given."""
    import numpy as np

    def units(column):
        rows = column.to_pylist()
        size = np.array([-1 if x is None else len(x) for x in rows], int)
        x = np.zeros((len(rows), max(1, size.max(initial=0))))
        for k, r in enumerate(rows):
            if r and None not in r:  # a vector with a gap is near to none
                x[k, : len(r)] = r
        length = np.linalg.norm(x, axis=1, keepdims=True)
        return size, np.divide(x, length, out=np.zeros_like(x), where=length != 0)

    def times(column):
        t = column.to_pylist()
        return np.array([x is not None for x in t], bool), np.array([x or 0 for x in t], np.int64)

    (size_a, a), (size_b, b), (has_a, ta), (has_b, tb) = units(e1), units(e2), times(t1), times(t2)
    width = min(a.shape[1], b.shape[1])  # vectors of different lengths have no cosine
    plain = len(set(size_a) | set(size_b)) == 1 and size_b[0] >= 0 if len(size_a) and len(size_b) else False
    step = max(1, (most or PAIRS_AT_ONCE) // max(1, len(tb)))
    for i in range(0, max(1, len(ta)), step):  # of no rows, a piece of none
        s = slice(i, i + step)
        sem = (a[s, :width] @ b[:, :width].T + 1) / 2
        if not plain:
            sem = np.where(size_a[s, None] == size_b[None], sem, 0.5)
            sem[size_a[s] < 0] = 0.5
        time = np.where(has_a[s, None] & has_b[None], np.exp(-(np.abs(ta[s, None] - tb[None]) / 1e6) / 86400.0), 0.5)
        yield i, min(i + step, len(ta)), 0.3 * time + 0.3 * sem


def pulls(affinities: DataFrame, clusters: DataFrame, energy: DataFrame) -> DataFrame:
    """memory_id, cluster, pull of each m1 of affinities (m1, m2, affinity): mean affinity to the members of each other cluster, times its energy
    (0.5 if unknown)."""
    way = affinities.select("m1", "m2", "affinity").toDF("memory_id", "other", "affinity")
    at = clusters.select(F.col("memory_id").alias("other"), F.col("cluster").alias("target"))
    rows = way.join(at, "other").join(clusters.select("memory_id", "cluster"), "memory_id").where("target <> cluster")
    mean = rows.groupBy("memory_id", F.col("target").alias("cluster")).agg(F.avg("affinity").alias("a"))
    return mean.join(energy, "cluster", "left").select("memory_id", "cluster", (F.col("a") * F.coalesce("energy", F.lit(0.5))).alias("pull"))


def flow(clusters: DataFrame, pull: DataFrame, rate: float = 0.1) -> DataFrame:
    """All memories decide at once: to the cluster of the strongest pull, if over rate; ties to the lesser cluster."""
    w = Window.partitionBy("memory_id").orderBy(F.col("pull").desc(), "cluster")
    best = pull.withColumn("n", F.row_number().over(w)).where("n = 1").select("memory_id", F.col("cluster").alias("to"), "pull")
    moved = F.coalesce(F.col("pull") > rate, F.lit(False))
    return clusters.join(best, "memory_id", "left").select("memory_id", F.when(moved, F.col("to")).otherwise(F.col("cluster")).alias("cluster"), moved.alias("moved"))


def centroids(vectors: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, centroid: means by place, aggregated in part before the shuffle."""
    rows = vectors.join(clusters, "memory_id").select("cluster", F.posexplode("embedding").alias("i", "x"))
    mean = rows.groupBy("cluster", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return mean.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def cluster_energy(energy: DataFrame, clusters: DataFrame, accessed: DataFrame) -> DataFrame:
    """Each access adds 0.05 up to 1, then all fall by a hundredth; those under 0.1 go."""
    hits = accessed.join(clusters, "memory_id").groupBy("cluster").agg(F.count("*").alias("n"))
    both = energy.join(hits, "cluster", "full")
    now = F.least(F.lit(1.0), F.coalesce("energy", F.lit(0.5)) + 0.05 * F.coalesce("n", F.lit(0))) * 0.99
    return both.select("cluster", now.alias("energy")).where("energy >= 0.1")


def kmeans(vectors: DataFrame, k: int = 64, seed: int = 42) -> DataFrame:
    """memory_id, cluster by k-means of Spark ML."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("memory_id", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    return KMeans(k=k, seed=seed).fit(rows).transform(rows).select("memory_id", F.col("prediction").alias("cluster"))


def drift(contexts: DataFrame, momentum: float = 0.95, before: DataFrame | None = None) -> DataFrame:
    """memory_id, drift from (memory_id, at, context): the first context, or the drift before, then momentum of the old and the rest of the new, in order."""
    contexts = contexts.select("memory_id", "at", F.col("context").cast("array<double>").alias("context"))
    if before is not None:
        contexts = before.select("memory_id", F.lit(None).alias("at"), F.col("drift").alias("context")).unionByName(contexts)  # nulls sort first
    rows = contexts.groupBy("memory_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "context"))), lambda x: x["context"]).alias("c"))
    step = lambda a, x: F.zip_with(a, x, lambda o, n: o * momentum + n.cast("double") * (1 - momentum))
    first = F.transform(F.col("c")[0], lambda x: x.cast("double"))
    return rows.select("memory_id", F.aggregate(F.slice("c", 2, F.greatest(F.lit(1), F.size("c"))), first, step).alias("drift"))


def drifted(base: DataFrame, drifts: DataFrame, share: float = 0.3) -> DataFrame:
    rows = base.join(drifts, "memory_id", "left")
    mixed = F.zip_with("embedding", "drift", lambda b, d: b.cast("double") * (1 - share) + d * share)
    return rows.select("memory_id", F.when(F.col("drift").isNull(), F.transform("embedding", lambda x: x.cast("double"))).otherwise(mixed).alias("embedding"))


def stored(synapses: DataFrame, more: DataFrame, known: int = 0) -> DataFrame:
    """Weights after more (m1, m2, weight) in either order: old ones grow up to 1, new ones stand as they come, over 1 too. known: about how many there are of
    either, by which the shuffle is cut."""
    own = cut(more.select(F.least("m1", "m2").alias("m1"), F.greatest("m1", "m2").alias("m2"), "weight"), known).groupBy("m1", "m2").agg(F.sum("weight").alias("add"))
    both = cut(synapses.select("m1", "m2", "weight"), known).join(own, ["m1", "m2"], "full")
    return both.select("m1", "m2", F.when(F.col("weight").isNull(), F.col("add")).otherwise(F.least(F.lit(1.0), F.col("weight") + F.coalesce("add", F.lit(0.0)))).alias("weight"))


def recent_access(accessed: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Accesses (memory_id, at) of the last days."""
    return accessed.where(F.to_timestamp("at") > F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def cluster_summary(clusters: DataFrame, energy: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster").agg(F.count("*").alias("members")).join(energy, "cluster", "left").select("cluster", "members", F.coalesce("energy", F.lit(0.5)).alias("energy"))
