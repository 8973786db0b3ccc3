"""Connected components over an edge table, without bringing edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import delete, spread_join, written


#: Edges of a node from which on they are spread.
HUB = 1000


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of the edges (a, b), longs: root is the least node of its component. An edge of a node to itself, or with a
    null end, joins nothing; edges may repeat; no edges give no rows.

    Alternates the large-star and small-star steps, each of which keeps components and moves edges to lesser
    nodes, until the edges are stars. Each round is a written table, so lost executors repeat a round at most; the round before is
    deleted. Where a node has many edges, its least neighbour goes to them by spread_join(), so they stay spread over the tasks.
    """
    spark = edges.sparkSession

    def round_of(rows: DataFrame) -> tuple[DataFrame, tuple[int, int], str]:
        e = written(rows, name)
        return e, e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first(), e.inputFiles()

    e, before, files = round_of(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u <> v").distinct())
    for _ in range(most_rounds):
        # large star: greater neighbours go to the least of the neighbourhood
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), f"{name}-least")
        most = least.agg(F.max("n")).first()[0] or 0
        greater = both.where("v > u")
        large = spread_join(greater, least, ["u"], "n", 2 * before[0]) if most > HUB else greater.join(least, "u")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()  # a hub's edges mostly go to the same node
        # small star: lesser neighbours and the node itself go to the least
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        old = files
        e, now, files = round_of(small)
        delete(spark, sorted({f.rsplit("/", 1)[0] for f in [*old, *least.inputFiles()]}))
        if before == now:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
