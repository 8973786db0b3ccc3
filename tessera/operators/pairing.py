"""Rows held against rows in blocks: a stated set against all rows of a table, by one shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block of either side, on average.
ROWS, ASKED = 16_384, 4096
#: Partitions for each two blocks whose results are of the size of all pairs.
SPREAD = 4


def paired(rows: DataFrame, key: str, asked: DataFrame, asked_key: str, meet: Callable, kinds: str, at: list[str] | None = None, sizes: DataFrame | None = None, row_block: int = ROWS, asked_block: int = ASKED, *, links: DataFrame | None = None) -> DataFrame:
    """meet(rows, asked), two Arrow tables, for each block of rows and each block of asked: the tables it yields, of kinds, are all rows of the result.

    Both sides are cut by a hash of their keys into blocks of about row_block and asked_block rows; a row goes to each block of asked and the other way
    round, so a task holds two blocks, however many rows there are. at: columns of both sides that must be equal; then sizes has a row for each of their
    values, with the numbers of rows n and of asked m, and each value is cut by its own, so that a frequent one is spread over many tasks.
    links: what is known of single pairs, with both keys in columns of these names; each goes to the blocks of its two keys, and is the third table that meet()
    gets. Then what meet() yields leaves the task table by table, for results that are of the size of all pairs, and there are SPREAD times as many partitions
    as blocks that meet, so that few of these share a task, however little of them is shuffled.
    """
    at = at or []
    if sizes is None:
        sizes = rows.agg(F.count("*").alias("n")).crossJoin(asked.agg(F.count("*").alias("m")))  # one row
    cuts = sizes.where("n > 0 and m > 0").select(*at, F.ceil(F.col("n") / row_block).cast("int").alias("_p"), F.ceil(F.col("m") / asked_block).cast("int").alias("_q"))
    both = lambda d: d.join(F.broadcast(cuts), at) if at else d.crossJoin(F.broadcast(cuts))  # noqa: E731  a row for each cell of an index, or one
    part, block = F.pmod(F.xxhash64(key), F.col("_p")).cast("int"), F.pmod(F.xxhash64(asked_key), F.col("_q")).cast("int")
    left = both(rows).withColumn("_part", part).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_q") - 1))).drop("_p", "_q")
    right = both(asked).withColumn("_block", block).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_p") - 1))).drop("_p", "_q")
    where = [*at, "_part", "_block"]

    def run(left, right):
        if not (left.num_rows and right.num_rows):
            left, right = left.slice(0, 0), right.slice(0, 0)
        return pa.concat_tables(meet(left, right))

    if links is None:
        return left.groupBy(*where).cogroup(right.groupBy(*where)).applyInArrow(run, kinds)

    sides, met = [(left, rows.columns), (right, asked.columns), (both(links).withColumn("_part", part).withColumn("_block", block), links.columns)], None
    for i, (side, own) in enumerate(sides):
        one = side.select(*where, F.lit(i).alias("_side"), F.struct(*own).alias(f"_s{i}"))
        met = one if met is None else met.unionByName(one, allowMissingColumns=True)
    names = [own for _, own in sides]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        got: list[list] = [[] for _ in names]
        for b in batches:
            for i, own in enumerate(names):
                s = b.column(f"_s{i}").filter(pc.equal(b.column("_side"), i))
                got[i].append(pa.RecordBatch.from_arrays(s.flatten(), names=own))
        tables = [pa.Table.from_batches(g).combine_chunks() for g in got]
        if tables[0].num_rows and tables[1].num_rows:
            for table in meet(*tables):
                yield from table.to_batches()

    blocks = cuts.agg(F.sum(F.col("_p").cast("long") * F.col("_q"))).first()[0] or 1
    return met.repartition(SPREAD * blocks, *where).groupBy(*where).applyInArrow(stream, kinds)
