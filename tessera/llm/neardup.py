"""MinHash near-duplicates by DartMinHash signatures."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import buffers, documents, freed, mix, shingles, split_by_size, spread_join, texts, words, written
from tessera.llm.graph import components

#: A band of ROWS coordinates; BANDS of them find a pair of similarity 0.8 with probability 0.9987.
BANDS, ROWS = 22, 6
#: Words of a shingle and least similarity.
SIZE, LEAST = 5, 0.8
#: A signature tells similarity within SURE at over three standard deviations; nearer to LEAST, shingles are compared.
SURE = 0.1
_SIGN = "doc_id long, ch1 long, ch2 long, size int, bands array<long>, sig binary"


def weighted(h: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit cells of weighted elements: an element that a text has n times is the cells (element, 0) to (element, n - 1).
    Gives the cells' hashes, their texts, both by text, and for each cell its number within the element."""
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(new)
    copy = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    return mix(h + np.uint64(0x51ED270B) * copy.astype(np.uint64)), of, copy


def signatures(cells: np.ndarray, of: np.ndarray, n: int, k: int) -> np.ndarray:
    """DartMinHash of n weighted sets: k coordinates each, 64-bit; equal with the probability of their weighted similarity.

    Darts fall on each unit cell at the times of a Poisson process, seeded by the cell's hash, so that sets that
    share a cell share its darts; a dart also draws a coordinate. Only darts before a time that shrinks with the set's
    weight are made, k (ln k + 4) of them expected, whatever the weight. The earliest dart of each coordinate stays.
    Sets with a coordinate without a dart are thrown at again for twice the time.
    """
    out = np.full(n * k, ~np.uint64(0))
    weight = np.bincount(of, minlength=n)
    limit = np.where(weight > 0, k * (math.log(k) + 4) / np.maximum(weight, 1), 0)
    open_ = weight > 0
    while open_.any():
        live = open_[of]
        c, o, time, turn = cells[live], of[live], np.zeros(int(live.sum()), np.float32), 0
        while len(c):
            turn += 1
            dart = mix(c + np.uint64(turn * 0x9E3779B97F4A7C15 % 2**64))
            time = time - np.log((((dart >> np.uint64(40)).astype(np.float32)) + 0.5) * np.float32(2.0**-24))
            keep = time < limit[o]
            c, o, time, dart = c[keep], o[keep], time[keep], mix(dart[keep])
            place = o * k + (dart >> np.uint64(33)).astype(np.int64) % k
            np.minimum.at(out, place, (time.view(np.uint32).astype(np.uint64) << np.uint64(32)) | (dart & np.uint64(0xFFFFFFFF)))
        empty = (out.reshape(n, k) == ~np.uint64(0)).any(axis=1)
        open_ &= empty
        limit = np.where(open_, limit * 2, limit)
    return mix(out).reshape(n, k)


def content(cells: np.ndarray, of: np.ndarray, n: int) -> list[pa.Array]:
    """A 128-bit hash of each of n multisets, as two longs; null for an empty one."""
    has = np.bincount(of, minlength=n) > 0
    sums = np.zeros((2, n), np.uint64)
    for r, x in enumerate((mix(cells + np.uint64(1)), mix(cells + np.uint64(2)))):
        np.add.at(sums[r], of, x)
    return [pa.array(x.view(np.int64), pa.int64(), mask=~has) for x in sums]


def sign(docs: DataFrame) -> DataFrame:
    """doc_id, a 128-bit hash of the multiset of shingles (null without a word), its size, band hashes and 16 bits a coordinate."""

    def run(batches):
        for b in split_by_size(batches, "text", 1 << 20):
            h, _, _, before = words(*buffers(b.column(1)))
            s, of = shingles(h, before, SIZE)
            n, k = b.num_rows, BANDS * ROWS
            cells, of, _ = weighted(s, of)
            sig = signatures(cells, of, n, k)
            bands = np.zeros((n, BANDS), np.uint64)
            for r in range(ROWS):
                bands = mix(bands + sig.reshape(n, BANDS, ROWS)[:, :, r])
            low = (sig & np.uint64(0xFFFF)).astype(np.uint16)
            yield pa.record_batch(
                [
                    b.column(0),
                    *content(cells, of, n),
                    pa.array(np.bincount(of, minlength=n), pa.int32()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS), pa.int32()), pa.array(bands.view(np.int64).ravel())),
                    pa.array([x.tobytes() for x in low], pa.binary()),
                ],
                names=["doc_id", "ch1", "ch2", "size", "bands", "sig"],
            )

    return texts(docs).mapInArrow(run, _SIGN)


def estimated(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """pairs (a, b) of nodes with est, the share of equal coordinates. A node without a signature drops its pairs; pairs that repeat stay."""

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint16).reshape(b.num_rows, -1) for i in (2, 3))
            yield pa.record_batch([b.column(0), b.column(1), pa.array((x == y).mean(axis=1) if b.num_rows else [], pa.float64())], names=["a", "b", "est"])

    sig = signed.select("node", "sig")  # a leader of a hot bucket is an end of many pairs; adaptive execution splits what is too large for a task
    both = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b")
    return both.mapInArrow(run, "a long, b long, est double")


def cell_sets(docs: DataFrame, nodes: DataFrame, broadcast_ids: int = 200_000) -> DataFrame:
    """(node, cells): sorted 32-bit hashes of the unit cells of the multisets of nodes (node, doc, ch1, ch2), where doc is a document that has
    it. Only those documents are read again: ids go to them by broadcast if they are broadcast_ids at most, which is counted first, else
    by a shuffled semi-join."""
    nodes = written(nodes, "open-nodes")
    ids = nodes.select(F.col("doc").alias("doc_id")).distinct()
    ids = F.broadcast(ids) if nodes.count() <= broadcast_ids else ids

    def run(batches):
        for b in split_by_size(batches, "text", 1 << 20):
            h, _, _, before = words(*buffers(b.column(1)))
            cells, of, _ = weighted(*shingles(h, before, SIZE))
            cut = np.searchsorted(of, np.arange(b.num_rows + 1))
            small = (cells >> np.uint64(32)).astype(np.uint32)
            yield pa.record_batch([b.column(0), *content(cells, of, b.num_rows), pa.array([np.unique(small[i:j]).tobytes() for i, j in zip(cut, cut[1:])], pa.binary())], names=["doc", "ch1", "ch2", "cells"])

    read = texts(docs).join(ids, "doc_id", "left_semi").mapInArrow(run, "doc long, ch1 long, ch2 long, cells binary")
    return read.join(nodes, ["doc", "ch1", "ch2"]).dropDuplicates(["node"]).select("node", "cells")  # rows of a node have the same cells


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard similarity from two arrays of unit cells."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def forest(band: int, root: np.ndarray, block: np.ndarray, bands: np.ndarray, sig: np.ndarray, cells: list[bytes]) -> list[tuple[int, int]]:
    """Links within a bucket that join different components: every pair of members of different components is looked at, nearest
    first by signature, unless a link made before joins the two. A pair whose signatures leave it open is
    decided by its cells. Pairs that share an earlier band are left to that bucket. With two blocks, pairs across them only."""
    two = len(np.unique(block)) > 1
    near: list[np.ndarray] = []
    for x in range(len(root) - 1):
        y = np.flatnonzero(root[x + 1 :] != root[x]) + x + 1
        if two:
            y = y[block[y] != block[x]]
        if len(y) and band:
            y = y[~(bands[y, :band] == bands[x, :band]).any(axis=1)]
        if len(y):
            est = (sig[y] == sig[x]).mean(axis=1)
            ok = est >= LEAST - SURE
            if ok.any():
                near.append(np.column_stack([-est[ok], np.full(ok.sum(), x), y[ok]]))
    if not near:
        return []
    pairs = np.concatenate(near)
    up = {r: r for r in root.tolist()}

    def top(r):
        while up[r] != r:
            up[r] = r = up[up[r]]
        return r

    out, seen = [], {}
    for est, x, y in pairs[np.lexsort((pairs[:, 2], pairs[:, 1], pairs[:, 0]))]:
        x, y = int(x), int(y)
        a, b = top(int(root[x])), top(int(root[y]))
        if a == b:
            continue
        for z in (x, y):
            if z not in seen:
                seen[z] = np.frombuffer(cells[z], np.uint32)
        if -est >= LEAST + SURE or similarity(seen[x], seen[y]) >= LEAST:
            up[a] = b
            out.append((x, y))
    return out


#: Members of a block; a larger bucket is cut into blocks of like sizes, and each two blocks that may hold a link meet in a task.
BLOCK = 256
#: Numbers of shingles are rounded to powers of STEP; sets that are linked differ by a factor of 1 / LEAST at most, so by NEAR powers.
STEP = 1.12
NEAR = int(-math.log(LEAST) / math.log(STEP)) + 1


def in_blocks(placed: DataFrame, mixed: DataFrame, total: int) -> DataFrame:
    """Members (band, h, node, size, root) of the buckets of mixed (band, h, n) as groups (band, h, i, j) of two blocks, or of one that meets
    itself. A bucket of BLOCK members at most is one block. Others are cut by rounded size, then by a hash; blocks meet unless their
    sizes rule a link out, so no pair that may be linked is left out, and pairs that can't be are not made."""
    bucket = ["band", "h"]
    level = F.when(F.col("n") > BLOCK, F.floor(F.log(F.greatest(F.col("size"), F.lit(1)).cast("double")) / math.log(STEP))).otherwise(0)
    rows = spread_join(placed, mixed, bucket, "n", total).withColumn("level", level.cast("long"))
    levels = written(rows.groupBy(*bucket, "level").agg(F.count("*").alias("m")), "levels")
    rows = spread_join(rows.select(*bucket, "node", "root", "level"), levels, [*bucket, "level"], "m", total)
    of = lambda at, part: at * (1 << 32) + part
    rows = rows.select(*bucket, "node", "root", of(F.col("level"), F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / BLOCK))).alias("block"))
    blocks = levels.select(*bucket, "level", F.explode(F.sequence(F.lit(0), F.ceil(F.col("m") / BLOCK) - 1)).alias("part"))
    other = blocks.select(*bucket, F.col("level").alias("to"), of(F.col("level"), F.col("part")).alias("j"))
    meets = blocks.withColumn("to", F.explode(F.expr(f"sequence(level, level + {NEAR})"))).join(other, [*bucket, "to"])
    meets = meets.select(*bucket, of(F.col("level"), F.col("part")).alias("i"), "j").where("i <= j")
    ends = meets.select(*bucket, "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return rows.join(ends, [*bucket, "block"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), a row for each row of docs. Documents are in one class if links of
    similarity 0.8 or more join them: weighted Jaccard of five-word shingles.

    1. Documents with the same multiset of shingles are one node, whatever their number. 2. Each bucket of a band links its
    members to two leaders, its least and greatest node, found by partial aggregation; links that signatures prove join
    nodes to components. 3. In buckets with members of several components, members of different ones are held against
    each other; what comes out is a forest, so never more links than members, and no pair that could join two components is left out.
    So a group of copies costs links in proportion to its size, and what belongs to a hot key reaches its rows by spread_join().

    Null and empty texts, or of spaces only, are classes of their own. A row without doc_id has the class of equal texts that have one, if there
    are any, else none. Rows with the same doc_id are one document, so their texts are in one class. Shorter texts than five words are one
    shingle. An empty table gives no rows. Other columns are ignored.
    """
    signed = written(sign(docs), "signed")
    rows = signed.count()
    reps = signed.where("ch1 is not null").groupBy("ch1", "ch2").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("size", "bands", "sig")])  # the same in all rows of a group
    reps = written(reps.withColumn("node", F.monotonically_increasing_id()), "nodes")
    live = reps.where("doc is not null")
    places = live.count() * BANDS
    buckets = live.select("node", "size", F.posexplode("bands").alias("band", "h"))
    leaders = buckets.groupBy("band", "h").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("low <> high")
    members = written(spread_join(buckets, leaders, ["band", "h"], "n", places), "buckets")  # buckets of two nodes at least
    star = members.select(F.col("node").alias("a"), F.explode(F.array("low", "high")).alias("b")).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sure = estimated(written(star, "stars"), reps).where(F.col("est") >= LEAST + SURE).select("a", "b")
    same = same_documents(signed, reps, rows)
    sure = written(sure if same is None else sure.unionByName(same), "links")
    freed(docs.sparkSession)
    roots = written(components(sure), "roots")
    # what the sure links leave apart, within each bucket
    placed = members.select("band", "h", "node", "size").join(roots, "node", "left").select("band", "h", "node", "size", F.coalesce("root", "node").alias("root"))
    placed = written(placed, "placed")
    mixed = placed.groupBy("band", "h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where("low <> high").select("band", "h", "n")
    groups = written(in_blocks(placed, written(mixed, "mixed"), places), "groups")
    sets = cell_sets(docs, groups.select("node").distinct().join(live, "node").select("node", "doc", "ch1", "ch2"))
    held = groups.join(live.select("node", "bands", "sig").join(sets, "node"), "node")

    def link(key, table):
        order = np.argsort(table.column("node").to_numpy())
        node, root, block = (table.column(n).to_numpy()[order] for n in ("node", "root", "block"))
        bands = np.array(table.column("bands").to_pylist(), np.int64)[order]
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(len(node), -1)[order]
        cells = table.column("cells").to_pylist()
        got = forest(key[0].as_py(), root, block, bands, sig, [cells[i] for i in order])
        return pa.table([pa.array([int(node[x]) for x, _ in got], pa.int64()), pa.array([int(node[y]) for _, y in got], pa.int64())], names=["a", "b"])

    links = held.groupBy("band", "h", "i", "j").applyInArrow(link, "a long, b long")
    links = written(sure.unionByName(written(links, "links")), "all-links")
    freed(docs.sparkSession)
    roots = written(components(links, "classes"), "roots")
    own = written(reps.select("node", "doc", "ch1", "ch2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "own")
    classes = own.groupBy("root").agg(F.min("doc").alias("class_id"))
    classed = own.join(classes, "root").select("ch1", "ch2", "class_id", F.lit(True).alias("worded"))
    out = signed.select("doc_id", "ch1", "ch2").join(classed, ["ch1", "ch2"], "left")
    return out.select("doc_id", F.when(F.col("worded"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def same_documents(signed: DataFrame, reps: DataFrame, rows: int) -> DataFrame | None:
    """Links (a, b) between the nodes of texts that have the same doc_id, if there are any."""
    texts_of = signed.where("doc_id is not null and ch1 is not null").select("doc_id", "ch1", "ch2")
    twice = texts_of.groupBy("doc_id").agg(F.min(F.struct("ch1", "ch2")).alias("low"), F.max(F.struct("ch1", "ch2")).alias("high"), F.count("*").alias("n")).where("low <> high").select("doc_id", "n")
    twice = written(twice, "same-ids")
    if twice.isEmpty():
        return None
    found = spread_join(texts_of, twice, ["doc_id"], "n", rows).select("doc_id", "ch1", "ch2").distinct()
    found = written(found.join(reps.select("ch1", "ch2", "node"), ["ch1", "ch2"]).select("doc_id", "node"), "same-nodes")
    least = found.groupBy("doc_id").agg(F.min("node").alias("b"), F.count("*").alias("n"))
    return spread_join(found, least, ["doc_id"], "n", rows).where("node <> b").select(F.col("node").alias("a"), "b")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates() of all documents, and whether a document is its class's representative; nulls, ties and repeated rows as there."""
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
