"""Source divergence audit: term shares of each source against its peers and its language, by systolic rotation."""

from __future__ import annotations

import heapq
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import documents, in_small_batches, pick, split_by_size, written

#: Documents of a language that must hold a term; terms of a group that are listed; what shares are scaled by, in steps whose products stay longs.
LEAST_DOCS, TOP, SCALE, STEP = 10, 10, 10**9, 1000
#: Entries that a task holds before it sends them on; terms of a shard of a language; entries of a cell of groups in a shard; cells at least.
HELD, SHARD_TERMS, CELL_ENTRIES, CELLS = 1_000_000, 1 << 18, 1 << 21, 6
#: Letters, and all bytes of characters beyond ASCII.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_BITS = 40  # a task's count of a term is in the low bits of a number, its documents in those above


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) summed by task: occurrences of each term in the whole texts of a group, and how many of its documents hold it."""

    def run(batches):
        held, size, seen = {}, 0, 0

        def out():
            for (lang, source), terms in held.items():
                keys, v = list(terms), np.fromiter(terms.values(), np.int64, len(terms))
                for i in range(0, len(keys), 1 << 16):
                    k, x = keys[i : i + (1 << 16)], v[i : i + (1 << 16)]
                    yield pa.record_batch([pa.array([lang] * len(k), pa.string()), pa.array([source] * len(k), pa.string()), pa.array(k, pa.binary()).cast(pa.string()), pa.array(x & ((1 << _BITS) - 1)), pa.array(x >> _BITS)], names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for b in split_by_size(batches, "text"):
            for lang, source, text in zip(*(b.column(i).to_pylist() for i in (0, 1)), b.column(2).cast(pa.binary()).to_pylist()):
                terms = held.setdefault((lang, source), {})
                before = len(terms)
                for term, n in Counter(TERM.findall(text.lower())).items():  # bytes.lower() changes A-Z only
                    terms[term] = terms.get(term, 0) + n + (1 << _BITS)
                size += len(terms) - before
                seen += 1
                if size > HELD or seen >> (62 - _BITS):
                    yield from out()
                    size = seen = 0
        yield from out()

    return docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def shares(count: np.ndarray, total: np.ndarray, v: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * v)), by long division, so exact for totals up to 2^53."""
    below, rest = total + 2 * v, count + 2
    out = rest // below
    rest = rest % below
    scale = SCALE
    while scale > 1:
        rest = rest * STEP
        out = out * STEP + rest // below
        rest = rest % below
        scale //= STEP
    return out + 1


def apart(p, q):
    return (p - q) * (p - q) // (p + q)


class Vector:
    """A group's terms in a shard: sorted ids and shares, the share of a term it lacks, and what its rows are named by."""

    def __init__(self, source: str, total: int, v: int, ids: bytes, counts: bytes, size: int):
        self.source, self.total, self.v = source, total, v
        self.ids = np.cumsum(np.frombuffer(pa.decompress(ids, size * 8, "zstd"), np.int64)) if size else np.zeros(0, np.int64)
        n = np.frombuffer(pa.decompress(counts, size * 8, "zstd"), np.int64) if size else np.zeros(0, np.int64)
        self.p = shares(n, np.int64(total), np.int64(v)) if size else n
        self.none = int(shares(np.zeros(1, np.int64), np.int64(total), np.int64(v))[0]) if v else 1

    def meet(self, other: Vector) -> tuple[int, int]:
        """The sum over the terms that one of the two has, and their number."""
        at = np.searchsorted(other.ids, self.ids)
        both = np.zeros(len(self.ids), bool)
        inside = at < len(other.ids)
        both[inside] = other.ids[at[inside]] == self.ids[inside]
        left = np.ones(len(other.ids), bool)
        left[at[both]] = False
        q = np.full(len(self.ids), other.none, np.int64)
        q[both] = other.p[at[both]]
        return int(apart(self.p, q).sum() + apart(other.p[left], self.none).sum()), len(self.ids) + int(left.sum())


_MET = "lang string, source string, item string, value long, terms long, total long, item_total long, v long"


def _met(lang: str, pairs) -> pa.Table:
    """Rows of both directions of each meeting."""
    rows = []
    for a, b in pairs:
        value, terms = a.meet(b)
        rows += [(lang, a.source, b.source, value, terms, a.total, b.total, a.v), (lang, b.source, a.source, value, terms, b.total, a.total, a.v)]
    kinds = [pa.string()] * 3 + [pa.int64()] * 5
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in _MET.split(", ")])


def _vectors(table: pa.Table) -> list[Vector]:
    return [Vector(*row) for row in zip(*(table.column(c).to_pylist() for c in ("source", "total", "v", "ids", "counts", "size")))]


def _pack(key, table):
    ids, n = table.column("id").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(ids)
    packed = [pa.compress(x.astype(np.int64).tobytes(), "zstd", asbytes=True) for x in (np.diff(ids[order], prepend=0), n[order])]
    return pa.table([pa.array([k.as_py()], k.type) for k in key] + [pa.array([x], pa.binary()) for x in packed] + [pa.array([len(ids)], pa.int64())], names=["lang", "source", "shard", "ids", "counts", "size"])


def _opponent(turn: int, n: int) -> Column:
    """Whom each of n cells meets in a turn of a tournament by the circle method; n is even, turns are 0 to n - 2."""
    m = n - 1
    own = F.pmod(F.lit(turn) - F.col("cell"), F.lit(m))
    return F.when(F.col("cell") == m, F.lit(turn * (m + 1) // 2 % m)).when(own == F.col("cell"), F.lit(m)).otherwise(own)


def rotated(pieces: DataFrame, cells: int) -> DataFrame:
    """All meetings of the groups of a language, each shard by itself: rows as _MET.

    The cells of groups stay in their partitions. In each of cells - 1 rounds, one of the two cells that meet is sent, compressed, to
    the other one's partition, so that what moves at once is half the vectors, and what a task holds is two cells. First, each cell's own groups meet.
    A round's rows are a written table.
    """
    spark, at = pieces.sparkSession, ["lang", "shard", "cell"]
    home = pieces.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *at).persist()

    def own(key, table):
        v = _vectors(table)
        return _met(key[0].as_py(), ((a, b) for i, a in enumerate(v) for b in v[:i]))

    def visit(key, resident, guests):
        v = _vectors(resident)
        return _met(key[0].as_py(), ((a, b) for b in _vectors(guests) for a in v))

    out = [written(home.groupBy(*at).applyInArrow(own, _MET), "met")]
    for turn in range(cells - 1):
        met = home.withColumn("other", _opponent(turn, cells).cast("int"))
        guests = met.where("cell > other").withColumn("cell", F.col("other")).drop("other")
        hosts = met.where("cell < other").drop("other")
        out.append(written(hosts.groupBy(*at).cogroup(guests.groupBy(*at)).applyInArrow(visit, _MET), "met"))
    home.unpersist()
    every = out[0]
    for x in out[1:]:
        every = every.unionByName(x)
    return every


def _heaps(batches):
    """The TOP terms of each group that a task sees, by value, then by the lesser term."""
    held, size = {}, 0

    def out():
        rows = [(lang, source, term, value) for (lang, source), h in held.items() for value, term in heapq.nsmallest(TOP, h)]
        held.clear()
        return pa.record_batch([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)] + [pa.array([r[2] for r in rows], pa.binary()).cast(pa.string()), pa.array([-r[3] for r in rows], pa.int64())], names=["lang", "source", "item", "value"])

    for b in batches:
        n, lang_n, total, lang_total, v = (b.column(i).to_numpy() for i in range(3, 8))
        p, q = shares(n, total, v), shares(lang_n, lang_total, v)
        more = np.flatnonzero(p > q)
        value = apart(p[more], q[more])
        rows = b.take(pa.array(more))
        for lang, source, term, x in zip(*(rows.column(i).to_pylist() for i in (0, 1)), rows.column(2).cast(pa.binary()).to_pylist(), value.tolist()):
            h = held.setdefault((lang, source), [])
            h.append((-x, term))
            size += 1
            if len(h) >= 8 * TOP:
                size -= len(h) - TOP
                h[:] = heapq.nsmallest(TOP, h)
        if size > HELD:
            yield out()
            size = 0
    yield out()


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, shard_terms: int = SHARD_TERMS, cell_entries: int = CELL_ENTRIES) -> DataFrame:
    """lang, source, part, item, value, rank: of each group (lang, source) that occurs, its distance from each other source of the language
    (part `pair`), and its TOP terms that are more frequent in it than in the language (part `term`).

    A term is a run of letters and of characters beyond ASCII, A-Z lower-cased; a language keeps those in least_docs of its rows or more. Shares and
    distances are integers: p = 1 + floor(10^9 * (n + 2) / (N + 2 * V)), value the sum of floor((p - q)^2 / (p + q)). Ties go to the lesser item.

    Terms are counted in the tasks before they are shuffled, so a source with a third of the rows is no hot key, and a group's vector has a number for
    each of its terms only: what two groups both lack is added as one product. Vectors are cut into shards of shard_terms terms, and groups into
    cells of cell_entries numbers on average, so no task holds more than two cells.

    Null texts, languages and sources are empty ones; rows that repeat count each; a group without terms is listed with its pairs; a language that keeps
    no term has pairs of value 0; an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    in_small_batches(spark)
    rows = pick(docs, "lang", "source", "text").select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = term_counts(rows).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    kept = counts.withColumn("row", F.monotonically_increasing_id()).withColumns({"docs": F.sum("docs").over(w), "lang_n": F.sum("n").over(w), "id": F.min("row").over(w)})
    kept = written(kept.where(F.col("docs") >= least_docs).select("lang", "source", "term", "n", "lang_n", "id", (F.col("row") == F.col("id")).alias("first")), "terms")
    langs = kept.where("first").groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("total", "v", "lang_total")}
    groups = written(rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").withColumns(zero), "groups")

    full = kept.join(groups, ["lang", "source"])
    heaped = full.select("lang", "source", "term", "n", "lang_n", "total", "lang_total", "v").mapInArrow(_heaps, "lang string, source string, item string, value long")
    by_value = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = heaped.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= TOP)

    shard = F.greatest(F.ceil(F.col("v") / shard_terms), F.lit(1))
    packed = full.select("lang", "source", F.pmod(F.xxhash64("id"), shard).cast("int").alias("shard"), "id", "n").groupBy("lang", "source", "shard").applyInArrow(_pack, "lang string, source string, shard int, ids binary, counts binary, size long")
    packed = written(packed, "vectors")
    most = packed.groupBy("lang", "shard").agg(F.sum("size").alias("n")).agg(F.max("n")).first()[0] or 0
    cells = max(CELLS, 2 * -(-most // (2 * cell_entries)))
    grid = groups.select("lang", "source", "total", "v", F.explode(F.sequence(F.lit(0), shard.cast("int") - 1)).alias("shard"), F.pmod(F.xxhash64("lang", "source"), F.lit(cells)).cast("int").alias("cell"))
    pieces = grid.join(packed, ["lang", "source", "shard"], "left").withColumn("size", F.coalesce("size", F.lit(0).cast("long")))
    none = lambda total: F.expr(f"1 + (2 * {SCALE}L) div greatest({total} + 2 * v, 1)")
    met = rotated(written(pieces, "pieces"), cells).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("terms").alias("terms"), *[F.first(c).alias(c) for c in ("total", "item_total", "v")])
    met = met.withColumns({"p": none("total"), "q": none("item_total")}).withColumn("value", F.expr("value + (v - terms) * ((p - q) * (p - q) div (p + q))"))
    pairs = met.select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(by_value))
    return pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """divergence() of all documents; nulls, ties and repeated rows as there."""
    return divergence(documents(spark, sf_dir))


ORACLE = r"""WITH docs AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
words AS MATERIALIZED (SELECT doc, lang, source, unnest(terms) AS term FROM docs),
kept AS MATERIALIZED (SELECT lang, term, count(*)::HUGEINT AS n FROM words GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM docs),
full_groups AS MATERIALIZED (SELECT lang, source, term, coalesce(c.n, 0)::HUGEINT AS n, k.n AS lang_n FROM groups JOIN kept k USING (lang)
LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM words GROUP BY ALL) c USING (lang, source, term)),
p AS MATERIALIZED (SELECT lang, source, term, n, 1 + 1000000000 * (n + 2) // (sum(n) OVER (PARTITION BY lang, source)::HUGEINT + 2 * v) AS p, 1 + 1000000000 * (lang_n + 2) // (total + 2 * v) AS q FROM full_groups JOIN langs USING (lang)),
met AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN met m ON m.lang = a.lang AND m.source = a.source AND m.item = b.source),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10"""
