"""Benchmark decontamination by a BM25 index of test items, read by block-max WAND."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import buffers, documents, mix, pick, shingles, split_by_size, texts, words, written

K1, B = 1.2, 0.75
#: A passage is retrieved for an item from this share of the item's score for its own text.
SHARE = 0.5
#: Words of the n-grams that are held against question and answer, and the least share of each that a document must have.
GRAM, OVERLAP = 5, 0.5
#: Items in a block, and in an index; more items are split into indexes, which bounds an index's table of blocks.
BLOCK, INDEX_ITEMS = 8, 1024
#: Bytes of test items that are sent to the executors at once; with more, documents are read again for each share.
SENT_BYTES = 8 << 20


@dataclass
class Statistics:
    """Of all items, whatever share of them an index holds: their number, mean and largest number of words, and for sorted terms the number of items that have them."""

    n: int
    mean: float
    longest: int
    terms: np.ndarray
    df: np.ndarray

    @classmethod
    def of(cls, items: list[str]) -> Statistics:
        h, _, _, before = words(*buffers(pa.array(items, pa.string())))
        n = np.diff(before)
        own = _each(h, before)[0]
        terms, df = np.unique(own, return_counts=True)
        return cls(len(items), float(n.mean()) if len(n) else 0.0, int(n.max()) if len(n) else 0, terms, df)


def _each(h: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of each text, and their texts."""
    of = np.repeat(np.arange(len(before) - 1), np.diff(before))
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.append(True, (h[1:] != h[:-1]) | (of[1:] != of[:-1]))[: len(h)]
    return h[new], of[new]


class Index:
    """An inverted index: for each term, items in order with their BM25 weights, and the largest weight in each block of items.

    Weights are divided by what their item needs, so an item is retrieved at a sum of 1. Items that share their most
    frequent term stand together, which keeps the blocks' largest weights close to the items'. Document frequencies, the mean
    length and the passages' length are those of all items (seen), so an item's scores don't depend on what shares its index.
    """

    def __init__(self, items: list[tuple[int, str]], seen: Statistics | None = None):
        seen = seen or Statistics.of([t for _, t in items])
        h, _, _, before = words(*buffers(pa.array([t for _, t in items], pa.string())))
        common = dict(zip(*np.unique(h, return_counts=True)))
        most = [max(((common[w], w) for w in h[a:b]), default=(0, 0)) for a, b in zip(before, before[1:])]
        order = sorted(range(len(items)), key=lambda i: (*most[i], items[i]))
        items = [items[i] for i in order]
        self.ids = [i for i, _ in items]
        h, _, _, before = words(*buffers(pa.array([t for _, t in items], pa.string())))
        n = np.diff(before)
        self.length = seen.longest
        of = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((of, h))
        term, item = h[order], of[order]
        first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (item[1:] != item[:-1]))) if len(term) else np.zeros(0, int)
        tf = np.diff(np.append(first, len(term)))
        term, item = term[first], item[first]
        self.terms, start = np.unique(term, return_index=True)
        self.start, self.item = np.append(start, len(term)), item
        df = np.diff(self.start)
        everywhere = seen.df[np.searchsorted(seen.terms, self.terms)]
        idf = np.log(1 + (seen.n - everywhere + 0.5) / (everywhere + 0.5))
        weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n[item] / max(1.0, seen.mean))) if len(term) else np.zeros(0)
        self.own = np.bincount(item, weight, minlength=len(n)) if len(term) else np.zeros(len(n))
        self.weight = weight / np.maximum(SHARE * self.own[item], 1e-9)
        self.block = np.zeros((len(self.terms), -(-len(n) // BLOCK)), np.float32)
        np.maximum.at(self.block, (np.repeat(np.arange(len(df)), df), item // BLOCK), np.nextafter(self.weight.astype(np.float32), np.float32(9)))
        self.postings = []
        where = np.repeat(np.arange(len(df)), df)
        for b in range(self.block.shape[1]):
            mine = item // BLOCK == b
            own, row = np.unique(where[mine], return_inverse=True)
            dense = np.zeros((len(own), BLOCK))
            dense[row, item[mine] - b * BLOCK] = self.weight[mine]
            self.postings.append((own, dense))
        # n-grams of question (the first half of the words) and answer, with their items; a half of fewer words is one window
        self.parts, self.sizes = [], {GRAM}
        for cut in (0, 1):
            half = [(h[a : a + (b - a + 1) // 2] if cut == 0 else h[a + (b - a + 1) // 2 : b]) for a, b in zip(before, before[1:])]
            self.sizes |= {len(x) for x in half if 0 < len(x) < GRAM}
            self.parts.append(shingles(np.concatenate(half) if half else h, np.append(0, np.cumsum([len(x) for x in half])).astype(int), GRAM))

    def passages(self, h: np.ndarray, before: np.ndarray):
        """Every passage as a query: (text, first word, last word, item, score) of all items at 1 or over.

        Passages are windows of twice the longest item's words that share half with the next, so that an item lies whole in
        one. Two levels of WAND: a passage goes on to a block of items only if the blocks' largest weights of its distinct
        terms add up to 1; there, cursors of the terms' postings skip to the block, and its items are scored.
        """
        if not len(self.terms) or not len(h):
            return
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        hit = self.terms[at] == h
        n = np.diff(before)
        step = max(1, self.length)
        count = np.where(n > 0, np.maximum(1, -(-n // step) - 1), 0)
        of = np.repeat(np.arange(len(n)), count)
        first = before[of] + step * (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count))
        last = np.minimum(first + 2 * step, before[of + 1])
        places = np.flatnonzero(hit)
        lo, hi = np.searchsorted(places, first), np.searchsorted(places, last)
        wide = len(self.terms)
        for a in range(0, len(of), 2048):
            z = min(a + 2048, len(of))
            many = hi[a:z] - lo[a:z]
            if not many.sum():
                continue
            window = np.repeat(np.arange(z - a), many)
            k = np.repeat(lo[a:z], many) + np.arange(len(window)) - np.repeat(np.cumsum(many) - many, many)
            pair = np.unique(window * wide + at[places[k]])
            window, term = pair // wide, pair % wide
            begin = np.flatnonzero(np.append(True, window[1:] != window[:-1]))
            bound = np.add.reduceat(self.block[term], begin, axis=0)
            end = np.append(begin[1:], len(term))
            for b in np.flatnonzero((bound >= 1 - 1e-5).any(axis=0)):
                ws = np.flatnonzero(bound[:, b] >= 1 - 1e-5)
                size = end[ws] - begin[ws]
                k = np.repeat(begin[ws], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                for w, item, score in self.scores(term[k], np.repeat(np.arange(len(ws)), size), int(b)):
                    i = a + int(window[begin[ws[w]]])
                    yield int(of[i]), int(first[i]), int(last[i]), item, score

    def scores(self, terms: np.ndarray, window: np.ndarray, block: int):
        """(window, item, score) of the items of a block that reach 1, from the distinct terms of some windows: the postings'
        cursors go to the block, so terms without one there cost a search only."""
        own, weight = self.postings[block]
        at = np.minimum(np.searchsorted(own, terms), len(own) - 1)
        there = own[at] == terms
        at, window = at[there], window[there]
        if not len(at):
            return
        begin = np.flatnonzero(np.append(True, window[1:] != window[:-1]))
        total = np.add.reduceat(weight[at], begin, axis=0)
        for w, k in zip(*np.nonzero(total >= 1)):
            yield int(window[begin[w]]), block * BLOCK + int(k), float(total[w, k])

    def verified(self, h: np.ndarray, item: int) -> tuple[float, float]:
        """The shares of question's and answer's n-grams that a passage has; a half without words counts as there."""
        seen = np.unique(np.concatenate([self._windows(h, k) for k in self.sizes]))
        out = []
        for g, gi in self.parts:
            mine = g[gi == item]
            out.append(float(np.isin(mine, seen).mean()) if len(mine) else 1.0)
        return out[0], out[1]

    @staticmethod
    def _windows(h: np.ndarray, k: int) -> np.ndarray:
        if len(h) < k:
            return np.zeros(0, np.uint64)
        out = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            out = mix(out + h[j : len(h) - k + 1 + j] + np.uint64(j + 1))
        return out


def statistics(rows: DataFrame) -> tuple[DataFrame, tuple[int, float, int]]:
    """Of all items (text): (term, n), the number of items with each term, written; and the number, mean and largest number of words of items."""

    def run(batches):
        for b in split_by_size(batches, "text"):
            h, _, _, before = words(*buffers(b.column(0)))
            terms, n = np.unique(_each(h, before)[0], return_counts=True)
            size = np.diff(before)
            yield pa.record_batch([pa.array(np.append(terms.view(np.int64), 0)), pa.array(np.append(n, len(size))), pa.array(np.append(np.zeros(len(n), np.int64), size.sum())), pa.array(np.append(np.full(len(n), -1), size.max()))], names=["term", "n", "words", "longest"])

    counts = written(rows.select("text").mapInArrow(run, "term long, n long, words long, longest long"), "item-terms")
    n, total, longest = counts.where("longest >= 0").agg(F.sum("n"), F.sum("words"), F.max("longest")).first()
    return written(counts.where("longest < 0").groupBy("term").agg(F.sum("n").alias("n")), "item-frequencies"), (n or 0, (total or 0) / max(1, n or 0), longest or 0)


def contamination(docs: DataFrame, items: DataFrame, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """doc_id, item_id, score, question and answer of each document and test item that it holds: the best passage's BM25 score
    and the shares of the item's n-grams in it. Documents without a hit have no row.

    Document frequencies, mean length and passage length are counted over all items first. The items' size is read; shares of sent_bytes
    of text at most are sent to the executors, each with the frequencies of its own terms, and read against all documents, so what is sent at
    once is bounded, however many items there are, and a score is the same with any number of shares. Each share is a pass over the documents.
    Every passage of every whole text is a query. Null and empty texts or items match nothing; equal items are found
    each; documents that repeat are found each; a null doc_id or item_id stays null; empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = pick(items, "item_id", "text").select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = max(1, -(-size // sent_bytes))
    frequencies, (n, mean, longest) = statistics(rows)
    out = None
    for p in range(parts):
        own = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p)
        got = [(r[0], r[1]) for r in own.orderBy("item_id", "text").toLocalIterator()]
        h = np.unique(words(*buffers(pa.array([t for _, t in got], pa.string())))[0])
        few = frequencies
        if parts > 1:
            few = frequencies.join(spark.createDataFrame(pa.table({"term": h.view(np.int64)})), "term", "left_semi")
        df = few.toArrow()  # the terms of a share
        order = np.argsort(df.column("term").to_numpy().view(np.uint64))
        seen = Statistics(n, mean, longest, df.column("term").to_numpy().view(np.uint64)[order], df.column("n").to_numpy()[order])
        sent = spark.sparkContext.broadcast([Index(got[i : i + INDEX_ITEMS], seen) for i in range(0, len(got), INDEX_ITEMS)])
        found = _against(docs, sent)
        out = found if out is None else out.unionByName(found)
    return out


def _against(docs: DataFrame, sent) -> DataFrame:
    def run(batches):
        for b in split_by_size(batches, "text"):
            h, _, _, before = words(*buffers(b.column(1)))
            found: dict[tuple[int, int], tuple[float, float, float]] = {}
            for x in sent.value:
                for text, a, e, item, score in x.passages(h, before):
                    q, w = x.verified(h[a:e], item)
                    if q >= OVERLAP and w >= OVERLAP:
                        key = (text, x.ids[item])
                        found[key] = max(found.get(key, (0.0, 0.0, 0.0)), (score * SHARE * float(x.own[item]), q, w))
            ids = b.column(0).to_pylist()
            rows = [(ids[t], i, *v) for (t, i), v in sorted(found.items(), key=lambda x: (x[0][0], x[0][1] is None, x[0][1] or 0))]
            types = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, types)], names=["doc_id", "item_id", "score", "question", "answer"])

    return texts(docs).mapInArrow(run, "doc_id long, item_id long, score double, question double, answer double")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contamination() of all documents by all items of benchmark; nulls, ties and repeated rows as there."""
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
