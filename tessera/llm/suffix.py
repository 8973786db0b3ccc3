"""Exact substring dedup by bucket-pointer refinement over all suffixes of a corpus."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import buffers, documents, mix, split_by_size, texts, written

#: Bytes of a repeated string, and of the q-grams that make the initial buckets.
LENGTH, Q = 100, 32
#: Windows in a block of an asked region.
STEP = 8
#: Regions that a task holds before it combines and sends them.
HELD = 2_000_000
_C = np.uint64(0x9E3779B97F4A7C15)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bucket of a longer prefix: from the bucket of its begin and the bucket at the later offset."""
    x = a * _C + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def buckets(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket identifiers of the 4-grams and the 32-grams at every place. Each round refines buckets of depth d by the
    identifiers at offset d, the same array, which was updated the round before. An identifier follows from the bytes alone, so
    tasks agree on it without a common table."""
    x, d, four = raw.astype(np.uint64) + np.uint64(1), 1, None
    while d < Q:
        x = _pair(x[: max(0, len(x) - d)], x[d:])
        d *= 2
        if d == 4:
            four = x
    return four, x


def refined(four: np.ndarray, x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Bucket identifiers at depth 100 of some places: 32 to 64 to 96 to 100, by identifiers at later offsets."""
    return _pair(_pair(_pair(x[at], x[at + 32]), x[at + 64]), four[at + 96])


def least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n identifiers in a row."""
    d = 1
    while 2 * d <= n:
        x = np.minimum(x[: max(0, len(x) - d)], x[d:])
        d *= 2
    return np.minimum(x[: max(0, len(x) - (n - d))], x[n - d :]) if d < n else x


def regions(raw: np.ndarray, at: np.ndarray):
    """Runs of windows whose first least 32-gram is at the same place: each window of each text is in one region, equal windows
    have the same key, and a region's own windows all differ. A region has 69 windows at most, so its first and
    last window cover it. Gives key, identity, text, first byte in the text, windows."""
    n = len(raw)
    if n < LENGTH:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z.astype(np.uint64), z, z, z
    four, x = buckets(raw)
    m = least(x, LENGTH - Q + 1)
    size = np.diff(at)
    long = np.flatnonzero(size >= LENGTH)
    mark = np.zeros(len(m) + 1, np.int8)
    mark[at[long]] = 1
    mark[at[long] + size[long] - LENGTH + 1] -= 1
    valid = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    new = valid.copy()
    new[1:] &= (m[1:] != m[:-1]) | (x[: len(m) - 1] == m[:-1])
    new[at[long]] = True
    start = np.flatnonzero(new)
    stop = np.flatnonzero(np.append(valid, False)[:-1] & ~np.append(valid[1:], False)) + 1
    end = np.append(start[1:], n)
    end = np.minimum(end, stop[np.searchsorted(stop, start, "right")] if len(stop) else end)
    first, windows = start, end - start
    of = np.searchsorted(at, first, "right") - 1
    same = _pair(_pair(refined(four, x, first), refined(four, x, first + windows - 1)), windows.astype(np.uint64))
    return m[first], same, of, first - at[of], windows


def union(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Spans of each document, overlapping and touching ones as one."""
    if not len(doc):
        return doc, start, end
    o = np.lexsort((start, doc))
    doc, start, end = doc[o], start[o], end[o]
    edge = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    # ends grow from document to document when each is lifted above the one before
    lift = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(doc)))) * (int(end.max()) + 1)
    far = np.maximum.accumulate(end + lift)
    new = np.append(True, start[1:] + lift[1:] > far[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], (far - lift)[last]


_SENT = "key long, same long, kind tinyint, doc long, start int, end int"
_ONE, _MANY, _MARK, _SPAN = 0, 1, 2, 3


def _sent(key, same, kind, doc, start, end):
    return pa.record_batch([pa.array(np.asarray(key).view(np.int64)), pa.array(np.asarray(same).view(np.int64)), pa.array(np.full(len(doc), kind, np.int8)), pa.array(doc), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], names=["key", "same", "kind", "doc", "start", "end"])


def _combined(key, same, doc, start, end, split: bool):
    """What a task sends of its own regions. Of equal ones, the earliest goes on and the others are removed at once, so a group
    has a row from each task at most. With split, a key of several regions in this task goes by region, not by key, and
    leaves a mark with the key, so that no key gathers more than two rows from each task either."""
    o = np.lexsort((start, doc, same, key))
    key, same, doc, start, end = key[o], same[o], doc[o], start[o], end[o]
    first = np.append(True, (key[1:] != key[:-1]) | (same[1:] != same[:-1])) if len(key) else np.zeros(0, bool)
    rest = union(doc[~first], start[~first], end[~first])
    if len(rest[0]):
        yield _sent(mix(rest[0].astype(np.uint64)), np.zeros(len(rest[0]), np.uint64), _SPAN, *rest)
    key, same, doc, start, end = key[first], same[first], doc[first], start[first], end[first]
    if not split:
        if len(key):
            yield _sent(_pair(key, same), same, _MANY, doc, start, end)
        return
    again = np.append(False, key[1:] == key[:-1]) if len(key) else np.zeros(0, bool)
    several = again | np.append(again[1:], False) if len(key) else again
    for pick, kind in ((~several, _ONE), (several, _MANY)):
        if pick.any():
            yield _sent(_pair(key[pick], same[pick]) if kind == _MANY else key[pick], same[pick], kind, doc[pick], start[pick], end[pick])
    marks = several & ~again
    if marks.any():
        z = np.zeros(marks.sum(), np.int64)
        yield _sent(key[marks], z.astype(np.uint64), _MARK, z, z, z)


def _collected(parts, split: bool):
    """Combines what a task finds, HELD regions at a time."""
    held, n = [], 0
    for p in parts:
        held.append(p)
        n += len(p[0])
        if n >= HELD:
            yield from _combined(*(np.concatenate(x) for x in zip(*held)), split)
            held, n = [], 0
    if n:
        yield from _combined(*(np.concatenate(x) for x in zip(*held)), split)


def _region_rows(batches):
    def parts():
        for b in split_by_size(batches, "text", 2 << 20):
            doc = b.column(0).to_numpy()
            key, same, of, start, windows = regions(*buffers(b.column(1)))
            yield key, same, doc[of], start, start + windows + LENGTH - 1

    return _collected(parts(), True)


def _asked_text(batches):
    """Of each document: the regions that were asked for, with their bytes one after another."""
    for b in split_by_size(batches, "text"):
        raw, at = buffers(b.column(1))
        rows = []
        for i, asks in enumerate(b.column(2)):
            s, e = (np.sort(asks.values.field(k).to_numpy()) for k in (0, 1))  # windows of regions are apart, so both rise together
            rows.append((s, e, b"".join(raw[at[i] + x : at[i] + y].tobytes() for x, y in zip(s, e))))
        kind = pa.list_(pa.int32())
        yield pa.record_batch([b.column(0), pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows], pa.binary())], names=["doc", "start", "end", "text"])


def _pieces(batches):
    """Asked regions in parts of a few MB: bytes, where each region begins among them (and the end), its document, its first byte there."""
    for b in split_by_size(batches, "text", 1 << 20):
        raw, at = buffers(b.column(3))
        starts, ends = b.column(1), b.column(2)
        n = np.diff(np.asarray(starts.offsets))
        s, e = (x.flatten().to_numpy().astype(np.int64) for x in (starts, ends))
        yield raw, np.append(0, np.cumsum(e - s)), np.repeat(b.column(0).to_numpy(), n), s, b


def _inside(cut: np.ndarray, size: int):
    """For each byte its region; and the places where a window begins that lies in its region."""
    of = np.repeat(np.arange(len(cut) - 1), np.diff(cut))
    return of, np.flatnonzero(np.arange(size) + LENGTH <= cut[of + 1])


def _block_rows(batches):
    """Asked regions as blocks of STEP windows, counted from the region's least 32-gram. A block's key is of the bytes that all its
    windows share, so blocks that only lie in the same bucket part here; where they don't, the block goes on as a whole."""

    def parts():
        for raw, cut, doc, start, _ in _pieces(batches):
            four, x = buckets(raw)
            of, w = _inside(cut, len(raw))
            near = np.arange(len(x)) - cut[of[: len(x)]]
            m = least(x, LENGTH - Q + 1)[cut[:-1]]
            place = np.flatnonzero((near <= LENGTH - Q) & (x == m[of[: len(x)]]))
            p = place[np.searchsorted(of[place], np.arange(len(doc)))]  # the first in each region
            r = of[w]
            k = (p[r] - w) // STEP
            first = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (k[1:] != k[:-1])))
            f, last = w[first], w[np.append(first[1:], len(w)) - 1]
            r, k = r[first], k[first]
            core = p[r] - STEP * k
            key = _pair(_pair(_pair(x[core], x[core + 32]), x[core + LENGTH - STEP + 1 - 32]), k.astype(np.uint64))
            same = _pair(_pair(refined(four, x, f), refined(four, x, last)), (STEP * (last - f) + (core - last)).astype(np.uint64))
            at = start[r] + f - cut[r]
            yield key, same, doc[r], at, at + (last - f) + LENGTH

    return _collected(parts(), True)


def _window_rows(batches):
    """Each window of the asked blocks."""

    def parts():
        for raw, cut, doc, start, b in _pieces(batches):
            four, x = buckets(raw)
            _, w = _inside(cut, len(raw))
            wanted = np.zeros(len(raw) + 1, np.int64)
            regions_ = np.append(0, np.cumsum(np.diff(np.asarray(b.column(1).offsets))))
            for i, asks in enumerate(b.column(4)):
                s, e = (asks.values.field(j).to_numpy().astype(np.int64) for j in (0, 1))
                own = np.searchsorted(start[regions_[i] : regions_[i + 1]], s, "right") - 1 + regions_[i]
                begin = cut[own] + s - start[own]
                np.add.at(wanted, begin, 1)
                np.add.at(wanted, begin + (e - s) - LENGTH + 1, -1)
            w = w[np.cumsum(wanted[:-1])[w] > 0]
            key = _pair(_pair(_pair(x[w + 68], x[w + 36]), x[w + 4]), four[w])
            of = np.searchsorted(cut, w, "right") - 1
            at = start[of] + w - cut[of]
            yield key, refined(four, x, w), doc[of], at, at + LENGTH

    return _collected(parts(), False)


def _settle(batches):
    """Rows by key, same, doc: of equal regions the first stays and the others are removed; regions whose key has different ones
    are asked for in smaller parts. Rows of a key that a batch ends in wait for the next batch."""
    wait = None

    def done(t):
        key, same, kind, doc, start, end = t
        span, mark = kind == _SPAN, kind == _MARK
        real = ~span & ~mark
        new_key = np.append(True, key[1:] != key[:-1])
        new = new_key | np.append(True, (same[1:] != same[:-1]) | (real[1:] != real[:-1]))
        group = np.cumsum(new_key) - 1
        first = new & real
        ask = np.bincount(group, mark | (kind == _MANY)) > 0
        ask |= np.bincount(group, first) > 1
        asked = first & ask[group]
        gone = real & ~first | span
        pick = asked | gone
        if pick.any():
            yield pa.record_batch([pa.array(doc[pick]), pa.array(start[pick]), pa.array(end[pick]), pa.array(asked[pick])], names=["doc", "start", "end", "ask"])

    for b in batches:
        if not b.num_rows:
            continue
        t = [b.column(i).to_numpy() for i in range(6)]
        t = t if wait is None else [np.concatenate(x) for x in zip(wait, t)]
        cut = int(np.searchsorted(t[0], t[0][-1]))
        wait = [x[cut:] for x in t]
        if cut:
            yield from done([x[:cut] for x in t])
    if wait is not None:
        yield from done(wait)


def _settled(sent: DataFrame) -> DataFrame:
    return sent.repartition("key").sortWithinPartitions("key", "same", "doc").mapInArrow(_settle, "doc long, start int, end int, ask boolean")


def repeats(docs: DataFrame) -> DataFrame:
    """(doc, start, end): bytes of documents (doc long, unique; text) that a 100-byte string covers which also starts earlier.

    Every suffix's window of 100 bytes belongs to the bucket of its least 32-gram, so equal windows share a bucket, and runs of
    windows of one bucket go together as regions: 35 bytes of text or so give a region, not 35 suffixes. Buckets are refined by
    identifiers at later offsets: regions as wholes; where a bucket has different regions, their blocks of windows; where
    blocks share their middle but not their ends, single windows. Equality is of two 64-bit identifiers.
    """
    settled = lambda sent, name: written(_settled(sent), name)
    asks = lambda t: t.where("ask").groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("asks"))
    one = settled(docs.select("doc", "text").mapInArrow(_region_rows, _SENT), "regions")
    asked = docs.join(asks(one), "doc").select("doc", "text", "asks")
    asked = written(asked.mapInArrow(_asked_text, "doc long, start array<int>, end array<int>, text binary"), "asked")
    two = settled(asked.mapInArrow(_block_rows, _SENT), "blocks")
    again = asked.join(asks(two), "doc").select("doc", "start", "end", "text", "asks")
    three = written(_settled(again.mapInArrow(_window_rows, _SENT)).where("not ask"), "windows")
    out = [t.where("not ask").select("doc", "start", "end") for t in (one, two, three)]
    return out[0].union(out[1]).union(out[2])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, text, spans (start, end in UTF-8 bytes, apart and in order) of what is removed, and kept, the remaining bytes; a row for each row.

    A string counts as earlier by its document's id, then by its start; matches never cross documents. Null texts are empty and
    keep nothing. Documents whose id repeats, or is null, are ordered by id (null first), then text, and are one document if the
    text is equal too; so are rows that repeat. An empty table gives no rows; other columns are ignored. Texts shorter than 100 bytes
    stay whole; a text of any length is one row, and what is held for it grows with it only.
    """
    rows = texts(docs)
    unique = not rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").take(1)
    if unique:
        numbered = rows.select(F.col("doc_id").alias("doc"), "doc_id", "text")
    else:  # ids that only keep the order
        ordered = rows.distinct().orderBy("doc_id", "text")
        numbered = written(ordered.select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text"), "numbered")
    spans = repeats(numbered).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    out = numbered.join(spans, "doc", "left").select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, text string, spans array<struct<start:long,end:long>>, kept binary")
    if unique:
        return out
    return rows.withColumn("h", F.sha2("text", 256)).alias("r").join(out.withColumn("h", F.sha2("text", 256)).alias("o"), F.col("r.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("r.h") == F.col("o.h"))).select("o.doc_id", "o.text", "o.spans", "o.kept")


def _cut(batches):
    for b in split_by_size(batches, "text"):
        raw, at = buffers(b.column(1))
        spans, kept = [], []
        for i, given in enumerate(b.column(2)):
            text = raw[at[i] : at[i + 1]]
            if given.is_valid and len(given.values):
                s, e = (given.values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
                _, s, e = union(np.zeros(len(s), np.int64), s, e)
                keep = np.zeros(len(text) + 1, np.int64)
                keep[s] += 1
                keep[e] -= 1
                kept.append(text[np.cumsum(keep[:-1]) == 0].tobytes())
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(s, e)])
            else:
                kept.append(text.tobytes())
                spans.append([])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.record_batch([b.column(0), b.column(1), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "text", "spans", "kept"])


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup() of all documents as counts and a hash; nulls, ties and repeated rows as there."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return dedup(documents(spark, sf_dir)).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
