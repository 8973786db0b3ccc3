"""Cost-balanced packing of token sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, split_by_size, texts
from tessera.llm.tokens import byte_ids

_TAILS = "doc_id long, doc_tokens long, start long, length long, ids binary, crc long, copy long"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


def cost(n: float, window: int) -> float:
    """Of a piece of n tokens: linear layers, plus attention, which is quadratic; equal at n = window."""
    return n + n * n / window


def balance(lengths: np.ndarray, window: int) -> list[tuple[int, int, int, int, int]]:
    """(piece, its start, length, sequence, offset): pieces in descending order of length, each to the sequence of the
    lowest cost that has room for it; one that fits nowhere is cut at the room of the lowest-cost sequence that has any.

    There are as many sequences as the tokens need at least, so that less than one window is padded in all.
    """
    lengths = np.asarray(lengths, np.int64)
    m = -(-int(lengths.sum()) // window)
    room, spent, out = np.full(m, window, np.int64), np.zeros(m), []
    for i in np.argsort(-lengths, kind="stable"):
        start, n = 0, int(lengths[i])
        while n:
            fits = room >= n
            if not fits.any():
                fits = room > 0
            k = int(np.argmin(np.where(fits, spent, np.inf)))
            take = min(n, int(room[k]))
            out.append((int(i), start, take, k, window - int(room[k])))
            room[k] -= take
            spent[k] += cost(take, window)
            start, n = start + take, n - take
    return out


def pack(docs: DataFrame, vocabulary: str, window: int = 2048, end_id: int = 1, group_docs: int = 1024) -> DataFrame:
    """Packs the ids of every whole text, with end_id after it, into sequences of window tokens at most.

    Whole windows of long documents are sequences of their own. What is left of each document goes to one of the
    groups of about group_docs documents, by a hash of its id, its tokens and how many of the same its task met before, and is balanced
    within it; so rows with one id, or none, or the same rows many times, spread over the groups, a task's memory is bounded by the
    group, and less than a window is padded in each group. Null and empty texts are one token; a null doc_id stays null. Documents that
    repeat are packed each time; equal pieces go by id, then start. An empty table gives no piece. Other columns are ignored. Losing an executor
    repeats its tasks with the same result, as groups don't depend on the order of rows.
    """
    docs = texts(docs)
    groups = max(1, -(-docs.count() // group_docs))

    def encode(batches):
        enc, met = byte_ids(vocabulary), {}
        for b in split_by_size(batches, "text"):
            rows = [[] for _ in range(7)]
            for d, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.append(np.frombuffer(enc.ids(x), np.uint16), np.uint16(end_id))
                full = len(ids) // window * window
                own = hash((d, x))
                met[own] = copy = met.get(own, -1) + 1
                for s in range(0, full, window):
                    for r, v in zip(rows, (d, len(ids), s, window, None, zlib.crc32(ids[s : s + window].astype("<u4").tobytes()), copy)):
                        r.append(v)
                if full < len(ids):
                    for r, v in zip(rows, (d, len(ids), full, len(ids) - full, ids[full:].tobytes(), None, copy)):
                        r.append(v)
            yield pa.record_batch([pa.array(r, t) for r, t in zip(rows, (pa.int64(),) * 4 + (pa.binary(), pa.int64(), pa.int64()))], names=["doc_id", "doc_tokens", "start", "length", "ids", "crc", "copy"])

    def place(key, table):
        group = key[0].as_py()
        d, n, s, length, ids, crc = (table.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "start", "length", "ids", "crc"))
        order = sorted(range(len(d)), key=lambda i: (-length[i], d[i] is None, d[i] or 0, s[i], ids[i] or b""))
        whole = [i for i in order if ids[i] is None]
        tails = [i for i in order if ids[i] is not None]
        out = [(d[i], s[i], length[i], crc[i], n[i], k, 0, cost(length[i], window)) for k, i in enumerate(whole)]
        for i, start, take, k, offset in balance([length[i] for i in tails], window):
            t = tails[i]
            part = np.frombuffer(ids[t], np.uint16)[start : start + take]
            out.append((d[t], s[t] + start, take, zlib.crc32(part.astype("<u4").tobytes()), n[t], len(whole) + k, offset, cost(take, window)))
        types = [pa.int64()] * 7 + [pa.float64()]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"]
        columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
        columns[5] = pa.array([group * (1 << 32) + v for v in columns[5].to_pylist()], pa.int64())
        return pa.table(columns, names=names)

    tails = docs.mapInArrow(encode, _TAILS)
    group = F.xxhash64("doc_id", "doc_tokens", "start", F.coalesce("crc", F.xxhash64("ids")), "copy")
    return tails.withColumn("grp", F.pmod(group, F.lit(groups))).drop("copy").groupBy("grp").applyInArrow(place, _PIECES)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack() of all documents' ids by byte_bpe_50k.json into sequences of 2048; nulls, ties and repeated rows as there."""
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
