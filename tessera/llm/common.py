"""Shared helpers: column picking, Arrow text buffers, word hashes, shared-folder tables."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a UTF-8 text that separate words: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly the named columns, whatever else the table has: extra columns never clash, even those
    that differ by case only; a column that is missing is null."""
    have = df.columns
    flat = df.toDF(*[f"c{i}" for i in range(len(have))])
    out = []
    for n in names:
        at = [i for i, h in enumerate(have) if h == n] or [i for i, h in enumerate(have) if h.lower() == n.lower()]
        out.append((F.col(f"c{at[0]}") if at else F.lit(None)).alias(n))
    return flat.select(*out)


def flattened(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns c0, c1 ..., so that no names clash, and the place of each name: an exact match, else the first one in another case."""
    at: dict[str, str] = {}
    for i, c in enumerate(df.columns):
        at.setdefault(c.lower(), f"c{i}")
    at |= {c: f"c{i}" for i, c in reversed(list(enumerate(df.columns)))}
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), at


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bytes of an Arrow batch, at most, so that what goes through Python at once follows bytes and not rows.
BATCH_BYTES = 4 << 20


def _bytes(size: str) -> int:
    """A size as Spark writes it: a number, and a unit of a power of 1024."""
    m = re.fullmatch(r"\s*(-?[0-9]+)\s*([kmgtp]?)i?b?\s*", size.lower())
    if m is None:
        raise ValueError(f"not a size: {size!r}")
    return int(m[1]) << 10 * " kmgtp".index(m[2] or " ")


def in_small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound of Arrow batches to BATCH_BYTES: long texts fill a batch long before its rows do. The bound is read when a
    plan runs, which is after an operator has given its plan, so it stays lowered for the session."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = _bytes(spark.conf.get(key, "64m"))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def trim() -> None:
    """Gives memory that a worker has freed back to the system; workers live on between stages."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def freed(spark: SparkSession) -> None:
    """Frees what done steps hold in the driver: its own memory, and broadcasts and shuffle files, which Spark deletes when the JVM collects them."""
    trim()
    spark._jvm.System.gc()


try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:  # another C library
    _LIBC = None


def texts(df: DataFrame) -> DataFrame:
    """doc_id as a long and the whole text, null as empty."""
    in_small_batches(df.sparkSession)
    return pick(df, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a temporary one with a local master, whose executors share
    the machine; an error on a cluster, where tables in it would be incomplete."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


#: Folders of the tables written since each open() of scratch, innermost last.
_open: list[list[str]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: this cuts the lineage and survives lost executors. Names that differ by case only
    are kept."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    flat = df if len({c.lower() for c in df.columns}) == len(df.columns) else flattened(df)[0]
    flat.write.option("compression", "zstd").parquet(path)
    if _open:
        _open[-1].append(path)
    back = spark.read.schema(flat.schema).parquet(path)
    return back if flat is df else back.toDF(*df.columns)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """The list of the tables written within it; those that are still in it when it ends are deleted, so nothing may read them later."""
    _open.append([])
    try:
        yield _open[-1]
    finally:
        delete(spark, _open.pop())


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders of written tables, in any store that Spark writes to."""
    jvm = spark._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread_join(left: DataFrame, right: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """left joined with right, which has a row for each key and in count the number of left's rows with it, of total in all. Keys with over a
    100,000th of the rows, and 1000 at least, of which there are 100,000 at most, go to the rows by broadcast; so no task gets a hot key."""
    cut = max(1000, total // 100_000)
    hot = F.broadcast(right.where(F.col(count) > cut).withColumn("_hot", F.lit(True)))
    rest = right.where(F.col(count) <= cut)
    both = left.join(hot, on, "left")
    cold = both.where("_hot is null").select(*left.columns).join(rest, on)
    columns = [*left.columns, *[c for c in right.columns if c not in on]]
    return both.where("_hot").select(*columns).unionByName(cold.select(*columns))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of a string column without nulls: its UTF-8 bytes and the n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * _M2
    x ^= x >> np.uint64(29)
    x *= _M1
    x ^= x >> np.uint64(32)
    return x


_R = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2^64; those of batches of a usual size are kept."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    size = max(n, 1 << 20)
    made = []
    for r in (_R, pow(_R, -1, 1 << 64)):
        p = np.full(size, r, np.uint64)
        p[0] = 1
        made.append(np.multiply.accumulate(p))
    if size <= 5 << 20:
        _powers[:] = made
    return made[0][:n], made[1][:n]


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts of a batch: 64-bit hash, first byte, byte after the last, and for each text the number
    of words before it (n + 1 values). A word never crosses from one text into the next."""
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(at), np.int64)
    inside = ~SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = at[(at > 0) & (at < n)]
    first[cuts] = inside[cuts]
    start = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    end = np.flatnonzero(last) + 1
    before = np.searchsorted(start, at)
    if not len(start):
        return np.zeros(0, np.uint64), start, end, before
    # the sum of byte times power of its place by prefix sums modulo 2^64, moved to the word's begin by the inverse power
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw + np.uint64(1)) * up, out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start, end, before


def shingles(h: np.ndarray, before: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of size words, and the index of each window's text. A text with fewer words, but
    one at least, is one window."""
    n = np.diff(before)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    of = np.repeat(np.arange(len(n)), count)
    first = np.repeat(before[:-1], count) + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    length = np.minimum(np.repeat(n, count), size)
    out = np.zeros(len(of), np.uint64)
    for k in range(size):
        ok = length > k
        out[ok] = mix(out[ok] + h[first[ok] + k] + np.uint64(k + 1))
    return out, of


def split_by_size(batches, column: str, limit: int = 4 << 20):
    """Record batches of about limit bytes of one string column at most, so that memory follows bytes, not rows."""
    for b in batches:
        if not b.num_rows:
            continue
        c = b.column(b.schema.get_field_index(column))
        size = np.cumsum(np.diff(np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)) if pa.types.is_string(c.type) or pa.types.is_binary(c.type) else np.diff(np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]))
        i = 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + limit, "right")))
            yield b.slice(i, j - i)
            i = j
    trim()
