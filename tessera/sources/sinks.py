"""Writers: exports, blocks, indexes, versioned state."""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from tessera.operators import store

#: Changes that are laid over a snapshot, at most, before the table is written as a whole again.
MOST_CHANGES = 16


def export_json(rows: DataFrame, path: str, time: str) -> None:
    """Records as lines of JSON beside an envelope of count and time; a part file for each task, so size is not bounded."""
    rows.write.mode("overwrite").json(f"{path}/memories")
    rows.agg(F.count("*").alias("count")).withColumn("export_time", F.lit(time)).write.mode("overwrite").json(f"{path}/envelope")


def export_csv(rows: DataFrame, path: str) -> None:
    flat = rows.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in rows.dtypes])
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def import_json(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/memories")


class Versions:
    """A table as a row of Parquet versions: a reader sees the last whole one, a failed write none of it.

    A write puts its rows into a folder of its own, and is done when the file of the next number, which names that folder, is there. That file is made at
    once and only if there is none, so of two writers of a number one fails, with FileExistsError; change() and remove() then begin again on what the other wrote,
    up to `tries` times. A version is a snapshot of all rows, or a change: only the rows that are new, replaced or removed by their key, so that
    what is written follows the change and not the table. read() lays the changes over their snapshot; after MOST_CHANGES of them a snapshot is
    written again. A version can name the batch of a stream that it is of, so that a batch which is repeated after a failure is skipped.

    key: a column or several. partition: a column that folders are partitioned by, so that a read of some of its values skips the others' files of the
    snapshot; a change is read whole, as its row may take the place of one in another partition. clean() deletes old versions, sweep() what failed writes left.
    """

    def __init__(self, spark: SparkSession, path: str, key: str | list[str] = "memory_id", tries: int = 5, partition: str | None = None):
        self.spark, self.path, self.tries, self.partition = spark, path.rstrip("/"), tries, partition
        self.keys = [key] if isinstance(key, str) else list(key)

    # ---- the log ----

    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm

    def numbers(self) -> list[int]:
        fs, jvm = self._fs()
        if not fs.exists(jvm.org.apache.hadoop.fs.Path(self.path)):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(self.path))]
        return sorted(int(x[1:-5]) for x in found if x.startswith("v") and x.endswith(".json"))

    def entry(self, n: int) -> dict:
        """What the file of a version says: folder, change, and the stream and batch it is of."""
        fs, jvm = self._fs()
        file = fs.open(jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{n}.json"))
        try:
            return json.loads(bytes(file.readAllBytes()).decode())
        finally:
            file.close()

    def _claim(self, n: int, entry: dict) -> None:
        """Makes the file of a version, whole, and only if there is none: by a hard link on a local disk, elsewhere by a rename that never overwrites."""
        fs, jvm = self._fs()
        path = jvm.org.apache.hadoop.fs.Path
        made, to = path(f"{self.path}/_made-{uuid.uuid4().hex}"), path(f"{self.path}/v{n}.json")
        out = fs.create(made)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        try:
            if fs.getScheme() == "file":
                place = lambda p: jvm.java.nio.file.Paths.get(jvm.org.apache.hadoop.fs.Path.getPathWithoutSchemeAndAuthority(p).toString(), self.spark.sparkContext._gateway.new_array(jvm.String, 0))
                jvm.java.nio.file.Files.createLink(place(to), place(made))
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(made, to, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            if "AlreadyExists" in type(e.java_exception).__name__ or "AlreadyExists" in e.java_exception.getClass().getName():
                raise FileExistsError(f"another writer made version {n} of {self.path}") from None
            raise
        finally:
            fs.delete(made, False)

    def done(self, stream: str) -> int:
        """The last batch of a stream that is in a version, -1 if none is."""
        for n in reversed(self.numbers()):
            got = self.entry(n).get("batches", {})
            if stream in got:
                return got[stream]
        return -1

    # ---- reading ----

    def read(self, version: int | None = None, where: Column | None = None) -> DataFrame:
        """The rows of a version, the last one by default; those that a predicate of their own columns holds for."""
        have = self.numbers()
        return self._laid(self._layers(have[-1] if version is None else version, have), where)

    def _layers(self, n: int, have: list[int]) -> list[int]:
        """The snapshot that a version begins from, and the changes up to it."""
        own, before = [n], [x for x in have if x < n]
        while self.entry(own[0])["change"]:
            own.insert(0, before.pop())
        return own

    def _laid(self, layers: list[int], where: Column | None = None) -> DataFrame:
        where = F.lit(True) if where is None else where
        folders = [f"{self.path}/{self.entry(n)['folder']}" for n in layers]
        base = self.spark.read.parquet(folders[0])
        if len(layers) == 1:
            return base.where(where)
        kinds = StructType([*base.schema.fields, StructField("_gone", BooleanType()), StructField("_number", LongType())])
        changes = self.spark.read.schema(kinds).parquet(*folders[1:])
        newest = Window.partitionBy(*self.keys).orderBy(F.col("_number").desc())
        last = changes.withColumn("_n", F.row_number().over(newest)).where("_n = 1")
        kept = base.where(where).join(last.select(*self.keys), self.keys, "left_anti").select(*base.columns)
        return kept.unionByName(last.where("not _gone").select(*base.columns).where(where))

    # ---- writing ----

    def write(self, rows: DataFrame, number: int | None = None, batch: tuple[str, int] | None = None) -> int:
        """Writes a snapshot as the next version, or the given one; gives its number."""
        return self._made(rows, (self.numbers() or [-1])[-1] + 1 if number is None else number, batch=batch)

    def _made(self, rows: DataFrame, n: int, change: bool = False, batch: tuple[str, int] | None = None) -> int:
        folder = f"data-{uuid.uuid4().hex}"
        if self.partition and not change:
            rows.repartition(self.partition).write.partitionBy(self.partition).parquet(f"{self.path}/{folder}")
        else:
            rows.write.parquet(f"{self.path}/{folder}")
        before = [x for x in self.numbers() if x < n]
        batches = self.entry(before[-1]).get("batches", {}) if before else {}
        try:
            self._claim(n, {"folder": folder, "change": change, "batches": batches | ({batch[0]: batch[1]} if batch else {})})
        except FileExistsError:
            self._delete([folder])
            raise
        return n

    def _delete(self, names: list[str]) -> None:
        fs, jvm = self._fs()
        for x in names:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{x}"), True)

    def _again(self, step) -> int:
        for k in range(self.tries):
            try:
                return step()
            except FileExistsError:
                if k == self.tries - 1:
                    raise
        raise ValueError("tries must be 1 or more")

    def change(self, rows: DataFrame, order: str | None = None, batch: tuple[str, int] | None = None) -> int:
        """The next version, with rows in place of those with their keys; of equal keys in rows the last by order stays. rows have the table's
        columns; a row without a key is an error. Gives the version's number."""
        lacking = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in self.keys])
        keyed = F.when(lacking, F.raise_error(F.lit(f"a row without {', '.join(self.keys)}"))).otherwise(F.lit(True))
        last = store.latest(rows.where(keyed), self.keys, order)

        def step() -> int:
            have = self.numbers()
            if not have:
                return self._made(last, 0, batch=batch)
            kinds = self._laid(self._layers(have[-1], have)).schema
            if set(rows.columns) != set(kinds.names):
                raise ValueError(f"columns {sorted(rows.columns)} in place of {sorted(kinds.names)}")
            return self._changed(last.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in kinds]).withColumn("_gone", F.lit(False)), have, batch)

        return self._again(step)

    def remove(self, gone: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """The next version, without the rows whose keys are in gone; gives its number."""
        keys = gone.select(*self.keys).dropna().distinct()

        def step() -> int:
            have = self.numbers()
            kinds = self._laid(self._layers(have[-1], have)).schema
            return self._changed(keys.select(*[F.col(f.name) if f.name in self.keys else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds], F.lit(True).alias("_gone")), have, batch)

        return self._again(step)

    def _changed(self, rows: DataFrame, have: list[int], batch: tuple[str, int] | None = None) -> int:
        layers, n = self._layers(have[-1], have), have[-1] + 1
        if len(layers) <= MOST_CHANGES:
            return self._made(rows.withColumn("_number", F.lit(n).cast("long")), n, True, batch)
        now = self._laid(layers)
        whole = now.join(rows.select(*self.keys), self.keys, "left_anti").select(*now.columns)
        return self._made(whole.unionByName(rows.where("not _gone").select(*now.columns)), n, batch=batch)

    # ---- housekeeping ----

    def clean(self, keep: int = 2) -> list[int]:
        """Deletes all versions but the last keep and what these are laid over; gives their numbers. Readers of older ones must be done."""
        have = self.numbers()
        first = self._layers(have[-keep:][0], have)[0] if keep and have else None
        old = [n for n in have if first is None or n < first]
        for n in old:
            folder = self.entry(n)["folder"]
            self._delete([f"v{n}.json", folder])  # the file first, so that no version lacks its rows
        return old

    def sweep(self, hours: float = 24.0) -> list[str]:
        """Deletes folders and files of writes that failed, if they are hours old; gives their names."""
        fs, jvm = self._fs()
        used = {self.entry(n)["folder"] for n in self.numbers()}
        old = time.time() - hours * 3600
        found = [s for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(self.path)) if s.getModificationTime() / 1000 < old]
        names = [x for x in (s.getPath().getName() for s in found) if x.startswith(("data-", "_made-")) and x not in used]
        self._delete(names)
        return names


class VectorIndex:
    """Vectors by id in versions of a table. Removed ones stay as tombstones (removed) until the next rebuild; searches leave them out before the cut."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = Versions(spark, path)

    def _now(self) -> DataFrame:
        if self.table.numbers():
            return self.table.read()
        return self.table.spark.createDataFrame([], "memory_id string, embedding array<float>, removed boolean")

    def add(self, rows: DataFrame) -> int:
        """rows (memory_id, embedding) in place of those with their ids."""
        new = rows.select("memory_id", F.col("embedding").cast("array<float>"), F.lit(False).alias("removed"))
        return self.table.change(new)

    def remove(self, ids: DataFrame) -> int:
        gone = self._now().join(ids.select("memory_id").distinct(), "memory_id", "left_semi")
        return self.table.change(gone.select("memory_id", "embedding", F.lit(True).alias("removed")))

    def rows(self) -> DataFrame:
        return self._now().where("not removed").drop("removed")

    def rebuild(self) -> int:
        """A version without tombstones."""
        return self.table.write(self._now().where("not removed"))

    def reset(self) -> int:
        return self.table.write(self._now().limit(0))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        from tessera.operators.vector import knn

        return knn(self.rows(), queries, k)


def save_state(synapses: DataFrame, importance: DataFrame, versions: Versions) -> int:
    """Consolidation state, synapses and importance, as one version: both are there or neither."""
    a = synapses.select(F.lit("synapse").alias("kind"), "m1", "m2", "weight", F.lit(None).cast("long").alias("connections"))
    b = importance.select(F.lit("importance").alias("kind"), F.col("memory_id").alias("m1"), F.lit(None).cast("string").alias("m2"), F.col("importance").alias("weight"), F.col("connections").cast("long").alias("connections"))
    return versions.write(a.unionByName(b))


def load_state(versions: Versions, number: int | None = None) -> tuple[DataFrame, DataFrame]:
    rows = versions.read(number)
    return rows.where("kind = 'synapse'").select("m1", "m2", "weight"), rows.where("kind = 'importance'").select(F.col("m1").alias("memory_id"), F.col("weight").alias("importance"), "connections")


def save_blocks(members: DataFrame, path: str) -> None:
    """Blocks, and their members by rank, as two tables."""
    members.select("query_id", "block", "block_tokens", "has_more", "prev_block").distinct().write.mode("overwrite").parquet(f"{path}/blocks")
    members.select("query_id", "block", "rank", "memory_id").write.mode("overwrite").parquet(f"{path}/block_members")


def load_blocks(spark: SparkSession, path: str) -> DataFrame:
    own = spark.read.parquet(f"{path}/block_members").groupBy("query_id", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "memory_id"))), lambda x: x["memory_id"]).alias("member_ids"))
    return spark.read.parquet(f"{path}/blocks").join(own, ["query_id", "block"], "left")


def rebuilt(mem: DataFrame, embedder) -> DataFrame:
    """memory_id and a new embedding of all memories."""
    from tessera.functions.text import embed_text
    from tessera.operators.vector import embedded_by

    said = embed_text(F.col("what"), F.col("why"), F.col("how"), F.col("raw_text"))
    return embedded_by(mem.select("memory_id", said.alias("embed_text")), embedder).select("memory_id", "embedding")


def repaired(mem: DataFrame, embedder, drop: bool = False) -> DataFrame:
    """mem with missing or zero embeddings made anew, or their rows left out."""
    from tessera.operators.vector import audit

    bad = audit(mem).where("status <> 'valid'").select("memory_id")
    good = mem.join(bad, "memory_id", "left_anti")
    if drop:
        return good.select(*mem.columns)
    lost = mem.join(bad, "memory_id", "left_semi")
    return good.select(*mem.columns).unionByName(lost.drop("embedding").join(rebuilt(lost, embedder), "memory_id").select(*mem.columns))
