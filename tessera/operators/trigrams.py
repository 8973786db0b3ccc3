"""Text search by trigrams: postings of three-letter pieces narrow what a pattern is verified against."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.sinks import Versions

#: Trigrams of a pattern that are looked up, at most: the rarest. The others are left to the verification.
MOST_GRAMS = 4
TEXTS = ("raw_text", "what", "why", "how")
#: Letters of the texts for a partition of postings: each gives a posting at most, so partitions grow in number with the texts and not in size.
LETTERS = 4_000_000


def grams(text: Column) -> Column:
    """The distinct trigrams of the lower-case text, found in one pass by what lies ahead of each place; so the cost follows the text's length."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(.{3}))"), F.lit(1)))


def postings(rows: DataFrame, key: str = "memory_id", columns: tuple[str, ...] = TEXTS) -> DataFrame:
    """(gram, key): each trigram of each of the columns, once for a row."""
    each = F.flatten(F.array(*[F.coalesce(grams(F.col(c)), F.array().cast("array<string>")) for c in columns]))
    return rows.select(key, F.explode(F.array_distinct(each)).alias("gram")).select("gram", key)


def contains(value: str, columns: tuple[str, ...] = TEXTS) -> Column:
    """Whether the pattern, in which % and _ stand for any letters, is in any of the columns, in either case of letters: what a scan tests."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.ilike(F.col(c), F.lit(f"%{value}%")), F.lit(False)) for c in columns])


def needed(value: str) -> list[str]:
    """The trigrams that every text with the pattern has: those of its literal pieces, in lower case. Letters whose lower case isn't one letter are left out."""
    pieces = re.split(r"\\.|[%_]", value)
    return sorted({p.lower()[i : i + 3] for p in pieces if len(p) == len(p.lower()) and p.isascii() for i in range(len(p) - 2)})


class TrigramTable:
    """Postings (gram, memory_id) as versions of a table, in ranges of trigrams, so that a lookup reads the row groups of its trigrams only.

    search() looks up the rarest trigrams of a pattern, keeps the rows that have all of them, and verifies these with the same predicate as a scan; a pattern
    without a trigram is scanned. Rows that are added or replaced add postings; those of replaced texts stay until the next build() and cost a verification.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "memory_id", columns: tuple[str, ...] = TEXTS):
        self.spark, self.key, self.columns = spark, key, columns
        self.table, self.counts = Versions(spark, f"{path}/postings", ["gram", key]), Versions(spark, f"{path}/counts", "gram")

    def build(self, rows: DataFrame) -> int:
        made = postings(rows, self.key, self.columns)
        letters = rows.agg(F.sum(reduce(lambda a, b: a + b, [F.coalesce(F.length(c), F.lit(0)) for c in self.columns]))).first()[0] or 0
        n = self.table.write(made.repartitionByRange(max(1, -(-letters // LETTERS)), "gram", self.key).sortWithinPartitions("gram", self.key))
        self.counts.write(self.table.read().groupBy("gram").agg(F.count("*").alias("n")).repartitionByRange("gram").sortWithinPartitions("gram"))
        return n

    def add(self, rows: DataFrame) -> int:
        return self.table.change(postings(rows, self.key, self.columns))

    def candidates(self, value: str) -> DataFrame | None:
        """Keys of the rows that have the pattern's rarest trigrams, None if it has no trigram."""
        own = needed(value)
        if not own:
            return None
        known = {r[0]: r[1] for r in self.counts.read(where=F.col("gram").isin(own)).collect()}  # a row for each trigram of the pattern
        rare = sorted(own, key=lambda g: (known.get(g, 0), g))[:MOST_GRAMS]
        hit = self.table.read(where=F.col("gram").isin(rare)).groupBy(self.key).agg(F.countDistinct("gram").alias("n"))
        return hit.where(F.col("n") == len(rare)).select(self.key)

    def search(self, rows: DataFrame, value: str) -> DataFrame:
        """The rows with the pattern in any of the columns."""
        own = self.candidates(value)
        found = rows if own is None else rows.join(own, self.key, "left_semi")
        return found.where(contains(value, self.columns))
