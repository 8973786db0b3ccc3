"""Chunkers: sentences, paragraphs, sections. Any object with chunk(text) -> list can stand for one."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of the texts whose chunks a task of Python holds at once, about.
AT_ONCE = 1 << 20
_SENTENCE, _PARAGRAPH, _HEADER = re.compile(r"(?<=[.!?])\s+"), re.compile(r"\n\s*\n"), re.compile(r"^#{1,6}\s+", re.M)


class _Packer:
    """Joins parts with a separator while they fit; a part's size counts the separator."""

    def __init__(self, joint: str, most: int):
        self.joint, self.most, self.out, self.open, self.size = joint, most, [], [], 0

    def close(self):
        if self.open:
            self.out.append(self.joint.join(self.open))
        self.open, self.size = [], 0

    def add(self, part: str, cost: int, fresh: int):
        if self.size + cost > self.most:
            self.close()
            self.open, self.size = [part], fresh
        else:
            self.open.append(part)
            self.size += cost


class Sentences:
    """Sentences in chunks of most characters; longer ones are cut at words. Each chunk begins with the last overlap words of the one before it
    (words, though sizes are characters); chunks under least characters go."""

    def __init__(self, most: int = 2000, overlap: int = 200, least: int = 100):
        self.most, self.overlap, self.least = most, overlap, least

    def chunk(self, text: str) -> list[str]:
        pack = _Packer(" ", self.most)
        for s in _SENTENCE.split(text or ""):
            if len(s) > self.most:
                pack.close()
                words = _Packer(" ", self.most)
                for w in s.split():
                    words.add(w, len(w) + 1, len(w))
                words.close()
                pack.out += words.out
            else:
                pack.add(s, len(s) + 1, len(s))
        pack.close()
        raw = pack.out
        if self.overlap > 0 and len(raw) > 1:
            raw = raw[:1] + [" ".join(a.split()[-self.overlap :]) + " " + b for a, b in zip(raw, raw[1:])]
        return [c for c in raw if len(c) >= self.least]


class Paragraphs(Sentences):
    """Paragraphs in chunks; longer ones by sentences."""

    def chunk(self, text: str) -> list[str]:
        pack = _Packer("\n\n", self.most)
        for p in filter(None, map(str.strip, _PARAGRAPH.split(text or ""))):
            if len(p) > self.most:
                pack.close()
                pack.out += Sentences(self.most, self.overlap, self.least).chunk(p)
            else:
                pack.add(p, len(p) + 2, len(p))
        pack.close()
        return [c for c in pack.out if len(c) >= self.least]


class Sections(Sentences):
    """Sections between headers; longer ones, and texts without a header, by paragraphs."""

    def chunk(self, text: str) -> list[str]:
        inner = Paragraphs(self.most, self.overlap, self.least)
        parts = _HEADER.split(text or "")
        if len(parts) == 1:
            return inner.chunk(text)
        out = []
        for s in filter(str.strip, parts):
            out += inner.chunk(s) if len(s) > self.most else [s.strip()]
        return [c for c in out if len(c) >= self.least]


def chunked(docs: DataFrame, chunker, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, chunk_index, total_chunks, chunk, words and characters: a row for each chunk of each document."""

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            first, made, size = 0, [], 0
            for i in range(b.num_rows):
                said = b.column(1)[i].as_py() or ""
                made.append(chunker.chunk(said))
                size += len(said)
                if size >= AT_ONCE or i == b.num_rows - 1:
                    yield pa.record_batch([b.column(0).slice(first, i + 1 - first), pa.array(made, pa.list_(pa.string()))], names=[key, "chunks"])
                    first, made, size = i + 1, [], 0

    rows = docs.select(key, F.col(text).cast("string").alias("_text")).mapInArrow(cut, T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("chunks", T.ArrayType(T.StringType()))]))
    out = rows.select(key, F.size("chunks").alias("total_chunks"), F.posexplode("chunks").alias("chunk_index", "chunk"))
    return out.withColumns({"n_words": _words(F.col("chunk")), "n_chars": F.length("chunk")})


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
