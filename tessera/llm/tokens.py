"""Token counts: byte-pair merging by a heap and a linked list, and cached ids of a byte-level vocabulary."""

from __future__ import annotations

import re
from array import array
from heapq import heapify, heappop, heappush
from sys import getsizeof

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, split_by_size, texts

SEP = "\x1f"
#: Bytes of a worker's cache, keys, values and table; it is emptied when full, so memory is bounded and results don't change.
CACHE_BYTES = 192 << 20
LONGEST_CACHED = 48


class Cache(dict):
    """What f gives for short segments."""

    def __init__(self, f, most: int = CACHE_BYTES):
        super().__init__()
        self.f, self.most, self.held = f, most, 0

    def __missing__(self, part: str):
        got = self.f(part)
        if len(part) <= LONGEST_CACHED:
            self.held += 104 + getsizeof(part) + getsizeof(got)  # a dictionary's slot takes 104 at most
            if self.held > self.most:
                self.clear()
                self.held = 0
            self[part] = got
        return got


class PieceCounter:
    """Counts the pieces that a sentencepiece BPE model with byte fallback gives, without making any.

    Adjacent symbols wait in a heap by (rank, position); a doubly linked list holds the symbols that are left.
    Each pop that is still valid is one merge. The count is the initial symbols minus the merges, where a
    character outside the vocabulary counts its UTF-8 bytes.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        self.chars = {c for p in self.rank for c in p}
        joined = {(a, b) for p in self.rank for a, b in zip(p, p[1:])}
        # cuts are made only where no piece crosses: before spaces, around line ends, between a letter and . or ,
        assert not any(a != "▁" and b == "▁" or "\n" in (a, b) for a, b in joined)
        letter = rf"[^\W\d_{re.escape(''.join(a for a, b in joined if b in '.,' and re.match(r'[^\W\d_]', a)))}]"
        self.odd = re.compile(rf"(?<!{letter})[.,]|  ")
        self.cut = re.compile(rf"(?<={letter})(?=[.,])|(?<=[^ ])(?= )|(?<=\n)|(?=\n)")
        self.cache = Cache(lambda p: self.merge(p.replace(" ", "▁")) if p else 0)

    def merge(self, s: str) -> int:
        """Pieces of one segment, spaces as U+2581 already."""
        rank, n = self.rank, len(s)
        part, left, right = list(s), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(rank[p], i, len(p)) for i in range(n - 1) if (p := part[i] + part[i + 1]) in rank]
        heapify(heap)
        count = n
        while heap:
            _, i, size = heappop(heap)
            j = right[i]
            if not part[i] or j >= n or len(part[i]) + len(part[j]) != size:
                continue
            part[i] += part[j]
            part[j] = ""
            right[i] = k = right[j]
            count -= 1
            if k < n:
                left[k] = i
                if (p := part[i] + part[k]) in rank:
                    heappush(heap, (rank[p], i, len(p)))
            if (k := left[i]) >= 0 and (p := part[k] + part[i]) in rank:
                heappush(heap, (rank[p], k, len(p)))
        for p in part:
            if len(p) == 1 and p not in rank:
                count += len(p.encode("utf-8", "surrogatepass")) - 1
        return count

    def count(self, text: str) -> int:
        """Pieces of a whole text."""
        if not text:
            return 0
        text = " " + text.replace("▁", " ")
        if SEP in text:  # a byte of its own, which no piece holds
            return text.count(SEP) + sum(self._count(x) for x in text.split(SEP))
        return self._count(text)

    def _count(self, text: str) -> int:
        if self.odd.search(text):
            parts = self.cut.sub(SEP, text).split(SEP)
        else:
            parts = text.replace(".", "\x1f.").replace(",", "\x1f,").replace("\n", "\x1f\n\x1f").replace(" ", "\x1f ").split(SEP)
        return sum(map(self.cache.__getitem__, parts))


_counters: dict[str, PieceCounter] = {}


def token_counts(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text.

    Null texts are empty: no bytes, no tokens. Rows that repeat give a row each; an empty table gives none; a text
    of any length is handled whole in memory that grows with that text only. Columns other than doc_id and text
    are ignored. A map without a shuffle: losing an executor repeats its own files only.
    """

    def run(batches):
        counter = _counters.get(model) or _counters.setdefault(model, PieceCounter(model))
        for b in split_by_size(batches, "text"):
            t = b.column(1).to_pylist()
            n = [counter.count(x) for x in t]
            yield pa.record_batch([b.column(0), pa.array([len(x.encode()) for x in t], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token_counts() of all documents by piece_bpe_32k.model; nulls and repeated rows as there."""
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


_WHOLE = re.compile(r"(?<![^\W\d_])[.,]|\s\s")


class ByteIds:
    """Ids of a byte-level BPE vocabulary of less than 65,536 ids, as little-endian 16-bit words.

    The vocabulary is read from the ranks beside the .json file (the same ids; a merge with a lower rank goes first
    in both). Texts are cut where the vocabulary's own pre-tokenizer always cuts, and each segment is encoded once.
    """

    def __init__(self, json_path: str):
        import base64
        import json

        import tiktoken
        from public_tokenizers import PATTERN

        with open(json_path, encoding="utf-8") as f:
            spec = json.load(f)
        with open(json_path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        assert max([*ranks.values(), *special.values()]) < 65536
        self.special = list(special)
        self.enc = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.cache = Cache(lambda p: array("H", self.enc.encode_ordinary(p)).tobytes())

    def ids(self, text: str, special: bool = True) -> bytes:
        """special: whether special strings inside the text become their ids, as the library does by default."""
        if special and any(s in text for s in self.special):
            return array("H", self.enc.encode(text, allowed_special="all")).tobytes()
        if SEP in text or _WHOLE.search(text):
            return array("H", self.enc.encode_ordinary(text)).tobytes()
        parts = text.replace(".", "\x1f.").replace(",", "\x1f,").replace("\n", "\x1f\n\x1f").replace(" ", "\x1f ").split(SEP)
        return b"".join(map(self.cache.__getitem__, parts))

    def text(self, ids) -> str:
        return self.enc.decode_bytes(ids).decode("utf-8")


_ids: dict[str, ByteIds] = {}


def byte_ids(json_path: str) -> ByteIds:
    return _ids.get(json_path) or _ids.setdefault(json_path, ByteIds(json_path))
