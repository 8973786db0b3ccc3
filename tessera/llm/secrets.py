"""Secrets: plain patterns, and weak parts that count only beside the parts that complete them."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import documents, flattened, in_small_batches, split_by_size, texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE = ("assign", "access", "hex")
#: Weak parts: what each looks like alone is common; kinds are listed after the base ones. An identifier is a key's prefix before 16 capitals
#: and digits, or before 12 or more with a digit among them, or is named by an assignment; a secret is a run of 20 characters or more, however long, with both cases of letters and a digit.
NAMED_ID = r"(?:client|account|access|user)_?(?:key_?)?id[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_-]{6,})"
WEAK_ID = re.compile(rf"(?<![A-Za-z0-9])(?:ASIA|AROA|AIDA|ABIA|ACCA)(?:[A-Z0-9]{{16}}(?![A-Za-z0-9])|(?=[A-Z]*[0-9])[A-Z0-9]{{12,}})|(?i:{NAMED_ID})", re.A)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9a-z+/_-]*[A-Z])(?=[0-9A-Z+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}")
NAMED = re.compile(NAMED_ID, re.I | re.A)
ENDPOINT = re.compile(r"(?:https?|s3|amqps?|postgres(?:ql)?|mysql|redis|mongodb(?:\+srv)?)://[^\s\"'<>]+", re.A)
#: What parts one block from the next: lines without a word.
BLANK = re.compile(r"\n(?:[ \t\r]*\n)+")
KINDS = (*BASE, "weak_id", "weak_secret", "endpoint")
ROLE = {"assign": "secret", "access": "id", "hex": "secret", "weak_id": "id", "weak_secret": "secret", "endpoint": "endpoint"}
#: Roles of which each completes the other.
COMPLETES = {"id": ("secret",), "secret": ("id", "endpoint"), "endpoint": ("secret",)}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the plain patterns, in code points."""
    out = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out


def weak_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all weak parts that no base span touches. Inside an endpoint only the value of a parameter is a secret, and what an
    assignment names an identifier is none."""
    weak = [(m.start(), m.end(), "weak_id") for m in WEAK_ID.finditer(text)]
    if "://" in text:
        weak += [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)]
    if weak or base:
        ends, ids = (_reach(sorted((s, e) for s, e, k in weak if k == kind)) for kind in ("endpoint", "weak_id"))
        found = ((m.start(), m.end(), "weak_secret") for m in WEAK_SECRET.finditer(text))
        weak += [w for w in found if not _meets(ids, w[0] + 1, w[1] - 1) and (text[w[0] - 1] == "=" or not _meets(ends, w[0] + 1, w[1] - 1))]
    touched = _reach(sorted((s, e) for s, e, _ in base))
    return [w for w in weak if not _meets(touched, w[0] + 1, w[1] - 1)]


def linked(text: str, base: list[tuple[int, int, str]], scope: int) -> list[tuple[int, int, str]]:
    """Weak parts with a completing part in a scope of theirs: an interval join of parts and scopes by binary search in each role's
    sorted starts, so without making pairs.

    Scopes: a part's block, between blank lines, as far as scope code points from it; and for what an assignment names (an
    identifier, a secret of kind assign) the whole text, where the other part is named as well. Either part completes the other.
    """
    weak = weak_spans(text, base)
    if not weak:
        return []
    cuts = [(m.start(), m.end()) for m in BLANK.finditer(text)]
    begins, ends = [0, *(e for _, e in cuts)], [*(s for s, _ in cuts), len(text)]
    parts: dict[str, list[tuple[int, int]]] = {r: [] for r in COMPLETES}
    for s, e, kind in [*base, *weak]:
        parts[ROLE[kind]].append((s, e))
    reach = {r: _reach(sorted(p)) for r, p in parts.items()}
    secret_named = any(k == "assign" for _, _, k in base)
    found = []
    for s, e, kind in weak:
        i = bisect_right(begins, s) - 1
        low, high = max(s - scope, begins[i] + 1), min(e + scope, ends[i] - 1)
        near = any(_meets(reach[r], low, high) for r in COMPLETES[ROLE[kind]])
        if near or kind == "weak_id" and secret_named and NAMED.match(text, s):
            found.append((s, e, kind))
    return found


def _reach(parts: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Sorted starts, and the farthest end so far."""
    ends, most = [], -1
    for _, e in parts:
        most = max(most, e)
        ends.append(most)
    return [s for s, _ in parts], ends


def _meets(reach, low: int, high: int) -> bool:
    starts, ends = reach
    i = bisect_left(starts, high + 1)
    return i > 0 and ends[i - 1] >= low


def spans_of(text: str, scope: int = 200) -> list[tuple[int, int, str]]:
    base = base_spans(text)
    return sorted({*base, *linked(text, base, scope)}, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scan(docs: DataFrame, scope: int = 200) -> DataFrame:
    """Every whole text's secrets: doc_id and spans, an array of (kind, start, end) in code points by start, then kind.

    Base spans are found by the plain patterns alone; weak ones are reported only where complementary parts meet in a scope, as linked() has it.
    Null and empty texts have none. Each row is scanned on its own, so rows that repeat repeat their result, and an
    empty table gives none; a null doc_id stays null; other columns are ignored. Spans of different kinds may overlap, as a secret that is a
    parameter of an endpoint; weak ones never overlap base ones. Equal starts go by kind, as listed in KINDS.
    """

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in split_by_size(batches, "text"):
            spans = [[{"kind": k, "start": s, "end": e} for s, e, k in spans_of(x, scope)] for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(spans, kind)], names=["doc_id", "spans"])

    return texts(docs).mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, scope: int = 200, mask: str = "[SECRET]") -> DataFrame:
    """docs with each run of overlapping secret spans in text replaced by mask; n_chars, if there, is counted anew.

    Rows and all other columns stay as they are, whatever their names; null texts stay null; a table without text stays as it is.
    """

    def mask_one(x: str | None) -> str | None:
        if not x:
            return x
        parts, at = [], 0
        for s, e in _merged(spans_of(x, scope)):
            parts += [x[at:s], mask]
            at = e
        return "".join([*parts, x[at:]])

    @F.pandas_udf("string")
    def masked(s: pd.Series) -> pd.Series:
        return pd.Series([mask_one(x) for x in s], dtype=object)

    in_small_batches(docs.sparkSession)
    flat, at = flattened(docs)
    if "text" not in at:
        return docs
    flat = flat.withColumn(at["text"], masked(F.col(at["text"]).cast("string")))
    if "n_chars" in at:
        flat = flat.withColumn(at["n_chars"], F.length(at["text"]).cast(flat.schema[at["n_chars"]].dataType))
    return flat.toDF(*docs.columns)


def _merged(spans):
    out: list[list[int]] = []
    for s, e, _ in spans:
        if out and s < out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def digest(docs: DataFrame, scope: int = 200) -> DataFrame:
    """The spans of scan() as counts, a hash of the base ones and one string of all."""

    def run(batches):
        for b in batches:
            rows = []
            for d, spans in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                said = [(x["kind"], f"{x['kind']}:{x['start']}:{x['end']}") for x in spans]
                base = ",".join(s for k, s in said if k in BASE)
                rows.append((d, *(sum(k == n for k, _ in said) for n in BASE), hashlib.sha256(base.encode()).hexdigest(), ",".join(s for _, s in said)))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, [pa.int64()] * 4 + [pa.string()] * 2)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return scan(docs, scope).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """digest() of every document; nulls, ties and repeated rows as in scan()."""
    return digest(documents(spark, sf_dir))
