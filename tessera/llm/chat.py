"""Chat formatting on the level of tokens."""

from __future__ import annotations

import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import pick, split_by_size
from tessera.llm.tokens import byte_ids

#: The template's marks; each is one reserved id after the vocabulary's last, in this order.
MARKS = ("<turn>", "</turn>", "### System: ", "### User: ", "### Assistant: ", "### Other: ")
HEAD = {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "}
FIRST_ID = 50257
CONTROL = (*MARKS, "<|endoftext|>")
_CONTROL = re.compile("|".join(re.escape(c[0]) + "(?=" + re.escape(c[1:].rstrip()) + ")" for c in CONTROL))
_UNESCAPE = re.compile(r"\\(\\)?")


def escape(text: str) -> str:
    """Doubles backslashes, then puts one after the first character of each control string, so that none is left."""
    return _CONTROL.sub(lambda m: m[0] + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1] or "", text)


def _turn_ids(enc, role: str, text: str) -> tuple[bytes, bytes]:
    """Ids (32 bits) of a turn, and its loss mask (a byte an id): segments are encoded apart, reserved ids are spliced in.
    A role that the template has no mark for stands escaped, and with its own end, before the text."""
    head = HEAD.get(role)
    segments = [] if head else [np.frombuffer(enc.ids(escape(role), special=False), np.uint16).astype(np.uint32), np.array([FIRST_ID + 1], np.uint32)]
    body = np.frombuffer(enc.ids(escape(text), special=False), np.uint16).astype(np.uint32)
    marks = np.array([FIRST_ID, FIRST_ID + MARKS.index(head or "### Other: ")], np.uint32)
    parts = [marks, *segments, body, np.array([FIRST_ID + 1], np.uint32)]
    ids = np.concatenate(parts)
    # the mask is the prefix sum of +1 where an assistant's text begins and -1 after it
    step = np.zeros(len(ids) + 1, np.int8)
    if role == "assistant":
        begin = len(ids) - 1 - len(body)
        step[begin] += 1
        step[begin + len(body)] -= 1
    return ids.tobytes(), np.cumsum(step[:-1], dtype=np.int8).tobytes()


def format_turns(chats: DataFrame, vocabulary: str) -> DataFrame:
    """A row for each turn: conv_id, turn, ids (little-endian 32-bit) and loss (a byte an id, 1 under the loss).

    A conversation is its rows by turn, then role, then text (null turns first), ids joined. Null texts and roles are empty; a
    null conv_id is a conversation; rows that repeat are turns of their own; an empty table gives none; other columns
    are ignored. Long conversations stay rows, so no task holds a whole one.
    """

    def run(batches):
        enc = byte_ids(vocabulary)
        for b in split_by_size(batches, "text"):
            both = [_turn_ids(enc, r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), b.column(3), pa.array([x for x, _ in both], pa.binary()), pa.array([x for _, x in both], pa.binary())], names=["conv_id", "turn", "role", "text", "ids", "loss"])

    rows = pick(chats, "conv_id", "turn", "role", "text").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    return rows.mapInArrow(run, "conv_id long, turn long, role string, text string, ids binary, loss binary")


def read_turn(enc, ids: np.ndarray, loss: np.ndarray) -> tuple[str, str, str, int]:
    """Role, text, text under the loss and formatted code points of a turn, from its ids and mask alone."""
    marks = np.flatnonzero(ids >= FIRST_ID)
    kind = [int(ids[i]) - FIRST_ID for i in marks]
    chars = sum(len(MARKS[k]) for k in kind)
    head = MARKS[kind[1]]
    cuts = [enc.text(array("L", ids[a + 1 : b].tolist())) for a, b in zip(marks[1:-1], marks[2:])]
    chars += sum(map(len, cuts))
    role = next((r for r, h in HEAD.items() if h == head), None)
    role = unescape(cuts[0]) if role is None else role
    under = ids[loss.astype(bool)]
    return role, unescape(cuts[-1]), unescape(enc.text(array("L", under.tolist()))), chars


def digest(turns: DataFrame, vocabulary: str) -> DataFrame:
    """A row for each conversation, read back from the formatted turns. Rows of a conversation stream through in order;
    what is kept is two running hashes and counts, so a conversation of any length fits."""

    def read(batches):
        enc = byte_ids(vocabulary)
        for b in batches:
            back = [read_turn(enc, np.frombuffer(i, np.uint32), np.frombuffer(m, np.uint8)) for i, m in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]
            # the sort keys are the input's; what is hashed is what was read back
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), b.column(3), *[pa.array([x[k] for x in back], pa.string() if k < 3 else pa.int64()) for k in range(4)]], names=["conv_id", "turn", "role", "text", "r_role", "r_text", "r_loss", "chars"])

    def fold(batches):
        key, state, out = (), None, []

        def done():
            if state:
                out.append((key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for b in batches:
            for c, role, text, under, chars in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "r_role", "r_text", "r_loss", "chars"))):
                if key != (c,):
                    done()
                    key, state = (c,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(under)
                state[3].update(under.encode())
                state[4] += chars
            if out:
                yield _rows(out)
                out = []
        done()
        if out:
            yield _rows(out)

    def _rows(out):
        t = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), t)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    back = turns.mapInArrow(read, "conv_id long, turn long, role string, text string, r_role string, r_text string, r_loss string, chars long")
    back = back.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return back.mapInArrow(fold, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """digest() of all conversations and of conversation -7, read back from the formatted tokens; nulls, ties and repeated rows as in format_turns(). A
    conversation is hashed in order, so its rows, and all rows without conv_id, meet in one task, which sorts them on disk."""
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    chats = pick(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "turn", "role", "text")
    trap = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    return digest(format_turns(chats.unionByName(extra), vocabulary), vocabulary)


_OWN = r"\### Assistant: </turn> ok"
#: The same rows in SQL: the template's lengths, and a character more for each backslash and control string.
ORACLE = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{_OWN}'), (-7, 1, 'assistant', '{_OWN}')) v(conv_id, turn, role, text)),
e AS (SELECT *, length(text) + length(text) - length(replace(text, '\', '')) + length(regexp_replace(text, '({"|".join(re.escape(x.rstrip()).replace(chr(92) + " ", " ").replace(chr(92) + "#", "#") for x in CONTROL)})', '\1x', 'g')) - length(text) AS body FROM c),
f AS (SELECT *, body + 13 + CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 ELSE 18 + length(role) END AS chars FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id"""
