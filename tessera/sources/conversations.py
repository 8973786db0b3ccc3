"""Conversations as memory rows."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


MESSAGES = "array<struct<role:string,content:string>>"


def parsed(text: Column) -> Column:
    """A conversation column, JSON or a Python literal, whose objects may lack commas between them, as an array of (role, content); empty if it is
    neither. What is plain JSON is read by Spark; only the rest goes through Python."""
    fixed = F.trim(F.regexp_replace(text, r"\}\r?\n ?\{", "}, {"))
    read = F.from_json(fixed, MESSAGES, {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})
    plain = F.rlike(fixed, F.lit(r"^\[")) & read.isNotNull() & F.try_parse_json(fixed).isNotNull()

    @F.pandas_udf(MESSAGES)
    def literal(texts: pd.Series) -> pd.Series:
        return pd.Series([_read(t) for t in texts], dtype=object)

    return F.when(plain, read).otherwise(literal(F.when(~F.coalesce(plain, F.lit(False)), fixed)))


def _read(text: str | None) -> list[dict] | None:
    if text is None:
        return None
    try:
        got = ast.literal_eval(text)
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        try:
            got = json.loads(text)
        except ValueError:
            return []
    said = lambda x: x if isinstance(x, str) or x is None else json.dumps(x, default=str)
    return [{"role": said(m.get("role")), "content": said(m.get("content"))} for m in got if isinstance(m, dict)] if isinstance(got, list) else []


def exploded(rows: DataFrame) -> DataFrame:
    """A row for each message of a bulk file's rows (conversation_id, conversation); a row that can't be read, or is null, gives none."""
    return rows.select(F.col("conversation_id").alias("conv_id"), F.posexplode(parsed(F.col("conversation"))).alias("turn", "m")).select("conv_id", "turn", "m.role", F.col("m.content").alias("text"))


def memories(chats: DataFrame, model: str = "fixture") -> DataFrame:
    """User and assistant messages with text as memories, by rules; the message before, of whatever role, gives the reason.

    A conversation's messages meet in one window partition; sorting spills, so its length is not bounded by memory.
    """
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = chats.withColumns({"_role": F.lag("role").over(w), "_text": F.substring(F.lag("text").over(w), 1, 200)})
    rows = rows.where(F.col("role").isin("user", "assistant") & (F.coalesce(F.col("text"), F.lit("")) != "")).withColumn("raw", F.substring("text", 1, 2000))
    user = F.col("role") == "user"
    why = F.when((F.col("_role") == "user") & ~user, F.concat(F.lit("Responding to: "), "_text")).when((F.col("_role") == "assistant") & user, F.concat(F.lit("Following up on: "), "_text")).otherwise("conversation exchange")
    words = F.size(F.filter(F.split("raw", r"\s+"), lambda x: x != ""))
    return rows.select(
        F.concat(F.lit("conv_"), F.col("conv_id"), F.lit("_"), F.col("turn")).alias("source_event_id"),
        F.col("conv_id").cast("string").alias("session_id"),
        F.when(user, "user").otherwise("llm").alias("who_type"),
        F.when(user, "chat_user").otherwise(model).alias("who_id"),
        F.concat(F.substring("raw", 1, 100), F.when(F.length("raw") > 100, "...").otherwise("")).alias("what"),
        F.concat(F.lit("conversation:"), F.col("conv_id")).alias("where_value"),
        why.alias("why"),
        F.when(user, "user input").otherwise(f"via {model}").alias("how"),
        F.col("raw").alias("raw_text"),
        words.alias("token_count"),
        F.substring("raw", 1, 500).alias("embed_text"),
    )


MEMORIES_SQL = r"""WITH p AS (SELECT *, lag(role) OVER w AS prole, substr(lag(text) OVER w, 1, 200) AS ptext FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), r AS (SELECT *, substr(text, 1, 2000) AS raw FROM p WHERE role IN ('user', 'assistant') AND coalesce(text, '') <> '')
SELECT 'conv_' || conv_id || '_' || turn AS source_event_id, conv_id::VARCHAR AS session_id, CASE role WHEN 'user' THEN 'user' ELSE 'llm' END AS who_type, CASE role WHEN 'user' THEN 'chat_user' ELSE 'fixture' END AS who_id,
  substr(raw, 1, 100) || CASE WHEN length(raw) > 100 THEN '...' ELSE '' END AS what, 'conversation:' || conv_id AS where_value,
  CASE WHEN prole = 'user' AND role = 'assistant' THEN 'Responding to: ' || ptext WHEN prole = 'assistant' AND role = 'user' THEN 'Following up on: ' || ptext ELSE 'conversation exchange' END AS why,
  CASE role WHEN 'user' THEN 'user input' ELSE 'via fixture' END AS how, raw AS raw_text, len(list_filter(regexp_split_to_array(raw, '\s+'), lambda x: x <> '')) AS token_count, substr(raw, 1, 500) AS embed_text FROM r"""
