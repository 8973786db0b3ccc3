"""Raw events as memory rows, by rules. Another extractor is any function of a DataFrame of events that gives the same columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.sources.fixtures import tokens

EVENT = "event_id string, session_id string, event_type string, timestamp timestamp, actor string, content string, metadata map<string,string>"
MULTI = 200


def _meta(*keys: str, default: str) -> Column:
    return F.coalesce(*[F.nullif(F.col("metadata")[k], F.lit("")) for k in keys], F.lit(default))


def is_multi(threshold: int = MULTI) -> Column:
    """Whether an event is worth several memories: long, of several paragraphs or lines, or an answer."""
    c = F.col("content")
    lines = F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return (F.length(c) > threshold) | F.contains(c, F.lit("\n\n")) | (lines > 3) | F.col("event_type").isin("llm_message", "tool_result")


def single(events: DataFrame) -> DataFrame:
    """One memory for each event."""
    found = X.rule_entities(F.col("content"))
    what = F.when(F.size(found) > 0, F.to_json(found)).otherwise(F.substring("content", 1, 160))
    why = F.coalesce(X.recall_topic(F.col("content")), _meta("intent", default="unspecified"))
    return _rows(events, what, _meta("location", "tool_name", default="local_ui"), why, _meta("method", "tool_name", default="message"), True)


def _part_rule() -> tuple[Column, Column, Column, Column]:
    """What, where, why and how of an event that is worth several parts."""
    what = _meta("operation", default="")
    return F.when(what == "", F.substring("content", 1, 160)).otherwise(what), _meta("location", default="local_ui"), _meta("intent", default="unspecified"), _meta("method", default="message")


def parts(events: DataFrame) -> DataFrame:
    """The rule for several parts: one part with the event's whole text."""
    return _rows(events.withColumn("event_id", F.concat("event_id", F.lit("_part0"))), *_part_rule(), False)


def parts_by(events: DataFrame, extract: Callable[[list[dict]], list[list[dict]]], batch: int = 8) -> DataFrame:
    """Several memories for each event. extract takes a list of events and gives a list of parts for each: who (type, id), what, where (type, value),
    why, how, all of which may be missing. It is called in the executors with batch events at a time. An event without parts, or one that extract fails
    on, is one part by the rule. Parts are numbered in their source_event_id; only the first holds the whole text. An event without an id, or
    content, is kept with null and empty text."""

    def run(batches):
        import pandas as pd

        for frame in batches:
            rows = []
            for i in range(0, len(frame), batch):
                own = frame.iloc[i : i + batch].to_dict("records")
                try:
                    found = extract(own)
                except Exception:  # a failing extractor falls back to the rule
                    found = [[]] * len(own)
                for e, ps in zip(own, found):
                    rows += _parted(e, ps)
            yield pd.DataFrame(rows, columns=_PART)

    what, where, why, how = _part_rule()
    rule = [X.who_type(F.col("event_type")).alias("who_type"), what.alias("what"), where.alias("where_value"), why.alias("why"), how.alias("how")]
    flat = events.select("event_id", "session_id", "event_type", "actor", "content", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("when_ts"), *rule)
    rows = flat.mapInPandas(run, ", ".join(f"{c} {'int' if c in ('part_index', 'total_parts') else 'string'}" for c in _PART))
    rows = rows.withColumn("memory_id", F.concat(F.lit("mem_"), F.substring(F.md5("source_event_id"), 1, 12)))
    rows = rows.withColumn("embed_text", X.embed_text(F.col("what"), F.col("why"), F.col("how"), None))
    return rows.withColumn("token_count", tokens(F.col("embed_text")))


_PART = ["session_id", "source_event_id", "who_type", "who_id", "what", "when_ts", "where_type", "where_value", "why", "how", "raw_text", "part_index", "total_parts"]


def _parted(event: dict, found: list[dict]) -> list[tuple]:
    content = event["content"] or ""
    given = found or [{"who": {"type": event["who_type"], "id": event["actor"]}, "what": event["what"], "where": {"value": event["where_value"]}, "why": event["why"], "how": event["how"]}]
    out = []
    for i, p in enumerate(given):
        who, where = p.get("who") or {}, p.get("where") or {}
        what = (p.get("what") or "").strip() or f"Part {i + 1} of {content[:100]}"
        raw = content if i == 0 else f"[Part {i + 1}] {what}"
        out.append((event["session_id"], f"{event['event_id']}_part{i}", who.get("type") or event["who_type"], who.get("id") or event["actor"], what, event["when_ts"], where.get("type") or "digital", where.get("value") or "local_ui", p.get("why") or "unspecified", p.get("how") or "message", raw, i, len(given)))
    return out


def _rows(events: DataFrame, what: Column, where: Column, why: Column, how: Column, raw: bool) -> DataFrame:
    rows = events.select(F.concat(F.lit("mem_"), F.substring(F.md5("event_id"), 1, 12)).alias("memory_id"), "session_id", F.col("event_id").alias("source_event_id"), X.who_type(F.col("event_type")).alias("who_type"), F.col("actor").alias("who_id"), what.alias("what"), F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("when_ts"), F.lit("digital").alias("where_type"), where.alias("where_value"), why.alias("why"), how.alias("how"), F.col("content").alias("raw_text"))
    said = X.embed_text(F.col("what"), F.col("why"), F.col("how"), F.col("raw_text") if raw else None)
    return rows.withColumn("embed_text", said).withColumn("token_count", tokens(F.col("embed_text")))


def extracted(events: DataFrame, threshold: int = MULTI, extractor: Callable[[list[dict]], list[list[dict]]] | None = None) -> DataFrame:
    """Each event by the rule that is_multi picks; those worth several memories by the extractor of parts_by(), if there is one. One pass: the two are parts of the same scan."""
    flag = events.withColumn("_multi", F.coalesce(is_multi(threshold), F.lit(False)))
    many = flag.where("_multi")
    if extractor is None:
        return single(flag.where("not _multi")).unionByName(parts(many))
    made = parts_by(many, extractor).drop("part_index", "total_parts")
    return single(flag.where("not _multi")).unionByName(made, allowMissingColumns=True)


def last_of_each(events: DataFrame) -> DataFrame:
    """Of the events with the same event_id the latest, of equally late ones that of the least hash; events without an id stay."""
    named = events.where("event_id is not null")
    plain = [c for c, t in events.dtypes if not t.startswith("map")]
    first = named.select(F.struct(*events.columns).alias("e"), F.struct(F.coalesce(F.unix_micros("timestamp"), F.lit(-(1 << 62))).alias("t"), F.xxhash64(*plain).alias("h")).alias("o"))
    once = first.groupBy(F.col("e.event_id").alias("k")).agg(F.max_by("e", "o").alias("e")).select("e.*")
    return once.unionByName(events.where("event_id is null"))


def stored(events: DataFrame, threshold: int = MULTI, embedder=None, extractor=None) -> DataFrame:
    """Events as rows of a memory store: extracted(), embedded, with their lists and counts. Events without an id, which no key could name, are left out."""
    from tessera.operators import vector

    rows = extracted(events.where("event_id is not null"), threshold, extractor)
    rows = vector.embedded_by(rows, embedder or vector.HashingEmbedder())
    return rows.withColumns({"who_list": F.to_json(F.array("who_id")), "when_list": F.to_json(F.array("when_ts")), "created_at": F.col("when_ts"), "accesses": F.lit(0), "who_label": F.lit(None).cast("string")})
