"""Text, JSON and entity functions, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.scoring import json_list

# Word lists and patterns whose results must be equal.
STOP_WORDS = ("The", "This", "That", "What", "When", "Where")
RULE_STOP_WORDS = ("The", "This", "That", "What", "When", "Where", "Who", "How", "Why", "If", "Then", "And", "But", "Or", "In", "On", "At", "To", "From", "Is", "Are", "Was", "Were", "Can", "Could", "Would", "Should")
CAPITALISED, ACRONYM = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b", r"\b[A-Z]{2,}(?:-\d+)?\b"
NUMBERED, QUOTED = r"\b[A-Za-z]+\d+[A-Za-z0-9]*\b", r"""["']([^"']+)["']"""
KEYWORDS = ("gene", "protein", "enzyme", "hormone", "receptor", "molecule", "Python", "JavaScript", "Docker", "Redis", "API", "database", "script", "function", "class", "method", "variable", "player", "team", "trade", "contract", "game")
DELIMITERS = r"""[\s,;:.!?'"()\[\]{}]+"""
RECALL = ("remember", "recall", "memory", "memories", "what do you know", "what did we discuss", "what was said", "find information", "is there any memory", "do you have any memory")
SEARCH_TRIGGERS = ("current", "today", "now", "latest", "recent", "search", "look up", "find out", "check", "weather", "news", "price", "stock", "what is the date", "what time")
QUERY_RULES = (
    (("weather", "temperature", "rain", "snow", "forecast"), ((("now", "current", "right now"), "weather_current"), (("today", "tonight"), "weather_today"), ((), "weather_forecast"))),
    (("stock", "share price", "market"), (((), "stock_price"),)),
    (("bitcoin", "ethereum", "crypto"), (((), "cryptocurrency"),)),
    (("breaking", "just happened", "latest"), (((), "news_breaking"),)),
    (("news", "headlines"), ((("today",), "news_daily"), ((), "news_general"))),
    (("score", "game", "match"), (((), "sports_score"),)),
    (("traffic", "commute", "congestion"), (((), "traffic"),)),
    (("event", "concert", "show"), (((), "events"),)),
    (("price", "cost", "how much"), (((), "product_price"),)),
    (("movie", "cinema", "showtime"), (((), "movie_showtimes"),)),
    (("what is", "define", "meaning"), (((), "definition"),)),
    (("how to", "tutorial", "guide"), (((), "tutorial"),)),
    (("history", "historical", "when did"), (((), "historical_fact"),)),
    (("scientific", "research", "study"), (((), "scientific_fact"),)),
)
VALID_HOURS = {"weather_current": 0.5, "weather_today": 3, "weather_forecast": 24, "stock_price": 0.25, "cryptocurrency": 0.083, "news_breaking": 1, "news_daily": 24, "sports_score": 0.5, "traffic": 0.25, "news_general": 72, "events": 168, "product_price": 24, "movie_showtimes": 24, "historical_fact": 8760, "scientific_fact": 2190, "definition": 8760, "tutorial": 730, "default": 24}
TIME_SENSITIVE = ("weather_current", "weather_today", "weather_forecast", "stock_price", "cryptocurrency", "news_breaking", "news_daily", "sports_score", "traffic")


def contains_any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def distinct_by_case(items: Column, most: int = 20) -> Column:
    """The first of each spelling apart from case, in order, the first most of them."""
    low = lambda xs: F.transform(xs, lambda x: F.lower(x))
    pick = lambda xs, lows: F.transform(F.slice(F.array_distinct(lows), 1, most), lambda x: F.element_at(xs, F.array_position(lows, x).cast("int")))
    return _bound(items, lambda xs: _bound(low(xs), lambda lows: pick(xs, lows)))


def _bound(value: Column, f) -> Column:
    """f of a value that is computed once, though f uses it in lambdas."""
    return F.transform(F.array(value), f)[0]


def entities(what: Column) -> Column:
    """A JSON array as it is; else capitalised runs, then acronyms."""
    caps = F.filter(all_matches(what, CAPITALISED), lambda x: (F.length(x) > 2) & ~x.isin(*STOP_WORDS))
    plain = distinct_by_case(F.concat(caps, all_matches(what, ACRONYM)))
    listed = F.rlike(F.trim(what), F.lit(r"(?s)^\[.*\]$")) & F.from_json(what, "array<string>", {"allowSingleQuotes": "false"}).isNotNull()
    return F.when(F.coalesce(what, F.lit("")) == "", F.array().cast("array<string>")).when(listed, json_list(what)).otherwise(plain)


def rule_entities(text: Column) -> Column:
    """Entities by rules alone: capitalised runs, acronyms, words with digits, short quotes, keywords."""
    t = F.trim(text)
    caps = F.filter(all_matches(t, CAPITALISED), lambda x: (F.length(x) > 2) & ~x.isin(*RULE_STOP_WORDS))
    quotes = F.filter(all_matches(t, QUOTED, 1), lambda x: F.length(x) < 50)
    words = F.filter(F.array(*[F.lit(k) for k in KEYWORDS]), lambda k: F.contains(F.lower(t), F.lower(k)))
    return distinct_by_case(F.concat(caps, all_matches(t, ACRONYM), all_matches(t, NUMBERED), quotes, words))


def memory_entities(what: Column, why: Column) -> Column:
    """The set that grouping compares: listed entities or words of over 2 letters of what, words of over 3 of why, lower-case."""
    parts = lambda t, n: F.filter(F.split(F.lower(t), DELIMITERS), lambda w: F.length(w) > n)
    none = F.array().cast("array<string>")
    listed = F.startswith(what, F.lit("[")) & F.from_json(what, "array<string>", {"allowSingleQuotes": "false"}).isNotNull()
    own = F.when(listed, F.transform(json_list(what), lambda x: F.lower(x))).otherwise(parts(what, 2))
    return F.when(F.coalesce(what, F.lit("")) == "", none).otherwise(F.array_union(F.coalesce(own, none), F.coalesce(parts(why, 3), none)))


def recall_topic(text: Column) -> Column:
    """memory_recall and what follows the first listed phrase that is there; null if none is."""
    low, out = F.lower(text), None
    for k in RECALL:
        at = F.instr(low, k)
        topic = F.concat(F.lit("memory_recall: "), F.substring(F.trim(F.substring(text, at + len(k), F.length(text))), 1, 50))
        out = F.when(at > 0, topic) if out is None else out.when(at > 0, topic)
    return out


def who_type(event_type: Column) -> Column:
    return F.when(event_type.isin("tool_call", "tool_result"), "tool").when(event_type == "user_message", "user").when(event_type == "llm_message", "llm").otherwise("system")


def embed_text(what: Column, why: Column, how: Column, raw: Column | None = None) -> Column:
    said = lambda c: F.coalesce(c, F.lit("None"))
    out = [F.lit("WHAT: "), said(what), F.lit("\nWHY: "), said(why), F.lit("\nHOW: "), said(how)]
    return F.concat(*out, *([F.lit("\nRAW: "), said(raw)] if raw is not None else []))


def part_text(text: Column, part: Column, total: Column, source: Column) -> Column:
    """A chunk as memory text: its part, if there are several, and its source."""
    head = F.when(total > 1, F.concat(F.lit("[Part "), part, F.lit(" of "), total, F.lit("] "))).otherwise("")
    return F.concat(head, text, F.when(source.isNotNull(), F.concat(F.lit("\n[Source: "), source, F.lit("]"))).otherwise(""))


def first_json(text: Column, shape: str) -> Column:
    """What lies between the first opening and the last closing bracket, parsed; null if it isn't one value, as where words stand between two objects."""
    pattern = r"(?s)\[.*\]" if shape.startswith("array") else r"(?s)\{.*\}"
    found = F.nullif(F.regexp_extract(text, pattern, 0), F.lit(""))
    listed = F.from_json(F.concat(F.lit("["), found, F.lit("]")), f"array<{shape}>", {"allowSingleQuotes": "false"})  # in a list nothing can follow the value unseen
    return F.when(F.size(listed) == 1, listed[0])


#: How calls stand in an answer, in the order they are looked for.
CALLS = (r"(?s)<tool_call>(.*?)</tool_call>", r"(?s)```tool_call\n(.*?)\n```", r"(?s)```json\n(.*?)\n```")


def _calls(text: Column) -> Column:
    """What stands in the places of calls and is one: its whole text and what it says, as (said, call)."""
    found = F.concat(*[F.zip_with(all_matches(text, p, 0), all_matches(text, p, 1), lambda said, inner: F.struct(said.alias("said"), inner.alias("inner"))) for p in CALLS])
    shape = "struct<name:string,tool:string,arguments:map<string,string>,params:map<string,string>>"
    read = F.transform(found, lambda x: F.struct(x["said"].alias("said"), F.from_json(F.replace(F.trim(x["inner"]), F.lit("'"), F.lit('"')), shape).alias("call")))
    return F.filter(read, lambda x: x["call"]["name"].isNotNull() | (x["call"]["tool"].isNotNull() & x["call"]["arguments"].isNotNull()))


def tool_calls(text: Column) -> Column:
    """Calls in a model's answer: tagged, or in fenced blocks, as (name, arguments)."""
    none = F.create_map().cast("map<string,string>")
    return F.transform(_calls(text), lambda x: F.struct(F.coalesce(x["call"]["name"], x["call"]["tool"]).alias("name"), F.coalesce(x["call"]["arguments"], x["call"]["params"], none).alias("arguments")))


def without_tool_calls(text: Column) -> Column:
    """The answer without its calls; what looks like one but doesn't parse stays."""
    bare = F.aggregate(_calls(text), text, lambda left, x: F.replace(left, x["said"], F.lit("")))
    return F.regexp_replace(F.regexp_replace(bare, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def wants_search(text: Column) -> Column:
    return F.when(contains_any(F.lower(text), SEARCH_TRIGGERS), "web_search")


def query_type(text: Column) -> Column:
    """The first rule of which a word is in the text, then the first of its cases."""
    low, out = F.lower(text), None
    for words, cases in QUERY_RULES:
        inner = None
        for sub, name in cases:
            if sub:
                inner = F.when(contains_any(low, sub), name) if inner is None else inner.when(contains_any(low, sub), name)
            else:
                inner = F.lit(name) if inner is None else inner.otherwise(name)
        hit = contains_any(low, words)
        out = F.when(hit, inner) if out is None else out.when(hit, inner)
    return out.otherwise("default")


def valid_hours(kind: Column) -> Column:
    pairs = [F.lit(x) for k, v in VALID_HOURS.items() for x in (k, float(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.lit(float(VALID_HOURS["default"])))


# How lines of each kind begin.
OUTLINE = {"imports": r"^(import|from|const|let|var|require)", "functions": r"^(def |function |func |fn |sub )", "classes": r"^(class |interface |struct |enum )"}


def code_outline(text: Column) -> Column:
    """imports, functions and classes of source text: lines by their beginning, the first ten each, a line in the first kind that fits."""
    lines = F.split(text, "\r\n|[\n\r\x0b\x0c]")
    fields, before = [], []
    for name, p in OUTLINE.items():
        fields.append(F.slice(F.transform(_lines(lines, p, before), lambda x: F.trim(x)), 1, 10).alias(name))
        before.append(p)
    return F.struct(*fields)


def _lines(lines: Column, pattern: str, but: list[str]) -> Column:
    bad = "|".join(but)
    return F.filter(lines, lambda x: F.rlike(x, F.lit(pattern)) & (~F.rlike(x, F.lit(bad)) if bad else F.lit(True)))


def html_text(html: Column) -> Column:
    """Text of a page by patterns: tags go, what is inside them goes too."""
    return F.regexp_replace(html, "<[^<]+?>", "")


def html_title(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit(""))


def log_levels(lines: Column) -> list[Column]:
    return [F.sum(F.when(F.contains(F.upper(lines), F.lit(x)), 1).otherwise(0)).alias(f"n_{x.lower()}") for x in ("ERROR", "WARNING", "INFO", "DEBUG")]
