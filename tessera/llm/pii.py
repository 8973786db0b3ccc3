"""Personal data by bootstrapped contextual extraction, in DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import documents, texts, written

KINDS = ("email", "ip", "card", "phone")
#: Kinds of discovered spans: what stands in the contexts of a base kind.
FOUND = tuple(f"id_{k}" for k in KINDS)
#: A separator that stands where the pattern allows one becomes MARK, so each pattern is runs of single characters, which
#: need no recursion and no backtracking, however long a text is. Texts' own MARKs become a character of no pattern.
MARK, NONE = "\x01", "\x03"
_LOCAL, _LABEL = rf"A-Za-z0-9._%+{MARK}-", "A-Za-z0-9-"
EMAIL_DOT = rf"(?<=[{_LABEL}])\.(?=[{_LABEL}])"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_LABEL}]++{MARK}[A-Za-z0-9{MARK}-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD_GAP = r"(?<=[0-9])[ -](?=[0-9])"
CARD = rf"[0-9][0-9{MARK}]{{12,}}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: What may be an identifier: a whole run of letters, digits and joining signs, of any length, with a digit anywhere; signs at its ends don't
#: belong to it, and it has TOKEN_DIGITS digits at least.
_JOINT = "_./#-"
TOKEN = rf"(?<![A-Za-z0-9{_JOINT}])[A-Za-z{_JOINT}]*+[0-9][A-Za-z0-9{_JOINT}]*+"
TOKEN_DIGITS = 4
#: Code points of text left of a span that its contexts are read from, and the longest part of a word that counts.
CONTEXT, WORD = 64, 24
#: Matches before a span that its context may reach over: they are 6 code points or longer, and apart, but for e-mail addresses of 5.
NEAR = 13
#: A pattern holds for a kind if this many known values of it stand in it, which are this share of all values there but known ones of
#: other kinds; rounds of the graph's scores.
SUPPORT, CONFIDENCE, ROUNDS = 3, 0.4, 3
#: Least score of an instance: one minus the product of what its patterns leave open.
ACCEPT = 0.6


def _found(text: Column, pattern: str) -> Column:
    """All matches, each with the piece of text since the last one: their lengths, and the ends of both that contexts need."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.zip_with(F.slice(pieces, 1, F.size(hits)), hits, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("size"), m.alias("value"), F.right(p, F.lit(CONTEXT)).alias("left")))


def _if(ask: Column, found: Column) -> Column:
    return F.when(ask, found).otherwise(F.array().cast("array<struct<gap:int,size:int,value:string,left:string>>"))


def matches(text: Column) -> list[Column]:
    """For each base kind, then for tokens: all matches of the pattern, whether they pass the kind's test or not."""
    text = F.translate(text, MARK, NONE)
    return [
        _if(F.contains(text, F.lit("@")), _found(F.regexp_replace(text, EMAIL_DOT, MARK), EMAIL)),
        _if(F.rlike(text, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), _found(text, IP)),
        _if(F.rlike(text, F.lit("[0-9](?:[ -]?[0-9]){12}")), _found(F.regexp_replace(text, CARD_GAP, MARK), CARD)),
        _if(F.rlike(text, F.lit(r"\+[0-9]")), _found(text, PHONE)),
        _if(F.rlike(text, F.lit("[0-9]")), _found(text, TOKEN)),
    ]


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether up to 19 digits pass: every second one from the right counts twice, with its digits added up."""
    back, total = F.reverse(digits), F.lit(0)
    for i in range(1, 20):
        d = F.coalesce(F.try_to_number(F.nullif(F.substring(back, i, 1), F.lit("")), F.lit("9")).cast("int"), F.lit(0))
        total = total + (d if i % 2 else d * 2 - F.when(d > 4, 9).otherwise(0))
    return total % 10 == 0


def passes(kind: Column, value: Column) -> Column:
    """The test of a base kind, and of tokens."""
    n = F.length(_digits(value))
    few = F.when(n.between(13, 19), _digits(value)).otherwise("1")
    byte = lambda p: F.coalesce(F.when(F.length(p) <= 3, p.cast("int")) <= 255, F.lit(False))
    ip = F.forall(F.split(value, r"\."), lambda p: byte(F.regexp_replace(p, "^0+(?=.)", "")))
    return F.when(kind == 0, True).when(kind == 1, ip).when(kind == 2, n.between(13, 19) & _luhn(few)).when(kind == 3, n.between(9, 15)).otherwise(n >= TOKEN_DIGITS)


def patterns(left: Column) -> Column:
    """The lexical patterns of what stands left of a span: its last word, and its last two, lower-case, a group of digits as 0."""
    plain = F.regexp_replace(F.lower(left), rf"[0-9]++(?:[ .{MARK}-][0-9]++)*+", "0")
    words = F.filter(F.split(F.translate(plain, MARK, "."), r"\s+"), lambda w: w != "")
    last = F.transform(F.slice(F.concat(F.array(F.lit(""), F.lit("")), words), -2, 2), lambda w: F.right(w, F.lit(WORD)))
    return F.when(F.size(words) == 0, F.array().cast("array<string>")).when(F.size(words) == 1, F.slice(last, 2, 1)).otherwise(F.array(last[1], F.array_join(last, " ")))


def spans(docs: DataFrame) -> DataFrame:
    """row, doc_id, kind (number, null for a row that stands for the document), start, end, value and patterns of all base spans, and of tokens
    that no base span touches. Places are running sums of lengths over a document's matches, in windows that spill, so a text of any
    number of matches costs in proportion to it. Contexts are of the text left of a span, whatever pattern found it."""
    kinds = F.filter(F.array(*[F.struct(F.lit(i).alias("kind"), found.alias("found")) for i, found in enumerate(matches(F.col("text")))]), lambda k: F.size(k["found"]) > 0)
    rows = texts(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")  # before the generators, so that it numbers documents
    rows = rows.select("row", "doc_id", F.explode_outer(kinds).alias("k"))
    rows = rows.select("row", "doc_id", F.col("k.kind").alias("kind"), F.posexplode_outer("k.found").alias("at", "m")).select("row", "doc_id", "kind", "at", "m.*")
    rows = written(rows, "matches")
    hits = rows.where("kind is not null").repartition("row")
    spot = Window.partitionBy("row", "kind").orderBy("at")
    unit = F.right(F.concat("left", "value"), F.lit(CONTEXT))
    hits = hits.withColumns({"end": F.sum(F.col("gap").cast("long") + F.col("size")).over(spot.rowsBetween(Window.unboundedPreceding, 0)), "near": F.collect_list(unit).over(spot.rowsBetween(-NEAR, -1))})
    hits = hits.where(passes(F.col("kind"), F.col("value")))
    token = F.col("kind") == len(KINDS)
    head = F.when(token, F.regexp_extract("value", f"^[{_JOINT}]*", 0)).otherwise("")
    tail = F.when(token, F.length(F.regexp_extract("value", f"(?<![{_JOINT}])[{_JOINT}]++$", 0))).otherwise(0)
    core = F.substr("value", F.length(head) + 1, F.col("size") - F.length(head) - tail)
    left = F.right(F.concat(F.array_join("near", ""), F.col("left"), head), F.lit(CONTEXT))
    hits = hits.select("row", "doc_id", "kind", (F.col("end") - F.col("size") + F.length(head)).alias("start"), (F.col("end") - tail).alias("end"), F.translate(core, MARK, ".").alias("value"), patterns(left).alias("patterns"))
    # a token is free if the base spans that begin before it end before it, and the next one begins after it
    all_before = Window.unboundedPreceding, -1
    forth = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(*all_before)
    back = Window.partitionBy("row").orderBy(F.col("start").desc(), F.col("kind").desc()).rowsBetween(*all_before)
    token = F.col("kind") == len(KINDS)
    hits = hits.withColumns({"last": F.max(F.when(~token, F.col("end"))).over(forth), "next": F.min(F.when(~token, F.col("start"))).over(back)})
    free = F.coalesce(F.col("last") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True))
    none = rows.where("kind is null or at = 0").select("row", "doc_id").distinct()
    none = none.select("row", "doc_id", F.lit(None).cast("int").alias("kind"), *[F.lit(None).cast(t).alias(n) for n, t in (("start", "long"), ("end", "long"), ("value", "string"), ("patterns", "array<string>"))])
    return written(hits.where(~token | free).drop("last", "next").unionByName(none), "spans")


def discovered(found: DataFrame) -> DataFrame:
    """value, kind (number of FOUND) of the values that are known in the end and were not at first: bootstrapping over the graph of patterns
    and values. Base spans are the seeds. In rounds, a pattern's confidence in a kind is the share of known values of it among all
    distinct values seen in it but those known to be of other kinds, and a value is known from a score of ACCEPT on, the noisy or of
    its patterns' confidences. Counts are aggregated in part before each shuffle, so a pattern that stands everywhere makes no large group."""
    n = range(len(KINDS))
    seed = lambda k: F.max(F.when(F.col("kind") == k, 1.0).otherwise(0.0)).alias(f"s{k}")
    edges = found.where("size(patterns) > 0").select(F.explode("patterns").alias("pattern"), "value", "kind").groupBy("pattern", "value").agg(*[seed(k) for k in n])
    edges = written(edges, "edges")
    s = [F.coalesce(f"s{k}", F.lit(0.0)) for k in n]
    seeds = edges.groupBy("value").agg(*[F.max(f"s{k}").alias(f"s{k}") for k in n]).where(F.greatest(*s) > 0)
    edges, known = edges.select("pattern", "value"), seeds
    for _ in range(ROUNDS):
        good = [F.sum(F.when(s[k] >= ACCEPT, 1).otherwise(0)).alias(f"g{k}") for k in n]
        seen = edges.join(known, "value", "left").groupBy("pattern").agg(F.sum(F.when(F.greatest(*s) >= ACCEPT, 0).otherwise(1)).alias("open"), *good)
        held = lambda k: (F.col(f"g{k}") >= SUPPORT) & (F.col(f"g{k}") >= CONFIDENCE * (F.col("open") + F.col(f"g{k}")))
        conf = [F.when(held(k), F.col(f"g{k}") / (F.col("open") + F.col(f"g{k}") + 1)).otherwise(0.0).alias(f"c{k}") for k in n]
        sure = seen.select("pattern", *conf).where(" or ".join(f"c{k} > 0" for k in n))
        score = edges.join(sure, "pattern").groupBy("value").agg(*[(1 - F.exp(F.sum(F.log(1 - F.col(f"c{k}"))))).alias(f"s{k}") for k in n])
        score = score.where(F.greatest(*s) >= ACCEPT).join(seeds, "value", "left_anti")
        known = written(seeds.unionByName(score), "known")
    best = reduce(lambda a, k: F.when(s[k] == F.greatest(*s), k).otherwise(a), reversed(n), F.lit(-1))
    return known.join(seeds, "value", "left_anti").select("value", (best + len(KINDS)).alias("kind"))


def extract(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: doc_id and spans, an array of (kind, start, end, value) in code points by kind, then start.

    Entities that the plain patterns match are the seeds. The last words to their left are patterns; tokens with TOKEN_DIGITS digits are
    candidates with the same patterns; discovered() tells which of them are known in the end. All their occurrences that no base span
    touches are spans of a kind of FOUND, by the kind of the seeds whose contexts they share.

    Null and empty texts have no spans; rows that repeat, also with the same doc_id, have a result each; a null doc_id stays null; an empty
    table gives no rows; other columns are ignored. Of equal scores the first kind wins. A document's spans are one row of the result.
    """
    found = spans(docs)
    new = found.where(F.col("kind") == len(KINDS)).drop("kind").join(discovered(found), "value")
    both = found.where(F.coalesce(F.col("kind") < len(KINDS), F.lit(True))).unionByName(new)
    item = F.when(F.col("kind").isNotNull(), F.struct("kind", "start", "end", "value"))
    out = both.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(item)).alias("spans"))
    names = F.array(*[F.lit(k) for k in (*KINDS, *FOUND)])
    return out.select("doc_id", F.transform("spans", lambda s: F.struct(F.element_at(names, s["kind"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))).alias("spans"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans, and all spans, of every document. Rows, nulls and ties as in extract()."""
    said = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    spans = F.col("spans")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return extract(documents(spark, sf_dir)).select("doc_id", *[count(k) for k in KINDS], F.sha2(said(F.filter(spans, lambda s: s["kind"].isin(*KINDS))), 256).alias("base_sha256"), said(spans).alias("spans"))
