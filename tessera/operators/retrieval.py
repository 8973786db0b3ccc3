"""Hybrid retrieval: candidates of three sources, six signals, grouping of related memories, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import scoring as S
from tessera.functions import text as X
from tessera.functions.temporal import RELATIVE
from tessera.operators import vector

SIGNALS = tuple(S.WEIGHTS)
#: Hints of queries, or rows that they take, that are sent to all executors, at most; more go by a shuffled join.
MOST_SENT = 100_000


#: Fixed value: rows that an actor hint takes at most.
ACTOR_CAP = 500


def candidates(mem: DataFrame, queries: DataFrame, k: int = 50, actor_cap: int = ACTOR_CAP) -> DataFrame:
    """query_id, memory_id, and from which sources it comes: semantic (its similarity as 0 to 1, else 0), actor, temporal (0 or 1).

    queries: query_id, query (a vector), text, actor (or null), first, last and cap (the days of a date hint, or null, and the rows it takes at
    most, as temporal.window() has them). Actors and days take their newest rows up to the caps.
    """
    near = vector.nearest(mem, queries, k).select("query_id", "memory_id", F.lit("semantic").alias("source"), "similarity")
    by = mem.select("memory_id", "who_id", "when_ts")
    most = max(k, actor_cap, *(x[2] for x in RELATIVE.values()))

    def newest(rows: DataFrame, *of: str) -> DataFrame:
        # the constant bound lets each task drop rows before the shuffle
        best = Window.partitionBy(*of).orderBy(F.col("when_ts").desc(), "memory_id")
        return rows.withColumn("n", F.row_number().over(best)).where(F.col("n") <= most)

    def sent(rows: DataFrame, n: int) -> DataFrame:
        return F.broadcast(rows) if n <= MOST_SENT else rows

    # what a hint takes is found once for all queries that have it, so rows and queries don't meet but by what is taken
    hints = queries.where("actor is not null").select(F.col("actor").alias("hint")).distinct()
    own = newest(by.join(sent(hints, hints.count()), F.col("who_id") == F.col("hint")), "hint").where(F.col("n") <= actor_cap)
    actors = queries.select("query_id", F.col("actor").alias("hint")).join(own, "hint").select("query_id", "memory_id", F.lit("actor").alias("source"), F.lit(0.0).alias("similarity"))
    # days meet by equality and not by range; of a day no more rows can be taken than of all
    spans = queries.where("first <= last").select("first", "last", "cap").distinct()
    dated = spans.withColumn("day", F.explode(F.sequence("first", "last")))
    n_spans = spans.count()
    days = dated.select("day").distinct()
    of_day = newest(by.withColumn("day", F.to_date(F.substring("when_ts", 1, 10))).join(F.broadcast(days), "day"), "day").drop("n")
    taken = newest(of_day.join(dated, "day"), "first", "last", "cap").where(F.col("n") <= F.col("cap")).select("first", "last", "cap", "memory_id")
    dates = queries.select("query_id", "first", "last", "cap").join(sent(taken, n_spans * most), ["first", "last", "cap"]).select("query_id", "memory_id", F.lit("temporal").alias("source"), F.lit(0.0).alias("similarity"))
    best = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "memory_id")
    near = near.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")
    rows = near.unionByName(actors).unionByName(dates)
    flag = lambda name: F.max(F.when(F.col("source") == name, 1.0).otherwise(0.0)).alias(name)
    semantic = F.max(F.when(F.col("source") == "semantic", S.unit(F.col("similarity"))).otherwise(0.0)).alias("semantic")
    return rows.groupBy("query_id", "memory_id").agg(semantic, flag("actor"), flag("temporal"))


def signals(cands: DataFrame, mem: DataFrame, queries: DataFrame, as_of: str, source: str = "when_list", half_life: float = 168.0, usage: DataFrame | None = None) -> DataFrame:
    """Candidates with all six signals; candidates that the store lacks are dropped. source: the column recency is read from, where
    when_list means its first element. usage: memory_id, accesses; missing means none."""
    rows = cands.withColumnRenamed("actor", "_actor").join(mem.drop("embedding", "accesses") if usage is not None else mem.drop("embedding"), "memory_id")
    if usage is not None:
        rows = rows.join(usage.select("memory_id", "accesses"), "memory_id", "left")
    rows = rows.join(queries.select("query_id", F.col("text").alias("_text"), F.col("actor").alias("_hint")), "query_id")
    when = S.first_of(F.col("when_list")) if source == "when_list" else F.col(source)
    actor = F.when((F.col("_actor") > 0) | F.coalesce(S.first_of(F.col("who_list")) == F.col("_hint"), F.lit(False)), 1.0).otherwise(0.0)
    spatial = F.when(F.contains(F.lower("_text"), F.lower("where_value")), 1.0).otherwise(0.0)
    return rows.withColumns({"recency": S.recency(when, as_of, half_life), "actor": actor, "spatial": F.coalesce(spatial, F.lit(0.0)), "usage": S.usage(F.col("accesses"))}).drop("_actor", "_text", "_hint")


def ranked(rows: DataFrame, weights: dict[str, float] | None = None, k: int | None = None) -> DataFrame:
    """Rows with score and rank within their query, best first, ties to the lesser id; the first k of each."""
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "memory_id")
    out = rows.withColumn("score", S.weighted(weights or S.WEIGHTS)).withColumn("rank", F.row_number().over(w))
    return out if k is None else out.where(F.col("rank") <= k)


def search(mem: DataFrame, queries: DataFrame, as_of: str, k: int = 50, weights: dict[str, float] | None = None, group: bool = False, source: str = "when_list", literal: bool = False, half_life: float = 168.0) -> DataFrame:
    """The flagship: candidates, signals, recency damped by group size, rank. Other weights re-rank what the
    default weights let through: the cut at k is by the defaults. literal: grouped() by the letter."""
    rows = signals(candidates(mem, queries, k), mem, queries, as_of, source, half_life)
    size = F.lit(1)
    if group:
        rows = grouped(rows, literal)
        size = F.count("*").over(Window.partitionBy("query_id", "group_id"))
    top = ranked(rows.withColumn("recency", S.smart(F.col("recency"), size)), None, k)
    return ranked(top, S.completed(weights)) if weights is not None else top


def grouped(rows: DataFrame, literal: bool = False) -> DataFrame:
    """rows with group_id: candidates of a query in descending semantic order join the first group, in order of creation, of which
    one of the first three members is related, else open one. A query's candidates are bounded by the cuts of candidates().

    Related: the same first actor and over 3 shared entities; or Jaccard over 0.4; or both over 0.7 semantically and over 2 shared.
    literal: any memory with a first actor is related to the first group.
    """
    keyed = rows.select("query_id", "memory_id", "semantic", S.first_of(F.col("who_list")).alias("who"), X.memory_entities(F.col("what"), F.col("why")).alias("entities"))

    def place(pdf):
        import pandas as pd

        groups: list[list[tuple]] = []
        out = []
        for r in pdf.sort_values(["semantic", "memory_id"], ascending=[False, True]).itertuples():
            mine = set(r.entities)
            who = r.who if isinstance(r.who, str) and r.who else None
            at = next((g for g, members in enumerate(groups) if any(related(r.semantic, who, mine, *m) for m in members[:3])), None)
            if at is None:
                at = len(groups)
                groups.append([])
            groups[at].append((r.semantic, who, mine))
            out.append((r.query_id, r.memory_id, at))
        return pd.DataFrame(out, columns=["query_id", "memory_id", "group_id"])

    def related(sem, who, mine, other_sem, other_who, other):
        both, all_ = len(mine & other), len(mine | other)
        if literal and who:
            return True
        return (who is not None and who == other_who and both > 3) or (all_ > 0 and both / all_ > 0.4) or (sem > 0.7 and other_sem > 0.7 and both > 2)

    kind = rows.schema["query_id"].dataType.simpleString()
    groups = keyed.groupBy("query_id").applyInPandas(place, f"query_id {kind}, memory_id string, group_id long")
    return rows.join(groups, ["query_id", "memory_id"])


def narrowed(rows: DataFrame, exclude: DataFrame | None = None, threshold: float = 0.0, k: int | None = None) -> DataFrame:
    """After ranking or packing: leaves out ids, then scores under the threshold (if over 0), then all but the first k of a query."""
    if exclude is not None:
        rows = rows.join(exclude.select("memory_id").distinct(), "memory_id", "left_anti")
    if threshold > 0:
        rows = rows.where(F.col("score") >= threshold)
    if k is not None:
        w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "memory_id")
        rows = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")
    return rows


def cards(rows: DataFrame) -> DataFrame:
    """What a result list shows."""
    return rows.select("query_id", "rank", "memory_id", F.round("score", 3).alias("score"), F.concat_ws(": ", "who_type", "who_id").alias("who"), F.concat_ws(": ", "where_type", "where_value").alias("place"), "when_ts", S.band(F.col("score")).alias("label"))


def histogram(rows: DataFrame) -> DataFrame:
    """Counts of scores in ten bins of a tenth; the lowest takes everything below 0.1."""
    bin_ = F.when(F.col("score") >= 0.9, 9)
    for i in range(8, 0, -1):
        bin_ = bin_.when(F.col("score") >= i / 10, i)
    return rows.groupBy(bin_.otherwise(0).alias("bin")).agg(F.count("*").alias("n"))


def averages(rows: DataFrame) -> DataFrame:
    return rows.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(f"avg_{c}") for c in SIGNALS], F.coalesce(F.avg("score"), F.lit(0.0)).alias("avg_score"))


def temporal_rank(mem: DataFrame, hint: str | tuple[str, str] | dict, as_of: str | None = None, cap: int | None = None) -> DataFrame:
    """Memories of a date hint, newest first, at 0.8 less a thousandth for each place.

    hint: a day; a first and a last day; a word such as last_week, which is counted back from as_of; or a parser's answer, a dict with value, or with first and last.
    cap: rows at most; 200 for a day or range, by its word for a relative date, unless it is given."""
    from tessera.operators import store

    if isinstance(hint, dict):
        hint = (hint["first"], hint.get("last") or hint["first"]) if hint.get("first") else hint.get("value") or "last_week"
    if isinstance(hint, str) and not hint[:1].isdigit():
        if as_of is None:
            raise ValueError("a relative date needs as_of")
        rows, most = store.relative(mem, hint, as_of), store.RELATIVE.get(hint, store.RELATIVE["last_week"])[2]
        rows = rows if cap is None or cap >= most else store.newest(rows, F.lit(True), cap)
    else:
        first, last = (hint, hint) if isinstance(hint, str) else hint
        rows = store.between_dates(mem, first, last, 200 if cap is None else cap)
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("when_ts").desc(), "memory_id")  # at most cap rows
    return rows.select("memory_id", "when_ts").withColumn("score", 0.8 - 0.001 * (F.row_number().over(w) - 1))


def compared(mem: DataFrame, query: DataFrame, as_of: str) -> DataFrame:
    """Each memory's signals to one query (query vector, actor, day, text) with the comparison's weights; spatial is shown but not counted."""
    rows = mem.join(F.broadcast(query.select(F.col("query").alias("_q"), F.col("actor").alias("_actor"), F.col("day").alias("_day"), F.col("text").alias("_text"))))
    one = lambda c: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)
    rows = rows.withColumns({"semantic": S.dot(F.col("embedding"), F.col("_q")), "recency": S.recency(F.col("when_ts"), as_of), "actor": one(F.col("who_id") == F.col("_actor")), "temporal": one(F.to_date(F.substring("when_ts", 1, 10)) == F.col("_day")), "spatial": one(F.contains(F.lower("_text"), F.lower("where_value"))), "usage": S.usage(F.col("accesses"))})
    total = S.weighted({k: v for k, v in S.COMPARE_WEIGHTS.items() if k != "spatial"})
    verbal = F.when(F.col("semantic") > 0.7, "strong").when(F.col("semantic") > 0.4, "moderate").otherwise("weak")
    return rows.select("memory_id", *SIGNALS, total.alias("total"), verbal.alias("verbal"))
