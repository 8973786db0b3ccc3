"""Lookups, filters, paging and writes of memory tables. State is immutable: writes give the next state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.temporal import RELATIVE

#: The columns that lists are sorted by, scores among them.
SORTABLE = ("when_ts", "created_at", "memory_id", "session_id", "who_id", "who_type", "where_type", "where_value", "what", "why", "how", "token_count", "score", "rank", "accesses")


def lookup(mem: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows with the ids; ids that aren't there give none."""
    return mem.join(ids.select("memory_id").distinct(), "memory_id", "left_semi")


def newest(mem: DataFrame, where: Column, limit: int, by: str = "when_ts") -> DataFrame:
    return mem.where(where).orderBy(F.col(by).desc_nulls_last(), "memory_id").limit(limit)


def by_actor(mem: DataFrame, who_id: str, limit: int = 100) -> DataFrame:
    return newest(mem, F.col("who_id") == who_id, limit)


def by_location(mem: DataFrame, value: str, limit: int = 100) -> DataFrame:
    return newest(mem, F.col("where_value") == value, limit)


def exists(mem: DataFrame, where: Column) -> DataFrame:
    """One row, one column: whether any row matches."""
    return mem.where(where).limit(1).agg((F.count("*") > 0).alias("found"))


def between_dates(mem: DataFrame, first: str, last: str, limit: int = 200) -> DataFrame:
    """Rows of the days first to last. The bound is on the stored text as well, so that the scan can skip row groups."""
    after = F.date_add(F.lit(last).cast("date"), 1).cast("string")
    near = (F.col("when_ts") >= first) & (F.col("when_ts") < after)
    return newest(mem, near & F.to_date(F.substring("when_ts", 1, 10)).between(F.lit(first).cast("date"), F.lit(last).cast("date")), limit)


def relative(mem: DataFrame, hint: str, as_of: str) -> DataFrame:
    """Rows of a relative date; unknown hints mean the last week."""
    import datetime

    back, until, limit = RELATIVE.get(hint, RELATIVE["last_week"])
    day = datetime.date.fromisoformat(as_of[:10])
    return between_dates(mem, str(day - datetime.timedelta(back)), str(day - datetime.timedelta(until)), limit)


def matching(text: str | None = None, session: str | None = None, who: str | None = None, where: str | None = None, entity: str | None = None, since: str | None = None, until: str | None = None) -> Column:
    """All the given predicates; texts match anywhere in the columns, in either case of letters."""
    any_of = lambda v, *cols: reduce(lambda a, b: a | b, [F.coalesce(F.ilike(F.col(c), F.lit(f"%{v}%")), F.lit(False)) for c in cols])
    parts = [F.lit(True)]
    parts += [any_of(text, "raw_text", "what", "why", "how")] if text else []
    parts += [F.col("session_id") == session] if session else []
    parts += [any_of(who, "who_id", "who_label", "who_type")] if who else []
    parts += [any_of(where, "where_value", "where_type")] if where else []
    parts += [any_of(entity, "what")] if entity else []
    parts += [F.col("when_ts") >= since] if since else []
    parts += [F.col("when_ts") <= until] if until else []
    return reduce(lambda a, b: a & b, parts)


def page(rows: DataFrame, sort: str = "when_ts", descending: bool = True, number: int = 1, size: int = 50) -> DataFrame:
    """A page with its row numbers and what pages there are; sort columns outside the list mean when_ts."""
    sort = sort if sort in SORTABLE else "when_ts"
    total = rows.agg(F.count("*").alias("total"), F.ceil(F.count("*") / F.lit(size)).alias("total_pages"))
    by = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_first()
    got = rows.orderBy(by, "memory_id").offset((number - 1) * size).limit(size)
    return got.crossJoin(F.broadcast(total)).withColumns({"has_prev": F.lit(number > 1), "has_next": F.col("total_pages") > number})  # one row of totals


def sessions(mem: DataFrame, prefix: str = "chat", limit: int = 50) -> DataFrame:
    rows = mem.where(F.col("session_id").like(f"{prefix}_%")).groupBy("session_id").agg(F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.count("*").alias("n"))
    return rows.orderBy(F.col("last_at").desc(), "session_id").limit(limit)


def upsert(state: DataFrame, delta: DataFrame, key: str = "memory_id", order: str = "created_at") -> DataFrame:
    """state with delta's rows in place of those with their key; of equal keys in delta the latest wins."""
    last = latest(delta, key, order)
    return state.join(last.select(key), key, "left_anti").select(*state.columns).unionByName(last)


def latest(rows: DataFrame, key: str | list[str], order: str | None = None) -> DataFrame:
    """A row for each key, of a column or several: the last by order, of equals the one with the least hash."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*([F.col(order).desc_nulls_last()] if order else []), F.xxhash64(*rows.columns))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def insert_ignore(state: DataFrame, delta: DataFrame, key: str = "memory_id") -> DataFrame:
    new = delta.join(state.select(key), key, "left_anti").dropDuplicates([key])
    return state.unionByName(new.select(*state.columns))


def delete(state: DataFrame, gone: DataFrame, key: str = "memory_id") -> DataFrame:
    """state without the rows of gone; dependents are deleted by the same call on their tables."""
    return state.join(gone.select(key).distinct(), key, "left_anti").select(*state.columns)


def record_access(usage: DataFrame, accessed: DataFrame) -> DataFrame:
    """Access counts and last times after more accesses (memory_id, at)."""
    more = accessed.groupBy("memory_id").agg(F.count("*").alias("accesses"), F.max("at").alias("last_access"))
    return usage.select("memory_id", "accesses", "last_access").unionByName(more.select("memory_id", F.col("accesses").cast(usage.schema["accesses"].dataType), "last_access")).groupBy("memory_id").agg(F.sum("accesses").alias("accesses"), F.max("last_access").alias("last_access"))
