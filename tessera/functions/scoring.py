"""Scalar functions of retrieval scores, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The shares of the six signals.
WEIGHTS = {"semantic": 0.68, "recency": 0.02, "actor": 0.10, "temporal": 0.10, "spatial": 0.05, "usage": 0.05}
COMPARE_WEIGHTS = {"semantic": 0.35, "recency": 0.20, "actor": 0.15, "temporal": 0.10, "spatial": 0.05, "usage": 0.15}
#: Text that is an ISO date, with a time or without; other texts that Spark would parse are no times.
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$"


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column, eps: float = 1e-8) -> Column:
    """v as doubles of length one; a zero vector stays zero."""
    n = norm(v) + F.lit(eps)
    return F.transform(v, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def unit(similarity: Column) -> Column:
    """A similarity of -1 to 1 as 0 to 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (similarity + 1) / 2))


def parsed(ts: Column) -> Column:
    """Text as a timestamp, if it is an ISO time; else null."""
    return F.when(F.rlike(ts, F.lit(ISO)), F.try_to_timestamp(ts))


def age_hours(ts: Column, as_of: str) -> Column:
    return (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(ts)) / F.lit(3.6e9)


def recency(ts: Column, as_of: str, half_life: float = 168.0) -> Column:
    """Halves with each half-life; later than as_of is 1, no time is 0.5."""
    r = F.pow(F.lit(0.5), age_hours(parsed(ts), as_of) / half_life)
    return F.when(r.isNull(), 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), r)))


def json_list(text: Column) -> Column:
    """A JSON array of strings; null, other JSON and plain text are an empty list."""
    ok = F.rlike(F.trim(text), F.lit(r"(?s)^\[.*\]$"))
    got = F.from_json(F.when(ok, text), "array<string>", {"allowSingleQuotes": "false", "mode": "PERMISSIVE"})
    return F.coalesce(got, F.array().cast("array<string>"))


def first_of(text: Column) -> Column:
    return F.try_element_at(json_list(text), F.lit(1))


def fresh_for(asked: DataFrame, mem: DataFrame, as_of: str) -> DataFrame:
    """asked (with kind, a type of query) with valid and invalid, the numbers of memories that are young enough for its kind and that are not, and
    needs_tool. Memories are counted once, for the few kinds there are."""
    from tessera.functions import text as X

    age = age_hours(parsed(F.col("when_ts")), as_of)
    counts = mem.agg(*[F.count(F.when(age <= float(h), 1)).alias(k) for k, h in X.VALID_HOURS.items()], F.count("*").alias("_all"))
    by = counts.select("_all", F.explode(F.create_map(*[x for k in X.VALID_HOURS for x in (F.lit(k), F.col(k))])).alias("kind", "valid"))
    rows = asked.join(F.broadcast(by), "kind").withColumn("invalid", F.col("_all") - F.col("valid")).drop("_all")  # a row for each kind
    return rows.withColumn("needs_tool", (F.col("valid") == 0) & F.col("kind").isin(*X.TIME_SENSITIVE))


def usage(accesses: Column, full: float = 50.0) -> Column:
    return F.least(F.lit(1.0), F.coalesce(accesses, F.lit(0)) / F.lit(full))


def weighted(weights: dict[str, float]) -> Column:
    """The sum of the signals' columns times their weights, in a fixed order."""
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + F.col(name) * F.lit(float(w))
    return total


def completed(weights: dict[str, float]) -> dict[str, float]:
    """Weights with defaults for missing ones; all divided by their sum if it is off 1 by more than 0.001."""
    full = WEIGHTS | weights
    total = sum(full.values())
    if abs(total - 1) > 0.001 and total:
        full = {k: v / total for k, v in full.items()}
    return full


def smart(base: Column, size: Column) -> Column:
    """Recency counts in full among five related memories or more, a tenth for one alone."""
    return base * F.when(size <= 1, 0.1).otherwise(0.1 + 0.9 * F.least(F.lit(1.0), size / 5.0))


def band(score: Column, high: float = 0.8, middle: float = 0.5) -> Column:
    return F.when(score >= high, "high").when(score >= middle, "medium").otherwise("low")
