"""Packing memories into a budget of tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tokens of the window, kept for output, and for the system's text.
WINDOW, OUTPUT, SYSTEM = 20480, 1024, 512


def left(window: int, output: int, system: int, overhead: int = 0, search: bool = False) -> int:
    """budget() for one query, with other fixed parts."""
    return max(512, window - output - system - overhead - (512 if search else 0))


def budget(overhead: Column, search: bool = False) -> Column:
    """What is left of the window for memories, 512 at least; a search keeps 512 more."""
    left = F.lit(WINDOW - OUTPUT - SYSTEM) - overhead - (512 if search else 0)
    return F.greatest(F.lit(512), left)


def fingerprint(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def knapsack(rows: DataFrame, limit: int, by: str = "query_id") -> DataFrame:
    """Greedy by score for each token: what doesn't fit is passed over. A row for each pick: by, memory_id, pick (from 1), tokens, used.

    A query's candidates were cut before, so the fold is over a bounded array.
    """
    item = F.struct((-F.col("score") / F.greatest(F.lit(1), F.col("token_count"))).alias("d"), F.col("memory_id").alias("id"), F.col("token_count").cast("long").alias("t"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<id:string,t:bigint,used:bigint>>").alias("picked"))
    add = lambda a, x: F.when(a["used"] + x["t"] <= limit, F.struct((a["used"] + x["t"]).alias("used"), F.concat(a["picked"], F.array(F.struct(x["id"].alias("id"), x["t"].alias("t"), (a["used"] + x["t"]).alias("used")))).alias("picked"))).otherwise(a)
    folded = rows.groupBy(by).agg(F.array_sort(F.collect_list(item)).alias("items")).select(by, F.aggregate("items", start, add)["picked"].alias("picked"))
    return folded.select(by, F.posexplode("picked").alias("at", "p")).select(by, F.col("p.id").alias("memory_id"), (F.col("at") + 1).alias("pick"), F.col("p.t").alias("tokens"), F.col("p.used").alias("used"))


def chain(rows: DataFrame, limit: int, by: str = "query_id") -> DataFrame:
    """All candidates in blocks: the knapsack over what is left, again and again; if nothing fits, the smallest goes alone.

    A row for each member: by, block (from 0), rank in it, memory_id, tokens, block_tokens, has_more, and the blocks before and after.
    """

    def build(pdf):
        import pandas as pd

        left = [(-(s / max(1, t)), i, int(t)) for s, i, t in zip(pdf["score"], pdf["memory_id"], pdf["token_count"])]
        left.sort()
        blocks = []
        while left:
            used, picked, rest = 0, [], []
            for x in left:
                if used + x[2] <= limit:
                    used += x[2]
                    picked.append(x)
                else:
                    rest.append(x)
            if not picked:
                least = min(left, key=lambda x: (x[2], x[1]))
                used, picked = least[2], [least]
                rest = [x for x in left if x is not least]
            blocks.append((picked, used, bool(rest)))
            left = rest
        out = [(pdf[by].iloc[0], b, r, x[1], x[2], used, more, b - 1 if b else None, b + 1 if b + 1 < len(blocks) else None) for b, (picked, used, more) in enumerate(blocks) for r, x in enumerate(picked)]
        return pd.DataFrame(out, columns=[by, "block", "rank", "memory_id", "tokens", "block_tokens", "has_more", "prev_block", "next_block"])

    kind = rows.schema[by].dataType.simpleString()
    return rows.select(by, "memory_id", "score", "token_count").groupBy(by).applyInPandas(build, f"{by} {kind}, block long, rank long, memory_id string, tokens long, block_tokens long, has_more boolean, prev_block long, next_block long")


def members(blocks: DataFrame, by: str = "query_id") -> DataFrame:
    """Blocks read back: a row each with its members in order."""
    return blocks.groupBy(by, "block", "block_tokens", "has_more", "prev_block", "next_block").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "memory_id"))), lambda x: x["memory_id"]).alias("member_ids"))
