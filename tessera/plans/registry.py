"""All queries and their SQL, collected from the modules that declare them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import queries as _queries, told as _told  # noqa: F401  both declare queries

Query = Callable[[SparkSession, str], DataFrame]
flagship = _queries.flagship


def queries() -> dict[str, Query]:
    return dict(_queries.QUERIES)


def oracles() -> dict[str, str]:
    return dict(_queries.ORACLES)
