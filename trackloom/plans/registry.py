"""All queries of the core."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from trackloom.plans import network_queries, pings_queries, track_queries
from trackloom.plans.ship import ship

Query = Callable[[SparkSession, str], DataFrame]


def shipped(f: Query) -> Query:
    """The query with this package sent to the workers first."""

    @wraps(f)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ship(spark)
        return f(spark, sf)

    return run


_MODULES = (pings_queries, track_queries, network_queries)

QUERIES: dict[str, Query] = {k: shipped(f) for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE.items()}
