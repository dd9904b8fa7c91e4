"""Registry of runnable queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    ops: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(ops: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under its own name."""

    def register(fn):
        if fn.__name__ in REGISTRY:
            raise ValueError(f"query {fn.__name__} registered twice")
        REGISTRY[fn.__name__] = Query(fn.__name__, ops, fn, sql)
        return fn

    return register


def r9(column):
    """Round a reported ratio so that engines with other float paths agree."""
    from pyspark.sql import functions as F

    return F.round(column.cast("double"), 9)


def r6(column):
    from pyspark.sql import functions as F

    return F.round(column.cast("double"), 6)
