"""Register of runnable queries with their SQL counterpart."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netloom.plans.fixtures import Tables, with_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, needs: tuple[str, ...] = (), sql: str | None = None, recursive: bool = False):
    """Register a function of `Tables`; `sql` may read the derived tables listed in `needs`."""
    def add(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            # `by` is a column name here and a keyword there
            ORACLES[name] = with_sql(needs, re.sub(r"\bby\b", '"by"', sql), recursive)
        return build
    return add
