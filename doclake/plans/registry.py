"""All registered queries and their SQL, by key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import session
from . import records, retrieval, sources, storage

PARTS = (sources, records, retrieval, storage)


def _set_up(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(session.configure(spark), sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _set_up(f) for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    """Questions answered from their documents, end to end."""
    return _set_up(retrieval.QUERIES["ask_document"])(spark, sf_dir)
