"""The reference operators' registered queries over the given tables, with their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkfolio.plans import bank_queries, canon_queries, hygiene_queries, jobs_queries, layout_queries, segment_queries, source_queries, store_queries

MODULES = (bank_queries, jobs_queries, segment_queries, canon_queries, layout_queries, hygiene_queries, source_queries, store_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in MODULES for name, (run, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
