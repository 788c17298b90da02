"""Every query of the library, and SQL for those that have it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafspan.plans import catalog_queries, more_queries, text_queries, tree_queries

_MODULES = (text_queries, tree_queries, catalog_queries, more_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document, the runs of pages that no leaf section covers."""
    return QUERIES["g1_gaps"](spark, sf_dir)
