"""Every query of the core by name, with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from railcorpus.plans import corpus_queries, review_queries, stat_queries, topic_queries  # noqa: F401  they fill the registry
from railcorpus.plans.registry import QUERIES, SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
