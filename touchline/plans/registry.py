"""All queries of the library but those of optional subpackages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from touchline.plans import breakdown_queries, form_queries, ingest_queries, legacy_queries, model_queries, report_queries, stream_queries, training_queries, validation_queries
from touchline.plans.fixtures import oracle

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (form_queries, model_queries, legacy_queries, report_queries, validation_queries, training_queries, ingest_queries, breakdown_queries, stream_queries)


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: oracle(sql) for module in MODULES for name, sql in module.SQL.items()}
