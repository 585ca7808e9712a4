"""All queries of the core and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fernbrand.plans import data_queries, more_queries, reference_queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference_queries.weather_classify(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return reference_queries.QUERIES | more_queries.QUERIES | data_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return reference_queries.ORACLES | more_queries.ORACLES | data_queries.ORACLES
