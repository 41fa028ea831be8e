"""All registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import input_queries, mechanism_queries, model_queries, pattern_queries, stat_queries, stream_queries, table_queries, text_queries  # noqa: F401  they register
from .registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship_group_contrast"](spark, sf_dir)
