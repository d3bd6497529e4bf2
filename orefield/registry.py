"""All queries of the relational, award, vector and text operators, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orefield.plans import awards, datasets, intake, monitoring, notices, records, relational, searching, streams, text, upkeep, vectors

MODULES = (relational, awards, vectors, text, records, searching, streams, notices, monitoring, datasets, intake, upkeep)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.facets_of_state(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
