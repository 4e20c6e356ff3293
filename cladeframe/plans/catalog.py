"""All queries of the core package."""

from __future__ import annotations

from cladeframe.plans import io, matrix, models, objects, quality, records, reports, validation
from pyspark.sql import DataFrame, SparkSession

from cladeframe.plans.registry import Query

_REGISTRIES = (records.R, matrix.R, quality.R, models.R, validation.R, reports.R, objects.R, io.R)


def queries() -> dict[str, Query]:
    return {k: v for r in _REGISTRIES for k, v in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for r in _REGISTRIES for k, v in r.sql.items()}


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """The study screen: trim, ratio, Welch by branch state."""
    return matrix.j01_welch_screen(spark, folder)
