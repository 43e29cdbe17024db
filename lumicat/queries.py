"""All registered queries of the catalog and raster operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import appearance, catalog, develop, measures, pointwise, raster, small, temperature, tone  # noqa: F401  registers them
from .plans.registry import ORACLE_SQL, QUERIES  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter and sort of the catalog."""
    return catalog.catalog_filter_sort(spark, sf_dir)
