"""All queries of the library and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphlake.operators.dashboard import confidence_trend
from glyphlake.plans import job_queries
from glyphlake.sources.fixtures import recognized_texts

QUERIES = job_queries.QUERIES
ORACLES = job_queries.ORACLES


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily confidence trend of every user."""
    return confidence_trend(recognized_texts(spark, sf_dir))
