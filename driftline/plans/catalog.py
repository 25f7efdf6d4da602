"""All queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftline.plans import analysis_queries, corridor_queries, decision_queries, flow_queries, join_queries, live_queries, measure_queries, road_queries, row_queries, state_queries, suite_queries  # noqa: F401
from driftline.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decision_queries.ranked(spark, sf_dir, 3).select("request_id", "station_id", "service", "rank", "final_cost_s")
