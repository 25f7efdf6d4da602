"""Deterministic ranking and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def rank(features: DataFrame, request: str, top: int | None = None) -> DataFrame:
    """Adds final_cost_s, score and rank (long) per request.

    features: travel_s, wait_s, service_s, onward_s, personal, confidence, community, community_confidence (0 to 1 or null),
    start_s, detour_s, detour_m, age_s, capacity, station_id, service. Eight keys decide, in this order: score scaled to the
    best time, start, detour in time, detour in metres, age of the state (nulls last), more capacity, station, service.
    """
    total = F.col("travel_s") + F.col("wait_s") + F.col("service_s") + F.coalesce("onward_s", F.lit(0.0))
    personal = F.coalesce(0.1 * (1 - F.col("personal")) * F.col("confidence"), F.lit(0.0))
    community = F.coalesce(0.1 * (1 - F.col("community")) * F.col("community_confidence"), F.lit(0.0))
    df = features.withColumn("__t", total).withColumn("__ref", F.greatest(F.lit(1.0), F.min("__t").over(W.partitionBy(request))))
    df = df.withColumn("score", 0.8 * F.col("__t") / F.col("__ref") + personal + community)
    df = df.withColumn("final_cost_s", F.bround(F.col("score") * F.col("__ref") / 0.8, 3))
    last = lambda c: F.col(c).asc_nulls_last()
    order = W.partitionBy(request).orderBy("final_cost_s", F.bround("start_s", 3), last("detour_s"), last("detour_m"), last("age_s"), F.col("capacity").desc(), "station_id", "service")
    df = df.withColumn("rank", F.row_number().over(order).cast("long")).drop("__t", "__ref")
    return df.where(F.col("rank") <= top) if top else df


def first_n(df: DataFrame, group: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each group; Spark limits groups before the shuffle."""
    return df.withColumn("n", F.row_number().over(W.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col("n") <= n)


def with_sentinel(df: DataFrame, group: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each group, and whether there was one more."""
    more = first_n(df, group, order, n + 1)
    return more.withColumn("truncated", F.max("n").over(W.partitionBy(*group)) > n).where(F.col("n") <= n)


def label_cost(traffic_s: Column, wait_s: Column, service_s: Column, detour_min: Column, detour_m: Column, capacity: Column) -> Column:
    return F.round(traffic_s + wait_s + service_s + 0.25 * detour_min + 0.002 * detour_m - 0.35 * F.least(capacity, F.lit(6)), 4)


def numbered(df: DataFrame, bucket: Column, order: list[Column | str], to: str = "number") -> DataFrame:
    """Numbers all rows from 1 in one order without one task for all: `bucket` must not decrease along the order. Rows are
    numbered within their bucket, and each bucket begins where the counts of the earlier ones end; that running sum alone
    runs in one task, over one row a bucket."""
    df = df.withColumn("__bucket", bucket)
    counts = df.groupBy(F.col("__bucket").alias("__of")).agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(W.orderBy("__of").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__of", before.alias("__before"))
    own = df.withColumn("__n", F.row_number().over(W.partitionBy("__bucket").orderBy(*order)))
    rows = own.join(starts, F.col("__bucket").eqNullSafe(F.col("__of")))
    return rows.withColumn(to, (F.col("__before") + F.col("__n")).cast("long")).drop("__bucket", "__of", "__n", "__before")
