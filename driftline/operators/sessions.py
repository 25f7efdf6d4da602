"""Sessions, gaps, runs over ordered events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def sessionize(df: DataFrame, key: str, ts: str, gap_s: float, tie: str) -> DataFrame:
    """Adds session (0, 1, ... per key): a new one starts after a gap of more than gap_s seconds."""
    order = W.partitionBy(key).orderBy(ts, tie)
    step = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(order).cast("timestamp"))) / 1_000_000.0
    df = df.withColumn("__new", F.when(step > gap_s, 1).otherwise(0))
    return df.withColumn("session", F.sum("__new").over(order.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def runs(df: DataFrame, key: str, order: list[str], value: Column, to: str = "run") -> DataFrame:
    """Adds `to`: numbers the stretches of equal neighbouring values within a key."""
    w = W.partitionBy(key).orderBy(*order)
    df = df.withColumn("__v", value)
    df = df.withColumn("__n", F.when(F.col("__v").eqNullSafe(F.lag("__v").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    return df.withColumn(to, F.sum("__n").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__v", "__n")


def mode(df: DataFrame, keys: list[str], value: str, to: str = "mode") -> DataFrame:
    """The most frequent value of each group; of equally frequent ones the smallest."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("__n"), F.col(value))).alias(to))


def parts(df: DataFrame, key: str, order: list[str], broken: Column) -> DataFrame:
    """Adds part (0, 1, ... per key): a new one begins at each row where `broken` holds; null does not break."""
    w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("part", F.sum(F.when(broken, 1).otherwise(0)).over(w))
