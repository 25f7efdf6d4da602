"""Joins that check what they join: cardinality, identity, predictions against a reference, stored state against new rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def many_to_one(facts: DataFrame, dim: DataFrame, on: list[str]) -> DataFrame:
    """Inner join; a key that occurs twice in dim fails the query when it runs instead of multiplying rows."""
    n = F.count("*").over(W.partitionBy(*on))
    checked = dim.withColumn("__n", n).withColumn("__ok", F.when(F.col("__n") == 1, F.lit(True)).otherwise(F.raise_error(F.lit("the dimension's key is not unique")).cast("boolean")))
    return facts.join(checked.where("__ok").drop("__n", "__ok"), on)


def with_reference(reference: DataFrame, predictions: DataFrame, on: list[str]) -> DataFrame:
    """Full join on a composite identity; side is BOTH, REFERENCE or PREDICTION."""
    left, right = reference.withColumn("__r", F.lit(1)), predictions.withColumn("__p", F.lit(1))
    side = F.when(F.col("__r").isNull(), "PREDICTION").when(F.col("__p").isNull(), "REFERENCE").otherwise("BOTH")
    return left.join(right, on, "full").withColumn("side", side).drop("__r", "__p")


def agreeing(sources: list[Column]) -> tuple[Column, Column]:
    """(value, whether the known ones agree): the first known of several statements of one identity."""
    known = F.array_distinct(F.array_compact(F.array(*sources)))
    return F.get(known, F.lit(0)), F.size(known) <= 1


def unique_matches(left: DataFrame, right: DataFrame, key: list[str], identity: str) -> DataFrame:
    """left with `identity` of the only right row of equal key, and matches: how many there are (0, 1, more). Several
    matches give none. Right rows are counted before the join, so no pair is ever made for them."""
    found = right.groupBy(*key).agg(F.min(identity).alias(identity), F.count_distinct(identity).alias("matches"))
    rows = left.join(found, key, "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
    return rows.withColumn(identity, F.when(F.col("matches") == 1, F.col(identity)))


def upsert_derived(stored: DataFrame, batch: DataFrame, key: str, evidence: str, derived: str) -> DataFrame:
    """stored after a batch: evidence never changes, derived values do where the evidence is the same; conflict marks keys
    whose new evidence differs (their row stays as it was)."""
    new = batch.select(F.col(key), F.col(evidence).alias("__e"), F.col(derived).alias("__d"), F.lit(True).alias("__new"))
    both = stored.withColumn("__old", F.lit(True)).join(new, key, "full")
    conflict = F.coalesce(F.col("__old") & F.col("__new") & ~F.col(evidence).eqNullSafe(F.col("__e")), F.lit(False))
    take = F.col("__new").isNotNull() & ~conflict
    return both.select(
        key, F.when(F.col("__old").isNull(), F.col("__e")).otherwise(F.col(evidence)).alias(evidence), F.when(take, F.col("__d")).otherwise(F.col(derived)).alias(derived), conflict.alias("conflict"),
    )


def recomputed(rows: DataFrame, group: str, changed: DataFrame, touched_by: list[str], compute) -> DataFrame:
    """compute(rows) only for groups with a row that a changed key touches; the other groups pass as they are. rows already
    holds compute's columns."""
    groups = rows.join(changed, touched_by, "left_semi").select(group).distinct()
    redone = compute(rows.join(groups, group, "left_semi"))
    return rows.join(groups, group, "left_anti").unionByName(redone.select(rows.columns))


def round_robin(df: DataFrame, classes: str, order: list[str], n: int) -> DataFrame:
    """n rows, one of each class in turn: first of each class, second of each, ... Only n rows of a class can matter, and
    Spark limits classes before the shuffle."""
    turn = F.row_number().over(W.partitionBy(classes).orderBy(*order)).cast("long")
    return df.withColumn("turn", turn).where(F.col("turn") <= n).orderBy("turn", classes).limit(n)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in conditions])
