"""Point-in-time joins over append-only state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def asof(requests: DataFrame, states: DataFrame, key: str, at: str, ts: str, payload: list[str], bucket: int | None = None) -> DataFrame:
    """Each request with the latest state of its key with ts <= at (inclusive), or nulls.

    One shuffle on (key, time bucket): both sides stand in one stream in order of time, and the last state seen so far is carried
    along. With `bucket` seconds a hot key is spread over its buckets; the state with which each bucket begins comes from
    one row for each key and bucket. payload columns come out with the prefix s_, as does ts. Ties on (key, ts): the larger
    payload. Rows with a null key or time match nothing.
    """
    second = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (1_000_000 * bucket)) if bucket else F.lit(0)
    names = requests.columns
    # requests that can match nothing stay out of the shuffle
    none = requests.where(F.col(key).isNull() | F.col(at).isNull())
    left = requests.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("__k"), F.col(at).alias("__t"), F.lit(1).alias("__side"), F.struct(*names).alias("__r"), second(at).alias("__b"))
    state = F.struct(F.col(ts), *payload)
    right = states.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key).alias("__k"), F.col(ts).alias("__t"), F.lit(0).alias("__side"), state.alias("__s"), second(ts).alias("__b"))
    both = left.unionByName(right, allowMissingColumns=True)
    order = W.partitionBy("__k", "__b").orderBy("__t", "__side", "__s").rowsBetween(W.unboundedPreceding, 0)
    rows = both.withColumn("__last", F.last("__s", ignorenulls=True).over(order)).where("__side = 1")
    if bucket:
        ends = right.groupBy("__k", "__b").agg(F.max("__s").alias("__s")).unionByName(left.select("__k", "__b").distinct(), allowMissingColumns=True)
        ends = ends.groupBy("__k", "__b").agg(F.max("__s").alias("__s"))
        before = W.partitionBy("__k").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
        ends = ends.select(F.col("__k").alias("__k2"), F.col("__b").alias("__b2"), F.last("__s", ignorenulls=True).over(before).alias("__before"))
        rows = rows.join(ends, (F.col("__k") == F.col("__k2")) & (F.col("__b") == F.col("__b2")), "left").withColumn("__last", F.coalesce("__last", "__before"))
    return _with_unmatched(rows.select("__r.*", *[F.col(f"__last.{c}").alias(f"s_{c}") for c in (ts, *payload)]), none)


def _with_unmatched(found: DataFrame, none: DataFrame) -> DataFrame:
    return found.unionAll(none.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema.fields[len(none.columns) :]]))


def known_asof(requests: DataFrame, states: DataFrame, key: str, at: str, ts: str, arrived: str, payload: list[str], bucket: int | None = None) -> DataFrame:
    """Each request with the latest state of its key, by ts, of those that were known by then: ts <= at and arrived <= at. A state
    that came late, or that was stamped ahead of its time, counts only from the later of both instants on.

    As a state is known from greatest(ts, arrived) on, a running maximum of (ts, payload) in that order is the answer: one shuffle
    on (key, time bucket) and one window, buckets beginning with the maximum of the earlier ones. payload, ts and arrived come
    out with the prefix s_. Ties on (key, ts): the larger payload, then arrival. Rows without key or time match nothing.
    """
    second = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / (1_000_000 * bucket)) if bucket else F.lit(0)
    none = requests.where(F.col(key).isNull() | F.col(at).isNull())
    left = requests.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("__k"), F.col(at).alias("__t"), F.lit(1).alias("__side"), F.struct(*requests.columns).alias("__r"), second(F.col(at)).alias("__b"))
    since = F.greatest(ts, arrived)
    right = states.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(arrived).isNotNull()).select(F.col(key).alias("__k"), since.alias("__t"), F.lit(0).alias("__side"), F.struct(ts, *payload, arrived).alias("__s"), second(since).alias("__b"))
    order = W.partitionBy("__k", "__b").orderBy("__t", "__side").rowsBetween(W.unboundedPreceding, 0)
    rows = left.unionByName(right, allowMissingColumns=True).withColumn("__last", F.max("__s").over(order)).where("__side = 1")
    if bucket:
        ends = right.groupBy("__k", "__b").agg(F.max("__s").alias("__s")).unionByName(left.select("__k", "__b").distinct(), allowMissingColumns=True)
        ends = ends.groupBy("__k", "__b").agg(F.max("__s").alias("__s"))
        before = W.partitionBy("__k").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
        ends = ends.select(F.col("__k").alias("__k2"), F.col("__b").alias("__b2"), F.max("__s").over(before).alias("__before"))
        rows = rows.join(ends, (F.col("__k") == F.col("__k2")) & (F.col("__b") == F.col("__b2")), "left").withColumn("__last", F.greatest("__last", "__before"))
    return _with_unmatched(rows.select("__r.*", *[F.col(f"__last.{c}").alias(f"s_{c}") for c in (ts, *payload, arrived)]), none)


def freshness(age_s: Column, limit_s: float = 600.0) -> Column:
    return F.when(age_s.isNull(), "MISSING").when(age_s <= limit_s, "FRESH").otherwise("STALE")


def latest_then_filter(states: DataFrame, key: str, ts: str, since: Column, until: Column, keep: Column, tie: str) -> DataFrame:
    """The newest row of each key in (since, until], and only then the filter: an old row never stands in for a newer one
    that fails it."""
    newest = W.partitionBy(key).orderBy(F.col(ts).desc(), F.col(tie).desc())
    rows = states.where((F.col(ts) > since) & (F.col(ts) <= until)).withColumn("__n", F.row_number().over(newest))
    return rows.where("__n = 1").drop("__n").where(keep)


def versions(df: DataFrame, key: str, at: str) -> DataFrame:
    """Adds until: when the next version of the key takes over (null: still valid)."""
    return df.withColumn("until", F.lead(at).over(W.partitionBy(key).orderBy(at)))


def bucket_join(requests: DataFrame, states: DataFrame, bucket: str, keys: list[str], value: str, fallback: str) -> DataFrame:
    """Left join on (keys, bucket); without a match the bucket's median over all keys, and else the given number."""
    medians = states.groupBy(bucket).agg(F.median(value).alias("__median"))
    rows = requests.join(states.select(*keys, bucket, value), [*keys, bucket], "left").join(medians, bucket, "left")
    return rows.withColumn(value, F.coalesce(F.col(value), F.col("__median"), F.expr(fallback))).drop("__median")


def append_once(table: DataFrame, batch: DataFrame, identity: list[str], payload: str) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, conflicts): the batch without repeats and without what is there; conflicts are identities whose
    payload differs from the table's or within the batch. A batch with conflicts must be rejected whole."""
    variants = batch.groupBy(*identity).agg(F.count_distinct(payload).alias("__n"), F.min(payload).alias(payload))
    inside = variants.where("__n > 1").select(*identity)
    old = table.select(*identity, F.col(payload).alias("__old"))
    against = variants.join(old, identity).where(~F.col(payload).eqNullSafe(F.col("__old"))).select(*identity)
    return variants.drop("__n").join(table, identity, "left_anti"), inside.union(against).distinct()
