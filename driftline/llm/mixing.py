"""Mixing sources to target weights by entropy balancing.

Every document starts at rate 1. The rates closest to that (in relative entropy), under one token constraint for each
source, are exponential tilts r = exp(lam * size / scale), held to `most` copies; lam is the source's multiplier. The
convex dual has one multiplier for each source, found by Newton steps whose gradient and curvature are sums over the
table (source, size, documents), spread over the executors; the driver holds only the multipliers. Rates become copies by
systematic rounding along each source in order of size; what is then missing or too much against the target is made up
by the smallest documents. All sums that decide are of whole numbers, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftline.llm.common import WORD, keep, partitions, table

WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2
#: Rates are whole numbers of this unit once they decide; moments are summed in it too.
UNIT = 1_000_000
STEPS, NEAR = 60, 1e-6
#: The multiplier of a source of which everything is taken as often as allowed.
FULL = 1e12
#: Sources up to this number are joined by broadcast (under 10 MB), more by shuffle.
FEW_SOURCES = 20_000


def size_of(text: str = "text") -> Column:
    line = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WORD, "x")
    return (F.length(line) - F.length(F.translate(line, "x", ""))).cast("long")


def targets(totals: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Tokens for each source: share of all tokens by weight; a source takes at most `most` times its own, and what is
    above goes to the others by weight, until none is above."""
    order = sorted(totals, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8", "surrogatepass")))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    cap = {s: float(most * n) for s, n in order}
    goal, left, free = {}, share * sum(n for _, n in order), [s for s, _ in order]
    while free:
        each = left / sum(weight[s] for s in free)
        full = [s for s in free if each * weight[s] >= cap[s]]
        if not full:
            return goal | {s: each * weight[s] for s in free}
        goal |= {s: cap[s] for s in full}
        left = max(0.0, left - sum(cap[s] for s in full))
        free = [s for s in free if s not in set(full)]
    return goal


def _per_source(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    df = spark.createDataFrame(rows, f"source string, {schema}")
    return F.broadcast(df) if len(rows) <= FEW_SOURCES else df


def solve(table_: DataFrame, goal: dict[str | None, float], scale: dict[str | None, float], most: float = MOST) -> dict[str | None, float]:
    """The multipliers. table_: source, size, docs. Damped Newton on the dual, all sources at once."""
    spark, lam = table_.sparkSession, {s: 0.0 for s in goal}
    high = {s: 20.0 * scale[s] + 60.0 for s in goal}
    low = {s: -high[s] for s in goal}
    full = {r.source for r in table_.groupBy("source").agg(F.sum(F.col("size") * F.col("docs") * most).alias("n")).collect() if goal[r.source] >= r.n}
    lam |= {s: FULL for s in full}
    open_ = {s for s in goal if scale[s] > 0} - full
    for _ in range(STEPS):
        if not open_:
            break
        now = _per_source(spark, [(s, lam[s], scale[s]) for s in sorted(open_, key=str)], "lam double, scale double")
        x = F.col("size") / F.col("scale")
        tilt = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        moment = F.col("docs") * F.round(F.least(tilt, F.lit(float(most))) * UNIT).cast("decimal(38,0)") * F.col("size")
        bend = F.col("docs") * F.round(F.when(tilt < most, tilt * x).otherwise(0.0) * UNIT).cast("decimal(38,0)") * F.col("size")
        sums = table_.alias("t").join(now.withColumnRenamed("source", "at"), F.expr("source <=> at")).groupBy("source").agg(F.sum(moment).alias("m"), F.sum(bend).alias("b")).collect()
        for s, m, b in ((r.source, float(r.m) / UNIT, float(r.b) / UNIT) for r in sums):
            off = m - goal[s]
            if abs(off) <= NEAR * max(goal[s], 1.0):
                open_.discard(s)
                continue
            (high if off > 0 else low)[s] = lam[s]
            step = lam[s] - off / b if b > 0 else math.inf
            lam[s] = step if low[s] < step < high[s] else (low[s] + high[s]) / 2
            if high[s] - low[s] < 1e-9 * max(1.0, abs(lam[s])):
                open_.discard(s)
    return lam


def running(df: DataFrame, group: str, order: list[str], value: str, to: str) -> DataFrame:
    """Adds `to`: the sum of `value` (long) over the rows of a group up to and with this one, in the given order.

    Rows are dealt by range of (group, order), so a large group spreads over many tasks; sums within a range are taken
    there, and each range adds the totals of the group's earlier ranges (one row for each range and group).
    """
    spark = df.sparkSession
    ranged = keep(df.repartitionByRange(partitions(spark), group, *order).withColumn("range", F.spark_partition_id()), "ranged")
    inside = W.partitionBy("range", group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    totals = ranged.groupBy("range", group).agg(F.sum(value).alias("total"))
    before = W.partitionBy(group).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(F.col("range").alias("r"), F.col(group).alias("g"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("earlier"))
    out = ranged.withColumn(to, F.sum(value).over(inside)).join(totals, (F.col("range") == F.col("r")) & F.col(group).eqNullSafe(F.col("g")))
    return out.withColumn(to, F.col(to) + F.col("earlier")).drop("range", "r", "g", "earlier")


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and the columns `carry` for every row of docs (doc_id, text, source).

    A null text has no words and is taken once; a null source is one source, ordered last. Repeated rows are rounded
    one by one. copies is 0 to `most`. A source's taken words miss its target by less than its largest document, mostly
    by much less. Other columns are left out. An empty table gives none.
    """
    spark = docs.sparkSession
    rows = keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size_of().alias("size"), *carry), "sizes")
    counts = keep(rows.groupBy("source", "size").agg(F.count("*").alias("docs")), "histogram")
    totals = [(r.source, int(r.n), float(r.top)) for r in counts.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("n"), F.max("size").alias("top")).collect()]
    goal = targets([(s, n) for s, n, _ in totals], weights, share, most)
    lam = solve(counts, goal, {s: top for s, _, top in totals}, most)
    of = _per_source(spark, [(s, n, goal[s], lam[s], max(top, 1.0)) for s, n, top in totals], "source_size long, target double, lam double, scale double")
    rows = rows.join(of.withColumnRenamed("source", "at"), F.expr("source <=> at")).drop("at")
    rate = F.least(F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(50.0))), F.lit(float(most)))
    rows = rows.withColumn("rate", F.round(rate * UNIT).cast("long")).drop("lam", "scale").withColumn("mixed", F.xxhash64("doc_id", "size"))
    rows = running(rows, "source", ["size", "mixed", "doc_id", *carry], "rate", "up_to")
    half = F.lit(UNIT // 2)
    copies = F.floor((F.col("up_to") + half) / UNIT) - F.floor((F.col("up_to") - F.col("rate") + half) / UNIT)
    rows = keep(rows.withColumn("copies", copies.cast("long")).drop("up_to"), "rounded")

    taken = rows.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("n"), F.first("target").alias("target"))
    missing = [(r.source, int(round(r.target - r.n))) for r in taken.collect()]
    now = _per_source(spark, missing, "missing long").withColumnRenamed("source", "at")
    rows = rows.join(now, F.expr("source <=> at")).drop("at")
    can = F.when(F.col("missing") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0) & (F.col("size") > 0) & (F.col("size") <= F.abs("missing"))
    rows = rows.withColumn("spare", F.when(can, F.col("size")).otherwise(0))
    rows = running(rows, "source", ["size", "mixed", "doc_id", *carry], "spare", "made_up")
    more = F.when((F.col("spare") > 0) & (F.col("made_up") <= F.abs("missing")), F.signum("missing").cast("long")).otherwise(0)
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("rate") / UNIT).alias("rate"), (F.col("copies") + more).alias("copies"), *carry)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = mix(table(spark, sf_dir, "documents"))
    return df.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")
