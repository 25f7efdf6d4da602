"""Point-in-time state, joins, windows and sessions over events and orders.

Events stand in for the domain's logs: views and clicks are state snapshots of a user, purchases are decisions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftline.functions import expr
from driftline.operators import asof as A
from driftline.operators import ranking, sessions
from driftline.plans.registry import query, table
from driftline.sources import readers

ASOF = """
WITH r AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
s AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL),
j AS (SELECT r.event_id, r.user_id, r.ts, s.ts AS s_ts, s.value AS s_value FROM r ASOF LEFT JOIN s ON r.user_id = s.user_id AND r.ts >= s.ts)
"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", "user_id", "ts")


def states(spark: SparkSession, sf_dir: str, kind: str = "view") -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type") == kind).select("user_id", "ts", "value")


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.asof(decisions(spark, sf_dir), states(spark, sf_dir), "user_id", "ts", "ts", ["value"], bucket=86_400)


@query("j5_asof_latest", ASOF + "SELECT event_id, user_id, epoch(ts)::DOUBLE AS at, epoch(s_ts)::DOUBLE AS s_at, s_value FROM j")
def j5_asof_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolved(spark, sf_dir).select("event_id", "user_id", expr.epoch(F.col("ts")).alias("at"), expr.epoch(F.col("s_ts")).alias("s_at"), "s_value")


@query("p17_freshness", ASOF + """
SELECT event_id, round(epoch(ts) - epoch(s_ts), 3) AS age_s, CASE WHEN s_ts IS NULL THEN 'MISSING' WHEN epoch(ts) - epoch(s_ts) <= 600 THEN 'FRESH' ELSE 'STALE' END AS freshness FROM j""")
def p17_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = expr.epoch(F.col("ts")) - expr.epoch(F.col("s_ts"))
    return resolved(spark, sf_dir).select("event_id", F.round(age, 3).alias("age_s"), A.freshness(age).alias("freshness"))


#: One state in five arrives up to half a day late, one in nine is stamped two hours ahead of its arrival.
KNOWN = """
WITH s AS (SELECT user_id, ts, value, ts + INTERVAL 1 MINUTE * CASE WHEN event_id % 5 = 0 THEN event_id % 720 WHEN event_id % 9 = 0 THEN -120 ELSE 0 END AS arrived FROM events WHERE event_type IN ('view', 'click')),
d AS (SELECT event_id, user_id, ts AS asked FROM events WHERE event_type = 'purchase'),
k AS (SELECT d.event_id, d.asked, max(ROW(s.ts, s.value, s.arrived)) FILTER (WHERE s.ts <= d.asked AND s.arrived <= d.asked) AS b, max(ROW(s.ts, s.value)) FILTER (WHERE s.ts <= d.asked) AS p FROM d LEFT JOIN s ON s.user_id = d.user_id GROUP BY d.event_id, d.asked),
x AS (SELECT event_id, asked, b[1] AS s_ts, b[2] AS s_value, b[3] AS s_arrived, p[1] AS p_ts, p[2] AS p_value FROM k)
"""


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions with the state known by then (s_) and the one that would be taken if arrival did not matter (p_)."""
    i = F.col("event_id")
    late = F.when(i % 5 == 0, i % 720).when(i % 9 == 0, -120).otherwise(0)
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click"))
    s = e.select("user_id", "ts", "value", F.timestamp_micros(F.unix_micros("ts") + late * 60_000_000).alias("arrived"))
    d = decisions(spark, sf_dir).select("event_id", "user_id", F.col("ts").alias("at"))
    found = A.known_asof(d, s, "user_id", "at", "ts", "arrived", ["value"], bucket=86_400)
    plain = A.asof(d.select("event_id", "user_id", "at"), s, "user_id", "at", "ts", ["value"], bucket=86_400)
    return found.join(plain.select("event_id", F.col("s_ts").alias("p_ts"), F.col("s_value").alias("p_value")), "event_id")


@query("x9_known_states", KNOWN + "SELECT event_id, epoch(s_ts)::DOUBLE AS s_at, s_value, epoch(s_arrived)::DOUBLE AS arrived_at, s_ts IS DISTINCT FROM p_ts OR s_value IS DISTINCT FROM p_value AS held_back FROM x")
def x9_known_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each decision could know: states count from when they hold and have arrived, whichever is later."""
    held = ~(F.col("s_ts").eqNullSafe(F.col("p_ts")) & F.col("s_value").eqNullSafe(F.col("p_value")))
    return known(spark, sf_dir).select("event_id", expr.epoch(F.col("s_ts")).alias("s_at"), "s_value", expr.epoch(F.col("s_arrived")).alias("arrived_at"), held.alias("held_back"))


@query("x9_causality", KNOWN + "SELECT count(*) AS decisions, count(s_ts) AS matched, count(*) FILTER (WHERE s_ts > asked OR s_arrived > asked) AS violations, count(*) FILTER (WHERE p_ts IS NOT NULL AND (s_ts IS DISTINCT FROM p_ts OR s_value IS DISTINCT FROM p_value)) AS held_back FROM x")
def x9_causality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing that a decision uses was stamped or had arrived after it; how many would else have used what came late."""
    held = F.col("p_ts").isNotNull() & ~(F.col("s_ts").eqNullSafe(F.col("p_ts")) & F.col("s_value").eqNullSafe(F.col("p_value")))
    return known(spark, sf_dir).agg(F.count("*").alias("decisions"), F.count("s_ts").alias("matched"), F.count_if((F.col("s_ts") > F.col("at")) | (F.col("s_arrived") > F.col("at"))).alias("violations"), F.count_if(held).alias("held_back"))


@query("j8_latest_then_filter", """
WITH t AS (SELECT max(ts) AS t FROM events), w AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events, t WHERE ts > t - INTERVAL 1 DAY AND ts <= t)
SELECT user_id, event_id, value FROM w WHERE n = 1 AND value >= 100 ORDER BY value DESC, event_id LIMIT 5""")
def j8_latest_then_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    until = events.agg(F.max("ts")).first()[0]
    rows = A.latest_then_filter(events, "user_id", "ts", F.lit(until) - F.expr("INTERVAL 1 DAY"), F.lit(until), F.col("value") >= 100, "event_id")
    return rows.select("user_id", "event_id", "value").orderBy(F.desc("value"), "event_id").limit(5)


@query("j7_bucket_median_fallback", """
WITH s AS (SELECT user_id, epoch(ts)::BIGINT // 600 AS b, ts, value FROM events WHERE event_type = 'click'),
s1 AS (SELECT user_id, floor(epoch(ts) / 600)::BIGINT AS bucket, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY ALL),
m AS (SELECT bucket, median(value) AS med FROM s1 GROUP BY ALL)
SELECT event_id, floor(epoch(ts) / 600)::BIGINT AS bucket, round(coalesce(s1.value, med, 1.0), 6) AS value
FROM events e LEFT JOIN s1 ON s1.user_id = e.user_id AND s1.bucket = floor(epoch(ts) / 600)::BIGINT LEFT JOIN m ON m.bucket = floor(epoch(ts) / 600)::BIGINT
WHERE event_type = 'purchase'""")
def j7_bucket_median_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = F.floor(expr.epoch(F.col("ts")) / 600).alias("bucket")
    state = states(spark, sf_dir, "click").select("user_id", bucket, "value").groupBy("user_id", "bucket").agg(F.max("value").alias("value"))
    rows = A.bucket_join(decisions(spark, sf_dir).select("event_id", "user_id", bucket), state, "bucket", ["user_id"], "value", "1.0")
    return rows.select("event_id", "bucket", F.round("value", 6).alias("value"))


@query("j12_active_version", """
WITH v AS (SELECT user_id, ts AS since, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS until FROM (SELECT DISTINCT user_id, ts FROM events WHERE event_type = 'signup'))
SELECT event_id, epoch(v.since)::DOUBLE AS since FROM events e JOIN v ON v.user_id = e.user_id AND v.since <= e.ts AND (v.until IS NULL OR e.ts < v.until) WHERE event_type = 'error'""")
def j12_active_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id", "ts")
    signups = table(spark, sf_dir, "events").where("event_type = 'signup'").select("user_id", F.col("ts").alias("since")).distinct()
    # the interval that holds at a time is the one that began last: no range join is needed
    found = A.asof(errors, signups.withColumn("version", F.col("since")), "user_id", "ts", "since", ["version"], bucket=86_400)
    return found.where("s_version is not null").select("event_id", expr.epoch(F.col("s_version")).alias("since"))


@query("s3_tagged_snapshots", """
SELECT event_type AS kind, user_id::VARCHAR AS entity_id, count(*) AS n, min(value) AS low, max(value) AS high FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL""")
def s3_tagged_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = readers.snapshots(*[(kind, states(spark, sf_dir, kind), "user_id", "ts") for kind in ("view", "click")])
    value = F.get_json_object("payload", "$.value").cast("double")
    return log.groupBy("kind", "entity_id").agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))


@query("k1_append_once", """
WITH t AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' AND event_id % 2 = 0 GROUP BY ALL),
b AS (SELECT user_id, ts, min(value) AS value, count(DISTINCT value) AS k FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT (SELECT count(*) FROM b WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.user_id = b.user_id AND t.ts = b.ts)) AS inserted,
       (SELECT count(*) FROM b LEFT JOIN t USING (user_id, ts) WHERE k > 1 OR (t.value IS NOT NULL AND t.value IS DISTINCT FROM b.value)) AS conflicts""")
def k1_append_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = table(spark, sf_dir, "events").where("event_type = 'view'")
    there = views.where("event_id % 2 = 0").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    new, conflicts = A.append_once(there, views.select("user_id", "ts", "value"), ["user_id", "ts"], "value")
    both = new.select(F.lit(1).alias("i"), F.lit(0).alias("c")).unionAll(conflicts.select(F.lit(0), F.lit(1)))
    return both.agg(F.coalesce(F.sum("i"), F.lit(0)).cast("long").alias("inserted"), F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("conflicts"))


@query("k2_content_ids", "SELECT event_id, sha256('{\"ts\":' || (epoch_us(ts))::VARCHAR || ',\"user_id\":' || user_id::VARCHAR || '}') AS id FROM events")
def k2_content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.to_json(F.struct(F.unix_micros("ts").alias("ts"), "user_id"))
    return table(spark, sf_dir, "events").select("event_id", F.sha2(body, 256).alias("id"))


@query("k2_uuid5", """
WITH x AS (SELECT event_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('{"value":' || (CASE WHEN event_id % 5 = 0 THEN 0.0 ELSE round(value) END)::VARCHAR || ',"user_id":' || user_id::VARCHAR || '}')) AS h FROM events)
SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + ('0x' || substr(h, 17, 1))::BIGINT % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM x""")
def k2_uuid5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content ids as version 5 UUIDs of canonical JSON, in which minus zero is zero."""
    value = F.when(F.col("event_id") % 5 == 0, F.lit(-0.0)).otherwise(F.round("value")) + F.lit(0.0)
    body = F.to_json(F.struct(value.alias("value"), "user_id"))
    return table(spark, sf_dir, "events").select("event_id", expr.uuid5(body, "6ba7b811-9dad-11d1-80b4-00c04fd430c8").alias("id"))


@query("k6_latest_cache", "SELECT user_id, epoch(max(ts))::DOUBLE AS at, arg_max(value, (ts, value)) AS value FROM events GROUP BY user_id")
def k6_latest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftline.streaming.trace import latest_state

    return latest_state(table(spark, sf_dir, "events")).select("user_id", expr.epoch(F.col("ts")).alias("at"), "value")


@query("k4_upsert_fill_once", """
WITH o AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer WHERE c_custkey % 2 = 0),
n AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 5 <> 0)
SELECT coalesce(o.k, n.k) AS k, coalesce(o.v, n.v) AS v, coalesce(o.v IS NOT NULL AND n.v IS NOT NULL AND o.v <> n.v, false) AS conflict FROM o FULL JOIN n ON o.k = n.k""")
def k4_upsert_fill_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    old = c.where("k % 2 = 0").withColumn("v", F.when(F.col("k") % 3 != 0, F.col("v")))
    both = old.withColumnRenamed("v", "o").join(c.where("k % 5 <> 0").withColumnRenamed("v", "n"), "k", "full")
    return both.select("k", F.coalesce("o", "n").alias("v"), F.coalesce(F.col("o") != F.col("n"), F.lit(False)).alias("conflict"))


GAPS = """
WITH g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events),
s AS (SELECT *, sum(CASE WHEN d > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
"""


def sessionized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessionize(table(spark, sf_dir, "events"), "user_id", "ts", 3600.0, "event_id")


@query("w6_sessionize", GAPS + "SELECT event_id, user_id, session::BIGINT AS session FROM s")
def w6_sessionize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessionized(spark, sf_dir).select("event_id", "user_id", "session")


@query("a9_session_summary", GAPS + """, c AS (SELECT user_id, session, event_type, count(*) AS k FROM s GROUP BY ALL),
m AS (SELECT user_id, session, arg_min(event_type, (-k, event_type)) AS mode FROM c GROUP BY ALL)
SELECT user_id, session::BIGINT AS session, count(*) AS n, (max(epoch_us(ts)) - min(epoch_us(ts)))::BIGINT AS span_us, arg_min(value, (ts, event_id)) AS first_value, arg_max(value, (ts, event_id)) AS last_value,
       bool_and(value > 1) AS all_above, any_value(m.mode) AS mode FROM s JOIN m USING (user_id, session) GROUP BY ALL""")
def a9_session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, order = sessionized(spark, sf_dir), F.struct("ts", "event_id")
    summary = rows.groupBy("user_id", "session").agg(
        F.count("*").alias("n"), (F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))).alias("span_us"), F.min_by("value", order).alias("first_value"),
        F.max_by("value", order).alias("last_value"), F.bool_and(F.col("value") > 1).alias("all_above"),
    )
    return summary.join(sessions.mode(rows, ["user_id", "session"], "event_type"), ["user_id", "session"])


@query("a10_interval_percentiles", """
WITH g AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000000.0 AS d FROM events)
SELECT user_id, round(min(d), 4) AS low, round(quantile_cont(d, 0.5), 4) AS median, round(quantile_cont(d, 0.9), 4) AS p90, round(quantile_cont(d, 0.95), 4) AS p95, round(max(d), 4) AS high FROM g WHERE d IS NOT NULL GROUP BY user_id""")
def a10_interval_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    gaps = table(spark, sf_dir, "events").withColumn("d", (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(order)) / 1_000_000.0).where("d is not null")
    parts = [F.round(F.percentile("d", p), 4).alias(n) for p, n in ((0.5, "median"), (0.9, "p90"), (0.95, "p95"))]
    return gaps.groupBy("user_id").agg(F.round(F.min("d"), 4).alias("low"), *parts, F.round(F.max("d"), 4).alias("high"))


@query("w5_lag_repeats", """
WITH l AS (SELECT *, lag(event_type) OVER w AS p, lag(value) OVER w AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) FILTER (WHERE p = event_type) AS repeated, count(*) FILTER (WHERE abs(value - v) < 5) AS still FROM l GROUP BY user_id""")
def w5_lag_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", (F.lag("event_type").over(order) == F.col("event_type")).alias("r"), (F.abs(F.col("value") - F.lag("value").over(order)) < 5).alias("s"))
    return rows.groupBy("user_id").agg(F.count_if("r").alias("repeated"), F.count_if("s").alias("still"))


@query("w8_collapse_runs", """
WITH l AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS n FROM events),
r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM l)
SELECT user_id, run::BIGINT AS run, any_value(event_type) AS event_type, count(*) AS n FROM r GROUP BY user_id, run""")
def w8_collapse_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions.runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_type"))
    return rows.groupBy("user_id", "run").agg(F.first("event_type").alias("event_type"), F.count("*").alias("n"))


@query("w17_confirmed_runs", """
WITH l AS (SELECT *, value > 200 AS on_, CASE WHEN lag(value > 200) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT DISTINCT FROM (value > 200) THEN 0 ELSE 1 END AS n FROM events),
r AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM l),
g AS (SELECT user_id, run, count(*) AS k, sum(value::DECIMAL(18,2)) AS s FROM r GROUP BY ALL)
SELECT event_id, on_ AS is_on, k >= 3 AND s >= 300 AS confirmed FROM r JOIN g USING (user_id, run)""")
def w17_confirmed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessions.runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("value") > 200)
    w = W.partitionBy("user_id", "run")
    return rows.select("event_id", (F.col("value") > 200).alias("is_on"), ((F.count("*").over(w) >= 3) & (F.sum(F.col("value").cast("decimal(18,2)")).over(w) >= 300)).alias("confirmed"))


@query("w13_cumulative", "SELECT event_id, sum(value::DECIMAL(18,2)) OVER (PARTITION BY user_id ORDER BY ts, event_id)::DOUBLE AS travelled FROM events")
def w13_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, sf_dir, "events").select("event_id", F.sum(F.col("value").cast("decimal(18,2)")).over(order).cast("double").alias("travelled"))


@query("w14_trailing_context", """
SELECT event_id, least(count(*) OVER w, 50) AS context, round(max(value) OVER w, 4) AS high FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)""")
def w14_trailing_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-3_600_000_000, 0)
    return table(spark, sf_dir, "events").select("event_id", F.least(F.count("*").over(w), F.lit(50)).cast("long").alias("context"), F.round(F.max("value").over(w), 4).alias("high"))


@query("w15_changed", """
SELECT event_id, (event_type, value > 100) IS DISTINCT FROM lag((event_type, value > 100)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS changed FROM events""")
def w15_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.struct("event_type", F.col("value") > 100)
    return table(spark, sf_dir, "events").select("event_id", (~now.eqNullSafe(F.lag(now).over(W.partitionBy("user_id").orderBy("ts", "event_id")))).alias("changed"))


@query("w12_even_samples", """
WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
p AS (SELECT DISTINCT user_id, floor(n * (8 + 12 * j) / 100)::BIGINT AS i FROM (SELECT DISTINCT user_id, n FROM r), range(8) AS t(j))
SELECT r.user_id, r.i::BIGINT AS place, event_id FROM r JOIN p USING (user_id, i)""")
def w12_even_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("user_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.row_number().over(w.orderBy("ts", "event_id")) - 1).cast("long").alias("place"), F.count("*").over(w).alias("n"))
    chosen = F.array(*[F.floor(F.col("n") * (8 + 12 * j) / 100) for j in range(8)])
    return rows.where(F.array_contains(chosen, F.col("place"))).select("user_id", "place", "event_id")


@query("w2_bounded_history", """
WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders)
SELECT o_custkey, o_orderkey, n, max(n) OVER (PARTITION BY o_custkey) > 6 AS truncated FROM r WHERE n <= 7 QUALIFY n <= 6 OR false""")
def w2_bounded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.with_sentinel(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"], 6).select("o_custkey", "o_orderkey", "n", "truncated")


@query("w4_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def w4_distinct_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.first_n(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 1).select("o_custkey", "o_orderkey", "o_totalprice")


@query("w9_monotone", """
WITH d AS (SELECT o_custkey, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS d FROM orders)
SELECT o_custkey, coalesce(bool_and(d >= 0), true) AS monotone, count(*) FILTER (WHERE d < 0) AS falls FROM d GROUP BY o_custkey""")
def w9_monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_totalprice") - F.lag("o_totalprice").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_custkey", d.alias("d")).groupBy("o_custkey").agg(F.coalesce(F.bool_and(F.col("d") >= 0), F.lit(True)).alias("monotone"), F.count_if(F.col("d") < 0).alias("falls"))


@query("w18_near_ties", """
WITH r AS (SELECT o_custkey, o_totalprice, row_number() OVER w AS n, lead(o_totalprice) OVER w - o_totalprice AS d FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey))
SELECT o_custkey, round(d, 4) AS margin, coalesce(d < 1000, false) AS near_tie FROM r WHERE n = 1""")
def w18_near_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = W.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumn("n", F.row_number().over(w)).withColumn("d", F.lead("o_totalprice").over(w) - F.col("o_totalprice")).where("n = 1")
    return rows.select("o_custkey", F.round("d", 4).alias("margin"), F.coalesce(F.col("d") < 1000, F.lit(False)).alias("near_tie"))


@query("x12_tumbling_windows", "SELECT epoch(time_bucket(INTERVAL 10 MINUTE, ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value::DECIMAL(18,2))::DOUBLE, 4) AS total FROM events GROUP BY ALL")
def x12_tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "10 minutes"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,2)")).cast("double"), 4).alias("total"))
    return rows.select(F.unix_seconds("window.start").alias("start"), "event_type", "n", "total")


@query("x3_gap_sessions", GAPS + "SELECT user_id, epoch(min(ts))::DOUBLE AS start, count(*) AS n FROM s GROUP BY user_id, session")
def x3_gap_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sessionized(spark, sf_dir).groupBy("user_id", "session").agg(F.min("ts").alias("t"), F.count("*").alias("n"))
    return rows.select("user_id", expr.epoch(F.col("t")).alias("start"), "n")


@query("j9_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%')")
def j9_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(urgent, "c_custkey", "left_semi")


@query("j10_unpaired", "SELECT c_custkey, c_nationkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j10_unpaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("j17_conflicts", "SELECT a.event_id FROM events a JOIN events b ON a.event_id = b.event_id + 1 WHERE a.event_type IS DISTINCT FROM b.event_type")
def j17_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    other = e.select((F.col("event_id") + 1).alias("event_id"), F.col("event_type").alias("other"))
    return e.join(other, "event_id").where(~F.col("event_type").eqNullSafe(F.col("other"))).select("event_id")


@query("j2_left_join", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j2_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select("c_custkey", "n_name", "r_name")


@query("s14_replay_schedule", """
SELECT row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_type, event_id) AS place, event_id, event_type FROM events""")
def s14_replay_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [table(spark, sf_dir, "events").where(F.col("event_type") == k) for k in ("error", "click", "view", "signup", "purchase")]
    merged = kinds[0].unionByName(kinds[1]).unionByName(kinds[2]).unionByName(kinds[3]).unionByName(kinds[4])
    return merged.select(F.row_number().over(W.partitionBy(F.date_trunc("day", "ts")).orderBy("ts", "event_type", "event_id")).cast("long").alias("place"), "event_id", "event_type")
