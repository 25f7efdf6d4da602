"""Live traces on proxies: a user's events are a driver's observations, some of them with match results that come back later."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.operators import registry
from driftline.plans.registry import query, table
from driftline.session import new_path
from driftline.streaming import live
from driftline.streaming.trace import replay

TTL_S, LATE_S = 300, 200.5

LIVE = f"""
WITH RECURSIVE a AS (SELECT user_id, event_id AS i, value, row_number() OVER w AS n, count(*) FILTER (WHERE event_id % 7 = 0) OVER w AS g, count(*) FILTER (WHERE event_id % 41 = 0) OVER w AS h FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT *, (100 + n * 20 + g * 70 + h * 400)::DOUBLE AS t, max(CASE WHEN n = 1 OR i % 7 = 0 OR i % 41 = 0 THEN n ELSE 1 END) OVER (PARTITION BY user_id ORDER BY n) AS began FROM a),
o AS (SELECT user_id, n * 10 AS seq, 'gps' AS kind, i AS item, t - CASE WHEN i % 13 = 0 THEN 45 ELSE 0 END AS at_s, CASE WHEN i % 29 <> 0 THEN floor(value / 30) * 30 END AS x, NULL::BIGINT AS asked, NULL::VARCHAR AS outcome, i FROM b),
r AS (SELECT user_id, seq, kind, item, at_s, x, asked, outcome FROM o UNION ALL SELECT user_id, seq + 1, kind, item, at_s, x, asked, outcome FROM o WHERE i % 11 = 0
  UNION ALL SELECT user_id, seq + 2, kind, item, at_s, x + 1, asked, outcome FROM o WHERE i % 17 = 0
  UNION ALL SELECT user_id, n * 10 + 5, 'result', i, t + 5, NULL::DOUBLE, CASE WHEN i % 5 = 0 THEN 10 ELSE began * 10 END, CASE i % 4 WHEN 0 THEN 'MATCHED' WHEN 1 THEN 'PARTIAL_MATCH' WHEN 2 THEN 'NO_MATCH' ELSE 'ENGINE_UNAVAILABLE' END FROM b WHERE i % 3 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS k FROM r),
z AS (
  SELECT DISTINCT user_id, 0::BIGINT AS k, NULL::BIGINT AS seq, NULL::DOUBLE AS at_s, NULL::DOUBLE AS last, NULL::DOUBLE AS x, NULL::BIGINT AS item, 0 AS buffered, 0 AS still, 0.0::DOUBLE AS moved, NULL::DOUBLE AS matched, NULL::BIGINT AS gen, '' AS status, false AS asks, NULL::DOUBLE AS gone, NULL::BIGINT AS gone_gen FROM k
  UNION ALL
  SELECT user_id, k, seq, at_s, CASE WHEN taken THEN at_s ELSE last END, CASE WHEN taken THEN nx ELSE x END, CASE WHEN taken THEN nitem ELSE item END, buf, stl, CASE WHEN status IN ('MATCHED', 'PARTIAL_MATCH') THEN 0 ELSE mov END,
    CASE WHEN status IN ('MATCHED', 'PARTIAL_MATCH') THEN at_s WHEN status = 'GAP_RESET' THEN NULL ELSE matched END, ngen, status,
    status = 'GPS_ACCEPTED' AND NOT (stl >= 3 AND matched IS NOT NULL) AND (mov >= 50 OR coalesce(at_s - matched >= 10, false)), gone, gone_gen
  FROM (
    SELECT *, taken AND NOT fresh AND gap AS reset, CASE WHEN NOT taken THEN gen WHEN fresh OR gap THEN seq ELSE gen END AS ngen, CASE WHEN NOT taken THEN buffered WHEN fresh OR gap THEN 1 ELSE buffered + 1 END AS buf,
      CASE WHEN NOT taken THEN still WHEN fresh OR gap THEN 0 WHEN abs(nx - x) < 5 THEN still + 1 ELSE 0 END AS stl, CASE WHEN NOT taken OR fresh OR gap THEN moved ELSE moved + abs(nx - x) END AS mov,
      CASE WHEN NOT taken THEN said WHEN NOT fresh AND gap THEN 'GAP_RESET' WHEN fresh OR buffered < 2 THEN 'WARMING_UP' ELSE 'GPS_ACCEPTED' END AS status
    FROM (
      SELECT *, last IS NULL AS fresh, coalesce(at_s - last > 60, false) AS gap, said = '' AS taken FROM (
        SELECT *, CASE WHEN kind = 'result' THEN CASE WHEN asked IS DISTINCT FROM gen OR last IS NULL THEN 'REFUSED' ELSE outcome END WHEN nx IS NULL THEN 'INVALID_GPS'
          WHEN nitem = item THEN CASE WHEN at_s = last AND nx = x THEN 'DUPLICATE' ELSE 'CONFLICT' END WHEN at_s < last THEN 'STALE_OBSERVATION' ELSE '' END AS said
        FROM (
          SELECT k.user_id, k.k, k.seq, k.kind, k.at_s, k.x AS nx, k.item AS nitem, k.asked, k.outcome, CASE WHEN ev THEN NULL ELSE z.last END AS last, CASE WHEN ev THEN NULL ELSE z.x END AS x, CASE WHEN ev THEN NULL ELSE z.item END AS item,
            CASE WHEN ev THEN 0 ELSE z.buffered END AS buffered, CASE WHEN ev THEN 0 ELSE z.still END AS still, CASE WHEN ev THEN 0 ELSE z.moved END AS moved, CASE WHEN ev THEN NULL ELSE z.matched END AS matched, CASE WHEN ev THEN NULL ELSE z.gen END AS gen,
            CASE WHEN ev THEN z.last + {TTL_S} END AS gone, CASE WHEN ev THEN z.gen END AS gone_gen
          FROM (SELECT z.*, q.at_s - z.last > {TTL_S} AS ev, q.k AS next FROM z JOIN k q ON q.user_id = z.user_id AND q.k = z.k + 1) z JOIN k ON k.user_id = z.user_id AND k.k = z.next))))),
e AS (SELECT max(at_s) - {LATE_S} AS done FROM r)
SELECT user_id, seq, at_s, status, asks, coalesce(gen, -1) AS generation FROM z WHERE k > 0
UNION ALL SELECT user_id, -1, gone, 'EVICTED', false, gone_gen FROM z WHERE gone IS NOT NULL
UNION ALL SELECT user_id, -1, last + {TTL_S}, 'EVICTED', false, gen FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS b FROM z) AS f, e WHERE b = 1 AND last + {TTL_S} <= done"""


@query("x7_live_replay", LIVE)
def x7_live_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every status of a finite replay: observations, results taken and refused, resets, and drivers that were forgotten (seq -1). A
    driver of whom nothing is known has generation -1."""
    i, n = F.col("event_id"), F.col("n")
    w = W.partitionBy("user_id").orderBy("event_id")
    flag = lambda m: F.sum((i % m == 0).cast("int")).over(w)
    a = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.row_number().over(w).alias("n"), flag(7).alias("g"), flag(41).alias("h"))
    a = a.withColumns({"t": (100 + n * 20 + F.col("g") * 70 + F.col("h") * 400).cast("double"), "began": F.max(F.when((n == 1) | (i % 7 == 0) | (i % 41 == 0), n).otherwise(1)).over(w)})
    none = lambda kind: F.lit(None).cast(kind)
    at, x = F.col("t") - F.when(i % 13 == 0, 45).otherwise(0), F.when(i % 29 != 0, F.floor(F.col("value") / 30) * 30.0)

    def gps(rows: DataFrame, later: int, place: F.Column) -> DataFrame:
        return rows.select("user_id", (n * 10 + later).cast("long").alias("seq"), F.lit("gps").alias("kind"), i.alias("item"), at.alias("at_s"), place.alias("x"), none("long").alias("asked"), none("string").alias("outcome"))

    outcome = F.element_at(F.array(*[F.lit(o) for o in live.OUTCOMES]), (i % 4 + 1).cast("int"))
    back = a.where(i % 3 == 0).select("user_id", (n * 10 + 5).cast("long").alias("seq"), F.lit("result").alias("kind"), i.alias("item"), (F.col("t") + 5).alias("at_s"), none("double").alias("x"), F.when(i % 5 == 0, 10).otherwise(F.col("began") * 10).cast("long").alias("asked"), outcome.alias("outcome"))
    rows = reduce(DataFrame.unionByName, [gps(a, 0, x), gps(a.where(i % 11 == 0), 1, x), gps(a.where(i % 17 == 0), 2, x + 1), back])
    source, into = new_path(spark, "live-in"), new_path(spark, "live-out")
    rows.write.parquet(source)
    stream = live.follow(spark.readStream.schema(live.INPUT).parquet(source), TTL_S, f"{int(LATE_S * 1000)} milliseconds")
    with live.state_store(spark):
        replay(stream, into, new_path(spark, "live-state"))
    return spark.read.parquet(into).select("user_id", F.coalesce("seq", F.lit(-1)).alias("seq"), "at_s", "status", "asks", F.coalesce("generation", F.lit(-1)).alias("generation"))


@query("u1_registered_models", """
WITH m AS (SELECT upper(trim(p_brand)) AS model, TIMESTAMP '1990-01-01' + INTERVAL 1 DAY * (p_partkey * 13 % 4000) AS since, CASE p_partkey % 3 WHEN 0 THEN 'range' WHEN 1 THEN 'energy' ELSE 'other' END AS rule, p_size::DOUBLE AS cap, (p_partkey % 5 * 40)::DOUBLE AS use FROM part),
d AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY model, since ORDER BY rule DESC, cap DESC, use DESC) = 1),
e AS (SELECT l_orderkey, l_linenumber, p_brand AS model, l_shipdate AS at, l_quantity AS soc FROM lineitem JOIN part ON p_partkey = l_partkey),
j AS (SELECT e.*, d.rule, d.cap, d.use FROM e ASOF LEFT JOIN d ON d.model = upper(trim(e.model)) AND e.at >= d.since)
SELECT l_orderkey, l_linenumber, count(*) AS n, min(rule) AS rule, round(sum(CASE rule WHEN 'range' THEN cap * soc * 10 / nullif(use, 0) WHEN 'energy' THEN cap * soc / 100 END), 4) AS estimate FROM j GROUP BY ALL""")
def u1_registered_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line by the model that was registered for its brand when it shipped, and by that model's own rule."""
    p = F.col("p_partkey")
    rule = F.when(p % 3 == 0, "range").when(p % 3 == 1, "energy").otherwise("other")
    since = F.timestamp_micros(F.unix_micros(F.lit("1990-01-01 00:00:00").cast("timestamp")) + p * 13 % 4000 * 86_400_000_000)
    entries = table(spark, sf_dir, "part").select(F.col("p_brand").alias("model"), since.alias("since"), rule.alias("rule"), F.col("p_size").cast("double").alias("capacity_kwh"), (p % 5 * 40).cast("double").alias("consumption_wh_km"))
    log = registry.registered(entries.limit(0), entries)
    brands = table(spark, sf_dir, "part").select(p.alias("l_partkey"), F.col("p_brand").alias("model"))
    events = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").alias("at"), F.col("l_quantity").alias("soc_pct")).join(brands, "l_partkey").drop("l_partkey")
    found = registry.with_models(events, log, {"range": registry.range_km(), "energy": registry.energy_kwh()})
    return found.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.min("m_rule").alias("rule"), F.round(F.sum("estimate"), 4).alias("estimate"))
