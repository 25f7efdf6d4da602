"""Measures over replays and labels, windows over traces, and the wider rule suites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftline.functions import expr, geo
from driftline.operators import checks, ranking, sessions
from driftline.plans.decision_queries import EXPANDED, RANKED, counted, first_eligible, served, stations
from driftline.plans.registry import query, table


@query("a6_coarser_groups", """
WITH t AS (SELECT DISTINCT o_orderkey, o_custkey, o_custkey % 64 AS cell FROM orders) SELECT cell // 8 AS coarse, count(DISTINCT o_orderkey) AS trips, count(DISTINCT o_custkey) AS drivers FROM t GROUP BY ALL""")
def a6_coarser_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fine cells with their trips, projected to coarser cells: a trip counts once for each of them."""
    fine = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 64).alias("cell"))
    per = fine.groupBy(F.floor(F.col("cell") / 8).alias("coarse"), "o_orderkey").agg(F.min("o_custkey").alias("driver"))
    return per.groupBy("coarse").agg(F.count("*").alias("trips"), F.count_distinct("driver").alias("drivers"))


@query("a8_metadata", "SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(DISTINCT o_custkey) FROM orders) AS drivers, (SELECT count(*) FROM events) AS events, (SELECT epoch(max(ts))::BIGINT FROM events) AS until")
def a8_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One aggregation over both tables: no row of one meets a row of the other."""
    o = table(spark, sf_dir, "orders").select(F.lit(1).alias("o"), "o_custkey", F.lit(None).cast("long").alias("us"))
    e = table(spark, sf_dir, "events").select(F.lit(None).cast("int"), F.lit(None).cast("long"), F.unix_micros("ts"))
    both = o.unionAll(e)
    return both.agg(F.count("o").alias("orders"), F.count_distinct("o_custkey").alias("drivers"), F.count_if(F.col("o").isNull()).alias("events"), F.round(F.max("us") / 1e6).cast("long").alias("until"))


@query("a13_median_delay", "SELECT epoch(l_shipdate)::BIGINT AS at, median(1 + l_discount * 10) AS delay FROM lineitem GROUP BY l_shipdate")
def a13_median_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.unix_seconds("l_shipdate").alias("at")).agg(F.median(1 + F.col("l_discount") * 10).alias("delay"))


@query("a19_match_accuracy", """
WITH x AS (SELECT l_shipdate, l_linenumber AS class, l_partkey % 97 AS truth, CASE WHEN l_suppkey % 7 = 0 THEN NULL WHEN l_suppkey % 5 = 0 THEN (l_partkey + 1) % 97 ELSE l_partkey % 97 END AS matched, l_quantity AS error_m FROM lineitem)
SELECT class, count(*) AS labelled, count(matched) AS matched, round(100.0 * sum(CASE WHEN matched = truth THEN 1 ELSE 0 END) / count(*), 4) AS among_all, round(100.0 * sum(CASE WHEN matched = truth THEN 1 ELSE 0 END) / count(matched), 4) AS among_matched,
 sum(CASE WHEN matched % 10 = truth % 10 THEN 1 ELSE 0 END)::BIGINT AS same_road, sum(CASE WHEN matched // 32 = truth // 32 THEN 1 ELSE 0 END)::BIGINT AS same_way, round(quantile_cont(CASE WHEN matched IS NOT NULL THEN error_m END, 0.95), 4) AS p95_m FROM x GROUP BY class""")
def a19_match_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    x = table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("class"), (p % 97).alias("truth"), F.when(s % 7 == 0, None).when(s % 5 == 0, (p + 1) % 97).otherwise(p % 97).alias("matched"), F.col("l_quantity").alias("error_m"))
    m, t = F.col("matched"), F.col("truth")
    exact = F.count_if(m == t)
    return x.groupBy("class").agg(
        F.count("*").alias("labelled"), F.count("matched").alias("matched"), F.round(100.0 * exact / F.count("*"), 4).alias("among_all"), F.round(F.try_divide(100.0 * exact, F.count("matched")), 4).alias("among_matched"),
        F.count_if(m % 10 == t % 10).alias("same_road"), F.count_if(F.floor(m / 32) == F.floor(t / 32)).alias("same_way"), F.round(F.percentile(F.when(m.isNotNull(), F.col("error_m")), 0.95), 4).alias("p95_m"),
    )


@query("a22_scenarios", "SELECT o_orderpriority AS scenario, count(*) AS trips, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first FROM orders GROUP BY ALL")
def a22_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("scenario")).agg(F.count("*").alias("trips"), F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first"))


@query("a24_supporting_trips", """
WITH x AS (SELECT c_nationkey AS route, o_custkey AS driver, (o_orderkey % 40) / 100.0 AS adherence FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT route, count(*) FILTER (WHERE adherence >= 0.10) AS supporting, count(DISTINCT driver) FILTER (WHERE adherence >= 0.10) AS drivers, count(DISTINCT driver) FILTER (WHERE adherence >= 0.10) >= 5 AS visible FROM x GROUP BY route""")
def a24_supporting_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("driver"), F.col("c_nationkey").alias("route"))
    x = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("driver"), ((F.col("o_orderkey") % 40) >= 10).alias("supports")).join(c, "driver")
    per = x.groupBy("route", "driver").agg(F.count_if("supports").alias("n")).groupBy("route").agg(F.sum("n").alias("supporting"), F.count_if(F.col("n") > 0).alias("drivers"))
    return per.withColumn("visible", F.col("drivers") >= 5)


@query("a25_best_time", RANKED + "SELECT request_id, floor(max(ref))::BIGINT AS whole_s, count(*) AS n FROM v GROUP BY request_id")
def a25_best_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = F.coalesce(F.col("wait_min") * 60.0, F.lit(5400.0)) + F.col("service_min") * 60.0
    total = F.round(F.col("distance_m") / 8.0, 3) + fixed
    best = first_eligible(spark, sf_dir, 1, 1 / 8.0, fixed, F.lit(0)).groupBy("request_id").agg(F.floor(F.greatest(F.lit(1.0), F.min(total))).alias("whole_s"))
    rows = counted(spark, sf_dir, served(stations(spark, sf_dir)).where("verdict = 'ELIGIBLE'"), F.lit("any"), F.lit(True))
    return best.join(rows.groupBy("request_id").agg(F.sum("near").alias("n")), "request_id")


@query("a28_replay_changes", """
WITH x AS (SELECT user_id, event_type, lag(event_type) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, count(*) AS decisions, count(*) FILTER (WHERE before <> event_type) AS changes, count(*) FILTER (WHERE before = 'error' AND event_type <> 'error') AS recoveries FROM x GROUP BY user_id""")
def a28_replay_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    x = table(spark, sf_dir, "events").select("user_id", "event_type", before.alias("before"))
    changed = F.col("before") != F.col("event_type")
    return x.groupBy("user_id").agg(F.count("*").alias("decisions"), F.count_if(changed).alias("changes"), F.count_if(changed & (F.col("before") == "error")).alias("recoveries"))


@query("a30_load_summary", """
WITH s AS (SELECT event_type, count(*) AS n, list_sort(list(value)) AS v, count(*) FILTER (WHERE event_id % 17 = 0) AS failed, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM events GROUP BY event_type)
SELECT event_type, n, failed, round(n / seconds, 6) AS per_second, v[1 + least(n - 1, n * 95 // 100)] AS p95, v[1 + least(n - 1, n // 2)] AS p50 FROM s""")
def a30_load_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles by position, sorted[int(n * p)]: values are counted before they are ordered, so that a class costs one row
    for each of its different values, not for each of its events."""
    e, w = table(spark, sf_dir, "events"), W.partitionBy("event_type")
    values = e.groupBy("event_type", "value").agg(F.count("*").alias("k")).withColumn("upto", F.sum("k").over(w.orderBy("value"))).withColumn("n", F.sum("k").over(w))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * p / 100)), F.col("value")))
    seconds = (F.max(F.unix_micros("ts")) - F.min(F.unix_micros("ts"))) / 1e6
    load = e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("event_id") % 17 == 0).alias("failed"), F.round(F.count("*") / seconds, 6).alias("per_second"))
    return load.join(values.groupBy("event_type").agg(at(95).alias("p95"), at(50).alias("p50")), "event_type")


@query("w1_ranked_drivers", "SELECT o_custkey, n, row_number() OVER (ORDER BY n DESC, o_custkey) AS rank FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL ORDER BY n DESC, o_custkey LIMIT 101)")
def w1_ranked_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(101)
    return top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "o_custkey")).cast("long"))  # 101 rows at most


@query("w3_top_two_per_region", """
WITH x AS (SELECT n_regionkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY n_regionkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT n_regionkey, c_custkey, c_acctbal FROM x WHERE n <= 2 ORDER BY c_acctbal DESC, c_custkey LIMIT 36""")
def w3_top_two_per_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", "c_custkey", "c_acctbal")
    return ranking.first_n(c, ["n_regionkey"], [F.desc("c_acctbal"), "c_custkey"], 2).drop("n").orderBy(F.desc("c_acctbal"), "c_custkey").limit(36)


TRACE = """
WITH g AS (SELECT user_id, event_id, ts, 21.0::DOUBLE + (event_id % 101)::DOUBLE * 0.00001::DOUBLE AS lat, 105.8::DOUBLE + (event_id % 53)::DOUBLE * 0.00001::DOUBLE AS lon, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
h AS (SELECT *, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap FROM g WINDOW w AS (PARTITION BY user_id ORDER BY n)),
j AS (SELECT *, 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lon - lon0) / 2), 2)))) AS jump FROM h)"""


def gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_id, ts, lat, lon, and towards the point before: gap_s, jump_m (null at the first)."""
    e, w = F.col("event_id"), W.partitionBy("user_id").orderBy("ts", "event_id")
    g = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", (21.0 + (e % 101) * 0.00001).alias("lat"), (105.8 + (e % 53) * 0.00001).alias("lon"))
    jump = geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return g.withColumns({"gap_s": (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)) / 1e6, "jump_m": jump})


@query("w7_jumps", TRACE + "SELECT user_id, count(jump) AS steps, round(sum(jump), 2) AS metres, round(max(jump), 4) AS longest FROM j GROUP BY user_id")
def w7_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gps(spark, sf_dir).groupBy("user_id").agg(F.count("jump_m").alias("steps"), F.round(F.sum("jump_m"), 2).alias("metres"), F.round(F.max("jump_m"), 4).alias("longest"))


@query("w16_stationary_runs", TRACE + """, s AS (SELECT *, sum(CASE WHEN jump < 300 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY n) AS island FROM j),
r AS (SELECT user_id, island, count(*) - 1 AS run FROM s GROUP BY ALL) SELECT user_id, max(run) AS longest, count(*) FILTER (WHERE run >= 3) AS stops FROM r GROUP BY user_id""")
def w16_stationary_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    still = F.coalesce(F.col("jump_m") < 300, F.lit(False))
    rows = sessions.runs(gps(spark, sf_dir).withColumn("still", still), "user_id", ["ts", "event_id"], F.col("still"))
    lengths = rows.groupBy("user_id", "run").agg(F.count_if("still").alias("n"))
    return lengths.groupBy("user_id").agg(F.max("n").alias("longest"), F.count_if(F.col("n") >= 3).alias("stops"))


@query("w11_nearest_pool", EXPANDED + "SELECT request_id, count(*) AS pool, round(max(distance_m), 3) AS widest FROM (SELECT * FROM cand WHERE verdict = 'ELIGIBLE' QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY distance_m, station_id, service) <= 8) GROUP BY request_id")
def w11_nearest_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = ranking.first_n(first_eligible(spark, sf_dir, 8, 1.0, F.lit(0), F.lit(0)), ["request_id"], ["distance_m", "station_id", "service"], 8)
    return near.groupBy("request_id").agg(F.count("*").alias("pool"), F.round(F.max("distance_m"), 3).alias("widest"))


@query("w19_sequential_ids", "SELECT event_id, printf('RE%08d', row_number() OVER (ORDER BY ts, event_id)) AS id FROM events")
def w19_sequential_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    numbers = ranking.numbered(e, F.date_trunc("minute", "ts"), ["ts", "event_id"])
    return numbers.select("event_id", F.format_string("RE%08d", "number").alias("id"))


@query("w20_systematic_sample", "SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS n FROM events) WHERE n % 8 = 1")
def w20_systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    return ranking.numbered(e, F.date_trunc("minute", "ts"), ["ts", "event_id"]).where("number % 8 = 1").select("event_id")


@query("g14_off_route", """
WITH x AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, value * 0.6 > 80 AS far FROM events),
y AS (SELECT *, far AND lag(far) OVER w AND lag(far, 2) OVER w AS off FROM x WINDOW w AS (PARTITION BY user_id ORDER BY n))
SELECT user_id, count(*) FILTER (WHERE off) AS off_samples, min(n) FILTER (WHERE off) IS NOT NULL AS left_route FROM y GROUP BY user_id""")
def g14_off_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Off the route from the third sample in a row that is more than 80 m away."""
    far = F.col("value") * 0.6 > 80
    rows = sessions.runs(table(spark, sf_dir, "events").withColumn("far", far), "user_id", ["ts", "event_id"], F.col("far"))
    runs = rows.where("far").groupBy("user_id", "run").agg(F.greatest(F.count("*") - 2, F.lit(0)).alias("off"))
    off = runs.groupBy("user_id").agg(F.sum("off").alias("off_samples"))
    users = rows.select("user_id").distinct().join(off, "user_id", "left")
    return users.select("user_id", F.coalesce("off_samples", F.lit(0)).alias("off_samples"), (F.coalesce("off_samples", F.lit(0)) > 0).alias("left_route"))


@query("g16_intervals", TRACE + """
SELECT user_id, CASE WHEN gap > 600000000 THEN 'GAP' WHEN jump > 1000 THEN 'WITHHELD' WHEN jump < 100 THEN 'STILL' ELSE 'MOVING' END AS state, count(*) AS intervals, round(sum(gap / 1e6), 3) AS seconds, round(sum(jump), 2) AS metres FROM j WHERE gap IS NOT NULL GROUP BY ALL""")
def g16_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("gap_s") > 600, "GAP").when(F.col("jump_m") > 1000, "WITHHELD").when(F.col("jump_m") < 100, "STILL").otherwise("MOVING")
    return gps(spark, sf_dir).where("gap_s is not null").groupBy("user_id", state.alias("state")).agg(F.count("*").alias("intervals"), F.round(F.sum("gap_s"), 3).alias("seconds"), F.round(F.sum("jump_m"), 2).alias("metres"))


@query("g17_continuous_parts", TRACE + """, b AS (SELECT *, sum(CASE WHEN gap > 1800000000 OR jump > 1000 OR jump > 55 * (gap / 1e6) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY n) AS part FROM j)
SELECT user_id, part::BIGINT AS part, count(*) AS points, min(event_id) AS lowest FROM b GROUP BY ALL""")
def g17_continuous_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = (F.col("gap_s") > 1800) | (F.col("jump_m") > 1000) | (F.col("jump_m") > 55 * F.col("gap_s"))
    return sessions.parts(gps(spark, sf_dir), "user_id", ["ts", "event_id"], broken).groupBy("user_id", F.col("part").cast("long").alias("part")).agg(F.count("*").alias("points"), F.min("event_id").alias("lowest"))


@query("q2_recomputed", """
SELECT 'gross' AS rule, count(*) AS checked, count(*) FILTER (WHERE abs(round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 2) - l_extendedprice * (1 - l_discount) * (1 + l_tax)) > 0.005001) AS failed FROM lineitem UNION ALL
SELECT 'tax_bounds', count(*), count(*) FILTER (WHERE l_tax < 0 OR l_tax > 0.08) FROM lineitem UNION ALL
SELECT 'status_vocabulary', count(*), count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) FROM orders UNION ALL
SELECT 'shipped_after_order', count(*), count(*) FILTER (WHERE l_shipdate < o_orderdate) FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def q2_recomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    gross = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return checks.report(
        checks.rule("gross", line, ~geo.close(F.round(gross, 2), gross, 0.005001, 0.0)), checks.rule("tax_bounds", line, ~F.col("l_tax").between(0, 0.08)),
        checks.rule("status_vocabulary", o, ~F.col("o_orderstatus").isin("F", "O")),
        checks.rule("shipped_after_order", line.join(o, F.col("l_orderkey") == F.col("o_orderkey")), F.col("l_shipdate") < F.col("o_orderdate")),
    ).drop("status")


@query("q4_scenarios", """
WITH g AS (SELECT o_orderpriority AS scenario, count(*) AS trips, count(DISTINCT o_custkey) AS drivers, count(*) FILTER (WHERE o_orderstatus = 'P') AS pending, max(o_totalprice) AS most FROM orders GROUP BY ALL)
SELECT scenario, trips, drivers, CASE WHEN trips < 100 THEN 'TOO_FEW' WHEN pending = 0 THEN 'NO_PENDING' WHEN most < 400000 THEN 'NO_LARGE' ELSE 'PASS' END AS result FROM g""")
def q4_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assertions of each scenario, with the evidence they rest on; the first that fails names the result."""
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("scenario")).agg(
        F.count("*").alias("trips"), F.count_distinct("o_custkey").alias("drivers"), F.count_if(F.col("o_orderstatus") == "P").alias("pending"), F.max("o_totalprice").alias("most"))
    failed = expr.violations({"TOO_FEW": F.col("trips") < 100, "NO_PENDING": F.col("pending") == 0, "NO_LARGE": F.col("most") < 400000})
    return g.select("scenario", "trips", "drivers", F.coalesce(F.get(failed, F.lit(0)), F.lit("PASS")).alias("result"))
