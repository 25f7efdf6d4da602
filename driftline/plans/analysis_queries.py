"""History aggregates, evaluation, data quality, set operations, JSON, geometry, graphs, trajectories, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftline.functions import expr, geo
from driftline.operators import paths, ranking, spatial, trajectory
from driftline.plans.registry import SQL, query, table
from driftline.sources import polylines, readers


@query("a2_latest_by_key", "SELECT o_custkey, epoch(max(o_orderdate))::BIGINT AS last FROM orders GROUP BY o_custkey ORDER BY max(o_orderdate) DESC, o_custkey LIMIT 101")
def a2_latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("t")).orderBy(F.desc("t"), "o_custkey").limit(101)
    return rows.select("o_custkey", F.unix_seconds("t").alias("last"))


@query("a3_filtered_distinct", """
SELECT o_orderpriority, count(DISTINCT (o_custkey, year(o_orderdate))) FILTER (WHERE o_orderstatus = 'F') AS pairs, coalesce(sum(o_totalprice::DECIMAL(18,2)) FILTER (WHERE o_orderstatus = 'F'), 0)::DOUBLE AS total FROM orders GROUP BY ALL""")
def a3_filtered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count_distinct(F.when(done, F.struct("o_custkey", F.year("o_orderdate")))).alias("pairs"),
        F.coalesce(F.sum(F.when(done, F.col("o_totalprice").cast("decimal(18,2)"))).cast("double"), F.lit(0.0)).alias("total"),
    )


HEAT = """
WITH t AS (SELECT c_nationkey AS cell, o_custkey AS driver, o_totalprice > 400000 AS departed FROM orders JOIN customer ON o_custkey = c_custkey),
d AS (SELECT cell, driver, count(*) AS trips, count(*) FILTER (WHERE departed) AS departures FROM t GROUP BY ALL),
c AS (SELECT cell, count(*) AS reached, count(*) FILTER (WHERE departures > 0) AS departing, sum(trips)::BIGINT AS trips, sum(departures)::BIGINT AS departures FROM d GROUP BY ALL)
"""


def heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("driver"), F.col("c_nationkey").alias("cell"))
    trips = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("driver"), (F.col("o_totalprice") > 400000).alias("departed")).join(customer, "driver")
    per = trips.groupBy("cell", "driver").agg(F.count("*").alias("trips"), F.count_if("departed").alias("departures"))
    return per.groupBy("cell").agg(F.count("*").alias("reached"), F.count_if(F.col("departures") > 0).alias("departing"), F.sum("trips").alias("trips"), F.sum("departures").alias("departures"))


def share() -> F.Column:
    return F.round(F.try_divide(100.0 * F.col("departures"), F.col("trips")), 2)


@query("a4_k_anonymity", HEAT + "SELECT cell, reached, departing, round(100.0 * departures / trips, 2)::DOUBLE AS percent FROM c WHERE reached >= 5 AND (departing = 0 OR departing >= 5)")
def a4_k_anonymity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heat(spark, sf_dir).where("reached >= 5 and (departing = 0 or departing >= 5)").select("cell", "reached", "departing", share().alias("percent"))


@query("p28_departure_colours", HEAT + """, p AS (SELECT cell, round(100.0 * departures / trips, 2)::DOUBLE AS percent FROM c)
SELECT cell, CASE WHEN percent = 0 THEN 'none' WHEN percent < 20 THEN 'low' WHEN percent < 50 THEN 'medium' ELSE 'high' END AS colour FROM p""")
def p28_departure_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = share()
    return heat(spark, sf_dir).select("cell", F.when(p == 0, "none").when(p < 20, "low").when(p < 50, "medium").otherwise("high").alias("colour"))


@query("a7_merge_aggregates", HEAT + """, n AS (SELECT n_nationkey AS cell, n_regionkey AS region FROM nation WHERE n_nationkey % 2 = 0)
SELECT coalesce(c.cell, n.cell) AS cell, coalesce(trips, 0)::BIGINT AS trips, coalesce(region, -1) AS region, CASE WHEN n.cell IS NULL THEN 'HISTORY' WHEN c.cell IS NULL THEN 'PAIRED' ELSE 'BOTH' END AS status FROM c FULL JOIN n ON c.cell = n.cell""")
def a7_merge_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("cell"), F.col("n_regionkey").alias("region"))
    both = heat(spark, sf_dir).select("cell", "trips").join(n, "cell", "full")
    status = F.when(F.col("region").isNull(), "HISTORY").when(F.col("trips").isNull(), "PAIRED").otherwise("BOTH")
    return both.select("cell", F.coalesce("trips", F.lit(0)).alias("trips"), F.coalesce("region", F.lit(-1)).alias("region"), status.alias("status"))


PARTS = "WITH a AS (SELECT l_orderkey, list_sort(list_distinct(list(l_suppkey % 4))) AS key FROM lineitem GROUP BY l_orderkey) "


@query("a5_group_by_array", PARTS + "SELECT array_to_string(key, ',') AS key, count(*) AS orders, min(l_orderkey) AS first FROM a GROUP BY a.key")
def a5_group_by_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.col("l_suppkey") % 4)).alias("key"))
    return a.groupBy("key").agg(F.count("*").alias("orders"), F.min("l_orderkey").alias("first")).withColumn("key", F.array_join("key", ","))


@query("a16_set_equality", PARTS + ", b AS (SELECT l_orderkey, list_sort(list_distinct(list(l_partkey % 4))) AS other FROM lineitem GROUP BY l_orderkey) SELECT count(*) AS orders, count(*) FILTER (WHERE key = other) AS equal FROM a JOIN b USING (l_orderkey)")
def a16_set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*[F.sort_array(F.collect_set(F.col(c) % 4)).alias(c) for c in ("l_suppkey", "l_partkey")])
    return sets.agg(F.count("*").alias("orders"), F.count_if(F.col("l_suppkey") == F.col("l_partkey")).alias("equal"))


@query("a15_exactly_one", "WITH g AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'P') AS n FROM orders GROUP BY ALL) SELECT count(*) FILTER (WHERE n = 1) AS one, count(*) FILTER (WHERE n >= 1) AS some, count(*) AS keys FROM g")
def a15_exactly_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "P").alias("n"))
    return g.agg(F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") >= 1).alias("some"), F.count("*").alias("keys"))


@query("a11_profile", """
SELECT count(*) AS n, count(*) FILTER (WHERE value IS NULL) AS nulls, count(*) FILTER (WHERE value < 1) AS small, round(avg(value::DECIMAL(18,2)), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.99), 4) AS p99, count(DISTINCT user_id) AS users FROM events""")
def a11_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").agg(
        F.count("*").alias("n"), F.count_if(v.isNull()).alias("nulls"), F.count_if(v < 1).alias("small"), F.round((F.sum(v.cast("decimal(18,2)")) / F.count(v)).cast("double"), 4).alias("mean"),
        F.round(F.percentile(v, 0.5), 4).alias("median"), F.round(F.percentile(v, 0.99), 4).alias("p99"), F.count_distinct("user_id").alias("users"),
    )


TRUTH = "WITH x AS (SELECT o_orderstatus AS split, o_orderpriority AS scenario, o_totalprice > 250000 AS y, o_custkey % 2 = 0 AS p FROM orders) "


@query("a17_confusion_grouping_sets", TRUTH + """
SELECT split, coalesce(scenario, 'all') AS scenario, count(*) FILTER (WHERE y AND p) AS tp, count(*) FILTER (WHERE NOT y AND p) AS fp, count(*) FILTER (WHERE y AND NOT p) AS fn, count(*) FILTER (WHERE NOT y AND NOT p) AS tn,
  round(count(*) FILTER (WHERE y AND p) / nullif(count(*) FILTER (WHERE p), 0), 6) AS precision, round(count(*) FILTER (WHERE y AND p) / nullif(count(*) FILTER (WHERE y), 0), 6) AS recall FROM x GROUP BY GROUPING SETS ((split), (split, scenario))""")
def a17_confusion_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    x = o.select(F.col("o_orderstatus").alias("split"), F.col("o_orderpriority").alias("scenario"), (F.col("o_totalprice") > 250000).alias("y"), (F.col("o_custkey") % 2 == 0).alias("p"))
    y, p = F.col("y"), F.col("p")
    got = x.groupingSets([["split"], ["split", "scenario"]], "split", "scenario").agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    ratio = lambda a, b: F.round(F.try_divide(F.col(a), F.col(a) + F.col(b)), 6)
    return got.withColumn("scenario", F.coalesce("scenario", F.lit("all"))).withColumn("precision", ratio("tp", "fp")).withColumn("recall", ratio("tp", "fn"))


@query("a20_latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.95), 4) AS interpolated, round(quantile_disc(value, 0.95), 4) AS nearest FROM events GROUP BY event_type")
def a20_latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    nearest = F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.95), 4).alias("interpolated"), F.round(nearest, 4).alias("nearest"))


@query("a29_histogram", "SELECT event_type, count(*) FILTER (WHERE value <= 50) AS le_50, count(*) FILTER (WHERE value <= 100) AS le_100, count(*) FILTER (WHERE value <= 250) AS le_250, count(*) AS le_inf FROM events GROUP BY event_type")
def a29_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(*[F.count_if(F.col("value") <= x).alias(f"le_{x}") for x in (50, 100, 250)], F.count("*").alias("le_inf"))


@query("a21_coverage", """
SELECT coalesce(n_regionkey::VARCHAR, 'all') AS region, round(100.0 * sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) / count(*), 4)::DOUBLE AS covered FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey)""")
def a21_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    got = c.rollup("n_regionkey").agg(F.round(100.0 * F.count_if(F.col("c_acctbal") > 0) / F.count("*"), 4).alias("covered"))
    return got.select(F.coalesce(F.col("n_regionkey").cast("string"), F.lit("all")).alias("region"), "covered")


@query("a23_smoothed_means", """
WITH d AS (SELECT c_nationkey AS route, o_custkey AS driver, count(*) AS n, avg((o_orderkey % 100)::DECIMAL(9,2)) AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT route, count(*) AS drivers, round((sum(m) + 1.5) / (count(*) + 3), 4) AS smoothed, round(count(*) / (count(*) + 3), 6) AS confidence FROM d GROUP BY route""")
def a23_smoothed_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("driver"), F.col("c_nationkey").alias("route"))
    d = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("driver"), (F.col("o_orderkey") % 100).cast("double").alias("v")).join(c, "driver").groupBy("route", "driver").agg(F.avg("v").alias("m"))
    n = F.count("*")
    return d.groupBy("route").agg(n.alias("drivers"), F.round((F.sum("m") + 1.5) / (n + 3), 4).alias("smoothed"), F.round(n / (n + 3), 6).alias("confidence"))


@query("a12_collapse_edges", "SELECT l_suppkey AS a, l_partkey % 100 + 1 AS b, min(l_quantity) AS cost FROM lineitem GROUP BY ALL")
def a12_collapse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads(spark, sf_dir)


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100 + 1).alias("b"), F.col("l_quantity").alias("cost"))
    return paths.collapse(rows, "a", "b", "cost")


@query("g9_bounded_paths", """
WITH RECURSIVE e AS (SELECT l_suppkey AS a, l_partkey % 100 + 1 AS b, min(l_quantity) AS cost FROM lineitem GROUP BY ALL),
l0 AS (SELECT DISTINCT a AS source, a AS node, 0.0::DOUBLE AS cost FROM e),
l1 AS (SELECT source, node, min(cost) AS cost FROM (FROM l0 UNION ALL SELECT source, e.b, l0.cost + e.cost FROM l0 JOIN e ON e.a = l0.node) GROUP BY ALL),
l2 AS (SELECT source, node, min(cost) AS cost FROM (FROM l1 UNION ALL SELECT source, e.b, l1.cost + e.cost FROM l1 JOIN e ON e.a = l1.node) GROUP BY ALL),
l3 AS (SELECT source, node, min(cost) AS cost FROM (FROM l2 UNION ALL SELECT source, e.b, l2.cost + e.cost FROM l2 JOIN e ON e.a = l2.node) GROUP BY ALL)
SELECT source, node, cost FROM l3""")
def g9_bounded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances of three edges at most from every supplier."""
    e = roads(spark, sf_dir)
    return paths.bounded_distances(e, e.select(F.col("a").alias("node")).distinct(), 3)


@query("g9_network_distances", """
WITH e AS (SELECT l_suppkey AS s, l_partkey % 100 + 1 AS n, min(l_quantity::BIGINT * 1000000 + l_linenumber) AS c FROM lineitem GROUP BY ALL),
d1 AS (SELECT s, n, min(c) AS c FROM (FROM e UNION ALL SELECT DISTINCT s, s, 0 FROM e) GROUP BY ALL),
d2 AS (SELECT x.s, y.n, min(x.c + y.c) AS c FROM d1 x JOIN d1 y ON x.n = y.s GROUP BY ALL),
t2 AS (FROM d1 UNION ALL FROM d2), f2 AS (SELECT s, n, min(c) AS c FROM t2 GROUP BY ALL),
d4 AS (SELECT x.s, y.n, min(x.c + y.c) AS c FROM f2 x JOIN f2 y ON x.n = y.s GROUP BY ALL), f4 AS (SELECT s, n, min(c) AS c FROM (FROM f2 UNION ALL FROM d4) GROUP BY ALL),
d8 AS (SELECT x.s, y.n, min(x.c + y.c) AS c FROM f4 x JOIN f4 y ON x.n = y.s GROUP BY ALL), f8 AS (SELECT s, n, min(c) AS c FROM (FROM f4 UNION ALL FROM d8) GROUP BY ALL),
d16 AS (SELECT x.s, y.n, min(x.c + y.c) AS c FROM f8 x JOIN f8 y ON x.n = y.s GROUP BY ALL), f16 AS (SELECT s, n, min(c) AS c FROM (FROM f8 UNION ALL FROM d16) GROUP BY ALL)
SELECT s AS source, n AS node, (c // 1000000)::DOUBLE AS cost, (c % 1000000)::DOUBLE AS also FROM f16""")
def g9_network_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every supplier to whatever it reaches over the network, with the second cost along the cheapest way."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100 + 1).alias("b"), F.col("l_quantity").alias("cost"), F.col("l_linenumber").cast("double").alias("also"))
    return paths.distances(rows, rows.select(F.col("a").alias("node")).distinct()).select("source", "node", "cost", "also")


query("g9_all_sources", SQL["g9_bounded_paths"])(g9_bounded_paths)  # its earlier name


@query("g10_components", """
WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, o_custkey - o_custkey % 7 AS b FROM orders),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), n AS (SELECT DISTINCT a AS node FROM u)
SELECT node, (SELECT min(x) FROM (SELECT b AS x FROM u WHERE u.a = node UNION ALL SELECT u2.b FROM u u1 JOIN u u2 ON u1.b = u2.a WHERE u1.a = node UNION ALL SELECT node)) AS component FROM n""")
def g10_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey")
    return paths.weak_components(table(spark, sf_dir, "orders").select(k.alias("a"), (k - k % 7).alias("b")).distinct())


query("g10_all_customers", SQL["g10_components"])(g10_components)  # its earlier name


@query("q6_split_leakage", """
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 10 < 6), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 10 >= 8)
SELECT (SELECT count(*) FROM (FROM a INTERSECT FROM b)) AS shared, (SELECT count(*) FROM a) AS train, (SELECT count(*) FROM b) AS test""")
def q6_split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 10).alias("b"))
    per = k.groupBy("k").agg(F.bool_or(F.col("b") < 6).alias("train"), F.bool_or(F.col("b") >= 8).alias("test"))
    return per.agg(F.count_if(F.col("train") & F.col("test")).alias("shared"), F.count_if("train").alias("train"), F.count_if("test").alias("test"))


@query("u1_concat_keep_first", """
WITH x AS (SELECT 1 AS o, event_id, user_id, value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 2, event_id, user_id, -value FROM events WHERE event_id % 3 = 0)
SELECT event_id, user_id, value FROM x QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY o) = 1""")
def u1_concat_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    x = e.where("event_id % 2 = 0").withColumn("o", F.lit(1)).unionByName(e.where("event_id % 3 = 0").withColumn("value", -F.col("value")).withColumn("o", F.lit(2)))
    return ranking.first_n(x, ["event_id"], ["o"], 1).select("event_id", "user_id", "value")


@query("u2_coverage_of_keys", "SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY ALL) WHERE k IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def u2_coverage_of_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    of = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k"))
    return o.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n")).join(of("O").exceptAll(of("P")).select("k").join(of("P"), "k", "left_anti"), "k", "left_semi")


@query("u4_change_set", """
WITH v AS (SELECT user_id, event_type, max(event_id) FILTER (WHERE event_id % 2 = 0) AS a, max(event_id) FILTER (WHERE event_id % 2 = 1) AS b FROM events GROUP BY ALL)
SELECT user_id, count(*) FILTER (WHERE a IS NULL) AS added, count(*) FILTER (WHERE b IS NULL) AS removed, count(*) FILTER (WHERE a < b) AS changed FROM v GROUP BY user_id""")
def u4_change_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type")
    half = lambda r: F.max(F.when(F.col("event_id") % 2 == r, F.col("event_id")))
    v = e.agg(half(0).alias("a"), half(1).alias("b"))
    return v.groupBy("user_id").agg(F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("b").isNull()).alias("removed"), F.count_if(F.col("a") < F.col("b")).alias("changed"))


@query("n2_json_counts", "SELECT (props::JSON ->> 'k')::BIGINT AS k, count(*) AS n, count(*) FILTER (WHERE value > 100) AS high FROM events GROUP BY ALL")
def n2_json_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.from_json("props", "map<string,bigint>")["k"]
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 100).alias("high"))


@query("n3_json_keys", "SELECT count(*) AS n, count(*) FILTER (WHERE len(list_filter(json_keys(props), lambda x: x <> 'k')) = 0) AS known FROM events")
def n3_json_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = F.array_except(F.json_object_keys("props"), F.array(F.lit("k")))
    return table(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.count_if(F.size(extra) == 0).alias("known"))


@query("r2_merge_equal_cells", """
WITH l AS (SELECT l_orderkey, l_linenumber, l_suppkey % 2 AS c, l_quantity AS w FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) = 1),
n AS (SELECT *, CASE WHEN lag(c) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) IS NOT DISTINCT FROM c THEN 0 ELSE 1 END AS f FROM l),
r AS (SELECT *, sum(f) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run FROM n)
SELECT l_orderkey, run::BIGINT AS run, any_value(c) AS cell, sum(w) AS weight FROM r GROUP BY l_orderkey, run""")
def r2_merge_equal_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = ranking.first_n(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity"], 1)
    lines = one.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", (F.col("l_suppkey") % 2).alias("v"), F.col("l_quantity").alias("w")))).alias("c"))
    merged = expr.runs(F.transform("c", lambda x: F.struct(x["v"].alias("v"), x["w"].alias("w"))))
    return lines.select("l_orderkey", F.posexplode(merged).alias("run", "x")).select("l_orderkey", (F.col("run") + 1).cast("long").alias("run"), F.col("x.v").alias("cell"), F.col("x.w").alias("weight"))


PLACES = """
WITH c AS (SELECT c_custkey AS point_id, 21.0 + (c_custkey % 1009) * 0.0003 AS lat, 105.8 + (c_custkey % 883) * 0.0003 AS lon FROM customer),
s AS (SELECT s_suppkey AS place_id, 21.0 + (s_suppkey % 97) * 0.003 AS lat, 105.8 + (s_suppkey % 89) * 0.003 AS lon FROM supplier),
d AS (SELECT point_id, place_id, 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(s.lat - c.lat) / 2), 2) + cos(radians(c.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lon - c.lon) / 2), 2)))) AS m FROM c, s)"""


def points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    return (
        table(spark, sf_dir, "customer").select(c.alias("point_id"), (21.0 + (c % 1009) * 0.0003).alias("lat"), (105.8 + (c % 883) * 0.0003).alias("lon")),
        table(spark, sf_dir, "supplier").select(s.alias("place_id"), (21.0 + (s % 97) * 0.003).alias("lat"), (105.8 + (s % 89) * 0.003).alias("lon")),
    )


@query("j13_tile_join", PLACES + "SELECT point_id, place_id, round(m, 3) AS distance_m, row_number() OVER (PARTITION BY point_id ORDER BY round(m, 3), place_id) AS n FROM d WHERE m <= 3000 QUALIFY n <= 8")
def j13_tile_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight nearest; distances that are equal in millimetres are tied, and the place decides."""
    a, b = points(spark, sf_dir)
    return spatial.within(a, b, 3000.0, 6, 8, digits=3).withColumn("distance_m", F.round("distance_m", 3))


@query("g1_grid_cells", "SELECT point_id, (floor(lat / 0.001::DOUBLE)::BIGINT + 2000000) * 8000000 + floor(lon / 0.001::DOUBLE)::BIGINT + 2000000 AS cell FROM (SELECT c_custkey AS point_id, 21.0::DOUBLE + (c_custkey % 1009)::DOUBLE * 0.0003::DOUBLE AS lat, 105.8::DOUBLE + (c_custkey % 883)::DOUBLE * 0.0003::DOUBLE AS lon FROM customer)")
def g1_grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, _ = points(spark, sf_dir)
    return a.select("point_id", geo.grid_cell(F.col("lat"), F.col("lon")).alias("cell"))


@query("m2_bearings", PLACES + """
SELECT c_custkey AS point_id, round(fmod(degrees(atan2(sin(radians(0.01)) * cos(radians(21.0)), cos(radians(lat)) * sin(radians(21.0)) - sin(radians(lat)) * cos(radians(21.0)) * cos(radians(0.01)))) + 360.0, 360.0), 4) AS bearing
FROM (SELECT c_custkey, 21.0 + (c_custkey % 1009 + 1) * 0.0003 AS lat FROM customer)""")
def m2_bearings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    lat = 21.0 + (k % 1009 + 1) * 0.0003
    return table(spark, sf_dir, "customer").select(k.alias("point_id"), F.round(geo.bearing(lat, F.lit(0.0), F.lit(21.0), F.lit(0.01)), 4).alias("bearing"))


@query("m4_project", """
WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity AS px, l_discount * 100 AS py, l_tax * 100 AS ax, 0.0 AS ay, 50.0 AS bx, l_linenumber * 5.0 AS by_ FROM lineitem),
s AS (SELECT *, greatest(0.0, least(1.0, ((px - ax) * (bx - ax) + (py - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS t FROM x)
SELECT l_linenumber, count(*) AS n, round(max(sqrt(pow(px - (ax + t * (bx - ax)), 2) + pow(py - (ay + t * (by_ - ay)), 2))), 6) AS farthest, round(min(t), 6) AS least FROM s GROUP BY l_linenumber""")
def m4_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, t = geo.project(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100, F.lit(0.0), F.lit(50.0), F.col("l_linenumber") * 5.0)
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", d.alias("d"), t.alias("t"))
    return rows.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.round(F.max("d"), 6).alias("farthest"), F.round(F.min("t"), 6).alias("least"))


@query("s5_reassembled_rows", "SELECT user_id, count(*) AS n, sum(len(event_type))::BIGINT AS chars FROM events GROUP BY user_id")
def s5_reassembled_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    # every event becomes two physical lines, the second of them a continuation
    lines = e.select(F.col("user_id").alias("file"), F.explode(F.array(F.struct((F.col("event_id") * 2).alias("line"), F.concat(F.lit("#"), "event_type").alias("value")), F.struct((F.col("event_id") * 2 + 1).alias("line"), F.lit("rest").alias("value")))).alias("l"))
    rows = readers.reassembled(lines.select("file", "l.*"), F.col("value").startswith("#"))
    return rows.groupBy(F.col("file").alias("user_id")).agg(F.count("*").alias("n"), F.sum(F.length("value") - 6).alias("chars"))


@query("g7_ordered_overlap")
def g7_ordered_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heaviest common ordered part of a user's morning and afternoon types. No SQL: tested against brute force."""
    e = table(spark, sf_dir, "events")
    seq = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("ts", "event_id", "event_type", "value")))), lambda x: F.struct(x["event_type"].alias("cell"), x["value"].alias("w")))
    pairs = e.groupBy("user_id").agg(seq(F.hour("ts") < 12).alias("a"), seq(F.hour("ts") >= 12).alias("b"))
    return trajectory.overlap_pairs(pairs).select("user_id", F.round("overlap", 4).alias("overlap"), "status")


@query("s9_polylines", """
WITH p AS (SELECT l_orderkey AS route, l_linenumber AS k, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
r AS (SELECT route, count(*) AS points, sum(2100000 + p % 97 * 10)::BIGINT AS lat5, sum(10580000 + p % 89 * 10)::BIGINT AS lon5 FROM p GROUP BY route),
f AS (SELECT *, CASE WHEN route % 10 = 3 THEN 'CUT_OFF' WHEN route % 10 = 7 THEN 'BAD_CHARACTER' WHEN points < 2 THEN 'TOO_FEW_POINTS' ELSE 'OK' END AS status FROM r)
SELECT route, status, CASE WHEN status = 'OK' THEN points ELSE 0 END AS points, CASE WHEN status = 'OK' THEN lat5 ELSE 0 END AS lat5, CASE WHEN status = 'OK' THEN lon5 ELSE 0 END AS lon5 FROM f""")
def s9_polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's lines as an encoded polyline, one in five of them broken, and decoded again: points, or the reason why not."""
    one = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("route"), F.col("l_linenumber").alias("k")).agg(F.min("l_partkey").alias("p"))
    lines = polylines.encode(one.select("route", "k", ((2_100_000 + F.col("p") % 97 * 10) / 1e5).alias("lat"), ((10_580_000 + F.col("p") % 89 * 10) / 1e5).alias("lon")), "route", "k")
    n = F.length("line")
    broken = F.when(F.col("route") % 10 == 3, F.substring(F.col("line"), F.lit(1), n - 1)).when(F.col("route") % 10 == 7, F.concat(F.substring(F.col("line"), F.lit(1), n - 2), F.lit(" "), F.right("line", F.lit(2)))).otherwise(F.col("line"))
    points, faults = polylines.decode(lines.select("route", broken.alias("line")), "route")
    five = lambda c: F.sum(F.bround(F.col(c) * 100_000).cast("long")).alias(f"{c}5")
    none = F.lit(0).cast("long")
    return points.groupBy("route").agg(F.lit("OK").alias("status"), F.count("*").alias("points"), five("lat"), five("lon")).unionAll(faults.select("route", "reason", none, none, none))
