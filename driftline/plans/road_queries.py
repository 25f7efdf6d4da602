"""Roads, routes and selections on proxies: an order is a route, its lines are the vertices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftline.functions import geo
from driftline.operators import roads, selection
from driftline.plans.analysis_queries import points
from driftline.plans.analysis_queries import roads as edges
from driftline.plans.decision_queries import pool_costs
from driftline.plans.registry import SQL, query, table

LEGS = """
WITH p AS (SELECT l_orderkey AS route, l_linenumber AS k, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
v AS (SELECT route, k, 3.3::DOUBLE + (p % 97)::DOUBLE * 10 AS x, 3.7::DOUBLE + (p % 89)::DOUBLE * 10 AS y FROM p),
l0 AS (SELECT *, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM v WINDOW w AS (PARTITION BY route ORDER BY k)),
l1 AS (SELECT *, sqrt((x1 - x) * (x1 - x) + (y1 - y) * (y1 - y)) AS len FROM l0 WHERE x1 IS NOT NULL),
legs AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY route ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l1)"""
SAMPLES = LEGS + """,
smp AS (SELECT route, u AS i, x + (u * 25 - start) / len * (x1 - x) AS x, y + (u * 25 - start) / len * (y1 - y) AS y FROM (SELECT *, unnest(range(ceil(start / 25)::BIGINT, ceil((start + len) / 25)::BIGINT)) AS u FROM legs))"""


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("route"), F.col("l_linenumber").alias("k")).agg(F.min("l_partkey").alias("p"))
    return one.select("route", "k", (3.3 + F.col("p") % 97 * 10).alias("x"), (3.7 + F.col("p") % 89 * 10).alias("y"))


@query("g5_resampled", SAMPLES + "SELECT route, count(*) AS points, round(sum(x), 2) AS sum_x, round(max(y), 3) AS top_y FROM smp GROUP BY route")
def g5_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads.resampled(vertices(spark, sf_dir), "route", "k", 25.0).groupBy("route").agg(F.count("*").alias("points"), F.round(F.sum("x"), 2).alias("sum_x"), F.round(F.max("y"), 3).alias("top_y"))


@query("g4_signatures", SAMPLES + """,
c AS (SELECT route, i, floor(x / 50)::BIGINT AS cx, floor(y / 50)::BIGINT AS cy FROM smp),
n AS (SELECT *, CASE WHEN lag(cx) OVER w = cx AND lag(cy) OVER w = cy THEN 0 ELSE 1 END AS f FROM c WINDOW w AS (PARTITION BY route ORDER BY i)),
r AS (SELECT route, cx, cy, sum(f) OVER (PARTITION BY route ORDER BY i) AS stretch FROM n)
SELECT route, stretch::BIGINT AS at, cx AS cell_x, cy AS cell_y, count(*) * 25.0::DOUBLE AS metres FROM r GROUP BY ALL""")
def g4_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads.signature(vertices(spark, sf_dir), "route", "k", 50.0)


@query("g18_midpoints", LEGS + """,
h AS (SELECT *, sum(len) OVER (PARTITION BY route) / 2 AS half FROM legs)
SELECT route, round(arg_min(x + (half - start) / len * (x1 - x), k), 3) AS x, round(arg_min(y + (half - start) / len * (y1 - y), k), 3) AS y FROM h WHERE len > 0 AND start <= half AND half <= start + len GROUP BY route""")
def g18_midpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads.midpoints(vertices(spark, sf_dir), "route", "k").select("route", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query("g8_work_budget", """
WITH p AS (SELECT l_orderkey AS route, l_suppkey % 3 AS cell, count(*) AS n FROM lineitem GROUP BY ALL), o AS (SELECT o_orderkey AS route, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next FROM orders),
w AS (SELECT o.route, coalesce(sum(a.n * b.n), 0) AS work FROM o LEFT JOIN p a USING (route) LEFT JOIN p b ON b.route = o.next AND b.cell = a.cell WHERE o.next IS NOT NULL GROUP BY o.route)
SELECT CASE WHEN work <= 6 THEN 'OK' ELSE 'SIMILARITY_WORK_LIMIT' END AS status, count(*) AS pairs FROM w GROUP BY ALL""")
def g8_work_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work, the pairs of shared cells, is counted before any is done, from counts by cell and without arrays."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("route"), (F.col("l_suppkey") % 3).alias("cell")).agg(F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("route"), F.expr("lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)").alias("next"))
    met = o.where("next is not null").join(n, "route", "left").join(n.select(F.col("route").alias("next"), "cell", F.col("n").alias("m")), ["next", "cell"], "left")
    pairs = met.groupBy("route").agg(F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("work"))
    return pairs.groupBy(F.when(F.col("work") <= 6, "OK").otherwise("SIMILARITY_WORK_LIMIT").alias("status")).agg(F.count("*").alias("pairs"))


@query("g12_snapped", """
WITH p AS (SELECT c_custkey AS point_id, (c_custkey % 1009)::DOUBLE AS x, (c_custkey * 7 % 883)::DOUBLE AS y FROM customer),
s AS (SELECT s_suppkey AS line_id, (s_suppkey * 37 % 1009)::DOUBLE AS ax, (s_suppkey * 53 % 883)::DOUBLE AS ay, (s_suppkey * 37 % 1009 + s_suppkey % 3 * 20 + 7)::DOUBLE AS bx, (s_suppkey * 53 % 883 + s_suppkey % 5 * 13)::DOUBLE AS by_ FROM supplier),
d AS (SELECT point_id, line_id, x, y, ax, ay, bx, by_, greatest(0.0, least(1.0, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) AS t FROM p, s),
e AS (SELECT point_id, line_id, degrees(atan2(bx - ax, by_ - ay)) AS h, sqrt(pow(x - ax - t * (bx - ax), 2) + pow(y - ay - t * (by_ - ay), 2)) AS m FROM d),
f AS (SELECT *, min(m) OVER (PARTITION BY point_id) AS best FROM e WHERE m <= 100), g AS (SELECT *, first_value(h) OVER (PARTITION BY point_id ORDER BY line_id) AS h0 FROM f WHERE m <= best + 0.05)
SELECT point_id, min(line_id) AS line_id, round(min(m), 4) AS distance_m, count(*) AS ties, max(least(abs(h - h0), 360 - abs(h - h0))) > 45 AS ambiguous FROM g GROUP BY point_id""")
def g12_snapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    p = table(spark, sf_dir, "customer").select(c.alias("point_id"), (c % 1009).cast("double").alias("x"), (c * 7 % 883).cast("double").alias("y"))
    ax, ay = s * 37 % 1009, s * 53 % 883
    ends = {"ax": ax, "ay": ay, "bx": ax + s % 3 * 20 + 7, "by": ay + s % 5 * 13}
    lines = table(spark, sf_dir, "supplier").select(s.alias("line_id"), *[v.cast("double").alias(n) for n, v in ends.items()])
    return roads.snapped(p, lines, 100.0).select("point_id", "line_id", F.round("distance_m", 4).alias("distance_m"), "ties", "ambiguous")


@query("g11_detours", """
WITH e AS (SELECT l_suppkey AS a, l_partkey % 100 + 1 AS b, min(l_quantity) AS cost FROM lineitem GROUP BY ALL),
t AS (SELECT s_suppkey AS trip_id, s_suppkey AS a, s_suppkey * 3 % 10 + 1 AS via, s_suppkey * 7 % 100 + 1 AS b FROM supplier)
SELECT trip_id, x.cost + y.cost AS through, z.cost AS direct, round(CASE WHEN x.cost + y.cost - z.cost > 0 THEN x.cost + y.cost - z.cost WHEN x.cost + y.cost - z.cost IS NOT NULL THEN 0 END, 1) AS detour
FROM t LEFT JOIN e x ON x.a = t.a AND x.b = t.via LEFT JOIN e y ON y.a = t.via AND y.b = t.b LEFT JOIN e z ON z.a = t.a AND z.b = t.b""")
def g11_detours(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    trips = table(spark, sf_dir, "supplier").select(k.alias("trip_id"), k.alias("a"), (k * 3 % 10 + 1).alias("via"), (k * 7 % 100 + 1).alias("b"))
    return roads.legs_and_detours(edges(spark, sf_dir), trips).select("trip_id", (F.col("leg1") + F.col("leg2")).alias("through"), "direct", "detour")


WAYS = """
WITH p AS (SELECT l_orderkey AS way_id, l_linenumber AS k, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
v AS (SELECT way_id, row_number() OVER (PARTITION BY way_id ORDER BY k) - 1 AS pos, 210000000 + p % 97 * 1000 AS la, 1058000000 + p % 89 * 1000 AS lo FROM p),
n AS (SELECT *, la * 4000000000 + lo AS node, lead(la) OVER w AS la1, lead(lo) OVER w AS lo1 FROM v WINDOW w AS (PARTITION BY way_id ORDER BY pos))"""


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("way_id"), F.col("l_linenumber").alias("k")).agg(F.min("l_partkey").alias("p"))
    node = F.struct("k", (21.0 + F.col("p") % 97 * 0.0001).alias("lat"), (105.8 + F.col("p") % 89 * 0.0001).alias("lon"))
    rows = one.groupBy("way_id").agg(F.array_sort(F.collect_list(node)).alias("v"))
    return rows.select("way_id", (F.col("way_id") % 3 == 0).alias("oneway"), F.transform("v", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))).alias("nodes"))


@query("s11_segments", WAYS + """,
s AS (SELECT way_id, pos, node AS a, la1 * 4000000000 + lo1 AS b FROM n WHERE la1 IS NOT NULL AND (la <> la1 OR lo <> lo1))
SELECT way_id, pos::BIGINT AS position, true AS forward, a AS from_node, b AS to_node FROM s UNION ALL SELECT way_id, pos, false, b, a FROM s WHERE way_id % 3 <> 0""")
def s11_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roads.segments(ways(spark, sf_dir)).select("way_id", F.col("position").cast("long").alias("position"), "forward", "from_node", "to_node")


@query("j23_adjacency", WAYS + """,
d AS (SELECT way_id, pos, node AS a, la1 * 4000000000 + lo1 AS b FROM n WHERE la1 IS NOT NULL), u AS (SELECT a, b, way_id AS w FROM d UNION ALL SELECT b, a, way_id FROM d)
SELECT d.way_id, d.pos::BIGINT AS position, count(DISTINCT w) AS ways FROM d LEFT JOIN u USING (a, b) GROUP BY ALL""")
def j23_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ways, in either direction, of all neighbouring nodes of all ways."""
    v = ways(spark, sf_dir).select("way_id", F.posexplode("nodes").alias("position", "n")).select("way_id", "position", roads.node_id(F.col("n.lat"), F.col("n.lon")).alias("node"))
    after = v.withColumn("b", F.lead("node").over(W.partitionBy("way_id").orderBy("position"))).where("b is not null")
    pairs = after.select(F.struct("way_id", F.col("position").cast("long").alias("position")).alias("pair_id"), F.col("node").alias("a"), "b")
    return roads.adjacent_nodes(pairs, v).select("pair_id.*", "ways")


query("j23_all_pairs", SQL["j23_adjacency"])(j23_adjacency)  # its earlier name


@query("g2_rings", """
WITH c AS (SELECT s_suppkey, 21000 + s_suppkey % 7 AS r, 105800 + s_suppkey % 5 AS c FROM supplier), o AS (SELECT (i // 5) - 2 AS i, (i % 5) - 2 AS j FROM range(25) t(i))
SELECT (2000000 + r + i) * 8000000 + 2000000 + c + j AS cell, count(*) AS n FROM c, o GROUP BY ALL""")
def g2_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    cell = geo.grid_cell((21000.5 + k % 7) * 0.001, (105800.5 + k % 5) * 0.001)
    return table(spark, sf_dir, "supplier").select(F.explode(geo.ring(cell, 2)).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"))


@query("g3_tile_index", "SELECT floor((210000 + c_custkey % 1009 * 3) / 40.0)::BIGINT AS row_, floor((1058000 + c_custkey % 883 * 3) / 40.0)::BIGINT AS col_, count(*) AS n FROM customer GROUP BY ALL")
def g3_tile_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many places each tile of about 450 m holds: what a query over tiles must be ready for."""
    a, _ = points(spark, sf_dir)
    ten = lambda c: F.bround(F.col(c) * 10_000)
    return a.groupBy(F.floor(ten("lat") / 40).alias("row_"), F.floor(ten("lon") / 40).alias("col_")).agg(F.count("*").alias("n"))


@query("m1_two_radii", """
WITH x AS (SELECT c_custkey, radians(c_custkey % 179 - 89) AS a, radians(c_custkey % 359 - 179) AS o FROM customer), h AS (SELECT c_custkey, pow(sin((a - radians(21.0)) / 2), 2) + cos(a) * cos(radians(21.0)) * pow(sin((o - radians(105.8)) / 2), 2) AS h FROM x)
SELECT c_custkey, round(2 * 6371 * atan2(sqrt(h), sqrt(1 - h)), 3) AS mean_km, round(2 * 6371.0088 * asin(sqrt(h)), 3) AS sphere_km FROM h""")
def m1_two_radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    km = lambda r: F.round(geo.haversine((k % 179 - 89).cast("double"), (k % 359 - 179).cast("double"), F.lit(21.0), F.lit(105.8), r) / 1000, 3)
    return table(spark, sf_dir, "customer").select("c_custkey", km(geo.MEAN_RADIUS).alias("mean_km"), km(geo.SPHERE_RADIUS).alias("sphere_km"))


@query("m3_great_circle", """
WITH x AS (SELECT c_custkey, radians((c_custkey % 80)::DOUBLE) AS a, acos(cos(radians((c_custkey % 80)::DOUBLE)) * cos(radians(20.0::DOUBLE))) AS d FROM customer)
SELECT c_custkey, round(degrees(atan2(sin(a) * sin(d / 2) / sin(d), sqrt(pow(sin(d / 2) / sin(d) * (cos(radians(170.0)) * cos(a) + cos(radians(-170.0))), 2) + pow(sin(d / 2) / sin(d) * (sin(radians(170.0)) * cos(a) + sin(radians(-170.0))), 2)))), 6) AS lat FROM x""")
def m3_great_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halfway from longitude 170 to the equator at -170: over the antimeridian, not around the earth."""
    lat, _ = geo.between((F.col("c_custkey") % 80).cast("double"), F.lit(170.0), F.lit(0.0), F.lit(-170.0), F.lit(0.5))
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(lat, 6).alias("lat"))


query("m3_all_latitudes", SQL["m3_great_circle"])(m3_great_circle)  # its earlier name


@query("m5_shared_intervals", """
WITH x AS (SELECT l_linenumber, l_quantity AS c, l_quantity + l_discount * 300 - 10 AS d FROM lineitem), y AS (SELECT l_linenumber, greatest(0, c) AS lo, least(40, d) AS hi FROM x)
SELECT l_linenumber, count(*) FILTER (WHERE hi > lo) AS n, round(sum(hi - lo) FILTER (WHERE hi > lo), 3) AS metres FROM y GROUP BY l_linenumber""")
def m5_shared_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered metres of a road of 40 m that runs north-east; the covering segments lie on it."""
    unit, start, end = 2**-0.5, F.col("l_quantity"), F.col("l_quantity") + F.col("l_discount") * 300 - 10
    lo, hi = geo.shared_interval(*[F.lit(v) for v in (0.0, 0.0, 40.0 * unit, 40.0 * unit)], start * unit, start * unit, end * unit, end * unit)
    x = table(spark, sf_dir, "lineitem").select("l_linenumber", F.round(hi - lo, 9).alias("m")).withColumn("m", F.when(F.col("m") > 0, F.col("m")))
    return x.groupBy("l_linenumber").agg(F.count("m").alias("n"), F.round(F.sum("m"), 3).alias("metres"))


@query("t8_set_cover")
def t8_set_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five suppliers that cover most customers' orders' parts, greedily. No SQL: tested against a plain greedy loop."""
    members = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("item"), F.col("l_orderkey").alias("element"))
    return spark.createDataFrame(selection.set_cover(members, 5), "round long, item long, gain long")


@query("t10_spaced")
def t10_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as places more than 700 m apart, taken in a hashed order. No SQL: tested against a plain greedy loop."""
    a, _ = points(spark, sf_dir)
    return selection.spaced(a.withColumnRenamed("point_id", "place_id"), 700.0, 8)


@query("u8_choice_weights")
def u8_choice_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of distance, wait and service that explain which candidate is cheapest. No SQL: tested on planted weights."""
    rows = pool_costs(spark, sf_dir)
    best = rows.groupBy("request_id").agg(F.min(F.struct("cost", "station_id", "service")).alias("best"))
    options = rows.join(best, "request_id").select(
        F.col("request_id").alias("group"), (F.struct("cost", "station_id", "service") == F.col("best")).alias("chosen"),
        (F.col("distance_m") / 20_000).alias("distance"), (F.coalesce("wait_min", F.lit(90.0)) / 120).alias("wait"), (F.col("service_min") / 30).alias("duration"))
    names = ["distance", "wait", "duration"]
    return spark.createDataFrame(list(zip(names, selection.choice_weights(options, names), strict=True)), "feature string, weight double")
