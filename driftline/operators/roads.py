"""Roads and routes: directed segments from ways, fixed-step samples of a route, signatures, snapping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftline.functions import geo, tiles
from driftline.operators.sessions import runs
from driftline.session import written


def node_id(lat: Column, lon: Column) -> Column:
    """One number for a place at seven decimals."""
    return F.bround(lat * 1e7).cast("long") * 4_000_000_000 + F.bround(lon * 1e7).cast("long")


def segments(ways: DataFrame, shortest_m: float = 0.5) -> DataFrame:
    """way_id, position, forward, from_node, to_node, metres of every directed segment.

    ways: way_id, oneway, nodes (array<struct<lat, lon>>). Each pair of neighbouring vertices is a segment, in both
    directions unless the way is one-way; segments shorter than shortest_m are left out.
    """
    pairs = F.arrays_zip(F.slice("nodes", F.lit(1), F.greatest(F.size("nodes") - 1, F.lit(0))).alias("a"), F.slice("nodes", F.lit(2), F.greatest(F.size("nodes") - 1, F.lit(0))).alias("b"))
    one = ways.select("way_id", "oneway", F.posexplode(pairs).alias("position", "p")).select("way_id", "oneway", "position", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    one = one.withColumn("metres", geo.haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))).where(F.col("metres") >= shortest_m)
    one = one.withColumns({"na": node_id(F.col("a.lat"), F.col("a.lon")), "nb": node_id(F.col("b.lat"), F.col("b.lon"))})
    there = F.struct(F.lit(True).alias("forward"), F.col("na").alias("from_node"), F.col("nb").alias("to_node"))
    back = F.struct(F.lit(False).alias("forward"), F.col("nb").alias("from_node"), F.col("na").alias("to_node"))
    both = one.withColumn("d", F.explode(F.when(F.col("oneway"), F.array(there)).otherwise(F.array(there, back))))
    return both.select("way_id", "position", "d.*", "metres")


def adjacent_nodes(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """(pair_id, ways, forward): ways on which nodes a and b are neighbours, and the direction if exactly one way has them.

    pairs: pair_id, a, b; vertices: way_id, position, node. Neighbours are made within ways before the join."""
    after = vertices.withColumn("next", F.lead("node").over(W.partitionBy("way_id").orderBy("position"))).where("next is not null")
    there = after.select(F.col("node").alias("a"), F.col("next").alias("b"), "way_id", F.lit(True).alias("forward"))
    both = there.unionByName(after.select(F.col("next").alias("a"), F.col("node").alias("b"), "way_id", F.lit(False).alias("forward")))
    known = both.groupBy("a", "b").agg(F.count_distinct("way_id").alias("ways"), F.bool_and("forward").alias("forward"))
    rows = pairs.join(known, ["a", "b"], "left").withColumn("ways", F.coalesce("ways", F.lit(0)))
    return rows.select("pair_id", "ways", F.when(F.col("ways") == 1, F.col("forward")).alias("forward"))


def measured(vertices: DataFrame, route: str, order: str) -> DataFrame:
    """Legs of each route: x, y, x1, y1, start (metres along the route), length. vertices: route, order, x, y (metres)."""
    w = W.partitionBy(route).orderBy(order)
    legs = vertices.select(route, order, "x", "y", F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1")).where("x1 is not null")
    legs = legs.withColumn("length", F.sqrt(F.pow(F.col("x1") - F.col("x"), 2) + F.pow(F.col("y1") - F.col("y"), 2)))
    return legs.withColumn("start", F.coalesce(F.sum("length").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))


def resampled(vertices: DataFrame, route: str, order: str, step_m: float) -> DataFrame:
    """(route, k, x, y): points every step_m metres of arc, from the start on. Each leg makes its own points; nothing is
    joined by range."""
    legs = measured(vertices, route, order)
    first, last = F.ceil(F.col("start") / step_m), F.ceil((F.col("start") + F.col("length")) / step_m) - 1
    ks = legs.where(last >= first).withColumn("k", F.explode(F.sequence(first, last)))
    share = (F.col("k") * step_m - F.col("start")) / F.col("length")
    return ks.select(route, "k", (F.col("x") + share * (F.col("x1") - F.col("x"))).alias("x"), (F.col("y") + share * (F.col("y1") - F.col("y"))).alias("y"))


def signature(vertices: DataFrame, route: str, order: str, cell_m: float) -> DataFrame:
    """(route, at, cell_x, cell_y, metres): the cells a route passes, in order, with the metres in each; sampled at half a
    cell, neighbours in one cell merged."""
    step = cell_m / 2
    samples = resampled(vertices, route, order, step).withColumns({"cell_x": F.floor(F.col("x") / cell_m), "cell_y": F.floor(F.col("y") / cell_m)})
    stretches = runs(samples, route, ["k"], F.struct("cell_x", "cell_y"), "at")
    return stretches.groupBy(route, "at", "cell_x", "cell_y").agg((F.count("*") * step).alias("metres"))


def midpoints(vertices: DataFrame, route: str, order: str) -> DataFrame:
    """(route, x, y) halfway along each route."""
    legs = measured(vertices, route, order).withColumn("half", F.sum("length").over(W.partitionBy(route)) / 2)
    at = legs.where("length > 0 and start <= half and half <= start + length")
    share = (F.col("half") - F.col("start")) / F.col("length")
    point = F.struct((F.col("x") + share * (F.col("x1") - F.col("x"))).alias("x"), (F.col("y") + share * (F.col("y1") - F.col("y"))).alias("y"))
    return at.groupBy(route).agg(F.min_by(point, "start").alias("p")).select(route, "p.*")


def snapped(points: DataFrame, lines: DataFrame, radius_m: float, tie_m: float = 0.05, turn: float = 45.0) -> DataFrame:
    """(point_id, line_id, distance_m, ties, ambiguous): the nearest line of each point up to radius_m.

    points: point_id, x, y; lines: line_id, ax, ay, bx, by (metres, of any length). A line stands in every tile up to the radius
    beside it, a point in its own, so they meet in one equi join and once. Where lines lie close, narrow tiles are searched first and only
    points that found nothing there look farther; each round is written. Within tie_m of the best the smallest line_id wins; where
    headings of those differ by more than `turn` degrees the point is ambiguous.
    """
    rounds, n = [radius_m], lines.count()
    box = lines.agg(*[(F.max(F.greatest(a, b)) - F.min(F.least(a, b)) + 1).alias(name) for name, a, b in (("w", "ax", "bx"), ("h", "ay", "by"))]).first()
    # a tile is to hold some hundred lines at most, were they dealt evenly
    while n and rounds[0] > 8 * tie_m and n * (2 * rounds[0]) ** 2 > 100 * (box["w"] or 1) * (box["h"] or 1):
        rounds.insert(0, rounds[0] / 4)
    left, parts = points, []
    for r in rounds[:-1]:
        found = written(_snapped(left, lines, r, tie_m, turn), "snapped")
        # all that ties with the nearest lies within the radius, too
        parts.append(found.where(F.col("distance_m") <= r - tie_m))
        left = written(left.join(parts[-1].select("point_id"), "point_id", "left_anti"), "unsnapped")
    return reduce(DataFrame.unionByName, [*parts, _snapped(left, lines, radius_m, tie_m, turn)])


def _snapped(points: DataFrame, lines: DataFrame, radius_m: float, tie_m: float, turn: float) -> DataFrame:
    wide = 2.0 * radius_m
    left = points.select("point_id", "x", "y", F.floor(F.col("x") / wide).alias("i"), F.floor(F.col("y") / wide).alias("j"))
    right = lines.withColumn("tile", F.explode(tiles.segment_tiles(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), wide, radius_m)))
    right = right.withColumns({"i": F.col("tile.i"), "j": F.col("tile.j")}).drop("tile")
    d, _ = geo.project(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    heading = F.pmod(F.degrees(F.atan2(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))) + 360.0, F.lit(360.0))
    near = left.join(right, ["i", "j"]).withColumns({"d": d, "heading": heading}).where(F.col("d") <= radius_m)
    near = near.withColumn("best", F.min("d").over(W.partitionBy("point_id"))).where(F.col("d") <= F.col("best") + tie_m)
    near = near.withColumn("first", F.min_by("heading", "line_id").over(W.partitionBy("point_id")))
    found = near.groupBy("point_id").agg(F.min("line_id").alias("line_id"), F.min("d").alias("distance_m"), F.count("*").alias("ties"), F.max(geo.heading_difference(F.col("heading"), F.col("first"))).alias("spread"))
    return found.select("point_id", "line_id", "distance_m", "ties", (F.col("spread") > turn).alias("ambiguous"))


def near_cells(places: DataFrame, radius_m: float, cell_m: float = 5.0) -> DataFrame:
    """i, j, sure, near of every cell of the plane that a place (x, y) may be within radius_m of: sure if one place is so of the whole cell,
    else near has the places that are so of a part of it. A dense crowd of places makes cells sure, not lists long."""
    square, all_of = radius_m * radius_m, lambda c: F.sequence(F.floor((F.col(c) - radius_m) / cell_m), F.floor((F.col(c) + radius_m) / cell_m))
    cells = places.select("x", "y").distinct().withColumn("i", F.explode(all_of("x"))).withColumn("j", F.explode(all_of("y")))
    low = {c: F.col(k) * cell_m - F.col(c) for c, k in (("x", "i"), ("y", "j"))}
    least = sum((F.pow(F.greatest(F.lit(0.0), low[c], -low[c] - cell_m), 2) for c in "xy"), F.lit(0.0))
    most = sum((F.pow(F.greatest(F.abs(low[c]), F.abs(low[c] + cell_m)), 2) for c in "xy"), F.lit(0.0))
    # a millimetre aside, so that rounding decides nothing
    cells = cells.where(least <= square + 2e-3 * radius_m).withColumn("sure", most <= square - 2e-3 * radius_m)
    sure = cells.groupBy("i", "j").agg(F.bool_or("sure").alias("sure"))
    part = cells.join(sure.where("not sure").select("i", "j"), ["i", "j"], "left_semi").groupBy("i", "j").agg(F.collect_list(F.struct("x", "y")).alias("near"))
    return sure.join(part, ["i", "j"], "left")


def covered_samples(samples: DataFrame, places: DataFrame, radius_m: float, route: str, cell_m: float = 5.0) -> DataFrame:
    """route, points, covered: how many samples (route, x, y) of each route there are, and lie within radius_m of any place (x, y)."""
    cells = written(near_cells(places, radius_m, cell_m), "cells")
    own = samples.select(route, "x", "y", F.floor(F.col("x") / cell_m).alias("i"), F.floor(F.col("y") / cell_m).alias("j")).join(cells, ["i", "j"], "left")
    hit = F.col("sure") | F.exists("near", lambda p: F.pow(p["x"] - F.col("x"), 2) + F.pow(p["y"] - F.col("y"), 2) <= radius_m * radius_m)
    return own.groupBy(route).agg(F.count("*").alias("points"), F.count_if(F.coalesce(hit, F.lit(False))).alias("covered"))


def legs_and_detours(matrix: DataFrame, trips: DataFrame) -> DataFrame:
    """trips (trip_id, a, via, b) with leg1, leg2, direct, detour from a matrix (a, b, cost); nulls where a leg is missing."""
    cost = lambda p, q, name: matrix.select(F.col("a").alias(p), F.col("b").alias(q), F.col("cost").alias(name))
    rows = trips.join(cost("a", "via", "leg1"), ["a", "via"], "left").join(cost("via", "b", "leg2"), ["via", "b"], "left").join(cost("a", "b", "direct"), ["a", "b"], "left")
    detour = F.col("leg1") + F.col("leg2") - F.col("direct")
    return rows.withColumn("detour", F.when(detour.isNotNull(), F.round(F.greatest(F.lit(0.0), detour), 1)))
