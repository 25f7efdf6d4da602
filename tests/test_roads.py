"""Roads, selections, checked joins and numbering on drawn cases, against plain loops."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from driftline.functions import expr, geo
from driftline.operators import ranking, reconcile, roads, selection


def test_resampling_keeps_equal_steps(spark):
    rows = [("a", 0, 0.0, 0.0), ("a", 1, 30.0, 0.0), ("a", 2, 30.0, 40.0), ("b", 0, 5.0, 5.0), ("c", 0, 1.0, 1.0), ("c", 1, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "route string, k int, x double, y double")
    got = sorted(tuple(r) for r in roads.resampled(df, "route", "k", 20.0).collect())
    assert got == [("a", 0, 0.0, 0.0), ("a", 1, 20.0, 0.0), ("a", 2, 30.0, 10.0), ("a", 3, 30.0, 30.0)]  # one point and zero length give none
    mid = {r.route: (r.x, r.y) for r in roads.midpoints(df, "route", "k").collect()}
    assert mid == {"a": (30.0, 5.0)}


def test_segments_directions_and_short_pieces(spark):
    nodes = lambda *x: [(21.0, 105.8 + i) for i in x]
    df = spark.createDataFrame([(1, True, nodes(0.0, 0.001, 0.001)), (2, False, nodes(0.0, 0.001)), (3, False, nodes(0.0)), (4, False, [])], "way_id int, oneway boolean, nodes array<struct<lat:double,lon:double>>")
    got = roads.segments(df).collect()
    assert sorted((r.way_id, r.forward) for r in got) == [(1, True), (2, False), (2, True)]
    a, b = (r for r in got if r.way_id == 2)
    assert (a.from_node, a.to_node) == (b.to_node, b.from_node)


def test_snapping_ties_and_headings(spark):
    points = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 500.0)], "point_id int, x double, y double")
    lines = spark.createDataFrame([(7, 0.0, 0.0, 10.0, 0.0), (8, 10.0, 0.0, 0.0, 0.0), (9, 0.0, 0.04, 10.0, 0.04)], "line_id int, ax double, ay double, bx double, by double")
    got = [tuple(r) for r in roads.snapped(points, lines, 50.0).collect()]
    assert [(r[0], r[1], r[3], r[4]) for r in got] == [(1, 7, 3, True)]
    straight = roads.snapped(points, lines.where("line_id <> 8"), 50.0).first()
    assert (straight.line_id, straight.ties, straight.ambiguous) == (7, 2, False)


def test_set_cover_equals_plain_loop(spark):
    random.seed(3)
    members = {i: {random.randrange(40) for _ in range(random.randrange(1, 15))} for i in range(12)}
    left, want = set().union(*members.values()), []
    for k in range(20):
        best = max(members, key=lambda i: (len(members[i] & left), -i))
        if not members[best] & left:
            break
        want.append((k + 1, best, len(members[best] & left)))
        left -= members[best]
    df = spark.createDataFrame([(i, e) for i, x in members.items() for e in x], "item int, element int")
    assert selection.set_cover(df, 20) == want
    assert selection.set_cover(df.limit(0), 3) == []


def test_spaced_equals_plain_loop(spark):
    random.seed(5)
    places = [(i, 21.0 + random.random() * 0.03, 105.8 + random.random() * 0.03) for i in range(60)]
    df = spark.createDataFrame(places, "place_id int, lat double, lon double")
    hav = lambda a, b: 2 * geo.MEAN_RADIUS * math.asin(math.sqrt(math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2))
    turn, taken = {r.place_id: r.h for r in df.select("place_id", F.xxhash64("place_id").alias("h")).collect()}, []
    for p in sorted(places, key=lambda p: (turn[p[0]], p[0])):
        if all(hav(p, q) > 700 for q in taken):
            taken.append(p)
    assert sorted(r.place_id for r in selection.spaced(df, 700.0, 8).collect()) == sorted(p[0] for p in taken)


def test_choice_weights_find_what_decides(spark):
    random.seed(9)
    rows = []
    for g in range(60):
        options = [(random.random(), random.random()) for _ in range(4)]
        best = min(options)
        rows += [(g, o == best, *o) for o in options]
    w = selection.choice_weights(spark.createDataFrame(rows, "group int, chosen boolean, a double, b double"), ["a", "b"], rounds=8)
    assert w[0] > 0.9 and abs(sum(w) - 1) < 1e-9
    assert selection.onto_simplex([0.5, 0.5, -3.0]) == [0.5, 0.5, 0.0]


def test_many_to_one_refuses_repeated_keys(spark):
    facts = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert reconcile.many_to_one(facts, spark.createDataFrame([(1, 5)], "k int, d int"), ["k"]).count() == 1
    with pytest.raises(Exception, match="not unique"):
        reconcile.many_to_one(facts, spark.createDataFrame([(1, 5), (1, 6)], "k int, d int"), ["k"]).collect()


def test_numbering_is_whole_and_in_order(spark):
    values = [None, *random.Random(1).sample(range(1000), 300)]
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    got = ranking.numbered(df, F.floor(F.col("v") / 50), ["v"]).collect()
    assert [r.v for r in sorted(got, key=lambda r: r.number)] == sorted(values, key=lambda v: (v is not None, v)) and sorted(r.number for r in got) == list(range(1, 302))


def test_unique_matches_and_agreeing(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, k string")
    right = spark.createDataFrame([("a", 10), ("b", 20), ("b", 21)], "k string, way int")
    got = {r.id: (r.way, r.matches) for r in reconcile.unique_matches(left, right, ["k"], "way").collect()}
    assert got == {1: (10, 1), 2: (None, 2), 3: (None, 0)}
    for x in itertools.product((None, 1, 2), repeat=3):
        df = spark.createDataFrame([x], "a int, b int, c int")
        value, same = reconcile.agreeing([F.col("a"), F.col("b"), F.col("c")])
        known = [v for v in x if v is not None]
        assert df.select(value, same).first()[:] == (known[0] if known else None, len(set(known)) <= 1)


def test_great_circle_over_the_antimeridian(spark):
    lat, lon = geo.between(F.lit(10.0), F.lit(179.0), F.lit(10.0), F.lit(-179.0), F.lit(0.5))
    r = spark.range(1).select(lat.alias("lat"), lon.alias("lon")).first()
    assert abs(abs(r.lon) - 180) < 1e-9 and 10 < r.lat < 10.01


def test_arrays_and_rules(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0, None],), ([float("nan")],), ([],), ([-1.0],)], "q array<double>")
    assert [r[0] for r in df.select(expr.sound_array(F.col("q"), 1, 3)).collect()] == [True, False, False, False, False]
    assert spark.range(1).select(expr.violations({"A": F.lit(True), "B": F.lit(None).cast("boolean"), "C": F.lit(False)})).first()[0] == ["A"]
