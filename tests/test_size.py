"""What must stay bounded on large tables: broadcasts, passes over the candidates, rows of a task."""

import hashlib
import random

import pytest

from driftline.operators import blocks, corridor, roads, spatial
from driftline.plans import corridor_queries, decision_queries
from driftline.plans.catalog import QUERIES
from driftline.sources import sinks
from tests.conftest import SMALL


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def trips(spark):
    trips, guidance, observations = corridor_queries.guided_trips(spark, SMALL)
    cut = corridor.written(corridor.pieces(guidance.withColumnRenamed("effective_s", "version"), ["trip_id", "version"], "k"), "guidance")
    return cut, corridor.written(corridor.observed(observations, guidance), "points"), trips, guidance, observations


def test_pieces_of_trips_are_not_broadcast(trips):
    cut, points, *_ = trips
    assert "Broadcast" not in plan_of(corridor.candidates(points, cut))


def test_trip_events_are_one_pass(trips):
    _, _, *given = trips
    assert "Union" not in plan_of(corridor.trip_events(given[0], corridor.labelled(corridor.followed(*given))))


@pytest.mark.parametrize("name", ["t1_rank_topn", "w10_label_cost_rank", "p31_choice_cost", "a18_agreement", "w11_nearest_pool", "t3_eligible_first", "a25_best_time"])
def test_first_stations_found_in_blocks_are_the_first_of_all(spark, monkeypatch, name):
    key = lambda df: sorted(map(str, df.collect()))
    want = key(QUERIES[name](spark, SMALL))
    monkeypatch.setattr(decision_queries, "FEW", 0)
    monkeypatch.setattr(blocks, "BLOCK", 2)
    assert key(QUERIES[name](spark, SMALL)) == want


def test_few_pairs_leave_a_block(spark):
    asks = spark.createDataFrame([(i, 1, "SWAP", 21.0 + i * 1e-4, 105.8, 100.0) for i in range(50)], "request_id long, area int, service string, lat double, lon double, range_km double")
    places = spark.createDataFrame([(i, 1, "SWAP", 21.0 + i * 1e-4, 105.8, 0.0, 0.0) for i in range(300)], "station_id long, area int, service string, s_lat double, s_lon double, fixed double, share double")
    got = sorted((r.request_id, r.station_id) for r in blocks.likely(asks, places, 1, 1.0).collect())
    assert got == [(i, i) for i in range(50)]


@pytest.mark.parametrize("name", ["a1_verdict_counts", "a26_degraded_reasons", "p11_range_feasible", "p14_refreshed_duration", "x13_state_changed"])
def test_counts_make_no_row_for_each_pair(spark, name):
    # of requests and stations only what a block returns is a row: the former join on the area alone is gone
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "asin" not in plan.lower()


def test_distances_equal_in_millimetres_are_tied(spark):
    # two places as far to the east as to the west: which is nearer in the last bits is chance
    points = spark.createDataFrame([(i, 21.0 + i * 0.003, 105.8 + i * 0.003) for i in range(60)], "point_id long, lat double, lon double")
    places = spark.createDataFrame([(2 * i + side, 21.0 + i * 0.003, 105.8 + i * 0.003 + (0.0009, -0.0009)[side]) for i in range(60) for side in (0, 1)], "place_id long, lat double, lon double")
    got = {r.point_id: r.place_id for r in spatial.within(points, places, 3000.0, 6, 1, digits=3).collect()}
    assert got == {i: 2 * i for i in range(60)}


def test_samples_near_a_crowd_of_places(spark):
    draw = random.Random(5)
    places = [(draw.uniform(0, 60), draw.uniform(0, 60)) for _ in range(300)] + [(200.0, 200.0), (240.0, 200.0)]
    samples = [(i % 7, draw.uniform(-50, 300), draw.uniform(-50, 300)) for i in range(800)] + [(1, 240.0, 240.0), (1, 240.0, 160.0)]
    near = lambda x, y: any((x - a) ** 2 + (y - b) ** 2 <= 1600 for a, b in places)
    want = {r: (sum(s[0] == r for s in samples), sum(s[0] == r and near(*s[1:]) for s in samples)) for r in range(7)}
    df, at = spark.createDataFrame(samples, "route int, x double, y double"), spark.createDataFrame(places, "x double, y double")
    assert {r.route: (r.points, r.covered) for r in roads.covered_samples(df, at, 40.0, "route").collect()} == want
    # in the middle of the crowd one place stands for all
    assert not any(r.near for r in roads.near_cells(at, 40.0).where("i between 3 and 8 and j between 3 and 8").collect())


def test_snapping_begins_narrow_where_lines_are_close(spark, monkeypatch):
    draw = random.Random(6)
    lines = [(i, (x := draw.uniform(0, 90)), (y := draw.uniform(0, 90)), x + draw.uniform(-9, 9), y + draw.uniform(-9, 9)) for i in range(400)] + [(400 + i, *lines0) for i, lines0 in enumerate([(300.0, 300.0, 350.0, 300.0), (300.0, 300.0, 350.0, 300.0)])]
    points = [(i, draw.uniform(-80, 400), draw.uniform(-80, 400)) for i in range(300)]
    df, at = spark.createDataFrame(points, "point_id long, x double, y double"), spark.createDataFrame(lines, "line_id long, ax double, ay double, bx double, by double")
    key = lambda rows: sorted((r.point_id, r.line_id, round(r.distance_m, 6), r.ties, r.ambiguous) for r in rows.collect())
    radii, plain = [], roads._snapped
    monkeypatch.setattr(roads, "_snapped", lambda a, b, r, *more: radii.append(r) or plain(a, b, r, *more))
    assert key(roads.snapped(df, at, 100.0)) == key(plain(df, at, 100.0, 0.05, 45.0))
    assert len(radii) > 1 and radii[-1] == 100.0


def test_customers_meet_stations_as_kinds(spark):
    plan = QUERIES["p9_compatibility"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2


def test_large_files_are_read_in_pieces(spark, tmp_path, monkeypatch):
    (tmp_path / "a b%20").mkdir()
    for name, n in (("small", 10), ("large", 5_000_000)):
        (tmp_path / "a b%20" / name).write_bytes(random.Random(n).randbytes(n))
    monkeypatch.setattr(sinks, "WHOLE", 1000)
    got = {r.name: (r.bytes, r.sha256) for r in sinks.digests(spark, str(tmp_path / "a b%20")).collect()}
    assert got == {n: (size, hashlib.sha256((tmp_path / "a b%20" / n).read_bytes()).hexdigest()) for n, size in (("small", 10), ("large", 5_000_000))}


@pytest.mark.parametrize("name", ["j4_expand", "p10_eligibility", "p13_replenishment"])
def test_pairs_are_made_by_many_tasks(spark, name):
    # the file of requests is one split, and so was the task that made all pairs
    df = QUERIES[name](spark, SMALL)
    assert "REPARTITION_BY_NUM" in plan_of(df) and df.rdd.getNumPartitions() >= 16
