"""Distances of any number of edges, and states as they were known, against plain loops."""

import heapq
import random

import pytest

from driftline.operators import asof, paths


def dijkstra(edges, source, bound=None):
    best, heap = {}, [((0.0, 0.0, 0), source)]
    while heap:
        way, node = heapq.heappop(heap)
        if node in best:
            continue
        best[node] = way
        for b, c, t in edges.get(node, ()):
            if b not in best and (bound is None or way[0] + c <= bound):
                heapq.heappush(heap, ((way[0] + c, way[1] + t, way[2] + 1), b))
    return best


@pytest.mark.parametrize("delta, bound, logs", [(None, None, 8), (0.5, None, 2), (1e9, None, 3), (None, 20.0, 8)])
def test_distances_equal_dijkstra(spark, delta, bound, logs):
    rng = random.Random(9)
    rows = [(i, i + 1, 1.0, 2.0) for i in range(24)] + [(0, 24, 30.0, 1.0), (0, 24, 40.0, 0.0)]  # the way round has 24 edges
    rows += [(rng.randrange(25, 70), rng.randrange(25, 70), float(rng.randrange(0, 6)), float(rng.randrange(0, 3))) for _ in range(160)]
    rows += [(24, 30, 0.0, 0.0), (5, 5, 1.0, 0.0), (100, 101, 2.0, None), (None, 3, 1.0, 1.0), (3, None, 1.0, 1.0)]
    edges = spark.createDataFrame(rows, "a int, b int, cost double, also double")
    sources = spark.createDataFrame([(0,), (30,), (100,), (999,), (0,), (None,)], "node int")
    near = {}
    for a, b, c, t in rows:
        if a is not None and b is not None:
            near.setdefault(a, []).append((b, c, t or 0.0))
    want = {(s, n, *w) for s in (0, 30, 100, 999) for n, w in dijkstra(near, s, bound).items()}
    got = [tuple(r) for r in paths.distances(edges, sources, delta, bound, logs).collect()]
    assert len(got) == len(want) and set(got) == want
    assert bound or max(r[4] for r in got) >= 24


def test_distances_of_nothing_and_negative_costs(spark):
    edges = spark.createDataFrame([(1, 2, -1.0, 0.0)], "a int, b int, cost double, also double")
    sources = spark.createDataFrame([(1,)], "node int")
    with pytest.raises(ValueError):
        paths.distances(edges, sources)
    assert [tuple(r) for r in paths.distances(edges.limit(0), sources).collect()] == [(1, 1, 0.0, 0.0, 0)]
    assert paths.distances(edges.limit(0), sources.limit(0)).count() == 0


def test_known_states_equal_a_replay_by_prefix(spark):
    rng = random.Random(6)
    states = [(rng.choice("ab"), rng.randrange(100), rng.randrange(100), i) for i in range(120)] + [(None, 1, 1, 900), ("a", None, 3, 901), ("a", 4, None, 902)]
    asks = [(i, rng.choice(["a", "b", "c"]), rng.randrange(-5, 110)) for i in range(90)] + [(90, None, 50), (91, "a", None)]
    s = spark.createDataFrame(states, "k string, ts int, arrived int, v int").selectExpr("k", "timestamp_seconds(ts) ts", "timestamp_seconds(arrived) arrived", "v")
    d = spark.createDataFrame(asks, "id int, k string, at int").selectExpr("id", "k", "timestamp_seconds(at) at")
    want, changed = {}, 0
    for i, k, at in asks:
        seen = [(ts, v, arr) for kk, ts, arr, v in states if kk is not None and kk == k and at is not None and ts is not None and arr is not None and arr <= at]
        best = max((x for x in seen if x[0] <= at), default=None)
        want[i] = best and best[1]
        plain = max(((ts, v) for kk, ts, arr, v in states if kk is not None and kk == k and at is not None and ts is not None and arr is not None and ts <= at), default=None)
        changed += (plain and plain[1]) != want[i]
    for bucket in (None, 7, 1000):
        assert {r.id: r.s_v for r in asof.known_asof(d, s, "k", "at", "ts", "arrived", ["v"], bucket).collect()} == want
    assert changed > 20
