"""Covered metres against fine sampling, UTM against integrals, sparse ordered overlap."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline.functions import geo
from driftline.operators import buffers, trajectory


def covered_plain(road, paths, r):
    """The union of what lies within r, found by bisection at each change of a fine sampling."""
    ax, ay, bx, by = road
    length = math.hypot(bx - ax, by - ay)
    if not length:
        return 0.0
    p = np.array(paths, float)
    d, m = p[:, 2:] - p[:, :2], (p[:, 2] - p[:, 0]) ** 2 + (p[:, 3] - p[:, 1]) ** 2

    def near(t):
        q = np.array([ax + t * (bx - ax) / length, ay + t * (by - ay) / length]) - p[:, :2]
        s = np.clip(np.where(m > 0, (q * d).sum(1) / np.where(m > 0, m, 1), 0), 0, 1)
        return bool((np.hypot(*(q - s[:, None] * d).T) <= r).any())

    n = 4000
    ts = [length * i / n for i in range(n + 1)]
    on = [near(t) for t in ts]
    total = 0.0
    for a, b, x, y in zip(ts, ts[1:], on, on[1:]):
        if x == y:
            total += (b - a) * x
        else:
            lo, hi = a, b
            for _ in range(40):
                mid = (lo + hi) / 2
                lo, hi = (mid, hi) if near(mid) == x else (lo, mid)
            total += lo - a if x else b - lo
    return total


def test_covered_metres(spark):
    rng = random.Random(3)
    u = lambda: rng.uniform(0, 300)
    roads = [(i, u(), u(), u(), u()) for i in range(25)] + [(25, 5.0, 5.0, 5.0, 5.0), (26, 0.0, 0.0, 100.0, 0.0), (27, 1000.0, 1000.0, 1100.0, 1000.0)]
    paths = [(u(), u(), u(), u()) for _ in range(6)] + [(50.0, 3.0, 50.0, 3.0), (20.0, 12.0, 40.0, 12.0), (20.0, 12.0, 40.0, 12.0), (10.0, 5.0, 10.0, 80.0)]
    df = spark.createDataFrame([*roads, (28, None, 1.0, 2.0, 3.0)], "road_id int, ax double, ay double, bx double, by double")
    got = {r.road_id: r for r in buffers.covered(df, spark.createDataFrame([*paths, (None, 1.0, 1.0, 1.0)], "px double, py double, qx double, qy double"), 12.0).collect()}
    assert len(got) == 29
    for i, *road in roads:
        assert got[i].covered_m == pytest.approx(covered_plain(road, paths, 12.0), abs=1e-6), i
    assert got[25].covered_m == got[27].covered_m == got[28].covered_m == 0
    assert buffers.covered(df, df.select(*[F.lit(0.0).alias(c) for c in ("px", "py", "qx", "qy")]).limit(0), 12.0).agg(F.sum("covered_m")).first()[0] == 0


def test_utm(spark):
    lat = [0.0, 0.5, 21.0, 45.0, 83.0]
    df = spark.createDataFrame([(a, o) for a in lat for o in (105.0, 105.0001, 107.9, 102.5)], "lat double, lon double")
    e, n = geo.utm(F.col("lat"), F.col("lon"), 48)
    e1, n1 = geo.utm(F.col("lat") + 1e-5, F.col("lon"), 48)
    rows = df.select("lat", "lon", e.alias("e"), n.alias("n"), e1.alias("e1"), n1.alias("n1")).collect()
    ee = geo.WGS84_F * (2 - geo.WGS84_F)
    for r in rows:
        if r.lon == 105.0:  # on the central meridian: the scaled arc of the meridian
            x = np.radians(np.linspace(0, r.lat, 200_001))
            arc = np.trapezoid(geo.WGS84_A * (1 - ee) / (1 - ee * np.sin(x) ** 2) ** 1.5, x)
            assert r.e == pytest.approx(500_000, abs=1e-6) and r.n == pytest.approx(0.9996 * arc, abs=1e-4)
        # a step to the north is as long as its arc by the point's scale, which is within UTM's bounds
        f = math.radians(r.lat)
        step = math.radians(1e-5) * geo.WGS84_A * (1 - ee) / (1 - ee * math.sin(f) ** 2) ** 1.5
        scale = math.hypot(r.e1 - r.e, r.n1 - r.n) / step
        eta = math.cos(f) * math.radians(r.lon - 105)
        assert scale == pytest.approx(0.9996 * (1 + eta**2 / 2 * (1 + ee / (1 - ee) * math.cos(f) ** 2)), abs=3e-5)


def test_ordered_overlap_is_sparse():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        wa, wb = ([rng.choice([0.5, 1.0, 2.0, 3.5]) for _ in x] for x in (a, b))
        best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + min(wa[i], wb[j]) if a[i] == b[j] else 0.0)
        assert trajectory.ordered_overlap(a, wa, b, wb) == best[-1][-1]
    a = [str(rng.randrange(576)) for _ in range(12_000)]
    b = [str(rng.randrange(576)) for _ in range(12_000)]
    assert 240_000 < trajectory.shared_pairs(a, b) < 260_000
    began = time.process_time()
    trajectory.ordered_overlap(a, [1.0] * len(a), b, [rng.random() for _ in b])
    assert time.process_time() - began < 3  # well under one second on an idle machine
