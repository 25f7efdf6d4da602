"""Polylines against a plain codec."""

import random

from pyspark.sql import functions as F

from driftline.sources import polylines as P


def plain_encode(points):
    out, before = "", (0, 0)
    for p in points:
        now = tuple(round(x * 1e5) for x in p)
        for a, b in zip(now, before):
            v = (a - b) * 2 if a >= b else -(a - b) * 2 - 1
            while v >= 32:
                out += chr((v & 31 | 32) + 63)
                v >>= 5
            out += chr(v + 63)
        before = now
    return out


def test_round_trips_and_faults(spark):
    rng = random.Random(2)
    lines = {i: [(round(rng.uniform(-90, 90), 5), round(rng.uniform(-180, 180), 5)) for _ in range(rng.randrange(2, 40))] for i in range(40)}
    lines[40] = [(0.0, 0.0), (0.0, 0.0)]
    df = spark.createDataFrame([(i, k, *p) for i, v in lines.items() for k, p in enumerate(v)], "id int, k int, lat double, lon double")
    made = P.encode(df, "id", "k").cache()
    assert {r.id: r.line for r in made.collect()} == {i: plain_encode(v) for i, v in lines.items()}
    points, faults = P.decode(made, "id")
    assert faults.count() == 0
    got = {}
    for r in points.orderBy("k").collect():
        got.setdefault(r.id, []).append((r.lat, r.lon))
    assert got == lines
    good = plain_encode([(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)])
    assert good == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    bad = {1: (None, "MISSING"), 2: ("", "TOO_FEW_POINTS"), 3: (good[:-1], "CUT_OFF"), 4: (plain_encode([(1.0, 2.0)]), "TOO_FEW_POINTS"), 5: (good[:5] + " " + good[5:], "BAD_CHARACTER"), 6: (plain_encode([(1.0, 2.0), (90.00001, 0.0)]), "OUT_OF_RANGE"),
           7: (plain_encode([(1.0, 2.0), (0.0, -180.00001), (0.0, 0.0)]), "OUT_OF_RANGE"), 8: ("~" * 12 + "?" + good, "NUMBER_TOO_LONG"), 9: ("?" * 40_002, "TOO_MANY_POINTS"), 10: ("?" * 100_001, "TOO_LONG"), 11: ("?" * 3, "CUT_OFF"), 12: ("é" * 9, "BAD_CHARACTER")}
    points, faults = P.decode(spark.createDataFrame([*[(i, t) for i, (t, _) in bad.items()], (99, good), (98, "?" * 40_000)], "id int, line string"), "id")
    assert {r.id: r.reason for r in faults.collect()} == {i: w for i, (_, w) in bad.items()} and faults.count() == len(bad)
    assert {r.id: r.n for r in points.groupBy("id").agg(F.count("*").alias("n")).collect()} == {99: 3, 98: 20_000}
