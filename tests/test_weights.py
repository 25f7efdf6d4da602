"""Choice probabilities and projected weights on drawn rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from driftline.functions import expr


def test_softmax_and_simplex(spark):
    rng = random.Random(1)
    rows = [(i, i % 7, rng.choice([rng.uniform(-900, 900), 5.0, None])) for i in range(90)]
    got = {r.id: r.p for r in spark.createDataFrame(rows, "id int, g int, s double").select("id", expr.softmax(F.col("s"), ["g"], 2.0).alias("p")).collect()}
    for i, g, s in rows:
        own = [x for _, h, x in rows if h == g and x is not None]
        want = None if s is None else math.exp(-2 * (s - min(own))) / sum(math.exp(-2 * (x - min(own))) for x in own)
        assert got[i] == (None if want is None else pytest.approx(want))
    arrays = [[rng.uniform(-2, 3) for _ in range(rng.randrange(1, 7))] for _ in range(60)] + [[0.2, 0.3, 0.5], [], [1.0, None], None]
    df = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "id int, w array<double>").select("id", expr.on_simplex(F.col("w"), 0.05).alias("p"))
    got = {r.id: r.p for r in df.collect()}
    assert got[61] is got[62] is got[63] is None and got[60] == pytest.approx([0.2, 0.3, 0.5])
    for i, a in enumerate(arrays[:60]):
        p = got[i]
        assert sum(p) == pytest.approx(1) and min(p) >= 0.05 - 1e-12
        for _ in range(40):  # no other point of the simplex is nearer
            q = [rng.expovariate(1) for _ in a]
            q = [0.05 + x / sum(q) * (1 - 0.05 * len(a)) for x in q]
            assert math.dist(a, p) <= math.dist(a, q) + 1e-12
