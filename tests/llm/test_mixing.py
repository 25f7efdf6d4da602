"""Entropy balancing against a plain bisection on each source's multiplier."""

import collections
import math

import pytest

from driftline.llm import mixing
from driftline.llm.common import table

SMALL = "/root/testdata/sf0.001"


def test_rates_solve_the_dual(spark):
    """Each source's rates are min(exp(lam * size), 2) for the one lam that meets its target; full sources take everything twice."""
    rows = mixing.mix(table(spark, SMALL, "documents")).collect()
    of = collections.defaultdict(list)
    for r in rows:
        of[r.source].append(r)
    open_ = 0
    for own in of.values():
        target, top = own[0].target, max(r.size for r in own)
        assert own[0].source_size == sum(r.size for r in own) and len({(r.target, r.source_size) for r in own}) == 1
        if target >= 2 * own[0].source_size:
            assert all(r.rate == 2 for r in own if r.size)
            continue
        rate = lambda lam, size: min(math.exp(min(lam * size / top, 50.0)), 2.0)  # noqa: E731, B023
        low, high = -200.0, 200.0
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if sum(rate(middle, r.size) * r.size for r in own) < target else (low, middle)
        open_ += 1
        assert all(r.rate == pytest.approx(rate(low, r.size), abs=5e-5) for r in own)
        assert sum(r.rate * r.size for r in own) == pytest.approx(target, rel=1e-4)
    assert open_
