"""Runs against every period tried on every stretch, the query against a plain version, and odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from driftline.llm import runs
from tests.conftest import SMALL


def plain_runs(x, least=12):
    best = {}
    for q in range(1, len(x) // 2 + 1):
        start = 0
        while start + q < len(x):
            if x[start] != x[start + q]:
                start += 1
                continue
            end = start
            while end + q < len(x) and x[end] == x[end + q]:
                end += 1
            length = end - start + q
            if length >= max(least, 2 * q):
                best.setdefault((start, length), q)  # periods ascend: the first is the smallest
            start = end + 1
    return sorted((s, n, q) for (s, n), q in best.items())


def drawn(rng):
    kind = rng.randrange(5)
    if kind == 0:
        return [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randrange(80))]
    if kind == 1:  # Fibonacci words hold many nested runs
        a, b = [0], [0, 1]
        for _ in range(rng.randrange(9)):
            a, b = b, b + a
        return b
    out = []
    for _ in range(rng.randrange(1, 5)):
        part = [rng.randrange(4) for _ in range(rng.randrange(1, 12))]
        out += part * rng.randrange(1, 6) + part[: rng.randrange(len(part))] + [rng.randrange(9) for _ in range(rng.randrange(3))]
    return out


@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_equal_all_periods_tried(least):
    rng = random.Random(least)
    for _ in range(700):
        x = drawn(rng)
        assert runs.runs_of(np.array(x, np.int64), least) == plain_runs(x, least), x


def test_large_ordered_sets_split_and_long_runs_stay_cheap(monkeypatch):
    monkeypatch.setattr(runs, "BLOCK", 3)
    rng = random.Random(1)
    for _ in range(60):
        x = drawn(rng)
        assert runs.runs_of(np.array(x, np.int64)) == plain_runs(x), x
    own, held = runs.Ends(50), [50]
    for x in rng.sample(range(50), 50) + rng.sample(range(51, 99), 48):
        before, after = own.add(x)
        assert (before, after) == (max((h for h in held if h < x), default=None), min((h for h in held if h > x), default=None))
        held.append(x)
    assert list(own) == sorted(held) and own.size == len(held)
    assert runs.runs_of(np.array([7] * 30_000)) == [(0, 30_000, 1)]
    assert runs.runs_of(np.tile(np.arange(5000), 9)[:44_999]) == [(0, 44_999, 5000)]


def plain_query(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    top = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (
        doc_id, len(found), *top, top[1] and 1000 * top[1] // top[2], hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def test_query_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    got = {r.doc_id: tuple(r) for r in runs.op11_runs(spark, SMALL).collect()}
    short = [d for d in docs if len((d.text or "").split()) < 700]
    assert len(got) == len(docs) and len(short) > 100
    for d in short:
        assert got[d.doc_id] == plain_query(d.doc_id, d.text), d.doc_id
    assert sum(r[1] > 0 for r in got.values()) > 10


def test_odd_rows(spark, tmp_path):
    rows = [(1, None), (2, ""), (3, " \t\n "), (None, "a b " * 20), (5, "a b " * 20), (5, "a b " * 20), (6, "é é " * 12 + "x"), (7, "wort " * 60_000), (8, " ".join(map(str, range(300))))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, runs.op11_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((plain_query(*r) if r[0] != 7 else (7, 1, 0, 60_000, 1, 60_000_000, hashlib.sha256(b"0,60000,1\n").hexdigest(), hashlib.sha256(b"wort").hexdigest()) for r in rows), key=str)
    docs = spark.createDataFrame([("a a " * 9, "x", 4)], "text string, runs string, collapsed int")
    assert runs.periodic_runs(docs).select("text", "collapsed").collect() == [("a a " * 9, "a")]
    assert runs.periodic_runs(docs.limit(0)).count() == 0
    assert [tuple(r) for r in runs.periodic_runs(docs).first().runs] == [(0, 18, 1)]
