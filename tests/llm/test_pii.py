"""Weak supervision of personal data: estimates on planted reliabilities, added and refused spans, long texts."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from driftline.llm import pii


def test_em_finds_planted_reliabilities():
    rng = np.random.default_rng(4)
    truth = rng.random(60_000) < 0.35
    chances = {"check": (0.95, 0.05), "gazetteer": (0.8, 0.3), "context": (0.7, 0.1), "border": (0.9, 0.4), "shape": (0.6, 0.5)}  # P(1 | yes), P(1 | no)
    votes = np.stack([np.where(rng.random(len(truth)) < np.where(truth, *chances[v]), 1, -1) for v in pii.VOTES], axis=1)
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    found, sure = pii.estimate([(tuple(map(int, p)), int(n)) for p, n in zip(patterns, counts, strict=True)])
    for v, (yes, no) in chances.items():
        assert abs(found[v][1][1] - yes) < 0.03 and abs(found[v][1][0] - no) < 0.03
    guess = np.array([sure[tuple(map(int, p))] for p in patterns])[at.ravel()] >= 0.5
    assert (guess == truth).mean() > 0.95


def test_running_results_and_cuts(spark):
    draw = random.Random(3)
    for n in (0, 1, 127, 128, 129, 1000):
        xs = [draw.randrange(-9, 9) for _ in range(n)]
        df = spark.createDataFrame([(xs,)], "xs array<int>")
        got = df.select(pii.scan(F.col("xs"), lambda a, b: a + b), pii.scan(F.col("xs"), F.greatest)).first()
        assert list(got) == [list(itertools.accumulate(xs)), list(itertools.accumulate(xs, max))]
    text = "".join(draw.choice("ab\n漢😀") for _ in range(5000))
    asked = [(0, 5), (1020, 9), (1023, 1), (1024, 2048), (4990, 50), (-3, 5), (6000, 3), (7, 0)]
    df = spark.createDataFrame([(text, a, n) for a, n in asked], "t string, a int, n int")
    got = [r[0] for r in df.select(pii.cut(pii.blocks_of(F.col("t")), F.col("a"), F.col("n"))).collect()]
    assert got == [text[max(a, 0) : a + n] for a, n in asked]


def documents():
    draw = random.Random(8)
    digits = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    luhn = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    rows = []
    for i in range(300):
        key = "".join(draw.choice("0123456789abcdef") for _ in range(40))
        card = next(c for c in iter(lambda: "4" + digits(15), None) if luhn(c))
        wrong = next(c for c in iter(lambda: digits(16), None) if not luhn(c))
        other = [f'set token = "{key}" here', f"pay {card} now", f"number {wrong} of it", f"see state-of-the-art-in-2020-{digits(3)} there", "plain words only"][i % 5]
        rows.append((i, f"The beginning. {other} and the end.", i % 5))
    return rows


def test_added_and_refused_spans(spark):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string, kind int")
    found = {r.doc_id: r.spans for r in pii.find_pii(df).collect()}
    names = lambda i: [(pii.KINDS[s.kind], rows[i][1][s.start : s.end], s.base) for s in found[i]]
    for i, text, kind in rows:
        if kind == 0:
            assert names(i) == [("secret", text.split('"')[1], False)]
        elif kind == 1:
            assert names(i) == [("card", text.split()[3], True)]
        else:
            assert names(i) == []  # numbers that fail their check, long names and plain words are refused


def test_wide_spans_leave_base_spans_alone(spark):
    """A run that a base span covers is not proposed again, whatever stands around it."""
    text = "x " * 700 + "abcdefgh1234567890abcdefgh@mail.com a1b2c3d4e5f6a7b8c9d0e1f2@b.org 0123456789abcdef0123456789abcdef01234567"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: [(pii.KINDS[c.kind], text[c.start : c.end], c.base) for c in r.candidates] for r in pii.with_candidates(df).collect()}
    assert got == {1: [("email", text.split()[700], True), ("email", text.split()[701], True), ("secret", text.split()[702], False)], 2: [], 3: []}


def test_a_text_with_thousands_of_spans(spark):
    n = 8000
    text = " ".join(f"user{i}@mail{i % 7}.example.com, 10.0.{i % 250}.{i % 199}" for i in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = pii.with_candidates(df)
    r = pii.with_spans(found, pii.fit(found)).select("spans", pii.mask(F.col("text"), F.col("spans")).alias("m")).first()
    assert len(r.spans) == 2 * n and text[r.spans[-1].start : r.spans[-1].end] == f"10.0.{(n - 1) % 250}.{(n - 1) % 199}"
    assert r.m == " ".join(["[EMAIL], [IP]"] * n)
