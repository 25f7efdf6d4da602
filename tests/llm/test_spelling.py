"""Near words against all pairs, the query against a plain version, and odd rows."""

import random
import re
import zlib
from collections import Counter

from driftline.llm import spelling
from tests.conftest import SMALL


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    # words that are near share what is left without one letter, or one is what is left of the other
    left = {}
    for w in n:
        for i in range(len(w)):
            left.setdefault(w[:i] + w[i + 1 :], set()).add(w)
    others = {w: set() for w in n}
    for rest, ws in left.items():
        for w in ws:
            others[w] |= {x for x in (*ws, rest) if x in n and near(w, x)}
    for w in n:
        for x in others[w]:
            others[x].add(w)
    form = {}
    for w in n:
        best = min(others[w], key=lambda x: (-n[x], x.encode()), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(others[w]), n.get(form[w])) for w in n}


def test_near_words_equal_all_pairs(spark):
    rng = random.Random(7)
    words = {}
    for _ in range(150):
        w = "".join(rng.choice("abcdéÿ") for _ in range(rng.randrange(6, 10)))
        for _ in range(4):
            words[w] = rng.choice([5, 6, 30, 31, 160, 900])
            i, c = rng.randrange(len(w)), rng.choice("abcdéÿÀ")
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])
    words |= {"aaaaaa": 5, "aaaaaaa": 25, "aaaaaaaa": 125, "aaaaaaab": 125, "abcabc": 9, "abcbac": 9}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = spelling.near_words(df).collect()
    want = {(a, words[a], b, words[b]) for a in words for b in words if near(a, b)}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert {tuple(r) for r in spelling.variants(df).collect()} == plain_variants(words)


def plain_query(docs):
    n = Counter()
    for doc_id, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.encode().lower().decode()
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    return plain_variants({w: k for w, k in n.items() if len(w) >= 6 and k >= 5})


def test_query_against_a_plain_version(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = spelling.op13_spelling(spark, SMALL).collect()
    want = plain_query(docs)
    assert len(got) == len(want) > 300 and {tuple(r) for r in got} == want
    assert any(w[1] for w in want)


def test_odd_rows(spark, tmp_path):
    text = "Straße straße STRASSE strase ÀÉÎÕÜß× " * 6 + "strassen " * 40 + "x" * 300_000 + " ab"
    rows = [(1, None), (2, ""), (None, text), (3, text), (3, text), (4, "12 _ .")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in spelling.op13_spelling(spark, str(tmp_path)).collect()} == plain_query(rows)
    clash = spark.createDataFrame([("haus haus " * 9, "häuser " * 9, 1)], "word string, text string, n int")
    assert [tuple(r) for r in spelling.spelling_variants(clash).collect()] == [("häuser", None, "häuser", 9, 0, None)]
    assert spelling.spelling_variants(clash.limit(0)).count() == 0
