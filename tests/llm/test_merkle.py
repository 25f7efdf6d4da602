"""Edits located by the tree, leaves cut by content."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from driftline.llm import merkle


def test_every_differing_branch_is_named(spark):
    draw = random.Random(2)
    para = lambda: " ".join(f"{draw.choice('abcdefghijklmnopqrstuvwxyz')}ord{draw.randrange(999)}" for _ in range(30))
    old = [[para() for _ in range(4)] for _ in range(5)]
    text = lambda x: "\n\n".join("\n".join(s) for s in x)
    cases = {"1.2,3.3,3.4": [(0, 1), (2, 2), (2, 3)], "5.4": [(4, 3)], "": []}
    for want, at in cases.items():
        new = [list(s) for s in old]
        for s, p in at:
            new[s][p] = para()
        inserted = [new[0], [para()], *new[1:]]  # a section more shifts all later ones and changes none
        for other in (new, inserted):
            df = merkle.grown(merkle.grown(spark.createDataFrame([(text(old), text(other))], "a string, b string"), "a", "t"), "b", "u")
            r = df.select(*merkle.differing("t", "u"), *[x.alias("r" + x_) for x, x_ in zip(merkle.differing("u", "t"), "sp", strict=True)]).first()
            assert r.edited_paragraphs == want and r.edited_sections == ",".join(sorted({str(s + 1) for s, _ in at}))
            assert len(r.rp.split(",")) == max(1, len(at) + (other is inserted))


def test_missing_nodes_equal_a_plain_search(spark):
    draw = random.Random(4)
    rows = [([str(draw.randrange(n or 1)) for _ in range(n)], [str(draw.randrange(n or 1)) for _ in range(m)]) for n, m in ((0, 0), (0, 3), (3, 0), (5, 5), (400, 300), (300, 400))]
    got = [r[0] for r in spark.createDataFrame(rows, "a array<string>, b array<string>").select(merkle.missing(F.col("a"), F.col("b"))).collect()]
    assert got == [[i for i, x in enumerate(a) if x not in b] for a, b in rows]


def test_leaves_follow_the_content(spark):
    draw = random.Random(6)
    texts = ["", " ", "a", "   lead and trail   ", "x" * 70, "\t tab\r", "\u2028 line", *("".join(draw.choice("dhzq 的漢é😀.\t") for _ in range(draw.randrange(200))) for _ in range(60))]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", merkle.leaves(F.col("t")).alias("l"))
    for r in df.collect():
        parts = [x for x in re.sub(merkle.CUT, "\\1\n", r.t).split("\n") if x]
        assert "".join(parts) == r.t and r.l == [hashlib.sha256(x.encode()).hexdigest()[:32] for x in parts]


def test_a_long_text(spark):
    text = "\n".join(f"the line {i} of a long text with some words" for i in range(60_000))
    df = spark.createDataFrame([(1, text), (2, text + "!")], "doc_id long, text string")
    got = {r.doc_id: r for r in merkle.fingerprint_documents(df).select("doc_id", merkle.likeness("own", "following").alias("n"), *merkle.differing("own", "following")).collect()}
    assert len(text) > 2_000_000 and 0.99 < got[1].n < 1 and got[1].edited_paragraphs == "1.60000"


def test_a_word_inserted_at_the_start(spark):
    line = " ".join(f"word{i}" for i in range(120))
    df = spark.createDataFrame([(1, line), (2, "new " + line), (3, None), (4, " "), (5, "one two"), (6, "one two")], "doc_id long, text string")
    got = {r.doc_id: r.v for r in merkle.fingerprint_documents(df).select("doc_id", merkle.likeness("own", "following").alias("v")).collect()}
    assert got[1] > 0.9  # leaves are cut by their content, so those after the inserted word stay as they are
    assert [got[i] for i in (2, 3, 4, 5)] == [0.0, 0.0, 0.0, 1.0]
