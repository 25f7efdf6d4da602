"""The pipeline's stages on odd rows and as a whole, against plain versions."""

import collections
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from driftline.llm import mixing, pieces, quality
from driftline.llm.common import table

SMALL = "/root/testdata/sf0.001"
STAGES = dict(cp.STAGES)
LONG = " ".join(f"word{i % 977} is {i}" for i in range(3000))
#: doc_id, text, source. Ties, repeats, nulls, shared ids with other texts, rows without an id.
ODD = [
    (1, LONG, "a"), (2, LONG + " end", "a"), (2, LONG + " end", None), (3, "write to some.one@mail.example.com now", "b"), (3, "another text under the same id, unrelated to it", "b"),
    (4, None, "b"), (5, "", "b"), (6, " \n", None), (None, "nobody numbered this one here", None), (None, "nobody numbered this one here", "c"), (None, LONG, "c"), (7, 'set token = "0123456789abcdef0123456789abcdef01234567" there', "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    schema = table(spark, SMALL, "documents").schema
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in ODD], schema)


def test_near_copies_on_odd_rows(spark, odd):
    got = collections.Counter((r.doc_id, r.text) for r in STAGES["near_duplicates"](spark, odd, SMALL).collect())
    empty = [k for k in got if not (k[1] or "").strip()]
    assert got == collections.Counter([(1, LONG), (3, ODD[3][1]), (3, ODD[4][1]), (None, ODD[8][1]), (7, ODD[11][1]), *empty]) and empty == [(4, None)]


def test_personal_data_on_odd_rows(spark, odd):
    got = collections.Counter((r.doc_id, r.text, r.n_chars) for r in STAGES["personal_data"](spark, odd, SMALL).collect())
    clean = lambda t: t and re.sub("some.one@mail.example.com", "[EMAIL]", t)
    left = got - collections.Counter((i, clean(t), len(clean(t) or "") if t is not None else 0) for i, t, _ in ODD if i != 7)
    assert len(left) == 1 and sum(got.values()) == len(ODD)
    assert next(iter(left))[0] == 7 and next(iter(left))[2] == len(next(iter(left))[1])


def test_mixing_on_odd_rows(spark, odd):
    """Each row has copies of its own; equal rows share theirs."""
    copies = collections.Counter()
    key = ("doc_id", "text", "source")
    for r in mixing.mix(odd.withColumn("row", F.xxhash64(*odd.columns)).withColumn("t", F.col("text")), carry=("row", "t")).collect():
        copies[r.doc_id, r.t, r.source] += r.copies
    got = collections.Counter(tuple(r[c] for c in key) for r in STAGES["mixing"](spark, odd, SMALL).collect())
    assert sum(got.values()) == sum(copies.values()) and {k[1] for k in got} <= {t for _, t, _ in ODD}
    words = lambda c: {s: sum(n * len((t or "").split()) for (_, t, z), n in c.items() if z == s) for s in ("a", "b", "c", None)}
    assert words(got) == words(copies)


def test_mixing_hits_its_targets_whatever_the_ids(spark):
    docs = table(spark, SMALL, "documents")
    nobody = docs.withColumn("doc_id", F.lit(None).cast("long"))
    nobody = nobody.unionAll(nobody.limit(7)).unionAll(nobody.limit(7))
    goal = {r.source: (r.n, r.target, r.top) for r in mixing.mix(nobody).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("n"), F.first("target").alias("target"), F.max("size").alias("top")).collect()}
    out = [STAGES["mixing"](spark, d, SMALL) for d in (nobody, nobody.repartition(9))]
    sizes = [{r.source: r.n for r in o.groupBy("source").agg(F.sum(mixing.size_of()).alias("n")).collect()} for o in out]
    assert sizes[0] == sizes[1] == {s: n for s, (n, _, _) in goal.items()}  # so much as the operator itself takes
    assert all(abs(n - t) < top for n, t, top in goal.values())
    first, second = (collections.Counter(map(tuple, o.collect())) for o in out)
    assert first == second


def test_equal_ids_and_texts_leave_one_defined_row(spark, odd):
    rows = spark.createDataFrame([(1, LONG, "en", s, 1) for s in ("c", "a", "b")] + [(1, LONG, "de", "a", 1)], odd.schema)
    for order in (rows, rows.orderBy(F.desc("source")), rows.repartition(5)):
        assert [tuple(r)[2:4] for r in STAGES["near_duplicates"](spark, order, SMALL).collect()] == [("de", "a")]


def test_quality_and_pieces_on_odd_rows(spark, odd):
    kept = collections.Counter((r.doc_id, r.text) for r in STAGES["quality"](spark, odd, SMALL).collect())
    scores = [r.score for r in quality.score_documents(odd, table(spark, SMALL, "labels")).collect()]
    assert sum(kept.values()) == sum(s >= 0.3 for s in scores) and not kept - collections.Counter((i, t) for i, t, _ in ODD)
    out = STAGES["pieces"](spark, odd, SMALL)
    assert sorted(map(str, map(tuple, pieces.decode(out.select("doc_id", "ids")).collect()))) == sorted(str((i, t or "")) for i, t, _ in ODD)


def test_stages_keep_columns_and_empty_tables(spark, odd):
    for name, stage in cp.STAGES:
        out = stage(spark, odd.limit(0), SMALL)
        assert out.count() == 0 and (name == "pieces" or out.columns == odd.columns)


def test_the_whole_run_is_its_stages(spark):
    """What each stage drops stays away, what it changes stays changed, and the pieces are those of the texts."""
    docs = table(spark, SMALL, "documents")
    for name, stage in cp.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), before.schema)
    want = collections.Counter((r.doc_id, r.text) for r in docs.collect())
    assert 0 < len(want) < table(spark, SMALL, "documents").count()
    assert collections.Counter(map(tuple, pieces.decode(cp.run(spark, SMALL).select("doc_id", "ids")).collect())) == want
    assert docs.where(F.col("text").rlike("[A-Za-z0-9]@[A-Za-z0-9-]+[.][a-z]")).count() == 0
