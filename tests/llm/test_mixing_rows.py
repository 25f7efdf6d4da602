"""Mixing by row: what is carried tells rows apart that share everything else."""

import random

from pyspark.sql import functions as F

from driftline.llm import mixing


def test_carried_columns_and_reruns(spark):
    rng = random.Random(5)
    rows = [(None if i % 3 else i, "w " * rng.randrange(1, 40), rng.choice("ab"), i) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row long")
    plain = mixing.mix(df.drop("row"))
    got = mixing.mix(df, carry=("row",))
    first = {r.row: r.copies for r in got.collect()}
    assert len(first) == 400 and set(got.columns) == {*plain.columns, "row"}
    assert {r.row: r.copies for r in mixing.mix(df.repartition(7).orderBy(F.rand(3)), carry=("row",)).collect()} == first
    for r in got.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 0.01 * r.target
