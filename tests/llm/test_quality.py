"""The compiled rule ensemble against a plain evaluation of its rules."""

import math

import numpy as np
from pyspark.sql import functions as F

from driftline.llm import quality
from driftline.llm.common import keep, table

SMALL = "/root/testdata/sf0.001"


def holds(rule, values):
    return all((values[name] <= bound) if at_most else (values[name] > bound) for name, at_most, bound in rule)


def test_compiled_score_is_the_fitted_model(spark):
    """Score and marks equal plain loops; the kept weights are those of a lasso: each one's mean gradient is its penalty."""
    rows = keep(quality.with_statistics(table(spark, SMALL, "documents")), "statistics")
    labels = table(spark, SMALL, "labels").where("quality is not null").select("doc_id", F.col("quality").cast("int").alias("label"))
    learned = rows.join(labels, "doc_id")
    model = quality.fit(learned)
    assert model.rules and all(w for _, w in model.rules) and all(1 <= len(r) <= 2 * quality.DEPTH for r, _ in model.rules)
    marks = [quality.condition(r).cast("int").alias(f"m{i}") for i, (r, _) in enumerate(model.rules)]
    got = learned.select("*", model.score().alias("score"), *marks).collect()
    for r in got:
        plain = [holds(rule, r) for rule, _ in model.rules]
        assert plain == [bool(r[f"m{i}"]) for i in range(len(plain))]
        total = model.bias + sum(w for (_, w), hit in zip(model.rules, plain, strict=True) if hit)
        assert math.isclose(r.score, 1 / (1 + math.exp(-total)), rel_tol=1e-9)
    off = np.array([r.score - r.label for r in got])
    hits = np.array([[r[f"m{i}"] for i in range(len(marks))] for r in got], float)
    slope = (off[:, None] * hits).mean(axis=0)
    penalty = quality.LASSO * np.sign([w for _, w in model.rules])
    assert abs(off.mean()) < 1e-4 and np.abs(slope + penalty).max() < quality.LASSO / 4


def test_scores_under_a_prefix_and_bounds_of_both_sides(spark):
    rule = (("entropy", False, 1.0), ("entropy", True, 2.0), ("log_words", True, 0.5))
    model = quality.RuleEnsemble(-1.0, ((rule, 2.0), ((("entropy", False, 2.0),), 0.5)))
    df = spark.createDataFrame([(1.0, 0.0), (1.5, 0.5), (2.0, 0.6), (2.5, 0.0)], "entropy double, log_words double")
    got = [r[0] for r in df.select(F.struct("*").alias("s")).select(model.score("s.")).collect()]
    assert np.allclose(got, [1 / (1 + math.exp(-x)) for x in (-1.0, 1.0, -1.0, -0.5)])
