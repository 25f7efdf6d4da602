"""Quality classifier: a sparse ensemble of rules.

Statistics of each whole text are gathered once. A random forest of shallow trees is grown over the labelled rows; every
path from a root to a node is a rule, a conjunction of bounds on statistics. A logistic regression with lasso penalty over
the rules keeps few of them. What is left is compiled into one Spark column expression, which scores all documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import keep, own_text, table

FOLDS, THRESHOLD = 5, 0.3
#: The fit takes labelled rows up to about this number, chosen by a hash of their id.
MOST_LABELS = 200_000
TREES, DEPTH, LASSO, SEED = 16, 4, 0.0005, 7

#: Classes of bytes whose shares are statistics.
CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".,;:?",
    "bang": b"!",
    "pipe": b"|",
    "symbol": b"#$%&*@~^_=+<>{}[]\\/`",
    "quote": b"\"'()-",
    "space": b" \t",
    "line": b"\n",
    "high": bytes(range(128, 256)),
}
STATS = (*(f"{k}_share" for k in CLASSES), "log_chars", "log_words", "word_length", "long_words", "short_words", "caps_words", "distinct_words", "top_word", "same_next", "repeated_4grams", "repeated_lines", "line_words", "symbol_ends", "stop_ends", "entropy")
_MASK = np.array([[b in v for v in CLASSES.values()] for b in range(256)], float)
_SYMBOLS = tuple(bytes([b]) for b in CLASSES["symbol"] + b"!|")
_STOPS = (b".", b",", b"?", b";", b":")


def statistics(text: str) -> list[float]:
    """STATS of a whole text; without words, shares are 0."""
    data = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    n = max(len(data), 1)
    p = counts[counts > 0] / n
    words = data.split()
    w = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    grams = max(len(words) - 3, 0)
    distinct = Counter(words)
    lines = [x for x in data.split(b"\n") if x]
    return [
        *(counts @ _MASK / n).tolist(),
        float(np.log1p(len(text))), float(np.log1p(len(words))), float(lengths.mean()) if words else 0.0,
        float((lengths > 12).sum() / w), float((lengths < 4).sum() / w), sum(map(bytes.isupper, words)) / w, len(distinct) / w,
        max(distinct.values(), default=0) / w, sum(map(eq, words, words[1:])) / w,
        1 - len(set(zip(words, words[1:], words[2:], words[3:], strict=False))) / grams if grams else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0, len(words) / max(len(lines), 1),
        sum(x.endswith(_SYMBOLS) for x in words) / w, sum(x.endswith(_STOPS) for x in words) / w, float(-(p * np.log2(p)).sum()) if len(p) else 0.0,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and STATS of every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([statistics(t) for t in b.column(1).to_pylist()], float).reshape(-1, len(STATS))
            yield pa.record_batch([b.column(0), *(pa.array(rows[:, i]) for i in range(len(STATS)))], names=["doc_id", *STATS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), own_text().alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{s} double" for s in STATS))


Rule = tuple[tuple[str, bool, float], ...]
"""Bounds that hold together: (statistic, at most?, value)."""


@dataclass(frozen=True)
class RuleEnsemble:
    """Rules with their weights. `score` is the compiled expression."""

    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, prefix: str = "") -> Column:
        """Over columns named as STATS, after a prefix."""
        total = F.lit(float(self.bias))
        for rule, weight in self.rules:
            total = total + F.when(condition(rule, prefix), float(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def condition(rule: Rule, prefix: str = "") -> Column:
    out = F.lit(True)
    for name, at_most, value in rule:
        out = out & ((F.col(prefix + name) <= value) if at_most else (F.col(prefix + name) > value))
    return out


def paths(node, so_far: Rule = ()) -> Iterator[Rule]:
    """Every node's path from the root, tightened: one bound for each statistic and side."""
    if so_far:
        yield so_far
    if node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        name, value = STATS[split.featureIndex()], float(split.threshold())
        for at_most, child in ((True, node.leftChild()), (False, node.rightChild())):
            rest = tuple(x for x in so_far if x[:2] != (name, at_most))  # a deeper bound on the same side is tighter
            yield from paths(child, tuple(sorted((*rest, (name, at_most, value)))))


def fit(labelled: DataFrame) -> RuleEnsemble:
    """labelled: STATS and label (0 or 1). With one class or no row at all the score is a constant near that class's share."""
    rows = keep(labelled.select(array_to_vector(F.array(*STATS)).alias("features"), F.col("label").cast("double").alias("label"), *STATS), "labelled")
    n = {int(r.label): r["count"] for r in rows.groupBy("label").count().collect()}
    if len(n) < 2:
        return RuleEnsemble(float(np.log((n.get(1, 0) + 1) / (n.get(0, 0) + 1))), ())
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird", minInstancesPerNode=max(1, sum(n.values()) // 500)).fit(rows)
    rules = sorted({rule for tree in forest.trees for rule in paths(tree._call_java("rootNode"))})
    if not rules:
        return RuleEnsemble(float(np.log((n[1] + 1) / (n[0] + 1))), ())
    marks = keep(rows.select(array_to_vector(F.array(*[condition(r).cast("double") for r in rules])).alias("features"), "label"), "rules")
    model = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(marks)
    return RuleEnsemble(float(model.intercept), tuple((r, float(w)) for r, w in zip(rules, model.coefficients.toArray(), strict=True) if w))


def held_out() -> Column:
    """Rows whose label is never learned. A null doc_id is not held out (and has no label)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))


def _learned(labels: DataFrame) -> DataFrame:
    """doc_id, label of the rows that are learned from, about MOST_LABELS at most."""
    marks = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where(~held_out())
    n = marks.count()
    return marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < MOST_LABELS) if n > MOST_LABELS else marks


@F.pandas_udf(T.StructType([T.StructField(s, T.DoubleType()) for s in STATS]))
def statistics_of(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([statistics(t) for t in texts], columns=list(STATS), dtype=float)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs (all their columns) whose score reaches the threshold. Repeated rows share their score; null texts
    are scored as empty ones. The labels' ids name documents of docs."""
    marks = _learned(labels).withColumnRenamed("doc_id", "__id")
    learned = docs.select(F.col("doc_id").cast("long").alias("__id"), own_text().alias("text")).join(F.broadcast(marks), "__id")  # about MOST_LABELS rows at most
    model = fit(learned.select(statistics_of("text").alias("s"), "label").select("s.*", "label"))
    scored = docs.withColumn("__stats", statistics_of(own_text()))
    return scored.where(model.score("__stats.") >= threshold).select(docs.columns)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text).

    Null texts count as empty and get the score of an empty text. Labels that are null or of unknown documents are not
    learned; repeated rows count as often as they occur. Other columns are left out. An empty table gives none.
    """
    stats = keep(with_statistics(docs), "statistics")
    model = fit(stats.join(_learned(labels), "doc_id"))
    scored = stats.select("doc_id", held_out().alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
