"""A corpus pipeline over documents: quality, near duplicates, personal data, mixing, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet and reads it again as the next
one's docs. All but the last return the columns of documents. Rows that share a doc_id but not their text are documents of their
own, and those without a doc_id are treated like any other. Null texts count as empty
throughout.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import mixing, overlap, pieces, pii, quality, simhash
from driftline.llm.common import keep, own_text, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As drop_near_copies, by op3_simhash's contract (four words, four bits); the pipeline does not use it."""
    return _one_of_each(docs, simhash.near_duplicates)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 of the five-word shingles or more) the document with the smallest doc_id stays, or, if
    none has a doc_id or two share it, that with the smallest hash."""
    return _one_of_each(docs, overlap.near_copies)


def _one_of_each(docs: DataFrame, grouped: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """grouped gives doc_id and component_id of each row; it is asked about rows by a key of their id and text."""
    rows = docs.withColumn("__key", F.xxhash64(F.col("doc_id"), own_text()))
    found = grouped(rows.select(F.col("__key").alias("doc_id"), "text")).select(F.col("doc_id").alias("__key"), "component_id").distinct()
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__key")
    ids = rows.groupBy("__key").agg(F.min("doc_id").alias("doc_id"))
    first = found.join(ids, "__key").groupBy("component_id").agg(F.min(order).alias("f")).select("f.__key")
    # rows of one id and text may differ in other columns: the least of them stays
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = rows.join(first, "__key", "left_semi").groupBy("__key").agg(F.min(F.struct(*others, "doc_id", "text")).alias("one"))
    return one.select("one.*").select(docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data becomes its kind in brackets; n_chars follows the text."""
    found = pii.with_candidates(docs, "__candidates")
    spans = pii.with_spans(found, pii.fit(found, "__candidates"), "__candidates", "__spans")
    masked = spans.withColumn("text", F.when(F.col("text").isNotNull(), pii.mask(own_text(), F.col("__spans")))).drop("__spans")
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row appears as often as the mix takes it, whatever its doc_id. Rows are told apart by two hashes of all their
    columns; of rows that are equal in all of them one stands for all, as often as they are taken together."""
    key = ["__key", "__key2"]
    rows = docs.withColumns({"__key": F.xxhash64(*docs.columns), "__key2": F.xxhash64(F.lit(1), *docs.columns)})
    taken = keep(mixing.mix(rows, carry=tuple(key)).groupBy(*key).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows")).where("__copies > 0"), "taken")
    single = rows.join(taken.where("__rows = 1"), key)
    repeated = taken.where("__rows > 1")
    several = rows.join(repeated.select(*key), key, "left_semi").dropDuplicates(key).join(repeated, key)
    both = single.select(*docs.columns, "__copies").unionAll(several.select(*docs.columns, "__copies"))
    return both.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(docs.columns)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (sampled pieces, seeded by doc_id), n_pieces."""
    return pieces.encode(docs).withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("pieces", to_pieces),
]

#: Trained models, sampling and iterations are not SQL; tests/llm/test_pipeline.py compares with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
