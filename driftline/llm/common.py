"""What the operators share: reading tables, tables kept in the shared folder, words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The whole input as bytes.split() cuts it: space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where none is set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/driftline/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str, by: str | None = None, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, and a lost executor costs nothing."""
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", codec)
    (writer.partitionBy(by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def own_text() -> F.Column:
    return F.coalesce(F.col("text"), F.lit(""))


#: Elements of an array that are run through one after the other.
CHUNK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(values: Column, step: Callable[[Column, Column], Column], kind: str = "int") -> Column:
    """Running results of an associative step over an array: within chunks, then over the chunks, so that no long array is
    copied for each element."""
    none = F.array().cast(f"array<{kind}>")
    along = lambda xs: F.aggregate(xs, none, lambda acc, x: F.concat(acc, F.array(F.coalesce(step(F.try_element_at(acc, F.lit(-1)), x), x))))

    def joined(parts: Column) -> Column:
        carried = along(F.transform(parts, lambda p: F.try_element_at(p, F.lit(-1))))
        earlier = F.concat(F.array(F.lit(None).cast(kind)), F.slice(carried, F.lit(1), F.greatest(F.size(carried) - 1, F.lit(0))))
        return F.flatten(F.zip_with(parts, earlier, lambda p, c: F.transform(p, lambda x: F.coalesce(step(c, x), x))))

    def chunked(xs: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(1)), F.lit(CHUNK))
        return let(F.transform(starts, lambda i: along(F.slice(xs, i, CHUNK))), joined)

    return let(values, chunked)


#: A key is hot that has more than this part of all rows, and at least so many of them.
HOT_PART, HOT_ROWS = 10_000, 100_000


def looked_up(rows: DataFrame, key: str, found: DataFrame, value: str, hot_rows: int | None = None) -> DataFrame:
    """rows with `value` of `found` (key, value, n: how many rows have the key), null where there is none. Hot keys are
    looked up in a broadcast of fewer than HOT_PART rows, so that no task gets all rows of one key; where no key can be
    hot the rest is the whole."""
    hot_rows = HOT_ROWS if hot_rows is None else hot_rows
    total = found.agg(F.sum("n")).first()[0] or 0
    if total <= hot_rows:
        return rows.join(found.select(F.col(key).alias("__key"), value), F.col(key) == F.col("__key"), "left").drop("__key")
    hot = F.col("n") > max(hot_rows, total // HOT_PART)
    often = found.where(hot).select(F.col(key).alias("__often"), F.col(value).alias("__value"))
    first = rows.join(F.broadcast(often), F.col(key) == F.col("__often"), "left")
    rest = found.where(~hot).select(F.col(key).alias("__key"), value)
    # a key that is looked up already takes part in the second join as null
    out = first.withColumn("__rest", F.when(F.col("__often").isNull(), F.col(key))).join(rest, F.col("__rest") == F.col("__key"), "left")
    return out.withColumn(value, F.coalesce("__value", value)).drop("__often", "__value", "__rest", "__key")
