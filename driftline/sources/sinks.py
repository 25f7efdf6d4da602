"""Sinks: Parquet with rejected rows and a profile beside it, verified loads, sealed predictions, file digests, a generator."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_checked(df: DataFrame, reasons: Column, path: str) -> None:
    """Rows without a reason go to path/rows (Parquet, snappy), the others to path/rejected (CSV, reasons joined by ;), and
    counts by reason to path/profile (JSON). A row with several reasons counts for each of them."""
    marked = df.withColumn("reasons", F.coalesce(reasons, F.array().cast("array<string>")))
    marked.where(F.size("reasons") == 0).drop("reasons").write.option("compression", "snappy").parquet(f"{path}/rows")
    marked.where(F.size("reasons") > 0).withColumn("reasons", F.array_join("reasons", ";")).write.option("header", True).csv(f"{path}/rejected")
    named = F.when(F.size("reasons") == 0, F.array(F.lit("ACCEPTED"))).otherwise(F.col("reasons"))
    marked.select(F.explode(named).alias("reason")).groupBy("reason").agg(F.count("*").alias("n")).write.json(f"{path}/profile")


def write_verified(df: DataFrame, path: str) -> DataFrame:
    """Writes df and compares what is there with what was meant, repeats included; raises ValueError if they differ."""
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    if df.exceptAll(back).limit(1).count() or back.exceptAll(df).limit(1).count():
        raise ValueError("what was written is not what was meant")
    return back


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of every file. Large files are read in pieces through pyarrow.fs: local ones of more than WHOLE bytes, and all
    of 2 GB and more, which Spark does not read whole."""
    files = spark.read.format("binaryFile").load(path)
    pieces = (F.col("length") > WHOLE) & (F.col("path").startswith("file:") | (F.col("length") >= 2_147_483_647))
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    small = files.where(~pieces).select(name, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = files.where(pieces).select("path", name, F.col("length").alias("bytes"))
    if not large.limit(1).count():
        return small
    return small.unionByName(large.select("name", "bytes", F.pandas_udf(lambda paths: paths.map(_digest), "string")("path").alias("sha256")))


#: Bytes of a file that a task holds whole.
WHOLE = 1 << 26


def _digest(path: str) -> str:
    """sha256 of a file, a megabyte at a time."""
    local = path.startswith("file:")
    store, at = (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if local else fs.FileSystem.from_uri(path)
    found = hashlib.sha256()
    with store.open_input_stream(at) as f:
        while piece := f.read(1 << 20):
            found.update(piece)
    return found.hexdigest()


def seal(df: DataFrame, path: str) -> DataFrame:
    """Writes predictions as JSON lines and returns the digests that prove later that they were there before the labels."""
    df.write.json(path)
    return digests(df.sparkSession, path).where("name like 'part-%'")


def walks(entities: DataFrame, ticks: int, lowest: int, highest: int, seed: int = 7) -> DataFrame:
    """(entity_id, tick, state): a bounded random walk by steps of -1, 0, 1 for each entity, the same for the same seed."""

    def run(batches):
        for rows in batches:
            out = []
            for e in rows.entity_id:
                draws = pd.util.hash_array(pd.RangeIndex(ticks).to_numpy() + (int(e) * 1_000_003 + seed) * ticks) % 3
                state = lowest + (int(e) + seed) % (highest - lowest + 1)
                for tick, d in enumerate(draws.tolist()):
                    state = min(highest, max(lowest, state + d - 1))
                    out.append((e, tick, state))
            yield pd.DataFrame(out, columns=["entity_id", "tick", "state"])

    return entities.select(F.col("entity_id").cast("long")).mapInPandas(run, "entity_id long, tick long, state long")
