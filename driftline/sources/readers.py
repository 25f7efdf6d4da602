"""Sources and sinks: strict CSV rows, snapshot logs of several kinds, lines put together again, WKT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

SNAPSHOT = T.StructType([T.StructField("kind", T.StringType()), T.StructField("entity_id", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("ts_ns", T.LongType()), T.StructField("source", T.StringType()), T.StructField("payload", T.StringType())])


def dimension(spark: SparkSession, path: str, schema: str, defaults: dict | None = None) -> DataFrame:
    """A CSV (or .csv.gz) with a header; columns of the schema that the file lacks are null, then the defaults."""
    df = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    want = T.StructType.fromDDL(schema)
    cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want]
    return df.select(*cols).fillna(defaults or {})


def snapshots(*parts: tuple[str, DataFrame, str, str]) -> DataFrame:
    """One tagged log from (kind, rows, entity column, time column); all other columns go to the JSON payload."""
    out = None
    for kind, df, entity, ts in parts:
        rest = [c for c in df.columns if c not in (entity, ts)]
        one = df.select(F.lit(kind).alias("kind"), F.col(entity).cast("string").alias("entity_id"), F.col(ts).cast("timestamp").alias("ts"), F.to_json(F.struct(*sorted(rest))).alias("payload"))
        out = one if out is None else out.unionByName(one)
    return out


def reassembled(lines: DataFrame, starts: Column, group: str = "file") -> DataFrame:
    """Logical rows from physical ones (file, line, value): a row begins where `starts` holds and takes the lines up to the
    next one, joined by a space. Lines before the first beginning are a row of their own."""
    w = W.partitionBy(group).orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    numbered = lines.withColumn("row", F.sum(F.when(starts, 1).otherwise(0)).over(w))
    parts = numbered.groupBy(group, "row").agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("p"))
    return parts.select(group, "row", F.array_join(F.transform("p", lambda x: F.trim(x["value"])), " ").alias("value"))


def wkt_points(line: Column) -> Column:
    """array<struct<lon, lat>> of a LINESTRING."""
    pairs = F.regexp_extract_all(line, F.lit(r"(-?[0-9.]+ -?[0-9.]+)"), F.lit(1))
    return F.transform(pairs, lambda p: F.struct(F.split(p, " ")[0].cast("double").alias("lon"), F.split(p, " ")[1].cast("double").alias("lat")))


def json_lines_verified(spark: SparkSession, path: str, sha256: str, schema: str) -> DataFrame:
    """JSON lines whose bytes have this digest; raises ValueError if a file differs."""
    found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).collect()
    if [r.h for r in found] != [sha256]:
        raise ValueError("the file is not the one that was sealed")
    return spark.read.schema(schema).json(path)
