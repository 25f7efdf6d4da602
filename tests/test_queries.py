"""Every query with SQL against DuckDB, and the operators without SQL on drawn cases."""

import itertools
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.operators import asof, energy, spatial, trajectory
from driftline.plans.catalog import QUERIES, SQL, flagship
from driftline.streaming import trace

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for f in os.listdir(SMALL):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SMALL}/{f}'")
    return con


def rows_of(df):
    df = df[sorted(df.columns)]
    one = lambda v: None if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v else round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)
    return sorted([tuple(map(one, r)) for r in df.itertuples(index=False)], key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_flagship_is_a_permutation_free_ranking(spark):
    assert flagship(spark, SMALL).count() > 0


def test_asof_boundaries(spark):
    at = lambda s: pd.Timestamp(f"2026-01-01 00:00:{s}").to_pydatetime()
    states = spark.createDataFrame([("a", at("01"), 1.0), ("a", at("02"), 2.0), (None, at("01"), 9.0)], "k string, ts timestamp, v double")
    asks = spark.createDataFrame([(1, "a", at("00.999999")), (2, "a", at("01")), (3, "a", at("01.999999")), (4, "a", at("02")), (5, "b", at("02")), (6, None, at("02"))], "id int, k string, at timestamp")
    for bucket in (None, 1):
        got = {r.id: r.s_v for r in asof.asof(asks, states, "k", "at", "ts", ["v"], bucket).collect()}
        assert got == {1: None, 2: 1.0, 3: 1.0, 4: 2.0, 5: None, 6: None}


def test_asof_plan_has_no_nested_loop(spark):
    plan = QUERIES["j5_asof_latest"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "rangepartitioning" not in plan


def test_eligibility_order(spark):
    rows = [dict(zip("rcowsbkl", x, strict=True)) for x in itertools.product((True, False), repeat=8)]
    df = spark.createDataFrame(rows)
    v = energy.eligibility(F.col("r"), F.col("c"), F.when(F.col("o"), "OPEN").otherwise("OFFLINE"), F.lit("SWAP"), F.when(F.col("s"), 1).otherwise(0), F.when(F.col("b"), 1).otherwise(0), F.when(F.col("k"), 1).otherwise(0), F.when(F.col("w"), 10.0).otherwise(91.0), F.col("l"))
    for r in df.withColumn("v", v).collect():
        want = next((n for bad, n in ((not r.r, "UNREACHABLE"), (not r.c, "INCOMPATIBLE"), (not r.o, "OFFLINE"), (r.s and not r.b, "NO_SWAP_BATTERY"), (not r.k, "FULL"), (not r.w, "EXCESSIVE_QUEUE"), (not r.l, "INSUFFICIENT_SOC_TO_REACH")) if bad), "ELIGIBLE")
        assert r.v == want


def test_tile_join_needs_wide_tiles(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0)], "point_id int, lat double, lon double")
    with pytest.raises(ValueError):
        spatial.within(df, df.withColumnRenamed("point_id", "place_id"), 500.0, 11)


def test_ordered_overlap_equals_brute_force():
    for a in itertools.product("ab", repeat=4):
        for b in itertools.product("ab", repeat=3):
            wa, wb = [1.0, 2.5, 0.5, 3.0], [2.0, 1.0, 4.0]
            best = [[0.0] * 4 for _ in range(5)]
            for i in range(4):
                for j in range(3):
                    best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + min(wa[i], wb[j]) if a[i] == b[j] else 0.0)
            assert trajectory.ordered_overlap(list(a), wa, list(b), wb) == best[4][3]


def test_trace_stream(spark, tmp_path):
    rows = [(1, 1, 0.0, 0.0), (1, 2, 5.0, 20.0), (1, 2, 5.0, 20.0), (1, 3, 10.0, 60.0), (1, 4, 9.0, 61.0), (1, 5, 10.0, 61.0), (1, 6, 100.0, 70.0)]
    spark.createDataFrame(rows, "user_id long, event_id long, ts_s double, x double").coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = T.StructType.fromDDL("user_id long, event_id long, ts_s double, x double")
    q = trace.trace(trace.event_stream(spark, str(tmp_path / "in"), schema)).writeStream.format("memory").queryName("traced").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [(r.event_id, r.status) for r in spark.table("traced").collect()]
    assert got == [(1, "WARM_UP"), (2, "WARM_UP"), (2, "DUPLICATE"), (3, "MATCHED"), (4, "STALE"), (5, "WAITING"), (6, "WARM_UP")]


def test_window_stream_equals_batch(spark, tmp_path):
    schema = spark.read.parquet(f"{SMALL}/events.parquet").schema
    os.makedirs(tmp_path / "e")
    os.symlink(f"{SMALL}/events.parquet", tmp_path / "e" / "events.parquet")
    stream = trace.windowed(trace.event_stream(spark, str(tmp_path / "e"), schema))
    stream.writeStream.outputMode("complete").format("memory").queryName("win").option("checkpointLocation", str(tmp_path / "w")).trigger(availableNow=True).start().awaitTermination()
    batch = trace.windowed(spark.read.parquet(f"{SMALL}/events.parquet"))
    key = lambda df: sorted((r.start, r.event_type, r.n) for r in df.collect())
    assert key(spark.table("win")) == key(batch)
