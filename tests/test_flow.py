"""Sinks, generators, replays and the trace's state on drawn cases."""

import hashlib
import json
import pathlib

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions import expr
from driftline.operators import checks
from driftline.plans.catalog import QUERIES
from driftline.sources import readers, sinks
from driftline.streaming import trace

SMALL = "/root/testdata/sf0.001"


def test_checked_sink_splits_and_counts(spark, tmp_path):
    df = spark.createDataFrame([(1, 5.0), (2, -1.0), (None, -2.0)], "id int, v double")
    sinks.write_checked(df, expr.violations({"NO_ID": F.col("id").isNull(), "LOW": F.col("v") < 0}), str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "out" / "rows")).collect()] == [(1, 5.0)]
    rejected = spark.read.option("header", True).csv(str(tmp_path / "out" / "rejected"))
    assert sorted(r.reasons for r in rejected.collect()) == ["LOW", "NO_ID;LOW"]
    profile = {r["reason"]: r["n"] for f in (tmp_path / "out" / "profile").glob("*.json") for r in map(json.loads, f.read_text().splitlines())}
    assert profile == {"ACCEPTED": 1, "NO_ID": 1, "LOW": 2}


def test_sealed_file_shows_tampering(spark, tmp_path):
    sealed = sinks.seal(spark.createDataFrame([(1, True)], "id int, p boolean").coalesce(1), str(tmp_path / "p")).collect()
    part = next(pathlib.Path(tmp_path / "p").glob("part-*"))
    assert [r.sha256 for r in sealed] == [hashlib.sha256(part.read_bytes()).hexdigest()]
    assert readers.json_lines_verified(spark, str(part), sealed[0].sha256, "id int, p boolean").count() == 1
    with pytest.raises(ValueError):
        readers.json_lines_verified(spark, str(part), "0" * 64, "id int, p boolean")


def test_file_digests_equal_hashlib(spark):
    got = {r.table: r.sha256 for r in QUERIES["q7_file_digests"](spark, SMALL).collect()}
    assert got == {n: hashlib.sha256(pathlib.Path(f"{SMALL}/{n}.parquet").read_bytes()).hexdigest() for n in (p.stem for p in pathlib.Path(SMALL).glob("*.parquet"))}


def test_walks_stay_in_bounds_and_repeat(spark):
    ids = spark.range(20).withColumnRenamed("id", "entity_id")
    one, two = (sinks.walks(ids.repartition(n), 50, 2, 6).toPandas().sort_values(["entity_id", "tick"]).reset_index(drop=True) for n in (1, 5))
    pd.testing.assert_frame_equal(one, two)
    assert len(one) == 1000 and one.state.between(2, 6).all() and one.state.nunique() == 5
    assert one.groupby("entity_id").state.diff().dropna().abs().max() == 1
    assert sinks.walks(ids.limit(0), 5, 0, 1).count() == 0


def test_learned_model_beats_the_rule(spark):
    got = {r.model: r.accuracy for r in QUERIES["u7_learned_demand"](spark, SMALL).collect()}
    assert got["learned"] >= got["rule"]


def test_trace_conflicts_and_generations(spark, tmp_path):
    schema = T.StructType.fromDDL("user_id long, event_id long, ts_s double, x double")
    rows = [(1, 1, 0.0, 0.0), (1, 1, 0.0, 0.0), (1, 1, 0.0, 7.0), (1, 2, 100.0, 1.0), (1, 3, 300.0, 2.0), (2, 1, 5.0, 7.0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    n = trace.replay(trace.trace(trace.event_stream(spark, str(tmp_path / "in"), schema)), str(tmp_path / "out"), str(tmp_path / "c"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert n == 6 and [(r.event_id, r.status, r.generation) for r in got if r.user_id == 1] == [(1, "WARM_UP", 0), (1, "DUPLICATE", 0), (1, "CONFLICT", 0), (2, "WARM_UP", 1), (3, "WARM_UP", 2)]


def test_trace_by_arrival_and_forgotten_ids(spark, tmp_path):
    schema = T.StructType.fromDDL("user_id long, event_id long, ts_s double, x double, arrival long")
    rows = [(1, 1, 0.0, 0.0, 0), (1, 2, 30.0, 0.0, 1), (1, 1, 60.0, 0.0, 2), (1, 9, 5000.0, 1.0, 3), (1, 1, 5001.0, 1.0, 4), (1, 9, 5000.0, 1.0, 5), (1, 2, 30.0, 0.0, 6), (2, 1, None, 0.0, 0)]
    spark.createDataFrame(rows[::-1], schema).where("ts_s is not null").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    trace.replay(trace.trace(stream, arrival="arrival"), str(tmp_path / "out"), str(tmp_path / "c"))
    got = sorted((r.ts_s, r.event_id, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0.0, 1, "WARM_UP"), (30.0, 2, "STALE"), (30.0, 2, "WARM_UP"), (60.0, 1, "CONFLICT"), (5000.0, 9, "DUPLICATE"), (5000.0, 9, "WARM_UP"), (5001.0, 1, "WARM_UP")]


def test_checks_count_rows_of_hot_and_null_keys(spark):
    a = spark.createDataFrame([(1,), (1,), (7,), (7,), (None,)], "k int")
    b = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert [tuple(r) for r in checks.foreign("f", a, "k", b, "k").collect()] == [("f", 5, 2)]
    assert [tuple(r) for r in checks.foreign("f", a.limit(0), "k", b, "k").collect()] == [("f", 0, 0)]
    got = {r.rule: (r.checked, r.failed) for r in checks.rules(a, {"low": F.col("k") > 5, "never": F.lit(False)}).collect()}
    assert got == {"low": (5, 3), "never": (5, 0)} and {(r.checked, r.failed) for r in checks.rules(a.limit(0), {"x": F.lit(True)}).collect()} == {(0, 0)}


def test_coverage_of_every_route(spark):
    from driftline.operators import roads
    from driftline.plans.flow_queries import vertices

    k = [r.s_suppkey for r in spark.read.parquet(f"{SMALL}/supplier.parquet").collect()]
    places = [(3.3 + i * 37 % 970, 3.7 + i * 53 % 890) for i in k]
    want = {}
    for r in roads.resampled(vertices(spark, SMALL), "route", "k", 25.0).collect():
        n, hit = want.get(r.route, (0, 0))
        want[r.route] = (n + 1, hit + any((x - r.x) ** 2 + (y - r.y) ** 2 <= 1600.0 for x, y in places))
    assert {r.route: (r.points, r.covered) for r in QUERIES["j16_all_routes"](spark, SMALL).collect()} == want
    assert {i % 20 for i in want} == set(range(20))
