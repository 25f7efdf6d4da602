"""Models that are registered while events come in."""

from datetime import datetime, timedelta

from driftline.operators import registry as R

RULES = {"range": R.range_km(), "energy": R.energy_kwh()}
T = lambda m: datetime(2026, 1, 1) + timedelta(minutes=m)


def test_versions_by_time_and_rule(spark):
    log = spark.createDataFrame([("VF 3", T(0), "range", 20.0, 100.0), ("VF 3", T(10), "energy", 30.0, 100.0), ("X", T(5), "none", 1.0, 1.0), ("ZERO", T(0), "range", 5.0, 0.0)], R.MODEL)
    log = R.registered(log, spark.createDataFrame([(" vf 3 ", T(10), "energy", 40.0, 90.0), ("new", T(3), "range", 10.0, 50.0), (None, T(1), "range", 1.0, 1.0)], R.MODEL))
    assert log.count() == 5
    events = [(1, "VF 3", T(0), 50.0), (2, " vf 3", T(9), 50.0), (3, "vf 3", T(10), 50.0), (4, "new", T(2), 50.0), (5, "NEW", T(3), 50.0), (6, "x", T(9), 50.0), (7, "?", T(9), 1.0), (8, None, T(9), 1.0), (9, "zero", T(9), 1.0), (10, "NEW", None, 1.0)]
    got = {r.id: (r.m_rule, r.estimate) for r in R.with_models(spark.createDataFrame(events, "id int, model string, at timestamp, soc_pct double"), log, RULES).collect()}
    assert got == {1: ("range", 100.0), 2: ("range", 100.0), 3: ("energy", 20.0), 4: (None, None), 5: ("range", 100.0), 6: ("none", None), 7: (None, None), 8: (None, None), 9: ("range", None), 10: (None, None)}


def test_a_model_registered_between_two_batches_counts_for_the_second(spark, tmp_path):
    log, into, events = str(tmp_path / "log"), str(tmp_path / "out"), str(tmp_path / "events")
    kind = "id int, model string, at timestamp, soc_pct double"
    R.register(spark, log, spark.createDataFrame([("old", T(0), "energy", 20.0, 100.0)], R.MODEL))
    for k in range(2):
        spark.createDataFrame([(2 * k, "late", T(5), 50.0), (2 * k + 1, "Old", T(5), 50.0)], kind).coalesce(1).write.mode("append").parquet(events)
        R.stream_with_models(spark.readStream.schema(kind).parquet(events), log, into, str(tmp_path / "c"), RULES)
        R.register(spark, log, spark.createDataFrame([(" late", T(1), "range", 10.0, 50.0)], R.MODEL))
    got = {r.id: r.estimate for r in spark.read.parquet(into).collect()}
    assert got == {0: None, 1: 10.0, 2: 100.0, 3: 10.0}
