"""Models registered at run time: a log of versions of which the one in force at an event's time counts, in batch and in streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators.asof import asof

#: A rule takes the columns of an event and of its model, and gives one column.
Rule = Callable[[], Column]

MODEL = "model string, since timestamp, rule string, capacity_kwh double, consumption_wh_km double"


def registered(log: DataFrame, entries: DataFrame) -> DataFrame:
    """The log of models (MODEL) with entries added: names are trimmed and in upper case, and a later entry of the same name and
    time replaces an earlier one. Nothing is ever taken back: a model changes by another version."""
    put = lambda rows, turn: rows.withColumn("model", F.upper(F.trim("model"))).withColumn("__turn", F.lit(turn))
    both = put(log, 0).unionByName(put(entries, 1)).where("model is not null and since is not null")
    rest = [c for c in log.columns if c not in ("model", "since")]
    return both.groupBy("model", "since").agg(F.max_by(F.struct(*rest), F.struct("__turn", *rest)).alias("m")).select("model", "since", "m.*").select(log.columns)


def with_models(events: DataFrame, log: DataFrame, rules: dict[str, Rule], at: str = "at", otherwise: Rule = lambda: F.lit(None).cast("double")) -> DataFrame:
    """events (model, at) with the model in force (m_since, m_rule, m_capacity_kwh, m_consumption_wh_km) and `estimate` by its rule.

    The rule is chosen row by row, by name, from `rules`; models of unknown rules and events without a model (unknown, or registered
    later) get `otherwise`. Names are matched trimmed and in upper case.
    """
    named = events.withColumn("__model", F.upper(F.trim("model")))
    found = asof(named, log.withColumnRenamed("model", "__model"), "__model", at, "since", ["rule", "capacity_kwh", "consumption_wh_km"], bucket=86_400)
    for c in ("since", "rule", "capacity_kwh", "consumption_wh_km"):
        found = found.withColumnRenamed(f"s_{c}", f"m_{c}")
    chosen = F.coalesce(*[F.when(F.col("m_rule") == name, rule()) for name, rule in rules.items()], otherwise())
    return found.drop("__model").withColumn("estimate", chosen)


def range_km(soc: str = "soc_pct") -> Rule:
    """How far the charge reaches, by the model's capacity and consumption."""
    return lambda: F.try_divide(F.col("m_capacity_kwh") * F.col(soc) * 10, F.col("m_consumption_wh_km"))


def energy_kwh(soc: str = "soc_pct") -> Rule:
    return lambda: F.col("m_capacity_kwh") * F.col(soc) / 100


def stream_with_models(events: DataFrame, log_path: str, into: str, checkpoint: str, rules: dict[str, Rule]) -> None:
    """Runs a finite stream of events (model, at) to its end, each micro-batch with the models that the Parquet log at log_path
    holds when it begins: a model registered between two of them counts for the second only. A batch that is run again
    replaces what it wrote before."""

    def one(batch: DataFrame, number: int) -> None:
        log = batch.sparkSession.read.schema(MODEL).parquet(log_path)
        with_models(batch, log, rules).write.mode("overwrite").parquet(f"{into}/batch={number}")

    events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def register(spark: SparkSession, log_path: str, entries: DataFrame) -> None:
    """Appends entries (MODEL) to the log; registered() or the as-of join settles what counts."""
    entries.select(*[c.split()[0] for c in MODEL.split(", ")]).withColumn("model", F.upper(F.trim("model"))).write.mode("append").parquet(log_path)
