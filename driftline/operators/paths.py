"""Shortest paths and components on large graphs, by rounds of relaxation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.session import written


def collapse(edges: DataFrame, a: str, b: str, cost: str) -> DataFrame:
    """Parallel edges become one with the least cost."""
    return edges.groupBy(a, b).agg(F.min(cost).alias(cost))


def bounded_distances(edges: DataFrame, sources: DataFrame, hops: int) -> DataFrame:
    """(source, node, cost): the least cost with at most so many edges (a, b, cost) from each source (column node).

    Each round relaxes only what the round before improved; rounds are written out, so a plan never grows.
    """
    best = sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("cost"))
    frontier = best
    for _ in range(hops):
        reached = frontier.join(edges.select(F.col("a").alias("node"), F.col("b").alias("to"), F.col("cost").alias("step")), "node")
        new = reached.groupBy("source", F.col("to").alias("node")).agg(F.min(F.col("cost") + F.col("step")).alias("new"))
        both = best.join(new, ["source", "node"], "full").select("source", "node", F.col("cost").alias("old"), F.least("cost", "new").alias("cost"))
        both = written(both, "paths")
        frontier = both.where("old is null or cost < old").select("source", "node", "cost")
        best = both.select("source", "node", "cost")
    return best


#: Tables of improvements that are read side by side before they are merged into one.
LOGS = 8


def distances(edges: DataFrame, sources: DataFrame, delta: float | None = None, bound: float | None = None, logs: int = LOGS) -> DataFrame:
    """(source, node, cost, also, edges): the least cost from each source (column node) to every node that it reaches, however many
    edges away; also: the second cost (distance and time, say) along that way, of equal ways the least, then the fewest edges.

    edges: a, b, cost, also; costs must not be negative. Delta-stepping: pairs wait in buckets of `delta` (default: twice the mean
    cost of an edge) by what they cost so far; only those of the lowest bucket are relaxed, until it is empty, so a pair
    is hardly relaxed before its cost is final. Each round writes the pairs it improved and those that wait, and merges the
    improvements of `logs` rounds; nothing but three numbers a round reaches the driver. With `bound` dearer ways are left out.
    """
    step = written(edges.where("a is not null and b is not null and cost is not null").groupBy("a", "b").agg(F.min(F.struct("cost", F.coalesce("also", F.lit(0.0)).alias("also"))).alias("e")).select(F.col("a").alias("node"), F.col("b").alias("to"), "e.cost", "e.also"), "edges")
    mean, least = step.agg(F.avg("cost"), F.min("cost")).first()
    if least is not None and least < 0:
        raise ValueError("costs must not be negative")
    delta = delta or 2 * (mean or 1.0) or 1.0
    way = F.struct("cost", "also", "edges").alias("way")
    start = sources.where("node is not null").select(F.col("node").alias("source"), "node").distinct().select("source", "node", F.struct(F.lit(0.0).alias("cost"), F.lit(0.0).alias("also"), F.lit(0).alias("edges")).alias("way"))
    waiting = written(start, "waiting")
    log = [waiting]
    known = lambda: reduce(DataFrame.unionAll, log).groupBy("source", "node").agg(F.min("way").alias("way"))
    while (lowest := waiting.agg(F.min("way.cost")).first()[0]) is not None:
        end = (lowest // delta + 1) * delta
        active = F.col("way.cost") < end
        via = waiting.where(active).join(step, "node").select("source", F.col("to").alias("node"), (F.col("way.cost") + F.col("cost")).alias("cost"), (F.col("way.also") + F.col("also")).alias("also"), (F.col("way.edges") + 1).alias("edges"))
        via = via if bound is None else via.where(F.col("cost") <= bound)
        found = via.groupBy("source", "node").agg(F.min(way).alias("way"))
        old = known().select(F.col("source").alias("s"), F.col("node").alias("n"), F.col("way").alias("old"))
        better = written(found.join(old, (F.col("source") == F.col("s")) & (F.col("node") == F.col("n")), "left").where(F.col("old").isNull() | (F.col("way") < F.col("old"))).select("source", "node", "way"), "better")
        waiting = written(waiting.where(~active).unionAll(better).groupBy("source", "node").agg(F.min("way").alias("way")), "waiting")
        log.append(better)
        if len(log) > logs:
            log = [written(known(), "known")]
    return known().select("source", "node", "way.*")


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, by alternating minimum labels and label jumps."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a"))).distinct()
    both = written(both, "edges")
    labels = written(both.select(F.col("u").alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        new = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        jump = new.select(F.col("node").alias("component"), F.col("component").alias("far"))
        new = written(new.join(jump, "component", "left").select("node", F.least("component", F.coalesce("far", "component")).alias("component"), "old"), "labels")
        if not new.where("component <> old").limit(1).count():
            return new.select("node", "component")
        labels = new.select("node", "component")
