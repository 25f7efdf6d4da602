"""Which places can be among the first for a request, of all places of its area, without making the pairs as rows.

Requests and places of an area meet in blocks; a block's distances are one matrix at a time. What is found is never too little: rules,
rounding and ties are applied afterwards, by the expressions that say them, to those pairs alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.functions.geo import MEAN_RADIUS

#: Requests of a block, and cells of a matrix.
BLOCK, CELLS = 4096, 1_000_000

#: Distances and costs are rounded to thousandths by the rules: that much, and a little more, is left to them.
SLACK = 0.01

#: km added to a distance that must be within a request's range (energy.feasible).
MARGIN_KM = 0.5


def _distances(asks: dict, places: dict) -> np.ndarray:
    la, lo, sa, so = (np.radians(c) for c in (asks["lat"][:, None], asks["lon"][:, None], places["s_lat"][None], places["s_lon"][None]))
    h = np.sin((sa - la) / 2) ** 2 + np.cos(la) * np.cos(sa) * np.sin((so - lo) / 2) ** 2
    return 2 * MEAN_RADIUS * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def _least(cost: np.ndarray, n: int) -> np.ndarray:
    """The n-th least of each row, infinity if there are fewer."""
    return np.full(len(cost), np.inf) if cost.shape[1] < n else np.partition(cost, n - 1, axis=1)[:, n - 1]


def _chosen(asks: dict, places: dict, n: int, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(row of asks, row of places) that may be among the n first: cost is rate * distance + fixed + share * the row's least
    rate * distance + fixed (1 at least)."""
    metres = _distances(asks, places)
    limit = asks["range_km"][:, None] * 1000 - MARGIN_KM * 1000
    sure, maybe = metres <= limit - SLACK, metres <= limit + SLACK
    base = rate * metres + places["fixed"][None]
    most, least = (np.maximum(1.0, _least(np.where(seen, base, np.inf), 1))[:, None] for seen in (sure, maybe))
    bound, share, cost = np.where(sure, base, np.inf), places["share"][None], base
    if share.any():
        bound = bound + share * np.where(np.isfinite(most), most, 0.0)
        cost = base + share * np.where(np.isfinite(least), least, 0.0)
    return np.nonzero(maybe & ((cost <= _least(bound, n)[:, None] + SLACK) | (base <= most + SLACK)))


def likely(asks: DataFrame, places: DataFrame, n: int, rate: float) -> DataFrame:
    """(request_id, service, station_id), each once: a superset of the n candidates of least cost of each request, all ties with the
    last among them, and that of least rate * distance + fixed.

    asks: request_id, area, service, lat, lon, range_km; places: station_id, area, service, s_lat, s_lon, fixed, share. The cost is rate *
    distance + fixed + share * the least of rate * distance + fixed over the request's candidates, 1 at least. Candidates are places of
    the request's area and a service that it asks for, within its range. A block holds its places whole: memory grows with the places of an
    area, not with the pairs.
    """
    sizes = asks.groupBy("area").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    # one row a request, so that the least is taken over all services
    one = asks.groupBy("request_id", "area", "lat", "lon", "range_km").agg(F.array_join(F.sort_array(F.collect_set("service")), ";").alias("services"))
    left = one.where("range_km > 0 and range_km <> double('infinity')").join(sizes, "area").withColumn("part", F.pmod(F.xxhash64("request_id"), F.col("parts")).cast("int")).drop("parts")
    right = places.join(sizes, "area").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    empty = {"request_id": "long", "service": "string", "station_id": "long"}
    schema = pa.schema([("request_id", pa.int64()), ("service", pa.string()), ("station_id", pa.int64())])

    def block(a: pa.Table, p: pa.Table) -> pa.Table:
        found = []
        for services in sorted(set(a["services"].to_pylist())):
            mine, at = ({c: x.to_numpy(zero_copy_only=False) for c, x in zip(t.column_names, t.columns, strict=True)} for t in (a, p))
            mine = {c: x[mine["services"] == services] for c, x in mine.items()}
            at = {c: x[np.isin(at["service"].astype(str), services.split(";"))] for c, x in at.items()}
            places, step = len(at["service"]), max(1, CELLS // max(1, len(at["service"])))
            for i in range(0, len(mine["services"]) if places else 0, step):
                part = {c: x[i : i + step] for c, x in mine.items()}
                r, s = _chosen(part, at, n, rate)
                found.append(pa.table([pa.array(part["request_id"][r], pa.int64()), pa.array(at["service"][s], pa.string()), pa.array(at["station_id"][s], pa.int64())], schema=schema))
        return pa.concat_tables(found) if found else schema.empty_table()

    return left.groupBy("area", "part").cogroup(right.groupBy("area", "part")).applyInArrow(block, ", ".join(f"{k} {v}" for k, v in empty.items()))


def in_range(asks: DataFrame, places: DataFrame) -> DataFrame:
    """request_id, service, kind, near, total: how many places of each kind, of the area and service of a request, are within its range, and
    how many there are. Kinds that no place has in the area have no row.

    asks as for likely, each request and service once; places: area, service, s_lat, s_lon, kind, ranged (false: all of them count as near).
    """
    sizes = asks.groupBy("area").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    left = asks.join(sizes, "area").withColumn("part", F.pmod(F.xxhash64("request_id"), F.col("parts")).cast("int")).drop("parts")
    right = places.join(sizes, "area").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    schema = pa.schema([("request_id", pa.int64()), ("service", pa.string()), ("kind", pa.string()), ("near", pa.int64()), ("total", pa.int64())])

    def block(a: pa.Table, p: pa.Table) -> pa.Table:
        mine, at = ({c: x.to_numpy(zero_copy_only=False) for c, x in zip(t.column_names, t.columns, strict=True)} for t in (a, p))
        found = []
        for service in sorted(set(mine["service"])):
            own, these = ({c: x[t["service"] == service] for c, x in t.items()} for t in (mine, at))
            for kind in sorted(set(these["kind"])):
                of = {c: x[these["kind"] == kind] for c, x in these.items()}
                near = _near(own, of) if of["ranged"][0] else np.full(len(own["lat"]), len(of["kind"]))
                n = len(near)
                found.append(pa.table([pa.array(own["request_id"], pa.int64()), pa.array([service] * n, pa.string()), pa.array([kind] * n, pa.string()), pa.array(near, pa.int64()), pa.array([len(of["kind"])] * n, pa.int64())], schema=schema))
        return pa.concat_tables(found) if found else schema.empty_table()

    return left.groupBy("area", "part").cogroup(right.groupBy("area", "part")).applyInArrow(block, "request_id long, service string, kind string, near long, total long")


def _near(asks: dict, places: dict) -> np.ndarray:
    """How many places each request reaches, by the rule of energy.feasible over metres rounded to thousandths."""
    reach = np.where(np.isfinite(asks["range_km"]) & (asks["range_km"] > 0), asks["range_km"], -1.0)
    # along the meridian and then along the parallel is no shorter than the way there
    span = lambda at, to: np.radians(np.maximum(np.abs(places[to].max() - asks[at]), np.abs(asks[at] - places[to].min())))
    farthest = MEAN_RADIUS * (span("lat", "s_lat") + span("lon", "s_lon"))
    near = np.where((farthest + 1) / 1000 + MARGIN_KM <= reach, len(places["s_lat"]), 0).astype("int64")
    open_ = np.nonzero((near == 0) & (reach >= MARGIN_KM))[0]
    step = max(1, CELLS // len(places["s_lat"]))
    for i in range(0, len(open_), step):
        rows = open_[i : i + step]
        metres = np.floor(_distances({c: asks[c][rows] for c in ("lat", "lon")}, places) * 1000 + 0.5) / 1000
        near[rows] = (metres / 1000 + MARGIN_KM <= reach[rows][:, None]).sum(axis=1)
    return near
