"""Encoded polylines as expressions: each number is the characters up to the first without a continuation bit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed bounds of a line: bytes, vertices, characters of one number.
MOST_BYTES, MOST_POINTS, MOST_DIGITS = 100_000, 20_000, 12

_MORE, _LAST = r"[\x5F-\x7E]", r"[\x3F-\x5E]"


def encoded(values: Column) -> Column:
    """The text of an array of whole numbers (already differences)."""
    def one(v: Column) -> Column:
        z = F.when(v < 0, -2 * v - 1).otherwise(2 * v)
        digit = lambda i: F.when((z >= 32**i) if i else F.lit(True), F.chr(63 + F.shiftright(z, 5 * i).bitwiseAND(31) + F.when(F.shiftright(z, 5 * (i + 1)) > 0, 32).otherwise(0)))
        return F.concat_ws("", *[digit(i) for i in range(7)])

    return F.array_join(F.transform(values, lambda v: one(v.cast("long"))), "")


def encode(points: DataFrame, key: str, order: str) -> DataFrame:
    """key, line of points (key, order, lat, lon), at five decimals."""
    w = W.partitionBy(key).orderBy(order)
    whole = [F.bround(F.col(c) * 100_000).cast("long") for c in ("lat", "lon")]
    steps = points.select(key, order, *[(x - F.coalesce(F.lag(x).over(w), F.lit(0))).alias(n) for x, n in zip(whole, ("a", "o"), strict=True)])
    whole_line = steps.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "a", "o"))).alias("s"))
    return whole_line.select(key, encoded(F.flatten(F.transform("s", lambda p: F.array(p["a"], p["o"])))).alias("line"))


def numbers(line: Column) -> Column:
    """The whole numbers of a sound text."""
    def one(text: Column) -> Column:
        codes = F.transform(F.split(text, ""), lambda c: F.when(c != "", (F.ascii(c) - 63).bitwiseAND(31).cast("long")))
        z = F.aggregate(F.reverse(F.array_compact(codes)), F.lit(0).cast("long"), lambda acc, d: acc * 32 + d)
        return F.when(z % 2 == 1, -F.shiftright(z + 1, 1)).otherwise(F.shiftright(z, 1))

    return F.transform(F.regexp_extract_all(line, F.lit(f"{_MORE}*{_LAST}"), F.lit(0)), one)


def fault(line: Column) -> Column:
    """Why a text cannot be read, the first that holds: MISSING, TOO_LONG, BAD_CHARACTER, NUMBER_TOO_LONG, CUT_OFF (within a number, or
    between a latitude and its longitude), TOO_MANY_POINTS; else null. Ranges and two points at least are seen by decode()."""
    count = F.size(F.regexp_extract_all(line, F.lit(_LAST), F.lit(0)))
    return (
        F.when(line.isNull(), "MISSING").when(F.octet_length(line) > MOST_BYTES, "TOO_LONG").when(line.rlike(r"[^\x3F-\x7E]"), "BAD_CHARACTER").when(line.rlike(f"{_MORE}{{{MOST_DIGITS},}}"), "NUMBER_TOO_LONG")
        .when(line.rlike(f"{_MORE}$") | (count % 2 == 1), "CUT_OFF").when(count > 2 * MOST_POINTS, "TOO_MANY_POINTS")
    )


def decode(lines: DataFrame, key: str, line: str = "line") -> tuple[DataFrame, DataFrame]:
    """(points, faults) of lines (key, line; keys each once). points: key, k from 0, lat, lon of the sound ones; faults: key, reason of all others,
    OUT_OF_RANGE and TOO_FEW_POINTS (under two) besides those of fault(). A line is either whole in points or in faults."""
    rows = lines.select(key, line, fault(F.col(line)).alias("reason"))
    steps = rows.where("reason is null").select(key, F.posexplode(numbers(F.col(line))).alias("at", "step"))
    pairs = steps.groupBy(key, F.floor(F.col("at") / 2).alias("k")).agg(F.max(F.when(F.col("at") % 2 == 0, F.col("step"))).alias("a"), F.max(F.when(F.col("at") % 2 == 1, F.col("step"))).alias("o"))
    w = W.partitionBy(key).orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    places = pairs.select(key, "k", F.sum("a").over(w).alias("a"), F.sum("o").over(w).alias("o"))
    own = W.partitionBy(key)
    wide = (F.abs("a") > 9_000_000) | (F.abs("o") > 18_000_000)
    places = places.withColumns({"wide": F.max(wide).over(own), "n": F.count("*").over(own)})
    points = places.where(~F.col("wide") & (F.col("n") >= 2)).select(key, "k", (F.col("a") / 1e5).alias("lat"), (F.col("o") / 1e5).alias("lon"))
    bad = places.where("k = 0 and (wide or n < 2)").select(key, F.when(F.col("wide"), "OUT_OF_RANGE").otherwise("TOO_FEW_POINTS").alias("reason"))
    empty = rows.where(F.col(line) == "").select(key, F.lit("TOO_FEW_POINTS").alias("reason"))
    return points, rows.where("reason is not null").select(key, "reason").unionAll(bad).unionAll(empty)
