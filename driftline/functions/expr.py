"""Column functions: numbers, time, text, arrays, JSON."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def epoch(ts: Column) -> Column:
    """Seconds since 1970 as a double with microseconds; timestamps without a zone are taken as UTC."""
    return F.unix_micros(ts.cast("timestamp")) / 1_000_000.0


def floor_minutes(ts: Column, minutes: int) -> Column:
    """The start of the bucket of so many minutes."""
    step = minutes * 60
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts.cast("timestamp")) / step) * step)


def tokens(text: Column) -> Column:
    """`;` or `,` separated tokens, trimmed, without empty ones; null gives none."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), ",", ";"), ";")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


#: An ISO date and time with seconds and, if it is aware, Z or an offset.
ISO = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}):(\d{2}):(\d{2})(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})?$"


def floor_local(text: Column, minutes: int) -> Column:
    """An ISO text at the start of its bucket of so many minutes of an hour, by its own clock and with its own offset; null if
    it is none."""
    at = F.regexp_extract(text, ISO, 3).try_cast("int")
    floored = F.concat(F.regexp_extract(text, ISO, 1), F.lit("T"), F.regexp_extract(text, ISO, 2), F.lit(":"), F.lpad((at - at % minutes).cast("string"), 2, "0"), F.lit(":00"), F.regexp_extract(text, ISO, 6))
    return F.when(text.rlike(ISO), floored)


def aware(text: Column) -> Column:
    """The instant of an ISO text that says its offset; null for naive, malformed and impossible ones."""
    return F.when(text.rlike(ISO) & (F.regexp_extract(text, ISO, 6) != ""), F.try_to_timestamp(text))


def clock_seconds(text: Column) -> Column:
    """Seconds of MM:SS.f, null for others."""
    return F.when(text.rlike(r"^\d+:[0-5]?\d(\.\d+)?$"), F.split(text, ":")[0].try_cast("double") * 60 + F.get(F.split(text, ":"), F.lit(1)).try_cast("double"))


def american(text: Column) -> Column:
    """m/d/Y H:M as a timestamp, null for others."""
    return F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$"), F.try_to_timestamp(text, F.lit("M/d/yyyy H:mm")))


def uuid5(name: Column, namespace: str) -> Column:
    """The name-based UUID (version 5) of a text within a namespace UUID."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(h.substr(17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), F.concat(F.lit("5"), h.substr(14, 3)), F.concat(variant, h.substr(18, 3)), h.substr(21, 12))


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin("true", "1", "yes"), F.lit(False))


def finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))


def digest_bucket(text: Column, buckets: int = 10) -> Column:
    """The whole SHA-256 of a text as a number, modulo 10: 16**k is 6 modulo 10 for every k above 0."""
    if buckets != 10:
        raise ValueError("the rule holds modulo 10 only")
    h = F.sha2(text, 256)
    rest = F.aggregate(F.split(h.substr(1, 63), ""), F.lit(0), lambda acc, c: acc + F.when(c == "", 0).otherwise(F.conv(c, 16, 10).cast("int")))
    return (F.conv(h.substr(64, 1), 16, 10).cast("int") + 6 * rest) % 10


def split_of(text: Column) -> Column:
    """60 / 20 / 20 by digest."""
    b = digest_bucket(text)
    return F.when(b < 6, "train").when(b < 8, "validation").otherwise("test")


def canonical_hash(*fields: Column, chars: int = 16) -> Column:
    """The first digits of the SHA-256 over fields in fixed formats, joined by |; nulls are empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(f, F.lit("")) for f in fields]), 256).substr(1, chars)


def runs(values: Column) -> Column:
    """array<struct<v, w>>: neighbours with equal v merged, their w added up. values: array<struct<v, w>>."""
    def step(acc: Column, x: Column) -> Column:
        same = (F.size(acc) > 0) & F.try_element_at(acc, F.lit(-1))["v"].eqNullSafe(x["v"])
        merged = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(x["v"].alias("v"), (F.try_element_at(acc, F.lit(-1))["w"] + x["w"]).alias("w"))))
        return F.when(same, merged).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(values, F.filter(values, lambda x: F.lit(False)), step)


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in order; a rule that is null does not."""
    return F.array_compact(F.array(*[F.when(bad, name) for name, bad in rules.items()]))


def tags(text: Column) -> Column:
    """map of a tag text `"k"=>"v", ...`."""
    found = lambda i: F.regexp_extract_all(text, F.lit('"([^"]*)"=>"([^"]*)"'), F.lit(i))
    return F.map_from_arrays(found(1), found(2))


def sound_array(values: Column, least: int, most: int) -> Column:
    """Length within bounds, and every number there, finite and not negative."""
    return F.size(values).between(least, most) & F.forall(values, lambda x: finite(x) & F.coalesce(x >= 0, F.lit(False)))


def softmax(score: Column, group: list[str], beta: float = 1.0) -> Column:
    """How likely each row of a group is chosen where a lower score is better: exp(-beta * score), scaled by the best row so that
    nothing overflows, over the group's sum. Null scores have null and count for nothing."""
    w = Window.partitionBy(*group)
    weight = F.exp(-beta * (score - F.min(score).over(w)))
    return weight / F.sum(weight).over(w)


def on_simplex(weights: Column, floor: float = 0.0) -> Column:
    """The nearest weights (array of double) that are at least `floor` each and one in all; null for no weights, nulls, or a floor
    that leaves no room."""
    n = F.size(weights)
    room = 1.0 - floor * n
    down = F.reverse(F.array_sort(F.transform(weights, lambda x: x - floor)))

    def shifted(us: Column) -> Column:
        # the shift that k largest weights need; the last k whose own weight is above it counts
        needs = F.transform(F.sequence(F.lit(1), F.size(us)), lambda k: F.struct(F.get(us, k - 1).alias("u"), ((F.aggregate(F.slice(us, F.lit(1), k), F.lit(0.0), lambda acc, x: acc + x) - room) / k).alias("t")))
        least = F.element_at(F.filter(needs, lambda x: x["u"] > x["t"]), -1)["t"]
        return F.transform(weights, lambda x: F.greatest(x - floor - least, F.lit(0.0)) + floor)

    sound = (n > 0) & F.forall(weights, lambda x: x.isNotNull()) & (room >= 0)
    return F.when(sound, F.element_at(F.transform(F.array(down), shifted), 1))
