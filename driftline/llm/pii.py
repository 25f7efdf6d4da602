"""Personal data by weak supervision, in DataFrame functions only.

Patterns propose spans of five kinds: the base ones (whether or not they pass their checks), and wider ones: spelled-out
addresses, IPv6, national phone numbers, long runs of letters and digits that may be secrets. Five labelers vote on each span: its check, a
gazetteer (top-level domains, card issuers, country codes, address ranges, key prefixes), the words before it, its borders, and the
shape of its digits. Expectation-maximisation over the counted vote patterns estimates how reliable each labeler is
for each kind. The posteriors are the soft labels of a logistic span classifier over features most of which no labeler looks at (form, first
character, neighbours, length, variety); it is compiled into a column expression and decides on every span that is not a
base one. Base spans always stay. The driver holds counts of vote patterns (3**5 for a kind) and of feature patterns
(FEATURE_PATTERNS for a kind) only.

Every step is linear in a text's length and in its number of spans: positions are running sums in two levels, and pieces of a
text are cut from blocks of 1,024 characters.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import keep, let, scan, table

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]

# The base patterns, written so that Java's engine neither recurses for each repetition nor starts again inside a run.
# They find what the plain ones find: possessive where nothing can be given back, and starting only where a run starts or
# the last match ended. A card is matched only if its run of digits has 12 to 19.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]|(?<= )at(?= )) ?[A-Za-z0-9-]++ ?(?:\(dot\)|\[dot\]|(?<= )dot(?= )) ?[A-Za-z]{2,}+",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
    "phone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{20,}+={0,2}",
}
#: What a text must contain before a pattern is tried at all.
HINT = {"email": ("@", "dot"), "ip": (".", ":"), "phone": ("+", None)}

# Gazetteers and context words: fixed values.
DOMAINS = "com|org|net|edu|gov|io|info|de|fr|es|uk|it|eu|us|ch|at|nl|be|ca|au|jp|in|br|co|me|biz"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35)"
COUNTRIES = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
KEYS = r"^(?:AKIA|ASIA|gh[pousr]_|sk[-_]|pk[-_]|xox[abp]-|eyJ)|^(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})$"
CONTEXT = {
    "email": r"e-?mail|mail|contact|write|reach|kontakt|correo|courriel|adresse",
    "ip": r"\bip\b|host|server|address|addr|login|client|adresse",
    "card": r"card|visa|master|amex|credit|debit|karte|carte|tarjeta|payment",
    "phone": r"phone|tel\b|tel\.|call|mobile|cell|fax|anruf|appel|llama|telefon|whatsapp",
    "secret": r"token|secret|passw|pwd|api.?key|\bkey\b|auth|credential|bearer|private",
}
AGAINST = r"version|build|isbn|issn|token|sha|hash|order|invoice|serial|part no|figure|section|chapter"
AGAINST_SECRET = r"sha|hash|commit|checksum|md5|digest|integrity|uuid|revision|etag|isbn|chapter"
BEFORE = 32
PART = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"

VOTES = ("check", "gazetteer", "context", "border", "shape")
#: Features of the classifier with the number of their values.
FEATURES = {"form": 2, "check": 3, "first": 4, "left": 4, "right": 4, "length": 6, "variety": 3}
FEATURE_PATTERNS = math.prod(FEATURES.values())
BLOCK_BITS = 10


def blocks_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{1 << BLOCK_BITS}}}"), F.lit(0))


def cut(blocks: Column, at: Column, n: Column) -> Column:
    """n characters from position at (from 0) of the text in blocks; what lies beyond its ends is left out."""
    at, n = F.greatest(at, F.lit(0)), F.greatest(F.least(n, n + at), F.lit(0))
    return let(F.struct(at.alias("a"), n.alias("n")), lambda x: F.array_join(F.slice(blocks, F.shiftright(x["a"], BLOCK_BITS) + 1, F.shiftright(x["a"] + x["n"], BLOCK_BITS) - F.shiftright(x["a"], BLOCK_BITS) + 1), "").substr(x["a"].bitwiseAND((1 << BLOCK_BITS) - 1) + 1, x["n"]))


def spans_of(text: Column, pattern: str, matches: Column) -> Column:
    """array<struct<end, m>>: where each match ends, in code points. The text between matches, as split() cuts it, and the
    matches themselves add up to the text."""
    lengths = lambda m: F.zip_with(m, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(m)), lambda x, gap: F.length(x) + F.length(gap))
    placed = let(matches, lambda m: F.zip_with(scan(lengths(m), lambda a, b: a + b), m, lambda e, x: F.struct(e.alias("end"), x.alias("m"))))
    return F.when(F.size(matches) > 0, placed).otherwise(F.array().cast("array<struct<end:int,m:string>>"))


def luhn(number: Column) -> Column:
    d = F.translate(number, " -", "")

    def digit(i: Column) -> Column:
        n = d.substr(i, F.lit(1)).cast("int")
        twice = F.when(n > 4, n * 2 - 9).otherwise(n * 2)
        return F.when((F.length(d) - i) % 2 == 1, twice).otherwise(n)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), lambda acc, i: acc + digit(i)) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """Whether a match of a base pattern is a base span."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike(PART))
    if kind == "card":
        return luhn(m)
    if kind == "phone":
        return F.length(F.translate(m, "+ ().-", "")).between(9, 15)
    return F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _variety(m: Column) -> Column:
    """How many different letters and digits."""
    return F.size(F.array_distinct(F.regexp_extract_all(F.lower(m), F.lit("[a-z0-9]"), F.lit(0))))


def _by_kind(x: Column, of: dict[str, Column]) -> Column:
    out = F.lit(0)
    for kind, value in of.items():
        out = F.when(x["kind"] == KINDS.index(kind), value).otherwise(out)
    return out


def _checked(x: Column) -> Column:
    """The kind's own check: passed for base patterns, none for wider ones, a mixture of characters for secrets."""
    m = x["m"]
    mixed = (F.length(F.regexp_replace(m, "[^0-9]", "")) >= 3) & (F.length(F.regexp_replace(m, "[^A-Za-z]", "")) >= 3)
    secret = F.when(mixed, F.when(x["variety"] >= 8, 1).otherwise(0)).otherwise(-1)
    return F.when(x["kind"] == KINDS.index("secret"), secret).when(x["form"] == 1, 0).when(x["passed"], 1).otherwise(-1)


def _gazetteer(x: Column) -> Column:
    m = x["m"]
    either = lambda yes: F.when(yes, 1).otherwise(-1)
    v4 = _vote(m.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\."), m.rlike(r"^0"))
    return _by_kind(x, {
        "email": either(F.lower(m).rlike(rf"(?:^|[^a-z])(?:{DOMAINS})$")),
        "ip": F.when(x["form"] == 0, v4).when(F.lower(m).rlike(r"^(?:2[0-9a-f]{3}|fd|fe80)"), 1).otherwise(0),
        "card": either(F.translate(m, " -", "").rlike(ISSUERS)),
        "phone": F.when(m.rlike(COUNTRIES), 1).otherwise(0),
        "secret": F.when(m.rlike(KEYS), 1).otherwise(0),
    })


def _shape(x: Column) -> Column:
    m = x["m"]
    varied = F.when(x["variety"] >= 5, 1).when(x["variety"] <= 3, -1).otherwise(0)
    return _by_kind(x, {
        "email": _vote(m.rlike(r"^[A-Za-z][A-Za-z0-9]*[._-]?[A-Za-z0-9]+[ @]"), m.rlike(r"\.\.|^[._%+-]")),
        "ip": F.when(m.rlike(r"(?:^|[.:])0[0-9]"), -1).otherwise(1),
        "card": varied,
        "phone": varied,
        "secret": _vote(m.rlike(r"[0-9][A-Za-z]+[0-9]|[A-Z][a-z]+[A-Z0-9]"), m.rlike(r"^[A-Za-z]+(?:[-_/][A-Za-z]+)+")),
    })


def _character(c: Column) -> Column:
    """0 none or white space, 1 a letter or digit, 2 a quote, bracket, sign of equality or colon, 3 another."""
    return F.when(c.rlike(r"^(?:\s|\z)"), 0).when(c.rlike(r"^[\p{L}\p{N}_]"), 1).when(c.rlike(r"^[\"'`=:<>()\[\]{}|]"), 2).otherwise(3)


def _votes(x: Column) -> Column:
    """A candidate from its kind, form, ends, text, check and neighbours."""
    context = {k: F.when(x["before"].rlike(CONTEXT[k]), 1).when(x["before"].rlike(AGAINST_SECRET if k == "secret" else AGAINST), -1).otherwise(0) for k in KINDS}
    length, variety = F.length(x["m"]), x["variety"]
    return F.struct(
        x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), (x["passed"] & (x["form"] == 0)).alias("base"),
        _checked(x).alias("check"), _gazetteer(x).alias("gazetteer"), _by_kind(x, context).alias("context"),
        F.when((x["left"] == 1) | (x["right"] == 1), -1).otherwise(1).alias("border"), _shape(x).alias("shape"), x["form"].alias("form"),
        F.when(x["m"].rlike("^[0-9]"), 0).when(x["m"].rlike("^[a-z]"), 1).when(x["m"].rlike("^[A-Z]"), 2).otherwise(3).alias("first"), x["left"].alias("left"), x["right"].alias("right"),
        F.when(length < 10, 0).when(length < 14, 1).when(length < 17, 2).when(length < 24, 3).when(length < 41, 4).otherwise(5).alias("length"),
        F.when(variety < 5, 0).when(variety < 9, 1).otherwise(2).alias("variety"),
    )


def _described(blocks: Column, x: Column) -> Column:
    start = x["end"] - F.length(x["m"])
    same = [x[n].alias(n) for n in ("end", "m", "kind", "form", "passed")]
    near = lambda y: F.struct(
        *[y[n].alias(n) for n in ("start", "end", "m", "kind", "form", "passed")], F.lower(y["before"]).alias("before"),
        _character(F.right(y["before"], F.lit(1))).alias("left"), _character(y["after"]).alias("right"), _variety(y["m"]).alias("variety"),
    )
    placed = F.struct(start.alias("start"), *same, cut(blocks, start - BEFORE, F.lit(BEFORE)).alias("before"), cut(blocks, x["end"], F.lit(1)).alias("after"))
    return let(let(placed, near), _votes)


def _free(spans: Column) -> Column:
    """Base spans, and the others that overlap none. spans stand in order of their starts."""
    ends = scan(F.transform(spans, lambda x: F.when(x["base"], x["end"]).otherwise(0)), F.greatest)
    far = F.lit((1 << 31) - 1)
    starts = F.reverse(scan(F.reverse(F.transform(spans, lambda x: F.when(x["base"], x["start"]).otherwise(far))), F.least))
    bounds = F.zip_with(ends, starts, lambda e, s: F.struct(e.alias("e"), s.alias("s")))
    open_ = F.zip_with(spans, bounds, lambda x, b: F.struct(x.alias("x"), (x["base"] | (b["e"] <= x["start"]) & (x["end"] <= b["s"])).alias("ok")))
    return F.transform(F.filter(open_, lambda y: y["ok"]), lambda y: y["x"])


def with_candidates(docs: DataFrame, to: str = "candidates") -> DataFrame:
    """Adds `to`: every proposed span of column text with its votes and features, in order of start and kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    names = {}
    for wide, patterns in ((False, BASE), (True, WIDER)):
        for kind, pattern in patterns.items():
            hint = HINT.get(kind, (None, None))[wide]
            found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
            names[kind, wide] = f"__{kind}_{int(wide)}"
            docs = docs.withColumn(names[kind, wide], F.when(text.contains(hint), found).otherwise(F.array().cast("array<string>")) if hint else found)

    def of(kind: str, wide: bool) -> Column:
        spans = spans_of(text, (WIDER if wide else BASE)[kind], F.col(names[kind, wide]))
        fields = {"kind": F.lit(KINDS.index(kind)), "form": F.lit(int(wide))}
        return F.transform(spans, lambda x: F.struct(x["end"].alias("end"), x["m"].alias("m"), *[v.alias(k) for k, v in fields.items()], (F.lit(True) if wide else valid(kind, x["m"])).alias("passed")))

    proposed = F.concat(*[of(*k) for k in names])
    all_of = lambda blocks: F.array_sort(F.transform(proposed, lambda x: _described(blocks, x)))
    some = sum((F.size(n) for n in names.values()), F.lit(0)) > 0
    blocks = F.when(some, blocks_of(text)).otherwise(F.array().cast("array<string>"))
    return docs.withColumn(to, let(let(blocks, all_of), _free)).drop(*names.values())


@dataclass(frozen=True)
class SpanModel:
    """reliability[kind][vote]: P(vote value | personal or not) as {value: (no, yes)}; weights of the final classifier
    by kind, feature and value."""

    reliability: dict[str, dict[str, dict[int, tuple[float, float]]]]
    weights: dict[str, float]

    def probability(self, x: Column) -> Column:
        """Of a candidate struct."""
        if not self.weights:
            return F.lit(0.0)
        known = F.create_map(*[F.lit(v) for kv in sorted(self.weights.items()) for v in kv])
        total = F.coalesce(known[F.concat(x["kind"].cast("string"), F.lit(":bias"))], F.lit(-5.0))
        for f in FEATURES:
            total = total + F.coalesce(known[F.concat(x["kind"].cast("string"), F.lit(f":{f}:"), x[f].cast("string"))], F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


Reliability = dict[str, dict[int, tuple[float, float]]]


def estimate(rows: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> tuple[Reliability, dict[tuple[int, ...], float]]:
    """EM over (votes, count) of one kind: each labeler's P(vote | not, yes), and P(yes) of each vote pattern. Labelers are
    taken to be independent given the truth and, by one pseudo-count each, better than chance."""
    votes, n = np.array([v for v, _ in rows]) + 1, np.array([c for _, c in rows], float)
    sure = 1 / (1 + np.exp(-1.5 * (votes - 1).sum(axis=1)))
    p = np.zeros((len(VOTES), 3, 2))
    for _ in range(rounds):
        mass = np.stack([n * (1 - sure), n * sure], axis=1)
        p[:] = 0.5
        p[:, 2, 1] += 1
        p[:, 0, 0] += 1
        for j in range(len(VOTES)):
            np.add.at(p[j], votes[:, j], mass)
        p /= p.sum(axis=1, keepdims=True)
        prior = mass.sum(axis=0) + 1
        logs = np.log(prior) + sum(np.log(p[j, votes[:, j]]) for j in range(len(VOTES)))
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -30, 30)))
        moved, sure = float(np.abs(new - sure).max()), new
        if moved < 1e-9:
            break
    found = {name: {v - 1: (float(p[j, v, 0]), float(p[j, v, 1])) for v in range(3)} for j, name in enumerate(VOTES)}
    return found, {v: float(s) for (v, _), s in zip(rows, sure, strict=True)}


def fit(candidates: DataFrame, column: str = "candidates") -> SpanModel:
    """Counts patterns over all documents, estimates the labelers, and trains the classifier on their posteriors."""
    own = [*VOTES, *(f for f in FEATURES if f not in VOTES)]
    seen = keep(candidates.select(F.explode(column).alias("c")).groupBy("c.kind", *[f"c.{v}" for v in own]).count(), "votes")
    reliability, posterior, weights = {}, {}, {}
    counted = defaultdict(list)
    for r in seen.groupBy("kind", *VOTES).agg(F.sum("count").alias("n")).collect():
        counted[r.kind].append((tuple(r[v] for v in VOTES), r.n))
    for k, rows in sorted(counted.items()):
        reliability[KINDS[k]], found = estimate(sorted(rows))
        posterior |= {f"{k}:" + ",".join(map(str, v)): p for v, p in found.items()}
    if not posterior:
        return SpanModel({}, {})
    key = F.concat_ws(":", F.col("kind").cast("string"), F.concat_ws(",", *[F.col(v).cast("string") for v in VOTES]))
    known = F.create_map(*[F.lit(v) for kv in sorted(posterior.items()) for v in kv])
    soft = seen.groupBy("kind", *FEATURES).agg(F.sum("count").alias("n"), F.sum(F.col("count") * known[key]).alias("yes")).collect()
    for k in counted:
        weights |= _logistic(k, sorted((tuple(r[f] for f in FEATURES), r.n, r.yes) for r in soft if r.kind == k))
    return SpanModel(reliability, weights)


def _logistic(kind: int, rows: list[tuple[tuple[int, ...], int, float]], steps: int = 60, ridge: float = 0.3) -> dict[str, float]:
    """Newton steps on the soft-label log loss with a ridge; one weight for each feature's value, and a bias."""
    names = sorted({f"{kind}:{f}:{v}" for values, _, _ in rows for f, v in zip(FEATURES, values, strict=True)})
    at = {n: i + 1 for i, n in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, 0] = 1
    for i, (values, _, _) in enumerate(rows):
        x[i, [at[f"{kind}:{f}:{v}"] for f, v in zip(FEATURES, values, strict=True)]] = 1
    n, yes = np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + ridge * np.eye(len(w)), x.T @ (yes - n * p) - ridge * w)
        w = w + step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return {f"{kind}:bias": float(w[0])} | {m: float(w[i]) for m, i in at.items()}


def with_spans(candidates: DataFrame, model: SpanModel, column: str = "candidates", to: str = "spans") -> DataFrame:
    """Replaces the candidates by `to`: array<struct<start, kind, end, base>> of what is personal data."""
    taken = F.filter(column, lambda x: x["base"] | (model.probability(x) >= 0.5))
    short = F.transform(taken, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["base"].alias("base")))
    out = candidates.withColumn("__taken", short).drop(column)
    return out.withColumnRenamed("__taken", to)


def mask(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one mark."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def done(blocks: Column) -> Column:
        def joined(ends: Column) -> Column:
            before = F.concat(F.array(F.lit(0)), F.slice(ends, F.lit(1), F.size(ends) - 1))
            parts = F.zip_with(spans, before, lambda x, b: F.when(x["start"] >= b, F.concat(cut(blocks, b, x["start"] - b), F.get(names, x["kind"]))).otherwise(""))
            last = F.element_at(ends, -1)
            return F.concat(F.array_join(parts, ""), cut(blocks, last, F.length(text) - last))

        return let(scan(F.transform(spans, lambda x: x["end"]), F.greatest), joined)

    return F.when(F.size(spans) > 0, let(blocks_of(text), done)).otherwise(text)


def _digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, spans for every row of docs (doc_id, text). Null texts have no spans; repeated rows stay and count each
    time; other columns are left out; an empty table gives none."""
    found = keep(with_candidates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "candidates"), "candidates")
    return with_spans(found, fit(found))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    of_kind = lambda k: lambda x: x["kind"] == k
    df = find_pii(table(spark, sf_dir, "documents")).withColumn("base", F.filter("spans", lambda x: x["base"]))
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE_KINDS)]
    added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    secret = F.size(F.filter("spans", of_kind(KINDS.index("secret")))).cast("long").alias("n_secret")
    return df.select("doc_id", *counts, F.sha2(_digest(F.col("base")), 256).alias("base_sha256"), _digest(F.col("spans")).alias("spans"), added, secret)
