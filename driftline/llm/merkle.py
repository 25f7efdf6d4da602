"""Document fingerprints: a Merkle tree over leaves, paragraphs and sections, in DataFrame functions only.

Sections are parted by an empty line, paragraphs by a line end, and a paragraph is cut into leaves of some words where its
content says so: after the spaces that follow certain letters, and after certain characters of scripts without spaces, so an edit changes
the leaves around it and no later ones. A leaf's node is a SHA-256 (128 bits of it), a
paragraph's that of its leaves' nodes, a section's that of its paragraphs' nodes, the root that of the sections' nodes. Leaves,
paragraphs and sections can be put together again, so equal roots mean equal texts.

Where roots differ, the branches that the other tree has nowhere say where the edits are, and the likeness of two trees is twice
the leaves in common over the leaves of both (each distinct leaf once).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from driftline.llm.common import let, scan, table

# Letters that end a good part of the words of many scripts, and frequent characters of scripts without spaces and of
# addresses: fixed values.
FINAL, INSIDE = "dnrkDNRK048.йтмлςνةنםתरन", "のにはをたがでてと的一是不了人我在有他าเร、。，！？；：_/+=&?;|-"
CUT = rf"([{FINAL}] +|[{INSIDE}])"
#: Documents whose ids differ only in these low bits are dealt together; further levels take this many bits more.
LOW_BITS, LEVEL_BITS = 8, 18
LOWEST = -(1 << 63)


def node(of: Column) -> Column:
    """The parent of an array of nodes."""
    return F.sha2(F.array_join(of, ""), 256)


def leaves(paragraph: Column) -> Column:
    found = F.filter(F.split(F.regexp_replace(paragraph, CUT, "$1\n"), "\n", -1), lambda x: x != "")
    return F.transform(found, lambda x: F.sha2(x, 256).substr(1, 32))


def grown(df: DataFrame, text: str, to: str) -> DataFrame:
    """Adds `to`, the tree of column `text`: struct(root, sections, paragraphs, leaves); paragraphs holds one array for each
    section, leaves the distinct ones."""
    nested = F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), leaves))
    df = df.withColumn(f"{to}_l", nested).withColumn(f"{to}_p", F.transform(f"{to}_l", lambda s: F.transform(s, node)))
    df = df.withColumn(f"{to}_s", F.transform(f"{to}_p", node))
    found = F.array_distinct(F.flatten(F.flatten(f"{to}_l")))
    return df.withColumn(to, F.struct(node(F.col(f"{to}_s")).alias("root"), F.col(f"{to}_s").alias("sections"), F.col(f"{to}_p").alias("paragraphs"), found.alias("leaves"))).drop(f"{to}_l", f"{to}_p", f"{to}_s")


def likeness(a: str, b: str) -> Column:
    """0 to 1; 1 for equal roots, also of two empty texts."""
    both = F.size(f"{a}.leaves") + F.size(f"{b}.leaves")
    return F.when(F.col(f"{a}.root") == F.col(f"{b}.root"), 1.0).when(both == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(f"{a}.leaves", f"{b}.leaves")) / both)


def missing(own: Column, other: Column) -> Column:
    """Positions (from 0) of the nodes of one array that the other has nowhere, by sorting both together."""
    tell = lambda h, side, at: F.struct(h.alias("h"), F.lit(side).alias("side"), at.alias("at"))
    marks = F.array_sort(F.concat(F.transform(other, lambda h: tell(h, 0, F.lit(0))), F.transform(own, lambda h, i: tell(h, 1, i))))

    def alone(sorted_: Column) -> Column:
        seen = scan(F.transform(sorted_, lambda m: F.when(m["side"] == 0, m["h"])), lambda acc, x: F.coalesce(x, acc), "string")
        both = F.zip_with(sorted_, seen, lambda m, s: F.struct(m["at"].alias("at"), ((m["side"] == 1) & ~m["h"].eqNullSafe(s)).alias("new")))
        return F.array_sort(F.transform(F.filter(both, lambda x: x["new"]), lambda x: x["at"]))

    return let(marks, alone)


def differing(own: str, other: str) -> list[Column]:
    """edited_sections, edited_paragraphs: every branch of a tree that the other has nowhere, as "2,3" and "2.1,2.2,3.5"."""
    labels = F.flatten(F.transform(f"{own}.paragraphs", lambda ps, s: F.transform(ps, lambda p, i: F.concat((s + 1).cast("string"), F.lit("."), (i + 1).cast("string")))))
    at = let(labels, lambda ls: F.transform(missing(F.flatten(f"{own}.paragraphs"), F.flatten(f"{other}.paragraphs")), lambda i: F.get(ls, i)))
    sections = F.transform(missing(F.col(f"{own}.sections"), F.col(f"{other}.sections")), lambda i: (i + 1).cast("string"))
    return [F.array_join(sections, ",").alias("edited_sections"), F.array_join(at, ",").alias("edited_paragraphs")]


def next_key(keys: DataFrame, key: str, bits: int = LEVEL_BITS) -> DataFrame:
    """key, next_key: the next larger value for each distinct long, null for the largest. No window holds more than
    2**bits values: the last key of each window looks to the first key of the next window, level by level."""

    def level(rows: DataFrame, shift: int) -> DataFrame:
        # rows: k (at this level), low (the smallest key below it)
        if shift >= 64 - LOW_BITS:
            up = None
        else:
            up = level(rows.groupBy(F.shiftright("k", bits).alias("k")).agg(F.min("low").alias("low")), shift + bits)
        if up is None:
            return rows.select("k", F.lead("low").over(W.partitionBy(F.lit(0)).orderBy("k")).alias("next"))
        here = rows.withColumn("g", F.shiftright("k", bits)).withColumn("next", F.lead("low").over(W.partitionBy("g").orderBy("k")))
        up = up.select(F.col("k").alias("g"), F.col("next").alias("beyond"))
        return here.join(up, "g").select("k", F.coalesce("next", "beyond").alias("next"))

    rows = keys.select(F.col(key).alias("k"), F.col(key).alias("low")).distinct()
    return level(rows, 0).select(F.col("k").alias(key), F.col("next").alias("next_key"))


def with_next(docs: DataFrame) -> DataFrame:
    """Adds next_text: the text of the next row in ascending order of (doc_id, text); after the last row, the first's.

    One shuffle of the texts: rows whose ids share all but the low bits stand together, and only the first text of
    each such group is sent again, to the group before it. A null doc_id stands before all others.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST).cast("long"))
    rows = rows.withColumn("k", key).withColumn("g", F.shiftright("k", LOW_BITS))
    order = W.partitionBy("g").orderBy("k", "text")
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("rank", F.row_number().over(order))
    chain = next_key(docs.select(F.shiftright(key, LOW_BITS).alias("g")), "g")
    lowest = docs.agg(F.min(F.shiftright(key, LOW_BITS))).first()[0]
    chain = chain.select("g", F.coalesce("next_key", F.lit(lowest).cast("long")).alias("then"))
    first = rows.where("rank = 1").select(F.col("g").alias("then"), F.col("text").alias("beyond"))
    beyond = chain.join(first, "then").select("g", "beyond")
    return rows.join(beyond, "g", "left").select("doc_id", "text", F.coalesce("next_text", "beyond").alias("next_text"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text, edited, next_text and their trees (own, changed, following) for every row of docs (doc_id, text).

    Null texts count as empty: one section with one empty paragraph, no leaves. A single document is its own next
    one. Repeated rows and ids follow one another. Other columns are left out. An empty table gives none.
    """
    df = with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    df = df.withColumn("edited", F.concat(F.col("text").substr(F.lit(1), (F.col("n_chars") - half).cast("int")), F.col("next_text").substr(F.lit(1), half)))
    return grown(grown(grown(df, "text", "own"), "edited", "changed"), "next_text", "following")


def op1_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fingerprint_documents(table(spark, sf_dir, "documents"))
    return df.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.col("own.root").alias("fingerprint"), F.col("changed.root").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"), likeness("own", "following").alias("near_next"), *differing("own", "changed"),
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, '')),
                  first_value(coalesce(text, '')) OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, ''))) AS next_text
  FROM documents),
e AS (
  SELECT *, length(text)::BIGINT AS n_chars,
         substring(text, 1, length(text) - length(text) // 2) || substring(next_text, 1, length(text) // 2) AS edited
  FROM d),
l AS (
  SELECT doc_id, n_chars, edited, text = edited AS same, text = next_text AS same_next,
         list_transform(string_split(text, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p:
           list_transform(list_filter(string_split(regexp_replace(p, 'CUT', '\1' || chr(10), 'g'), chr(10)), lambda x: x <> ''), lambda x: substring(sha256(x), 1, 32)))) AS a,
         list_transform(string_split(edited, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p:
           list_transform(list_filter(string_split(regexp_replace(p, 'CUT', '\1' || chr(10), 'g'), chr(10)), lambda x: x <> ''), lambda x: substring(sha256(x), 1, 32)))) AS b,
         list_transform(string_split(next_text, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)), lambda p:
           list_transform(list_filter(string_split(regexp_replace(p, 'CUT', '\1' || chr(10), 'g'), chr(10)), lambda x: x <> ''), lambda x: substring(sha256(x), 1, 32)))) AS c
  FROM e),
p AS (
  SELECT *, list_transform(a, lambda s: list_transform(s, lambda x: sha256(array_to_string(x, '')))) AS ap,
         list_transform(b, lambda s: list_transform(s, lambda x: sha256(array_to_string(x, '')))) AS bp,
         list_distinct(flatten(flatten(a))) AS al, list_distinct(flatten(flatten(b))) AS bl, list_distinct(flatten(flatten(c))) AS cl
  FROM l),
s AS (
  SELECT *, list_transform(ap, lambda x: sha256(array_to_string(x, ''))) AS own, list_transform(bp, lambda x: sha256(array_to_string(x, ''))) AS other, flatten(bp) AS bf
  FROM p)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, sha256(array_to_string(own, '')) AS fingerprint, sha256(array_to_string(other, '')) AS edited_fingerprint,
       CASE WHEN same THEN 1.0 WHEN len(al) + len(bl) = 0 THEN 0.0 ELSE 2.0::DOUBLE * len(list_intersect(al, bl)) / (len(al) + len(bl)) END::DOUBLE AS near_edited,
       CASE WHEN same_next THEN 1.0 WHEN len(al) + len(cl) = 0 THEN 0.0 ELSE 2.0::DOUBLE * len(list_intersect(al, cl)) / (len(al) + len(cl)) END::DOUBLE AS near_next,
       array_to_string(list_filter(list_transform(own, lambda h, i: CASE WHEN list_contains(other, h) THEN NULL ELSE i::VARCHAR END), lambda x: x IS NOT NULL), ',') AS edited_sections,
       array_to_string(list_filter(flatten(list_transform(ap, lambda ps, i: list_transform(ps, lambda h, j: CASE WHEN list_contains(bf, h) THEN NULL ELSE i::VARCHAR || '.' || j::VARCHAR END))), lambda x: x IS NOT NULL), ',') AS edited_paragraphs
FROM s
""".replace("CUT", CUT)
