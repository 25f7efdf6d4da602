"""Spelling variants by anagram hashing: words that differ by one letter, and the common form each leads to.

A word's key is the sum of a power of each of its letters, so that adding, removing or exchanging a letter adds, takes or
exchanges one power, wherever it stands. Two words that differ by a removal meet where the longer one's key less a letter is
the shorter one's key; two that differ by an exchange where both keys less a letter are equal. As the change lies in one half
of the word, the other half must be equal: it is part of what is joined on, and the order of the letters is verified after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import keep, table

#: Maximal runs of these are words; only A-Z are lower-cased.
RUN = "[A-Za-zÀ-ÿ]+"

#: A word has at least so many letters and occurrences; a form has so many times the word's occurrences.
LEAST_LETTERS, LEAST_TIMES, FORM_TIMES = 6, 5, 5

#: Keys are sums of fifth powers modulo this prime (2**61 - 1).
MODULUS = (1 << 61) - 1


def lowered(word: Column) -> Column:
    """A-Z in lower case, all others as they are."""
    plain = F.octet_length(word) == F.length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def power(letter: Column) -> Column:
    x = (F.ascii(letter) - 96).cast("long")
    return x * x * x * x * x


def words_of(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUN), F.lit(0)), lowered)


def counted(words: DataFrame, least_letters: int = LEAST_LETTERS, least_times: int = LEAST_TIMES) -> DataFrame:
    """word, n of the words (column word) with enough letters and occurrences; null words are none."""
    return words.where(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_times)


def keyed(words: DataFrame) -> DataFrame:
    """words with key, size and the array of the powers of its different letters."""
    letters = F.transform(F.filter(F.split("word", ""), lambda c: c != ""), power)
    summed = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda acc, x: (acc + x) % MODULUS)
    return words.withColumn("__powers", letters).select("word", "n", summed(F.col("__powers")).alias("key"), F.length("word").alias("size"), F.array_distinct("__powers").alias("powers"))


def _sides(word: Column, size: Column) -> Column:
    """What must be equal if the change lies in the second or in the first half of a word of `size` letters."""
    half = F.floor(size / 2).cast("int")
    head, tail = F.substring(word, F.lit(1), half), F.right(word, size - half)
    return F.array(F.struct(F.lit(0).alias("side"), F.xxhash64(head).alias("rest")), F.struct(F.lit(1).alias("side"), F.xxhash64(tail).alias("rest")))


def near_words(words: DataFrame) -> DataFrame:
    """word, n, other, other_n, both ways, of all words (word, n; each once) that differ by exactly one inserted, deleted or
    replaced code point."""
    all_words = keep(keyed(words), "keyed")
    by = ["key", "size", "side", "rest"]
    less = lambda power: F.pmod(F.col("key") - power, F.lit(MODULUS))

    def spread(rows: DataFrame, key: Column | None, size: Column) -> DataFrame:
        keys = rows.select("word", "n", key.alias("key") if key is not None else F.col("key"), size.alias("size"))
        return keys.select("word", "n", "key", "size", F.explode(_sides(F.col("word"), F.col("size"))).alias("s")).select("word", "n", "key", "size", "s.side", "s.rest")

    without = all_words.select("word", "n", "size", F.explode(F.transform("powers", less)).alias("key"))
    shorter = spread(all_words, None, F.col("size"))
    longer = spread(without, None, F.col("size") - 1)
    same = spread(without, None, F.col("size"))
    # without the hint Spark sizes both sides by the file below the explodes and may broadcast what is many times as large
    named = lambda rows: rows.select(*by, F.col("word").alias("other"), F.col("n").alias("other_n")).hint("merge")
    met = shorter.join(named(longer), by).union(same.join(named(same), by).where("word < other"))
    sure = met.where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n").distinct()
    return sure.union(sure.select("other", "other_n", "word", "n"))


def variants(words: DataFrame, times: int = FORM_TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n; each once).

    form: the near word with the largest n (of equal ones the first in code-point order) if that is at least `times` the
    word's n, else null; root: where the forms of forms end, the word itself if it has none; n_near: how many near words it has.
    """
    words = keep(words.select("word", "n"), "words")
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("form"))).alias("one"))
    found = best.select(F.col("word").alias("__word"), "n_near", (-F.col("one.n")).alias("form_n"), "one.form")
    near = words.join(found, F.col("word") == F.col("__word"), "left").drop("__word")
    good = F.col("form_n") >= times * F.col("n")
    near = keep(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")), "near")
    roots = rooted(near.where("form is not null").select("word", F.col("form").alias("root")))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def rooted(steps: DataFrame) -> DataFrame:
    """word, root: the end of the way that begins with each step (word, root). Ways double in each round; counts grow along a
    way, so it has an end."""
    now = keep(steps, "roots")
    while True:
        on = now.select(F.col("word").alias("__word"), F.col("root").alias("__root"))
        if not now.join(on, F.col("root") == F.col("__word"), "left_semi").limit(1).count():
            return now
        now = keep(now.join(on, F.col("root") == F.col("__word"), "left").select("word", F.coalesce("__root", "root").alias("root")), "roots")


def spelling_variants(docs: DataFrame, text: str = "text") -> DataFrame:
    """variants of the words of a text column: see there. Words are maximal runs of Latin letters, lower-cased in A-Z, of at least
    six letters and five occurrences over all texts. Null and empty texts have none; repeated rows count each time; other
    columns are left; an empty table gives an empty table."""
    return variants(counted(docs.select(F.explode(words_of(F.col(text))).alias("word"))))


def misspelt(word: Column, doc_id: Column) -> Column:
    """The word, or, where the crc32 of `<doc_id>:<word>` is a multiple of 199, the word without one letter; no id counts as
    an empty one."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word))
    at = (h % F.length(word)).cast("int")
    return F.when(h % 199 == 0, F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))).otherwise(word)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents, one in 199 of them misspelt."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(words_of(F.col("text"))).alias("word"))
    return variants(counted(docs.select(misspelt(F.col("word"), F.col("doc_id")).alias("word"))))
