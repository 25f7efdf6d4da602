"""Language identification by cross-parsing: the language whose reference text explains a text in the fewest phrases.

The reference of a language is a bounded sample of labelled texts, held as a suffix automaton. A text is cut into phrases, each
the longest stretch that occurs in the reference; their number times the bits of a position in the reference, over the text's
letters, estimates the cross-entropy. The language with the least wins.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import table

#: A reference is made of so many texts of a language at most, each giving a piece of so many characters at most.
ROWS, CHARS = 256, 400

#: References have so many characters together at most; more languages get shorter pieces, though no shorter than LEAST_CHARS.
MOST_CHARS, LEAST_CHARS = 400_000, 40

#: Bits: 2 ** -64 is lost in a sum of 1.
NEGLIGIBLE = 64.0

#: The characters of the short look that orders the languages; the order decides how much is read in vain, never a result.
LOOK = 200

LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")

#: The same among the first 256 code points.
LATIN = re.compile("[A-Za-zªµºÀ-ÖØ-öø-ÿ]+")

#: The prediction for texts that are null or have no letter.
NONE = "und"


def lettered(text: str | None) -> str:
    """The words of letters, lower-cased, a space before and after each; empty if there are none."""
    low = (text or "").lower()
    try:
        low.encode("latin-1")
        words = LATIN.findall(low)
    except UnicodeEncodeError:
        words = LETTERS.findall(low)
    return f" {' '.join(words)} " if words else ""


def automaton(text: str) -> dict:
    """The suffix automaton of a text: each state is the dict of its transitions; the root is returned."""
    length, link, out = [0], [-1], [{}]
    last = 0
    for at, c in enumerate(text):
        new, p = len(length), last
        length.append(at + 1)
        link.append(0)
        out.append({})
        while p >= 0 and c not in out[p]:
            out[p][c] = new
            p = link[p]
        if p >= 0:
            q = out[p][c]
            if length[q] != length[p] + 1:
                clone = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                out.append(out[q].copy())
                while p >= 0 and out[p].get(c) == q:
                    out[p][c] = clone
                    p = link[p]
                link[q] = clone
                q = clone
            link[new] = q
        last = new
    for state in out:
        for c, to in state.items():
            state[c] = out[to]
    return out[0]


def phrases(root: dict, text: str, most: float = math.inf) -> int:
    """Into how many phrases the text falls: each the longest stretch from there on that the automaton knows, or one character
    that it does not know. Once they are more than `most`, the number so far."""
    count, state = 0, root
    for c in text:
        if c in state:
            state = state[c]
        else:
            count += state is not root
            state = root.get(c)
            if state is None:
                count, state = count + 1, root
            if count > most:
                return count
    return count + (state is not root)


def references(docs: DataFrame, rows: int = ROWS, chars: int = CHARS) -> dict[str, str]:
    """A reference text for each lang of docs (text, lang). Rows without a lang or a letter are left out. Texts are dealt by
    hash to `rows` slots for each lang and the least hash of a slot gives a piece of at most `chars` characters, placed by
    the hash, too: copies of a text count once, and what reaches the driver is bounded by the number of languages."""
    mark = F.xxhash64("text")
    room = F.greatest(F.length("text") - chars, F.lit(0)) + 1
    piece = F.substring(F.col("text"), (F.pmod(F.shiftright(mark, 20), room) + 1).cast("int"), F.lit(chars))
    dealt = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", F.pmod(mark, F.lit(rows)).alias("slot"), F.struct(mark.alias("mark"), piece.alias("piece")).alias("one"))
    found = dealt.groupBy("lang", "slot").agg(F.min("one").alias("one")).select("lang", "slot", "one.piece").orderBy("lang", "slot").collect()
    langs = sorted({x.lang for x in found})
    most = max(LEAST_CHARS, min(chars, MOST_CHARS // (rows * max(1, len(langs)))))
    texts = {lang: "".join(lettered(x.piece)[:most] for x in found if x.lang == lang) for lang in langs}
    return {lang: text for lang, text in texts.items() if text}


@lru_cache(maxsize=2)
def _models(texts: tuple[tuple[str, str], ...]) -> list[tuple[str, float, dict]]:
    """Built once in each worker process."""
    return [(lang, math.log2(len(text) + 1), automaton(text)) for lang, text in texts]


def named(models: list[tuple[str, float, dict]], text: str | None) -> tuple[str, float]:
    """The language of a text and how sure it is: code lengths read as probabilities, 0 to 1."""
    plain = lettered(text)
    if not plain or not models:
        return NONE, 0.0
    # The likeliest language first, by a short look: others are given up once they are NEGLIGIBLE bits behind the least
    # so far, where they add nothing to the score.
    looks = [phrases(root, plain[:LOOK]) * size for _, size, root in models]
    bits, least = [math.inf] * len(models), math.inf
    for k in sorted(range(len(models)), key=looks.__getitem__):
        _, size, root = models[k]
        bits[k] = phrases(root, plain, (least + NEGLIGIBLE) / size) * size
        least = min(least, bits[k])
    best = bits.index(least)  # of equal ones the first language in code-point order
    return models[best][0], 1 / sum(2.0 ** max(-1000.0, least - b) for b in bits)


def identify(docs: DataFrame, texts: dict[str, str]) -> DataFrame:
    """docs (text; columns lang_pred and score are replaced, all others are kept) with lang_pred, a key of texts, and score
    (0 to 1), from the whole text. A null text, one without a letter, and every text if texts is empty, get `und` and 0. Equal
    texts get equal results; repeated rows stay repeated; an empty table gives an empty table."""
    others = [c for c in docs.columns if c not in ("lang_pred", "score")]
    kind = docs.select(*others, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    held = tuple(sorted(texts.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = _models(held)
        for batch in batches:
            found = [named(models, x.as_py()) for x in batch.column(batch.schema.get_field_index("text"))]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in others]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*others, "lang_pred", "score"])

    return docs.select(*others).mapInArrow(run, kind)


def held_out(doc_id: Column) -> Column:
    """A document without an id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; learned from the text and lang of those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    texts = references(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    own = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(own, texts).select("doc_id", "held_out", "lang_pred", "score")
