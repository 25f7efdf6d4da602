"""Cross-parsing against a plain search, and languages on held-out documents."""

import random

from driftline.llm import languages
from tests.conftest import SMALL


def plain_phrases(known, text):
    at = count = 0
    while at < len(text):
        n = 0
        while at + n < len(text) and text[at : at + n + 1] in known:
            n += 1
        at, count = at + max(n, 1), count + 1
    return count


def test_phrases_are_the_longest_that_the_reference_has():
    rng = random.Random(3)
    for _ in range(300):
        known = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 60)))
        text = "".join(rng.choice("abcd ") for _ in range(rng.randrange(60)))
        assert languages.phrases(languages.automaton(known), text) == plain_phrases(known, text), (known, text)


def test_held_out_documents_get_their_language(spark):
    got = languages.op12_language(spark, SMALL).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and len(held) > 20
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_label_noise_copies_and_rare_languages(spark):
    rng = random.Random(4)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(2, 8)))
    text = lambda letters, n: " ".join(word(letters) for _ in range(n))
    rows = [(text("abcdef", 60), "one" if rng.random() < 0.9 else "two") for _ in range(300)] + [(text("efghij", 60), "two") for _ in range(300)] + [("ab ab ab", "two")] * 900 + [(text("klmn", 9), "few")]
    texts = languages.references(spark.createDataFrame([*rows, (None, "one"), ("123", "nil"), ("abc", None)], "text string, lang string"), rows=64)
    assert set(texts) == {"one", "two", "few"} and all(len(t) <= 64 * languages.CHARS + 128 for t in texts.values())
    asked = [("one", text("abcdef", 25)) for _ in range(40)] + [("two", text("efghij", 25)) for _ in range(40)] + [("few", text("klmn", 25)) for _ in range(5)]
    got = languages.identify(spark.createDataFrame(asked, "want string, text string"), texts).collect()
    assert all(r.lang_pred == r.want for r in got)


def test_odd_rows(spark):
    texts = {"de": "der die das und nicht ein", "en": "the and of not one a"}
    rows = [(1, None, 1), (1, "", 1), (2, "1234 !! __", 1), (3, "the " * 300_000, 1), (4, "Das UND", 1), (4, "Das UND", 1), (5, "語", 1), (6, "á", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = sorted((r.doc_id, r.lang_pred, r.score) for r in languages.identify(df, texts).collect())
    assert [r[:2] for r in got if r[0] < 5] == [(1, "und"), (1, "und"), (2, "und"), (3, "en"), (4, "de"), (4, "de")] and got[4] == got[5]
    assert [r[2] for r in got[:3]] == [0, 0, 0]
    assert languages.identify(df.limit(0), texts).count() == 0
    assert {r.lang_pred for r in languages.identify(df, {}).collect()} == {"und"}
    assert languages.references(df.select("text", "doc_id").withColumn("lang", languages.F.lit(None).cast("string"))) == {}
