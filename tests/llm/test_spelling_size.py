"""op13's joins are over exploded rows, which Spark would size by the file below."""

from driftline.llm import spelling


def test_exploded_words_are_not_broadcast(spark):
    words = spark.createDataFrame([("station", 5), ("statian", 9), ("stations", 7)], "word string, n long")
    found = spelling.near_words(words)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.word, r.other) for r in found.collect()} == {("station", "statian"), ("statian", "station"), ("station", "stations"), ("stations", "station")}
