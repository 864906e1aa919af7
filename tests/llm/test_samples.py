"""What the learned operators learn from: copies take no places, and all training rows count."""

import zlib

from pyspark.sql import functions as F

from residuum.llm import langid, lm


def test_copies_take_no_places_in_the_language_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_DOCS", 20)
    texts = spark.createDataFrame([(f"text number {i} of this language", "en") for i in range(50)], "text string, lang string")
    lowest = texts.orderBy(F.xxhash64("text")).first().text
    copies = spark.range(300).select(F.lit(lowest).alias("text"), F.lit("en").alias("lang"))
    got = langid.sample(texts.unionByName(copies))
    assert len(got) == 20 and len({tuple(cut) for _, cut in got}) == 20


def test_language_model_learns_from_all_rows(spark):
    # The order of two words tells the cycle; one very long text and many copies of another come first.
    ids = [i for i in range(30000) if zlib.crc32(str(i).encode()) % 5 != 1]
    rows = [(ids[0], "x y " * 150000)] + [(i, "p q " * 20) for i in ids[1:1500]] + [(i, "a b c d e f g h " * 6) for i in ids[1500:9000]]
    held = [i for i in range(30000, 30050) if zlib.crc32(str(i).encode()) % 5 == 1]
    docs = spark.createDataFrame(rows + [(i, "a b c d e f g h " * 6) for i in held], "doc_id long, text string").repartition(4)
    got = [r for r in lm.score_texts(docs).collect() if r.doc_id in held]
    assert len(got) == len(held) and all(r.score / r.n_tokens > -0.12 for r in got)


def test_rounds_average_tasks_and_learn_every_symbol(monkeypatch):
    model, seen = lm.Model([("a", 5), (lm.END, 3)], 2), []
    monkeypatch.setattr(model, "_run", lambda streams, adam: seen.append(streams[1:].T.ravel()))
    flat = __import__("numpy").arange(5000)
    model.learn(flat, None)
    assert sorted(x for s in seen for x in s) == list(range(1, 5000))
