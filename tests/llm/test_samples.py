"""What the fitted operators take as their sample."""

import zlib

from awkward import table
from llm import quality, toxicity


def test_a_long_text_does_not_push_out_the_others(spark, monkeypatch):
    rows = [(i, f"some {'nasty' if i % 4 == 0 else 'kind'} words {i}", "a") for i in range(200)]
    # any place in hash order: these are long texts among the others
    rows += [(1000 + i, "long " * 4000, "a") for i in range(20)]
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 15_000)
    labels = spark.createDataFrame([(i, int(i % 4 == 0) if i < 1000 else 0) for i, _, _ in rows], "doc_id long, toxic int")
    seen, fit = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic: seen.append(len(texts)) or fit(texts, toxic))
    assert toxicity.score_toxicity(table(spark, rows), labels).count() == 220
    assert seen == [sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(200))]


def test_no_labels_predict_nothing(spark):
    rows = [(i, f"clean words {i}", "a") for i in range(5)]
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.score < 0.5 and r.predicted == 0 for r in toxicity.score_toxicity(table(spark, rows), empty).collect())


def test_a_repeated_id_teaches_quality_once(spark, monkeypatch):
    rows = [(i, f"words of text {i} here", "a") for i in range(40)] + [(0, f"again {i}", "a") for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    seen, fit = [], quality.Classifier.fit
    monkeypatch.setattr(quality.Classifier, "fit", lambda x, y: seen.append(len(y)) or fit(x, y))
    from pyspark.sql import functions as F

    assert quality.classify_quality(table(spark, rows), labels, F.col("source"), F.col("lang")).count() == 340
    assert seen == [40]
