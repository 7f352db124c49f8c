"""The language sample: rare languages, long texts, empty tables, clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.llm import language


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string")


def test_a_rare_language_is_learned(spark):
    rows = [(f"the page {k} of an english book says so and so", "en") for k in range(400)] + [(f"die seite {k} eines buches sagt dies und das", "de") for k in range(400)] + [(f"strana {k} knihy pravi toto", "cs") for k in range(6)]
    model = language.train(frame(spark, rows), rows=60, of_each=30)
    assert model.languages == ["cs", "de", "en"]
    got = language.predict(frame(spark, [("strana knihy", ""), ("the book", ""), ("die seite", "")]), model).collect()
    assert [r.lang_pred for r in got] == ["cs", "en", "de"]


def test_only_long_texts_still_train(spark):
    rows = [("the words of a page " * 5000 + str(k), "en") for k in range(4)] + [("die worte der seite " * 5000 + str(k), "de") for k in range(4)]
    model = language.train(frame(spark, rows))
    assert model.languages == ["de", "en"]
    assert [r.lang_pred for r in language.predict(frame(spark, [("the words", ""), ("die worte", "")]), model).collect()] == ["en", "de"]


def test_partitions_do_not_change_the_model(spark):
    rows = [(f"text {k} in some words {k * 7}", "ab"[k % 2]) for k in range(50)] * 2
    a, b = (language.train(frame(spark, rows).repartition(n), rows=20, of_each=15) for n in (1, 6))
    assert np.array_equal(a.weights, b.weights) and a.temperature == b.temperature


def test_features_equal_a_plain_count():
    text = "The cat, the CAT; naïve 12"
    at, share = language.text_features(text, {})
    grams = np.concatenate([language.subwords(w) for w in language.WORD.findall(text.lower())])
    assert at.tolist() == sorted(set(grams.tolist())) and share == pytest.approx([np.mean(grams == a) for a in at])
    assert [len(x) for x in language.text_features("12 !", {})] == [0, 0]


def test_odd_tables(spark):
    assert language.train(frame(spark, [])).languages == []
    assert language.train(frame(spark, [(None, "en"), ("words", None), ("12", "de")])).languages == []
    model = language.train(frame(spark, [("some words", "en")]))
    assert language.predict(frame(spark, []), model).count() == 0
    tied = language.predict(frame(spark, [("zzz", "x")]), language.Model(["a", "b"], np.zeros((language.BUCKETS, 2)), np.zeros(2))).first()
    assert (tied.lang_pred, tied.score, tied.lang) == ("a", 0.5, "x")
    with pytest.raises(ValueError, match="in the way"):
        language.predict(frame(spark, []).withColumn("score", F.lit(1)), model)
