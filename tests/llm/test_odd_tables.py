"""Names in the way, odd rows and empty tables of operators and of the whole pipeline."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from kerbside.llm import catalog, contamination, secrets, substrings, toxicity


def frame(spark, rows, columns="doc_id long, text string"):
    return spark.createDataFrame(rows, columns)


def test_names_in_the_way_raise(spark):
    df = frame(spark, [(1, "words")])
    with pytest.raises(ValueError):
        secrets.scan(df.withColumn("secret_spans", F.lit(1)), catalog.RANKS, public_tokenizers.PATTERN)
    for name in ("n_words", "items", "contaminated"):
        with pytest.raises(ValueError):
            contamination.contamination(df.withColumn(name, F.lit(1)), frame(spark, [("a", "b")], "item_id string, text string"), keep=["doc_id", name])
    chain = toxicity.train(df, frame(spark, [], "doc_id long, toxic int"), ["toxic"])
    for name in ("p_toxic", "is_toxic"):
        with pytest.raises(ValueError):
            toxicity.score(df.withColumn(name, F.lit(1)), chain)


def test_repeats_drop_other_columns(spark):
    whole = "a passage that two documents share, and that is longer than a hundred bytes, so it goes from the second one. "
    df = frame(spark, [(1, whole), (2, "own words first. " + whole)]).withColumns({"id": F.lit("x"), "tk": F.lit(3), "start": F.lit(0)})
    got = {r.doc_id: r.n_removed for r in substrings.digests(substrings.remove_repeats(df)).collect()}
    assert got[1] == 0 and got[2] >= 100


def test_the_toxic_sample_does_not_depend_on_partitions(spark):
    dice = random.Random(3)
    texts = [" ".join(dice.choice(["good", "bad", "vile", "kind", "word"]) for _ in range(8)) for _ in range(40)]
    docs = frame(spark, [(k % 10, t) for k, t in enumerate(texts)])  # ten ids, four texts each, many of one length
    labels = frame(spark, [(k, int(k % 2)) for k in range(10)], "doc_id long, toxic int")
    a, b = (toxicity.train(docs.repartition(n), labels.repartition(n), ["toxic"], rows=15) for n in (1, 7))
    probe = [toxicity.score(docs, c).orderBy("text").select("p_toxic").collect() for c in (a, b)]
    assert probe[0] == probe[1]


@pytest.fixture(scope="module")
def odd_sf(spark, tmp_path_factory):
    """Tables with nulls in every column, repeated and empty rows, a very long text and columns with clashing names."""
    at = f"file://{tmp_path_factory.mktemp('odd')}"
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (None, "no id but words enough to be some text here", "en", "s", 1), (3, "the same words in a row of twenty or so words that stand here twice as they are and stay once", "en", "s", 2), (3, "the same words in a row of twenty or so words that stand here twice as they are and stay once", "en", "s", 2), (4, "long " * 60000, "en", "s", 3), (5, "\n\n", "en", "s", 4), (6, "password = Zx9kQ2mL8vB4nR7tY1wE and more words", "en", "s", 5)]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = frame(spark, rows, columns).withColumns({"_text": F.lit("x"), "tk": F.lit(1), "n_words": F.lit(2), "secrets": F.lit("y")})
    for name, df in {"documents": docs, "benchmark": frame(spark, [("b1", None), (None, "a b c"), ("b2", "")], "item_id string, text string"), "labels": frame(spark, [(1, 1, 0), (None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")}.items():
        df.coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return at


def test_the_pipeline_on_odd_rows(spark, odd_sf):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, odd_sf).collect()
    assert all(r.intact for r in out)
    ids = [r.doc_id for r in out]
    assert ids.count(3) == 1 and {1, 4, 6} <= set(ids) and None in ids  # repeated rows leave one; a null text stays


def test_each_stage_keeps_columns_of_odd_rows(spark, odd_sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{odd_sf}/documents.parquet")
    for name, step in corpus_pipeline.STAGES[:-1]:
        if name == "decontamination":
            docs_in = docs.drop("n_words")
        else:
            docs_in = docs
        out = step(spark, docs_in, odd_sf)
        assert out.columns == docs_in.columns and out.count() > 0, name


def test_the_pipeline_on_empty_tables(spark, odd_sf, tmp_path):
    import corpus_pipeline

    for name in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{odd_sf}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
