"""Line dedup against brute force, by batches, both ways of dropping, and odd rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kerbside.llm import lineruns

ODD = [(1, None), (2, ""), (3, "a\nB\n"), (3, "a\nB\n"), (4, " A \nb"), (5, "\n\n \t\n"), (None, "a\nno id"), (6, "a\n" * 50000 + "é"), (7, "c\r\n\x0bC\x0c\nc"), (8, "É\né")]


def plain(rows, least):
    """The contract read word for word: (doc_id, n_lines, n_dropped, kept text) of each row."""
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))

    counts = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or counts[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(map(repr, out))


def told(df):
    return sorted(repr((r.doc_id, r.n_lines, r.n_dropped, r.text or "")) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize(("fan_in", "hot_keys"), [(2, 1000), (3, 7), (4, 0)])
def test_batches_equal_brute_force(spark, fan_in, hot_keys):
    dice = random.Random(fan_in)
    lines = [f"{'  ' * (k % 2)}Line {k}" for k in range(60)]
    rows = [(i, "\n".join(dice.choice(lines[: 5 if dice.random() < 0.3 else 60]) for _ in range(dice.randint(0, 8)))) for i in range(120)]
    docs, runs = frame(spark, rows), lineruns.LineRuns(spark, least=9, fan_in=fan_in)
    for k in range(7):
        batch = docs.where(F.col("doc_id") % 7 == k)
        runs.add(batch, k)
        runs.add(batch, k)  # a repeated micro-batch
    assert len(runs.runs()) <= 2 * fan_in
    settled = runs.settled()
    assert len(runs.runs()) == 1 and 0 < settled.count() < 60
    assert told(lineruns.drop_common(docs, settled, hot_keys=hot_keys)) == plain(rows, 9)
    runs.drop()


def test_settled_keys_are_not_counted_again(spark):
    runs = lineruns.LineRuns(spark, least=2)
    runs.add(frame(spark, [(1, "x"), (2, "x"), (3, "y")]))
    runs.add(frame(spark, [(4, "x"), (5, "y"), (6, "z")]))
    last = runs.read(runs.runs()[-1])
    assert sorted((r.n, r.settled) for r in last.collect()) == [(1, False), (1, False)]
    assert sorted(r.n for r in runs.settled().collect()) == [2, 2]
    runs.drop()


def test_runs_are_joined_and_compacted_without_a_shuffle(spark):
    runs = lineruns.LineRuns(spark, least=2, fan_in=9)
    for k in range(3):
        runs.add(frame(spark, [(k, "x\ny"), (9, f"{k}")]), k)
    with lineruns.sorted_reads(spark):
        a, b, c = map(runs.read, runs.runs())
        plan = a.union(b).union(c).groupBy("key").agg(F.sum("n"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    runs.drop()


@pytest.mark.parametrize("hot_keys", [100, 1])
def test_odd_rows(spark, hot_keys):
    docs, runs = frame(spark, ODD).withColumn("key", F.lit("k")), lineruns.LineRuns(spark, least=3)
    runs.add(docs)
    out = lineruns.drop_common(docs, runs.settled(), hot_keys=hot_keys)
    assert told(out) == plain(ODD, 3)
    assert out.columns == ["doc_id", "key", "text", "n_lines", "n_dropped"]
    assert [r.text for r in out.where("doc_id = 1").collect()] == [None]
    with pytest.raises(ValueError, match="in the way"):
        lineruns.drop_common(docs.withColumn("n_lines", F.lit(1)), runs.settled())
    runs.drop()


def test_batches_of_files_hold_every_row_once(spark, tmp_path):
    frame(spark, [(k, f"x\ny {k}") for k in range(50)]).repartition(5, "doc_id").write.parquet(f"file://{tmp_path}/docs of all")
    docs = spark.read.parquet(f"file://{tmp_path}/docs of all").select("doc_id", "text")
    batches = lineruns.file_batches(docs, 3)
    assert len(batches) == 3
    assert sorted(r.doc_id for b in batches for r in b.collect()) == list(range(50))
    assert all(b.count() for b in batches)
    runs = lineruns.LineRuns(spark, least=50)
    for k, b in enumerate(batches):
        runs.add(b, k)
    assert [r.n for r in runs.settled().collect()] == [50]
    assert lineruns.file_batches(frame(spark, [(1, "a")]), 3)[0].count() == 1
    runs.drop()


def test_an_empty_table(spark):
    empty, runs = frame(spark, []), lineruns.LineRuns(spark)
    assert runs.settled().count() == 0
    runs.add(empty)
    assert lineruns.drop_common(empty, runs.settled()).count() == 0
    assert told(lineruns.drop_common(frame(spark, ODD), runs.settled())) == plain(ODD, 10**9)
    runs.drop()
