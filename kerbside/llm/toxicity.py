"""Toxicity by a classifier chain.

The chain's categories are the label columns, in a given order. Each has a linear model over the words
and word beginnings that a text has (present or not, so one insult weighs the same in a short text and
a long one) and over the probabilities of the categories before it. Those are out-of-fold in training:
each fold's come from models that did not see the fold, so later models learn from the errors that they
will meet. Models are trained by follow-the-regularised-leader steps in numpy on a bounded sample; its
L1 term leaves words without evidence at weight zero.

Defined results: a null or empty text has no features and gets each category's base rate; with no
labelled rows every probability is 0; null labels are left out of their category; labels of repeated
documents count each time, within the sample's bound; repeated rows are scored each; a score at its
threshold is positive; other columns pass through, but for the names of new ones, which raise
ValueError. Whole texts, long ones too, are read in training and scoring.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.llm.common import map_arrow, read_in_turn, text_first, with_columns

#: The bound of the training sample, in pairs of a label row and a document of its doc_id.
SAMPLE_ROWS = 8_000
BUCKETS, FOLDS, EPOCHS = 1 << 20, 4, 2
#: Characters of the word's beginnings that are features beside the word: inflected forms share them.
BEGINNINGS = (4, 5)
#: Labelled documents a feature must occur in, and the L1 term.
LEAST_ROWS, L1, RATE = 8, 2.0, 0.3
CACHE_WORDS = 100_000
WORD = re.compile(r"[^\W\d_]+")


def features(text: str, cache: dict[str, tuple[int, ...]]) -> np.ndarray:
    """Buckets of the distinct words and of their beginnings."""
    if len(cache) > CACHE_WORDS:
        cache.clear()
    out = set()
    for w in set(WORD.findall(text.lower())):
        both = cache.get(w)
        if both is None:
            both = cache[w] = tuple(zlib.crc32(x.encode()) % BUCKETS for x in (w, *(f"{w[:n]}~" for n in BEGINNINGS)))
        out.update(both)
    return np.fromiter(out, np.int32, len(out))


@dataclass
class Linear:
    """weights over buckets, then one for each earlier category, then the bias."""

    weights: np.ndarray

    def score(self, at: np.ndarray, earlier: np.ndarray) -> float:
        w, n = self.weights, len(earlier)
        return 1 / (1 + np.exp(-np.clip(w[at].sum() + w[BUCKETS : BUCKETS + n] @ earlier + w[-1], -30, 30)))


@dataclass
class Chain:
    categories: list[str]
    models: list[Linear]
    thresholds: list[float]
    cache: dict[str, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def probabilities(self, text: str) -> list[float]:
        at, out = features(text, self.cache), np.zeros(0)
        for model in self.models:
            out = np.append(out, model.score(at, out))
        return out.tolist()


def fit_linear(rows: list[np.ndarray], earlier: np.ndarray, labels: np.ndarray, seed: int) -> Linear:
    n = earlier.shape[1]
    support = np.bincount(np.concatenate(rows), minlength=BUCKETS) if rows else np.zeros(BUCKETS)
    live = support >= LEAST_ROWS
    z, seen, w = (np.zeros(BUCKETS + n + 1) for _ in range(3))
    dense = np.arange(BUCKETS, BUCKETS + n + 1)
    penalty = np.full(BUCKETS + n + 1, L1)
    penalty[BUCKETS:] = 0
    random = np.random.default_rng(seed)
    active = [np.concatenate([r[live[r]], dense], dtype=np.int32) for r in rows]
    for _ in range(EPOCHS):
        for k in random.permutation(len(rows)):
            at = active[k]
            value = np.ones(len(at))
            value[len(at) - n - 1 : len(at) - 1] = earlier[k]
            now = np.where(np.abs(z[at]) <= penalty[at], 0.0, -(z[at] - np.sign(z[at]) * penalty[at]) / (1.0 + np.sqrt(seen[at])) * RATE)
            p = 1 / (1 + np.exp(-np.clip(now @ value, -30, 30)))
            g = (p - labels[k]) * value
            z[at] += g - (np.sqrt(seen[at] + g * g) - np.sqrt(seen[at])) / RATE * now
            seen[at] += g * g
    touched = np.flatnonzero(seen)
    w[touched] = np.where(np.abs(z[touched]) <= penalty[touched], 0.0, -(z[touched] - np.sign(z[touched]) * penalty[touched]) / (1.0 + np.sqrt(seen[touched])) * RATE)
    return Linear(w.astype(np.float32))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Half way between two scores, where the out-of-fold F1 is best; 0.5 where there is nothing to choose by."""
    if not y.any() or y.all():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(p[order][1:] != p[order][:-1], True)
    k = int(np.argmax(np.where(last, f1, -1)))
    return float((p[order][k] + (p[order][k + 1] if k + 1 < len(y) else 0)) / 2)


def fit(categories: list[str], rows: list[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> Chain:
    """labels: a row for each text and a column for each category, NaN where unknown."""
    earlier = np.zeros((len(rows), 0))
    models, thresholds = [], []
    for c in range(len(categories)):
        known = np.flatnonzero(~np.isnan(labels[:, c])) if len(rows) else np.zeros(0, int)
        pick = lambda at: ([rows[k] for k in at], earlier[at], labels[at, c])  # noqa: B023, E731
        model = fit_linear(*pick(known), seed=c) if len(known) else Linear(np.append(np.zeros(BUCKETS + c), -30.0))
        out = np.zeros(len(rows))
        for fold in range(FOLDS):
            train, rest = known[folds[known] != fold], np.flatnonzero(folds == fold)
            other = fit_linear(*pick(train), seed=c) if len(train) else model
            out[rest] = [other.score(rows[k], earlier[k]) for k in rest]
        models.append(model)
        thresholds.append(best_threshold(out[known], labels[known, c] > 0) if len(known) else 0.5)
        earlier = np.column_stack([earlier, out])
    return Chain(list(categories), models, thresholds)


def train(documents: DataFrame, labels: DataFrame, categories: list[str], rows: int = SAMPLE_ROWS) -> Chain:
    """Fit on `rows` pairs of a label row and its document at most, those of the least hashes.

    First the hash that ends the sample is found, from ids alone; so only the sample's texts become
    feature numbers, where they are read, and only those come to the driver.
    """
    read_in_turn(documents.sparkSession)
    named = [F.col(c).cast("double").alias(f"y{k}") for k, c in enumerate(categories)]
    picked = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), *named, F.xxhash64("doc_id").alias("o")).orderBy("o", *(f"y{k}" for k in range(len(named)))).limit(rows)
    whole = documents.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), "text")
    # `rows` of a few numbers each are broadcast at most.
    pairs = whole.select("id", F.xxhash64("id", F.length("text")).alias("p")).join(F.broadcast(picked.select("id")), "id")
    last = pairs.select("p").orderBy("p").limit(rows).agg(F.max("p")).first()[0]
    joined = whole.join(F.broadcast(picked.drop("o")), "id").where(F.xxhash64("id", F.length("text")) <= (0 if last is None else last)).select("id", "text", *(f"y{k}" for k in range(len(named))), F.xxhash64("id", F.length("text")).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            found = [np.sort(features(t.as_py(), cache)).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), *batch.columns[2:]], names=["id", "f", *ys, "p"])

    ys = [f"y{k}" for k in range(len(categories))]
    schema = "id long, f binary, " + "".join(f"{y} double, " for y in ys) + "p long"
    sample = map_arrow(joined, run, schema).orderBy("p", *ys, "f").limit(rows).collect()  # the same rows whatever the partitions
    sample.sort(key=lambda r: (r.id, bytes(r.f)))
    labelled = np.array([[np.nan if r[y] is None else r[y] for y in ys] for r in sample], float).reshape(-1, len(categories))
    folds = np.array([zlib.crc32(str(r.id).encode()) % FOLDS for r in sample], int)
    return fit(categories, [np.frombuffer(r.f, np.int32) for r in sample], labelled, folds)


def score(df: DataFrame, chain: Chain, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default), and p_<category> and is_<category> of each category."""
    keep = df.columns if keep is None else keep
    names = [f"p_{c}" for c in chain.categories] + [f"is_{c}" for c in chain.categories]
    if clash := set(names) & set(keep):
        raise ValueError(f"columns in the way: {sorted(clash)}")
    sent = df.sparkSession.sparkContext.broadcast(chain)  # buckets x categories: its size does not grow
    kinds = [T.DoubleType()] * len(chain.categories) + [T.BooleanType()] * len(chain.categories)
    schema = T.StructType([*(df.schema[c] for c in keep), *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = sent.value
        for batch in batches:
            p = np.array([chain.probabilities(t.as_py() or "") for t in batch.column(0)]).reshape(-1, len(chain.categories))
            new = [pa.array(c, pa.float64()) for c in p.T] + [pa.array(c >= t, pa.bool_()) for c, t in zip(p.T, chain.thresholds, strict=True)]
            rest = batch.select(batch.schema.names[1:]).rename_columns(keep)
            yield with_columns(rest, keep, **dict(zip(names, new, strict=True)))
        chain.cache.clear()  # the worker lives on and serves other stages

    return map_arrow(text_first(df, text, keep), run, schema)
