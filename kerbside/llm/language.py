"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's vector is the mean of the embeddings of all its subwords (character n-grams of marked words,
hashed to buckets); a linear layer and a softmax give language probabilities. Both layers are trained
together by stochastic gradient descent in numpy on a bounded sample. A temperature and the score below
which a prediction should be rejected are fitted on a part of the sample that training did not see.

Defined results: a text that is null or has no letter is `und` with score 0 and is rejected; training
leaves out null labels and such texts; with no training rows at all every text is `und`; repeated rows
are predicted each and count once in training; of languages with one score the first by name is told;
other columns pass through, but for the names of new ones, which raise ValueError. Training and prediction
read whole texts of any length. The sample is bounded in rows alone and dealt evenly over the languages, so
that a rare one is learned too; its texts become features (BUCKETS numbers at most) in the tasks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.llm.common import map_arrow, text_first, with_columns

#: The bound of the training sample: rows of all languages, and of each.
SAMPLE_ROWS, LANGUAGE_ROWS = 3_000, 1_000
BUCKETS, DIMENSIONS = 1 << 15, 16
EPOCHS, RATE = 4, 0.5
GRAMS = (2, 3, 4)
#: Share of confident held-back predictions that the rejection score keeps.
KEPT_SHARE = 0.99
CACHE_WORDS = 300_000
WORD = re.compile(r"[^\W\d_]+")


def subwords(word: str) -> np.ndarray:
    """Buckets of the word's n-grams."""
    marked = f"<{word}>"
    return np.array([zlib.crc32(marked[k : k + n].encode()) % BUCKETS for n in GRAMS for k in range(len(marked) - n + 1)], np.int64)


@dataclass
class Model:
    languages: list[str]
    #: What each bucket adds to the languages' logits: embeddings times the linear layer.
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least_score: float = 0.0
    cache: dict[str, int] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean logits of each text and whether it has a letter. A word's sum is worked out once."""
        if len(self.cache) > CACHE_WORDS or not self.cache:
            self.cache, self.sums = {}, np.zeros((1 << 12, len(self.languages) + 1))
        out, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), bool)
        for k, text in enumerate(texts):
            words = WORD.findall(text.lower())
            if not words:
                continue
            ids = list(map(self.cache.get, words))
            if None in ids:
                for w in {w for w, i in zip(words, ids, strict=True) if i is None}:
                    at = self.cache[w] = len(self.cache)
                    if at == len(self.sums):
                        self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
                    grams = subwords(w)
                    self.sums[at, :-1], self.sums[at, -1] = self.weights[grams].sum(axis=0), len(grams)
                ids = list(map(self.cache.__getitem__, words))
            total = self.sums[ids].sum(axis=0)
            out[k], letters[k] = total[:-1] / total[-1] + self.bias, True
        return out, letters

    def probabilities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        logits, letters = self.logits(texts)
        return softmax(logits / self.temperature), letters


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


#: The buckets of a text's subwords (ascending), and their shares of them.
Features = tuple[np.ndarray, np.ndarray]


def text_features(text: str, known: dict[str, np.ndarray]) -> Features:
    """The features of a whole text; `known` keeps words' subwords."""
    words, counts = np.unique(WORD.findall(text.lower()), return_counts=True)
    if not len(words):
        return np.zeros(0, np.uint16), np.zeros(0, np.float32)
    if len(known) > CACHE_WORDS:
        known.clear()
    grams = [known[w] if w in known else known.setdefault(w, subwords(w)) for w in words.tolist()]
    total = np.bincount(np.concatenate(grams), np.repeat(counts, [len(g) for g in grams]), BUCKETS)
    at = np.flatnonzero(total)
    return at.astype(np.uint16), (total[at] / total.sum()).astype(np.float32)


def fit(rows: list[tuple[Features, str]], seed: int = 7) -> Model:
    """Train on (features, language) pairs; a fifth of them is held back for calibration."""
    rows = [(f, y) for f, y in rows if len(f[0])]
    languages = sorted({y for _, y in rows})
    if not rows:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    target, features = {y: k for k, y in enumerate(languages)}, [f for f, _ in rows]
    labels = np.array([target[y] for _, y in rows])
    random = np.random.default_rng(seed)
    order = random.permutation(len(rows))
    held, train = np.split(order, [len(rows) // 5])
    embed = random.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    linear, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    embed_seen, linear_seen = np.full((BUCKETS, 1), 1e-6), np.full_like(linear, 1e-6)
    for _ in range(EPOCHS):
        for k in random.permutation(train):
            at, share = features[k]
            vector = share @ embed[at]
            error = softmax(vector @ linear + bias)
            error[labels[k]] -= 1
            to_linear, to_embed = np.outer(vector, error), np.outer(share, linear @ error)
            linear_seen += to_linear**2
            linear -= RATE * to_linear / np.sqrt(linear_seen)
            bias -= 0.01 * error
            embed_seen[at] += (to_embed**2).mean(axis=1, keepdims=True)
            embed[at] -= RATE * to_embed / np.sqrt(embed_seen[at])
    model = Model(languages, embed @ linear, bias)
    if len(held):
        logits = np.array([features[k][1] @ model.weights[features[k][0]] + bias for k in held])
        temperatures = np.geomspace(0.05, 20, 60)
        losses = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(held)), labels[held]], 1e-12)).mean() for t in temperatures]
        model.temperature = float(temperatures[int(np.argmin(losses))])
        p = softmax(logits / model.temperature)
        right = p.argmax(axis=1) == labels[held]
        model.least_score = float(np.quantile(p.max(axis=1)[right], 1 - KEPT_SHARE)) if right.any() else 0.0
    return model


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS, of_each: int = LANGUAGE_ROWS) -> Model:
    """Fit on a bounded sample: each language's texts by their least hashes, `of_each` at most, dealt in turn to
    `rows` in all; a text counts once for a language."""
    usable = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    hashed = usable.select(F.col(text).alias("t"), F.col(lang).alias("y"), F.xxhash64(F.lit("language"), F.col(text)).alias("o"))
    # First the hashes alone, so that tasks send no texts but those of the sample. Hashes are spread evenly, so of a
    # language of n texts those below a share of (2 of_each + 100) / n hold its of_each least; fewer than that
    # would take a chance of e to the minus of_each / 4 or less, and only make the sample smaller.
    counts = {r.y: r.n for r in hashed.groupBy("y").agg(F.approx_count_distinct("o").alias("n")).collect()}
    below = [(y, min(2**63 - 1, int(-(2**63) + 2**64 * (2 * of_each + 100) / max(n, 1)))) for y, n in counts.items()]
    if not below:
        return fit([])
    least = F.broadcast(labelled.sparkSession.createDataFrame(below, T.StructType([hashed.schema["y"], T.StructField("most", T.LongType())])))
    turn = F.row_number().over(Window.partitionBy("y").orderBy("o"))
    chosen = hashed.select("o", "y").join(least, "y").where("o <= most").select("o", "y").distinct().withColumn("k", turn).where(F.col("k") <= of_each).orderBy("k", "o", "y").limit(rows).select("o", "y").collect()
    if not chosen:
        return fit([])
    few = F.broadcast(labelled.sparkSession.createDataFrame([tuple(r) for r in chosen], T.StructType([T.StructField("o", T.LongType()), hashed.schema["y"]])))
    texts = hashed.join(few, ["o", "y"]).dropDuplicates(["o", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}
        for batch in batches:
            found = [text_features(t, known) for t in batch.column(0).to_pylist()]
            yield with_columns(batch.select(["o", "y"]), ["o", "y"], at=pa.array([f[0].tobytes() for f in found], pa.binary()), share=pa.array([f[1].tobytes() for f in found], pa.binary()))

    schema = T.StructType([T.StructField("o", T.LongType()), hashed.schema["y"], T.StructField("at", T.BinaryType()), T.StructField("share", T.BinaryType())])
    made = sorted(map_arrow(texts.select("t", "o", "y"), run, schema).collect(), key=lambda r: (r.o, r.y))  # `rows` at most
    return fit([((np.frombuffer(r["at"], np.uint16), np.frombuffer(r.share, np.float32)), r.y) for r in made])


def predict(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all but the text by default), lang_pred, score and rejected."""
    keep = [c for c in df.columns if c != text] if keep is None else keep
    if clash := {"lang_pred", "score", "rejected"} & set(keep):
        raise ValueError(f"columns in the way: {sorted(clash)}")
    sent = df.sparkSession.sparkContext.broadcast(model)  # buckets x languages: its size does not grow
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            if model.languages:
                p, letters = model.probabilities(texts)
                best, score = p.argmax(axis=1), np.where(letters, p.max(axis=1), 0.0)
                names = [model.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
            else:
                names, score = ["und"] * len(texts), np.zeros(len(texts))
            reject = [n == "und" or s < model.least_score for n, s in zip(names, score, strict=True)]
            rest = batch.select(batch.schema.names[1:]).rename_columns(keep)
            yield with_columns(rest, keep, lang_pred=pa.array(names, pa.string()), score=pa.array(score, pa.float64()), rejected=pa.array(reject, pa.bool_()))

    return map_arrow(text_first(df, text, keep), run, schema)
