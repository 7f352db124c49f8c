"""Token ids of documents in wavelet-matrix shards.

Documents are range-partitioned by doc_id and encoded in that order; every partition cuts its ids into
shards of about SHARD_TOKENS. A shard is one row of a Parquet file: its bit planes (each level's bits,
zeros sorted before ones), the zeros per level, rank samples, and the documents it holds. Everything
that asks something of the file (token access, count, occurrences, all ids again) reads those planes.

Defined results: a null text encodes as an empty one; every document, empty ones too, gets the end id;
rows of one doc_id are ordered by text and kept apart; a null doc_id sorts first; other columns are not
stored. An empty table makes no shard. A document is never cut, so a shard is as large as its longest
document at least.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbside.llm.common import by_chars, map_arrow

#: Ids after which a shard is closed.
SHARD_TOKENS = 1 << 20
#: Code points whose words are encoded at once; eight for each id that is decoded at once.
ENCODE_CHARS, GROUP_CHARS = 1 << 20, 1 << 21
#: Bits between two rank samples.
SAMPLE_BITS = 512
#: The most words that a worker remembers.
CACHE_WORDS = 700_000
#: Characters beyond which a word is not remembered.
LONG_WORD = 256
_LETTERS = "a-zA-Z" + "".join(chr(c) for c in range(0x80, 0x100) if chr(c).isalpha())
#: The vocabulary's own pattern on lower-case Latin-1: letters, a number, a contraction, other signs but white space.
PIECES = re.compile(f"[{_LETTERS}]+|[0-9²³¹¼½¾]|'(?:[stmd]|re|ve|ll)|[^\\t-\\r \x85\xa00-9²³¹¼½¾{_LETTERS}]+")

SHARD = "part long, start_in_part long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, levels int, zeros array<long>, planes array<binary>, samples array<binary>"


class WaveletMatrix:
    """Bit planes with rank samples over one shard's ids."""

    def __init__(self, n: int, zeros: list[int], planes: list[bytes], samples: list[bytes]) -> None:
        self.n, self.zeros, self.planes = n, zeros, [np.frombuffer(p, np.uint8) for p in planes]
        self.samples = [np.frombuffer(s, "<u4") for s in samples]

    @classmethod
    def build(cls, ids: np.ndarray, levels: int) -> WaveletMatrix:
        zeros, planes, samples, now = [], [], [], ids
        for level in range(levels - 1, -1, -1):
            ones = (now >> level & 1).astype(bool)
            plane = np.packbits(ones, bitorder="little")
            low = now[~ones]
            zeros.append(len(low))
            planes.append(plane.tobytes())
            counts = np.add.reduceat(np.bitwise_count(plane), np.arange(0, len(plane), SAMPLE_BITS // 8)) if len(plane) else np.zeros(0)
            samples.append(np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]).astype("<u4").tobytes())
            now = np.concatenate([low, now[ones]])
        return cls(len(ids), zeros, planes, samples)

    def bit(self, level: int, at: int) -> int:
        return int(self.planes[level][at >> 3]) >> (at & 7) & 1

    def rank1(self, level: int, at: int) -> int:
        """Ones before position `at`."""
        block = at // SAMPLE_BITS
        lo, hi = block * SAMPLE_BITS // 8, at >> 3
        part = int(np.bitwise_count(self.planes[level][lo:hi]).sum())
        rest = int(self.planes[level][hi]) & (1 << (at & 7)) - 1 if at & 7 else 0
        return int(self.samples[level][block]) + part + rest.bit_count()

    def select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit."""
        ones = self.samples[level].astype(np.int64)
        before = ones if bit else np.minimum(np.arange(len(ones), dtype=np.int64) * SAMPLE_BITS, self.n) - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        lo = block * SAMPLE_BITS
        bits = np.unpackbits(self.planes[level][lo // 8 : (lo + SAMPLE_BITS) // 8], bitorder="little")[: self.n - lo]
        return lo + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def access(self, at: int) -> int:
        value = 0
        for level in range(len(self.planes)):
            bit, ones = self.bit(level, at), self.rank1(level, at)
            value = value << 1 | bit
            at = self.zeros[level] + ones if bit else at - ones
        return value

    def rank(self, token: int, at: int) -> tuple[int, int]:
        """Where the token's run starts at the last level, and where its occurrences before `at` end there."""
        lo, levels = 0, len(self.planes)
        for level in range(levels):
            a, b = self.rank1(level, lo), self.rank1(level, at)
            lo, at = (self.zeros[level] + a, self.zeros[level] + b) if token >> levels - 1 - level & 1 else (lo - a, at - b)
        return lo, at

    def count(self, token: int) -> int:
        lo, hi = self.rank(token, self.n)
        return hi - lo

    def positions(self, token: int) -> list[int]:
        """Every position of the token, in order, by select from the last level up."""
        lo, hi = self.rank(token, self.n)
        out = []
        for at in range(lo, hi):
            for level in range(len(self.planes) - 1, -1, -1):
                bit = token >> len(self.planes) - 1 - level & 1
                at = self.select(level, bit, at - self.zeros[level] * bit)
            out.append(at)
        return out

    def all_ids(self) -> np.ndarray:
        """Every id: the sort of each level undone from the last one up."""
        now = np.zeros(self.n, np.uint32 if len(self.planes) > 16 else np.uint16)
        for level in range(len(self.planes) - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            up = np.empty_like(now)
            up[~ones] = now[: self.zeros[level]]
            up[ones] = now[self.zeros[level] :] | now.dtype.type(1 << len(self.planes) - 1 - level)
            now = up
        return now


class WordEncoder:
    """The library's ids for texts, one blank-separated word at a time.

    The vocabulary drops white space and no token crosses it, so a word's ids do not depend on its
    neighbours; words are encoded once and remembered. On lower-case Latin-1 the normaliser does nothing
    and the splitter finds PIECES, so there the pieces go to the library's model without those two.
    """

    def __init__(self, content: bytes) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_str(content.decode())
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocabulary = self.library.get_vocab()
        self.levels = (len(vocabulary) - 1).bit_length()
        self.kind = "<u2" if self.levels <= 16 else "<u4"
        self.suffix = getattr(self.library.model, "end_of_word_suffix", None)  # of tokens that end a piece
        self.ends = np.array([bool(self.suffix) and t.endswith(self.suffix) for t, _ in sorted(vocabulary.items(), key=lambda v: v[1])])
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # Byte-level vocabularies write printable Latin-1 bytes as themselves and the rest from U+0100 on.
        printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        others = [b for b in range(256) if b not in printable]
        self.byte_signs = "".join(chr(b) if b in printable or b == 0x20 else chr(0x100 + others.index(b)) for b in range(256))

    def by_library(self, words: list[str]) -> list[bytes]:
        """Ids of each word by the library's whole pipeline."""
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def by_model(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece by the library's model, which gets them side by side."""
        found = self.model.encode_batch_fast([codecs.charmap_decode(" ".join(pieces).encode(), "strict", self.byte_signs)[0]], add_special_tokens=False)[0]
        ids = np.array(found.ids, self.kind)
        stops = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *stops[:-1]], stops, strict=True)] if stops else []

    def learn(self, words: list[str], plain: bool) -> None:
        """Remember the ids of words not met before. plain: they are lower-case Latin-1 without special tokens."""
        if not plain:
            self.cache.update(zip(words, self.by_library(words), strict=True))
            return
        # A full stop or comma behind letters is by far the most common split.
        split = {w: (w[:-1], w[-1]) if w[-1:] in (".", ",") and w[:-1].isalpha() else PIECES.findall(w) for w in words if not w.isalpha()}
        pieces = list({w for w in words if w not in split}.union(*split.values()).difference(self.cache))
        self.cache.update(zip(pieces, self.by_model(pieces), strict=True))
        self.cache.update((w, b"".join([self.cache[v] for v in p])) for w, p in split.items())

    def look_up(self, words: list[str], plain: bool) -> list[bytes]:
        """Ids of words that differ. Those not asked for while CACHE_WORDS / 2 others came are forgotten."""
        found = list(map(self.cache.get, words))
        new = [w for w, f in zip(words, found, strict=True) if f is None]
        if new:
            kept = {w: f for w in new if (f := self.older.get(w)) is not None}
            self.cache.update(kept)
            self.learn([w for w in new if w not in kept] if kept else new, plain)
            found = [self.cache[w] if f is None else f for w, f in zip(words, found, strict=True)]
            for w in new:
                if len(w) > LONG_WORD:
                    self.cache.pop(w, None)
            if len(self.cache) > CACHE_WORDS // 2:
                self.cache, self.older = {}, self.cache
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [bool(self.suffix) and is_latin(t) and "<|" not in t for t in texts]
        out = [b""] * len(texts)
        for kind in set(plain):
            at = [k for k, p in enumerate(plain) if p == kind]
            for k, ids in zip(at, self.encode_alike([texts[k] for k in at], kind), strict=True):
                out[k] = ids
        return out

    def encode_alike(self, texts: list[str], plain: bool) -> Iterator[bytes]:
        """Each word of the texts is looked up once; Arrow numbers the words and NumPy puts their ids in place."""
        joined = "".join(t + " " for t in texts).replace("\n", " ")
        if plain:
            joined = joined.lower()  # as the vocabulary's own normaliser does, so that fewer words differ
        data = np.frombuffer(joined.encode(), np.uint8)
        stops = np.concatenate([[0], np.flatnonzero(data == 0x20) + 1])  # of words, each with the blank behind it
        counts = np.array([t.count(" ") + t.count("\n") + 1 for t in texts])
        words = pa.StringArray.from_buffers(len(stops) - 1, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(data)).dictionary_encode()
        differ = pc.binary_join(pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary), "")[0].as_py().split(" ")[:-1]
        found = self.look_up(differ, plain)
        size = np.dtype(self.kind).itemsize
        lengths = np.array(list(map(len, found)), np.int64) // size
        starts = np.cumsum(lengths) - lengths
        number = words.indices.to_numpy()
        each = lengths[number]
        stops = np.cumsum(each)  # of ids
        ids = np.frombuffer(b"".join(found), self.kind)[np.arange(stops[-1]) + np.repeat(starts[number] - (stops - each), each)]
        cuts = [0, *stops[np.cumsum(counts) - 1].tolist()]
        return (ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False))


def is_latin(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


@lru_cache(1)
def encoder(content: bytes) -> WordEncoder:
    return WordEncoder(content)


def write_shards(documents: DataFrame, path: str, tokenizer_path: str, end_id: int, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode documents (doc_id, text) and write their shards, in ascending doc_id order, under path."""
    spark = documents.sparkSession
    with open(tokenizer_path, "rb") as f:
        content = spark.sparkContext.broadcast(f.read())

    def shard(start: int, doc_ids: list[int], ids: list[bytes], enc: WordEncoder) -> pa.RecordBatch:
        wm = WaveletMatrix.build(np.frombuffer(b"".join(ids), enc.kind), enc.levels)
        size = np.dtype(enc.kind).itemsize
        row = [TaskContext.get().partitionId(), start, wm.n, doc_ids, [len(i) // size for i in ids], enc.levels, wm.zeros, [p.tobytes() for p in wm.planes], [s.tobytes() for s in wm.samples]]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in SHARD.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(content.value)
        end = np.array([end_id], enc.kind).tobytes()
        start = held = 0
        doc_ids: list[int] = []
        ids: list[bytes] = []
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            coded = (c for lo, hi in by_chars(texts, ENCODE_CHARS) for c in enc.encode(texts[lo:hi]))
            for doc_id, found in zip(batch.column(0).to_pylist(), coded, strict=True):
                doc_ids.append(doc_id)
                ids.append(found + end)
                held += len(ids[-1]) // np.dtype(enc.kind).itemsize
                if held >= shard_tokens:
                    yield shard(start, doc_ids, ids, enc)
                    start, held, doc_ids, ids = start + held, 0, [], []
        if ids:
            yield shard(start, doc_ids, ids, enc)

    ordered = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    # The planes hold the entropy of the ids already; zstd takes what is left of it.
    map_arrow(ordered, run, SHARD).write.option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The shards with `start`, the ids before each one in the whole file."""
    shards = spark.read.schema(SHARD).parquet(path)
    # One row for each partition that wrote: their running sum is the only thing done in one task.
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # A row for each task that wrote: no more than the scheduler holds of that job anyway.
    return shards.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("start_in_part")).drop("base")


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of every stored document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = WaveletMatrix(row["n_tokens"], row["zeros"], row["planes"], row["samples"]).all_ids()
                cuts = np.concatenate([[0], np.cumsum(row["doc_tokens"])])
                # A few thousand documents at once leave the worker, never a whole shard's ids twice.
                for lo, hi in by_chars([range(n) for n in row["doc_tokens"]], GROUP_CHARS // 8):
                    pieces = [ids[cuts[k] : cuts[k + 1]].astype("<u4").tobytes() for k in range(lo, hi)]
                    yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"][lo:hi], pa.int64()), pa.array(row["start"] + cuts[lo:hi], pa.int64()), pa.array(row["doc_tokens"][lo:hi], pa.int64()), pa.array(pieces, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return map_arrow(shards.select("start", "n_tokens", "doc_ids", "doc_tokens", "zeros", "planes", "samples"), run, "doc_id long, start long, n_tokens long, ids binary")


def count_token(shards: DataFrame, token: int) -> DataFrame:
    """How often the token occurs in each shard (start, n), by rank on the planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            found = [WaveletMatrix(r["n_tokens"], r["zeros"], r["planes"], r["samples"]).count(token) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array([r["start"] for r in rows], pa.int64()), pa.array(found, pa.int64())], names=["start", "n"])

    return map_arrow(shards.select("start", "n_tokens", "zeros", "planes", "samples"), run, "start long, n long")


def locate_token(shards: DataFrame, token: int) -> DataFrame:
    """Every position of the token in the whole file, by select on the planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found = WaveletMatrix(r["n_tokens"], r["zeros"], r["planes"], r["samples"]).positions(token)
                yield pa.RecordBatch.from_arrays([pa.array([r["start"] + p for p in found], pa.int64())], names=["position"])

    return map_arrow(shards.select("start", "n_tokens", "zeros", "planes", "samples"), run, "position long")

