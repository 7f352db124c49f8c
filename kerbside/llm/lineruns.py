"""Line dedup: lines that many documents share go, by levelled sorted runs of line hashes.

A line's key is the line without blanks (space and 0x09 to 0x0D) at both ends and with A-Z lower-cased; it
is known by 128 bits of its BLAKE2b digest. `LineRuns` counts the documents that hold each key, batch by
batch. A run is a Parquet table (key, n) sorted by key inside buckets by key, split into settled keys,
which enough documents hold, and open ones. A new batch is counted by key (each batch of texts first
counts its own), merge-anti-joins the settled keys of the runs there are, since nothing more needs to be
known of them, and its open keys become a run of level 0. FAN_IN runs of a level are compacted into one of
the next: equal buckets meet in one task, so neither the anti-joins nor compaction shuffles a run. B
batches thus rewrite a key about log B times (base FAN_IN).

`drop_common` takes the settled keys out of texts. The HOT_KEYS of the most documents, as counted until
they were settled (16 bytes each), are broadcast and dropped inside tasks that read the texts. Where there
are more, the rest is joined by shuffle: one row for each key of each distinct text, and what goes comes
back to texts by their digest. A key that got hot only after it was settled, and a text of very many
copies, are left to Spark's skew join there.

Defined results: a null or empty text is one empty line; a null stays null; empty keys never go; every
row is a document of its own, so repeated rows count and come back each; an empty table has no keys and
gives an empty result; other columns pass through, but for the names of new ones (n_lines, n_dropped),
which raise ValueError. Texts are read whole, one at a time. A batch id that was added once is not added
again, so a repeated micro-batch does no harm.
"""

from __future__ import annotations

import contextlib
import uuid
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.llm.common import free_names, map_arrow, new_path, stage, text_first, with_columns

#: Runs of a level that become one of the next.
FAN_IN = 4
#: Keys that are broadcast, those of the most documents: 4 MB.
HOT_KEYS = 250_000
BLANKS = b" \t\n\v\f\r"
RUN = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("n", T.LongType())])
#: Bucketed tables whose buckets are one sorted file each are then read as sorted.
SORTED_READ = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_key(line: bytes) -> bytes:
    """128 bits for a line; none for a line of blanks."""
    key = line.strip(BLANKS).lower()  # bytes.lower() changes A-Z alone
    return blake2b(key, digest_size=16).digest() if key else b""


def raw_texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column(0).cast(pa.binary()).to_pylist()


def line_keys(docs: DataFrame, text: str = "text") -> DataFrame:
    """(key, n): the documents of a batch of texts that hold a key; a key may come from many batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[bytes] = Counter()
            for t in raw_texts(batch):
                counts.update({line_key(x) for x in t.split(b"\n")} if t else ())
            counts.pop(b"", None)
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=RUN.names)

    return map_arrow(text_first(docs, text, []), run, RUN)


@contextlib.contextmanager
def sorted_reads(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(SORTED_READ, None)
    spark.conf.set(SORTED_READ, "true")
    try:
        yield
    finally:
        spark.conf.unset(SORTED_READ) if before is None else spark.conf.set(SORTED_READ, before)


class LineRuns:
    """Counts of line keys, for keys that `least` documents hold."""

    def __init__(self, spark: SparkSession, least: int = 10, fan_in: int = FAN_IN) -> None:
        self.spark, self.least, self.fan_in = spark, least, fan_in
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))  # so a counted batch is dealt like the runs
        self.levels: list[list[str]] = []
        self.seen: set[int] = set()

    def add(self, docs: DataFrame, batch_id: int | None = None, text: str = "text") -> None:
        """Count a batch of documents: one new run, and compaction where a level is full."""
        if batch_id is not None and batch_id in self.seen:
            return
        with sorted_reads(self.spark):
            fresh = line_keys(docs, text).groupBy("key").agg(F.sum("n").alias("n"))
            for run in self.runs():
                fresh = fresh.join(self.read(run).where("settled").select("key").hint("merge"), "key", "left_anti")
            self.put(0, fresh)
            level = 0
            while len(self.levels[level]) >= self.fan_in:
                self.compact(level, level + 1)
                level += 1
        if batch_id is not None:
            self.seen.add(batch_id)

    def settled(self) -> DataFrame:
        """(key, n) of the keys that enough documents hold; n counts until the key was settled."""
        with sorted_reads(self.spark):
            if len(self.runs()) > 1:
                for level in range(len(self.levels) - 1):
                    self.levels[level + 1][:0] = self.levels[level]
                    self.levels[level] = []
                self.compact(len(self.levels) - 1, len(self.levels) - 1)
        found = self.runs()
        return self.read(found[0]).where("settled").select(*RUN.names) if found else self.spark.createDataFrame([], RUN)

    def drop(self) -> None:
        """Forget the runs; their files go with drop_stages()."""
        for run in self.runs():
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        self.levels = []

    def runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def read(self, run: str) -> DataFrame:
        return self.spark.table(run)

    def put(self, level: int, keys: DataFrame) -> None:
        name = f"kerbside_run_{uuid.uuid4().hex}"
        split = keys.select("key", "n", (F.col("n") >= self.least).alias("settled"))
        split.write.partitionBy("settled").bucketBy(self.buckets, "key").sortBy("key").option("compression", "zstd").option("path", new_path(self.spark, "lineruns")).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def compact(self, level: int, target: int) -> None:
        old, self.levels[level] = self.levels[level], []
        every = self.read(old[0])
        for run in old[1:]:
            every = every.union(self.read(run))
        self.put(target, every.groupBy("key").agg(F.sum("n").alias("n")))
        for run in old:
            self.spark.sql(f"DROP TABLE {run}")


def file_batches(docs: DataFrame, most: int) -> list[DataFrame]:
    """docs by groups of its files, at most so many; all at once where no files are under it."""
    if not docs.inputFiles():
        return [docs]
    path = F.col("_metadata.file_path")  # inputFiles() writes some paths another way
    files = sorted(r[0] for r in docs.select(path).distinct().collect())
    return [docs.where(path.isin(files[k::most])) for k in range(min(most, len(files)))]


def drop_common(docs: DataFrame, settled: DataFrame, text: str = "text", keep: list[str] | None = None, hot_keys: int = HOT_KEYS) -> DataFrame:
    """The kept columns (all by default), the text without lines of settled keys, n_lines and n_dropped."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != text]
    if clash := {"n_lines", "n_dropped"} & {c.lower() for c in (*keep, text)}:
        raise ValueError(f"columns in the way: {sorted(clash)}")
    spark = docs.sparkSession
    hot = [r.key for r in settled.orderBy(F.desc("n"), "key").limit(hot_keys + 1).select("key").toLocalIterator()]
    if len(hot) > hot_keys:
        hot = hot[:hot_keys]
        docs, rest = with_cold_keys(docs, settled, hot, text)
    else:
        rest = None
    shared = spark.sparkContext.broadcast(b"".join(bytes(k) for k in hot))
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(text, T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob = shared.value
        common = {blob[k : k + 16] for k in range(0, len(blob), 16)}
        for batch in batches:
            texts, lines, dropped = [], [], []
            own = batch.column(batch.num_columns - 1).to_pylist() if rest else [None] * batch.num_rows
            for t, more in zip(raw_texts(batch), own, strict=True):
                every = (t or b"").split(b"\n")
                gone = common.union(more) if more else common
                kept = [x for x in every if line_key(x) not in gone]
                texts.append(None if t is None else b"\n".join(kept))
                lines.append(len(every))
                dropped.append(len(every) - len(kept))
            rows = batch.select(batch.schema.names[1 : len(keep) + 1]).rename_columns(keep)
            yield with_columns(rows, keep, **{text: pa.array(texts, pa.binary()).view(pa.string()), "n_lines": pa.array(lines, pa.int64()), "n_dropped": pa.array(dropped, pa.int64())})

    return map_arrow(text_first(docs, text, [*keep, *([rest] if rest else [])]), run, schema)


def with_cold_keys(docs: DataFrame, settled: DataFrame, hot: list[bytes], text: str) -> tuple[DataFrame, str]:
    """docs with one more column, the text's settled keys that are not hot (null if none), and its name."""
    spark, columns = docs.sparkSession, docs.columns
    rest, digest = free_names(columns, "_keys", "_digest")
    few = F.broadcast(spark.createDataFrame([(bytes(k),) for k in hot], "key binary"))
    cold = settled.select("key").join(few, "key", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for whole in set(raw_texts(batch)) - {None}:
                keys = {line_key(x) for x in whole.split(b"\n")} - {b""}
                yield pa.RecordBatch.from_arrays([pa.array([blake2b(whole, digest_size=16).digest()] * len(keys), pa.binary()), pa.array(keys, pa.binary())], names=["digest", "key"])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [None if t is None else blake2b(t, digest_size=16).digest() for t in raw_texts(batch)]
            rows = batch.select(batch.schema.names[1:]).rename_columns(columns)
            yield with_columns(rows, columns, **{digest: pa.array(digests, pa.binary())})

    pairs = map_arrow(text_first(docs, text, []), run, "digest binary, key binary").join(few, "key", "left_anti")
    found = stage(pairs.join(cold, "key").groupBy("digest").agg(F.collect_set("key").alias(rest)).withColumnRenamed("digest", digest), "coldlines")
    marked = map_arrow(text_first(docs, text, columns), mark, T.StructType([*docs.schema, T.StructField(digest, T.BinaryType())]))
    return marked.join(found, digest, "left").drop(digest), rest
