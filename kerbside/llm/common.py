"""What the corpus operators share: staged tables and batch helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.session import ship_package

#: The most rows and bytes of one Arrow batch.
BATCH_ROWS, BATCH_BYTES = 1024, 1 << 24
#: Bytes of rows up to which a table is broadcast; a larger one is joined by shuffle.
BROADCAST_BYTES = 32 << 20
#: Whether Parquet asks for a column's ranges at once. From local files each range comes through a direct buffer of its
#: size (up to a row group's column), which its thread keeps; read one after the other, they are heap only.
RANGES_AT_ONCE = "parquet.hadoop.vectored.io.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees. A local session without spark.checkpoint.dir gets a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        found = f"file://{tempfile.mkdtemp(prefix='kerbside-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no one uses yet; drop_stages() knows it."""
    path = f"{shared_dir(spark)}/kerbside/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    staged(spark).append(path)
    return path


def staged(spark: SparkSession) -> list[str]:
    """Paths this application has staged and not dropped, oldest first."""
    context = spark.sparkContext
    if not hasattr(context, "_kerbside_staged"):
        context._kerbside_staged = []
    return context._kerbside_staged


def read_in_turn(spark: SparkSession) -> None:
    """From now on Parquet tables are read without large direct buffers, unless the session says otherwise."""
    if spark.conf.get(RANGES_AT_ONCE, None) is None:
        spark.conf.set(RANGES_AT_ONCE, "false")


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema) in batches that fit a worker even when texts are long.

    Lowers the session's limits on Arrow batches to BATCH_ROWS and BATCH_BYTES where they are above, and
    leaves them so: Spark reads them when the plan runs, not when it is made.
    """
    ship_package(df.sparkSession)
    read_in_turn(df.sparkSession)
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(key, None)
        if now is not None and not 0 < int(now.rstrip("b")) <= most:
            conf.set(key, str(most))
    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return to the system what a Python worker has freed: it lives on, and its memory counts beside the executor's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    Cuts the lineage the way checkpoint() does, but keeps columns prunable; a lost executor costs
    no recomputation. Tables live until drop_stages() or as long as the shared folder.
    """
    spark = df.sparkSession
    read_in_turn(spark)
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def row_bytes(column: Column, kind: T.DataType) -> Column:
    """About the bytes that a value takes in a broadcast, upwards."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return 24 + F.coalesce(F.octet_length(column), F.lit(0))
    if isinstance(kind, T.ArrayType):
        each = F.aggregate(column, F.lit(0).cast("long"), lambda acc, v: acc + row_bytes(v, kind.elementType))
        return 32 + F.coalesce(each, F.lit(0))
    if isinstance(kind, T.StructType):
        return sum((row_bytes(column[f.name], f.dataType) for f in kind), F.lit(16))
    return F.lit(16)


def smaller(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its rows have BROADCAST_BYTES at most; df should be cheap to read."""
    size = df.agg(F.sum(sum((row_bytes(F.col(f.name), f.dataType) for f in df.schema), F.lit(32)).cast("long"))).first()[0]
    return F.broadcast(df) if (size or 0) <= BROADCAST_BYTES else df


def drop_stages(spark: SparkSession, first: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete the tables that this application staged, from the first-th on, but for those to keep."""
    jvm, paths = spark.sparkContext._jvm, staged(spark)
    for name in [p for p in paths[first:] if p not in keep]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        paths.remove(name)


def text_first(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The text and after it the kept columns, under names that cannot clash."""
    return df.select(F.col(text).cast("string").alias("_text"), *(F.col(c).alias(f"_{k}") for k, c in enumerate(keep)))


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, with marks added to those that the columns have already."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def text_key(text: Column) -> Column:
    """Tells apart rows that share a doc_id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def by_chars(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` code points; a longer text stands alone."""
    start = size = 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > start and size + n > most:
            yield start, k
            start, size = k, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def with_columns(batch: pa.RecordBatch, keep: list[str], **new: pa.Array) -> pa.RecordBatch:
    """The named columns of batch, and new ones."""
    return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new.values()], names=[*keep, *new])


def flat(values: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(values) if values else np.zeros(0, kind)
