"""A corpus pipeline of five operators over documents.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; every stage but the
last returns the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm import bytebpe, catalog, contamination, dartminhash, secrets, toxicity
from kerbside.llm.common import drop_stages, stage, staged


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain calls toxic go."""
    return toxicity.score(docs, catalog.toxic_chain(spark, docs, sf_dir)).where(~F.col("is_toxic")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near-duplicates stays."""
    return dartminhash.representatives(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark windows beyond the contract's share go."""
    return contamination.clean(docs, catalog.table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets give way to a mark, and n_chars follows."""
    found = secrets.redact(secrets.scan(docs, catalog.RANKS, catalog.public_tokenizers.PATTERN))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.size("secret_spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each document, and whether they decode to its text's bytes."""
    return bytebpe.encode(docs, catalog.RANKS, keep=["doc_id"], checked=True).select("doc_id", "n_tokens", "ids", "intact")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("byte_bpe", encode_tokens),
]

#: SQL cannot express the trained chain, the token-efficiency test or the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written and read again; what it and the stages before it staged goes then."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = len(staged(spark))
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
        drop_stages(spark, first, keep=(staged(spark)[-1],))
    return STAGES[-1][1](spark, docs, sf_dir)
