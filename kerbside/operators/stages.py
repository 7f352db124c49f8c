"""Cutting lineage: a table written once in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session without one gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        found = f"file://{tempfile.mkdtemp(prefix='kerbside-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """df as a Parquet table: worked out once, whatever is built on it, and not again if an executor is lost.

    It lives as long as the shared folder; unlike checkpoint(), it takes one job and keeps columns prunable.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kerbside/{spark.sparkContext.applicationId}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
