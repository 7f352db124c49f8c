"""GeoJSON files of markers and roads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "features array<struct<geometry: struct<type: string, coordinates: array<double>>, properties: struct<road: string, km: double>>>"
LINES = "features array<struct<geometry: struct<type: string, coordinates: array<array<double>>>, properties: struct<road: string>>>"


def read_markers(spark: SparkSession, path: str, default_road: str) -> DataFrame:
    """road, km, mlat, mlon of every point with two coordinates."""
    f = spark.read.schema(POINTS).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    at = F.col("f.geometry.coordinates")
    return f.where(F.size(at) >= 2).select(F.coalesce("f.properties.road", F.lit(default_road)).alias("road"), F.col("f.properties.km").alias("km"), at[1].alias("mlat"), at[0].alias("mlon"))


def read_roads(spark: SparkSession, path: str) -> DataFrame:
    """road, ord, lat, lon of every vertex of lines with two at least."""
    f = spark.read.schema(LINES).option("multiLine", True).json(path).select(F.explode("features").alias("f")).where(F.size("f.geometry.coordinates") >= 2)
    return f.select(F.col("f.properties.road").alias("road"), F.posexplode("f.geometry.coordinates").alias("ord", "c")).select("road", "ord", F.col("c")[1].alias("lat"), F.col("c")[0].alias("lon"))
