"""Depth runs in NPZ files: a row for each frame."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from kerbside.session import ship_package

FRAMES = "path string, frame int, height int, width int, depth array<float>, confidence array<float>, k array<float>, e array<float>"
NEEDED = ("depth", "confidence", "intrinsics", "extrinsics")


def frames(name: str, content: bytes) -> Iterator[pd.DataFrame]:
    """The frames of one archive, one at a time; float32 arrays in C order only."""
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        if missing := [n for n in NEEDED if n not in z]:
            raise ValueError(f"{name} lacks {', '.join(missing)}")
        depth, confidence, k, e = (z[n] for n in NEEDED)
    for a in (depth, confidence, k, e):
        if a.dtype != np.dtype("<f4") or not a.flags.c_contiguous:
            raise ValueError(f"{name}: arrays must be little-endian float32 in C order")
    for i in range(len(depth)):
        yield pd.DataFrame({"path": [name], "frame": [i], "height": [depth.shape[1]], "width": [depth.shape[2]], "depth": [depth[i].ravel()], "confidence": [confidence[i].ravel()], "k": [k[i].ravel()], "e": [e[i].ravel()]})


def parse(files: DataFrame) -> DataFrame:
    """The frames of NPZ files (path, content)."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for name, content in zip(b["path"], b["content"], strict=True):
                yield from frames(name, content)

    return files.select("path", "content").mapInPandas(run, FRAMES)


def read_depth_runs(spark: SparkSession, path: str) -> DataFrame:
    """Frames of every NPZ file under path, read by Spark's binary source."""
    return parse(spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(path))
