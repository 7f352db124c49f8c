"""Point clouds in binary glTF files (GLB, version 2): a row for each point."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kerbside.session import ship_package

POINTS = "path string, i long, x double, y double, z double, red int, green int, blue int, alignment array<double>"
#: Fixed values of the format: its magic number, chunk kinds, component types and components, and the mode of points.
MAGIC, JSON_CHUNK, BIN_CHUNK = 0x46546C67, 0x4E4F534A, 0x004E4942
COMPONENTS = {5121: "<u1", 5123: "<u2", 5126: "<f4"}
WIDTHS = {"VEC3": 3, "VEC4": 4}
POINT_MODE = 0
#: Points in one batch.
ROWS = 65536


def chunks(content: bytes) -> tuple[dict, bytes]:
    """A file's JSON and binary chunk."""
    if len(content) < 12 or struct.unpack_from("<II", content)[0] != MAGIC:
        raise ValueError("no GLB file")
    magic, version, whole = struct.unpack_from("<III", content)
    if version != 2 or whole > len(content):
        raise ValueError(f"GLB version {version} of {whole} bytes in a file of {len(content)}")
    found, at = {}, 12
    while at + 8 <= whole:
        size, kind = struct.unpack_from("<II", content, at)
        found.setdefault(kind, content[at + 8 : at + 8 + size])
        at += 8 + size
    if JSON_CHUNK not in found:
        raise ValueError("a GLB file without JSON")
    return json.loads(found[JSON_CHUNK]), found.get(BIN_CHUNK, b"")


def accessor(head: dict, body: bytes, number: int) -> np.ndarray:
    """The rows of an accessor, whatever its stride."""
    a = head["accessors"][number]
    view = head["bufferViews"][a["bufferView"]]
    kind, width = np.dtype(COMPONENTS[a["componentType"]]), WIDTHS[a["type"]]
    start = view.get("byteOffset", 0) + a.get("byteOffset", 0)
    step = view.get("byteStride", kind.itemsize * width)
    if a["count"] and start + step * (a["count"] - 1) + kind.itemsize * width > len(body):
        raise ValueError("an accessor reaches past the binary chunk")
    return np.ndarray((a["count"], width), kind, body, start, (step, kind.itemsize))


def alignment(head: dict) -> list[float] | None:
    """The row-major 4 x 4 matrix that the scene's extras give as hf_alignment; null unless it is one of finite numbers."""
    for scene in head.get("scenes", [])[head.get("scene", 0) :][:1]:
        rows = scene.get("extras", {}).get("hf_alignment")
        if isinstance(rows, list) and len(rows) == 4 and all(isinstance(r, list) and len(r) == 4 for r in rows):
            flat = [v for r in rows for v in r]
            if all(isinstance(v, int | float) and not isinstance(v, bool) and np.isfinite(v) for v in flat):
                return [float(v) for v in flat]
    return None


def clouds(content: bytes) -> Iterator[tuple[np.ndarray, np.ndarray | None, list[float] | None]]:
    """Positions, colours of 0 to 255 (if any) and the alignment of each primitive of points."""
    head, body = chunks(content)
    aligned = alignment(head)
    for mesh in head.get("meshes", []):
        for part in mesh.get("primitives", []):
            if part.get("mode", 4) != POINT_MODE or "POSITION" not in part["attributes"]:
                continue
            places = accessor(head, body, part["attributes"]["POSITION"]).astype(float)
            colours = None
            if "COLOR_0" in part["attributes"]:
                raw = accessor(head, body, part["attributes"]["COLOR_0"])[:, :3]
                most = {"f": 1.0, "u": float(np.iinfo(raw.dtype).max) if raw.dtype.kind == "u" else 1.0}[raw.dtype.kind]
                colours = np.floor(raw / most * 255 + 0.5).astype(int)
            yield places, colours, aligned


def pack(places: np.ndarray, colours: np.ndarray | None = None, aligned: list[list[float]] | None = None) -> bytes:
    """A file of one cloud."""
    body = np.ascontiguousarray(places, "<f4").tobytes()
    views, accessors, attributes = [{"buffer": 0, "byteOffset": 0, "byteLength": len(body)}], [{"bufferView": 0, "componentType": 5126, "count": len(places), "type": "VEC3"}], {"POSITION": 0}
    if colours is not None:
        four = np.column_stack([colours, np.full(len(colours), 255)]).astype("<u1").tobytes()
        views.append({"buffer": 0, "byteOffset": len(body), "byteLength": len(four)})
        accessors.append({"bufferView": 1, "componentType": 5121, "normalized": True, "count": len(places), "type": "VEC4"})
        attributes["COLOR_0"], body = 1, body + four
    scene = {"nodes": [0]} | ({"extras": {"hf_alignment": aligned}} if aligned else {})
    head = json.dumps({"asset": {"version": "2.0"}, "scene": 0, "scenes": [scene], "nodes": [{"mesh": 0}], "meshes": [{"primitives": [{"attributes": attributes, "mode": POINT_MODE}]}], "accessors": accessors, "bufferViews": views, "buffers": [{"byteLength": len(body)}]}).encode()
    head, body = head + b" " * (-len(head) % 4), body + bytes(-len(body) % 4)
    return struct.pack("<III", MAGIC, 2, 28 + len(head) + len(body)) + struct.pack("<II", len(head), JSON_CHUNK) + head + struct.pack("<II", len(body), BIN_CHUNK) + body


def parse(files: DataFrame) -> DataFrame:
    """The points of GLB files (path, content), in batches."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                start = 0
                for places, colours, aligned in clouds(content):
                    for k in range(0, len(places), ROWS):
                        p = places[k : k + ROWS]
                        n = len(p)
                        shade = [pa.nulls(n, pa.int32())] * 3 if colours is None else [pa.array(colours[k : k + ROWS, c], pa.int32()) for c in range(3)]
                        yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(start + k, start + k + n)), *(pa.array(p[:, c]) for c in range(3)), *shade, pa.array([aligned] * n, pa.list_(pa.float64()))], names=["path", "i", "x", "y", "z", "red", "green", "blue", "alignment"])
                    start += len(places)

    return files.select("path", "content").mapInArrow(run, POINTS)


def read_clouds(spark: SparkSession, path: str) -> DataFrame:
    """The points of every GLB file under path, read by Spark's binary source from any store it reaches."""
    return parse(spark.read.format("binaryFile").option("pathGlobFilter", "*.glb").load(path))
