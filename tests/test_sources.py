"""GLB files: round trips, strides, several clouds, and files that are none."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.functions import vectors
from kerbside.plans import files
from kerbside.sources import glb


def test_a_packed_cloud_comes_back(spark, tmp_path):
    d = np.random.default_rng(1)
    places, shade = d.normal(size=(200, 3)).astype("<f4"), d.integers(0, 256, (200, 3))
    turn = d.normal(size=(4, 4)).tolist()
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.glb").write_bytes(glb.pack(places, shade, turn))
    (tmp_path / "b.glb").write_bytes(glb.pack(places[:1]))
    (tmp_path / "c.glb").write_bytes(glb.pack(places[:0]))
    (tmp_path / "note.txt").write_text("no cloud")
    rows = glb.read_clouds(spark, f"file://{tmp_path}").orderBy("path", "i").collect()
    a, b = rows[:200], rows[200:]
    assert np.allclose([(r.x, r.y, r.z) for r in a], places) and [[r.red, r.green, r.blue] for r in a] == shade.tolist()
    assert a[0].alignment == pytest.approx(sum(turn, [])) and len(b) == 1 and b[0].red is None and b[0].alignment is None
    assert a[0].path.endswith("a.glb") and [r.i for r in a] == list(range(200))


def file(head, body):
    head = json.dumps(head).encode()
    head += b" " * (-len(head) % 4)
    return struct.pack("<III", glb.MAGIC, 2, 28 + len(head) + len(body)) + struct.pack("<II", len(head), glb.JSON_CHUNK) + head + struct.pack("<II", len(body), glb.BIN_CHUNK) + body


def test_interleaved_and_several_primitives():
    rows = [(float(k), 1.0, 2.0, k * 6553, 0, 65535, 0) for k in range(10)]
    body = b"".join(struct.pack("<fffHHHH", *r) for r in rows)
    head = {
        "accessors": [{"bufferView": 0, "componentType": 5126, "count": 10, "type": "VEC3"}, {"bufferView": 0, "byteOffset": 12, "componentType": 5123, "count": 10, "type": "VEC4"}],
        "bufferViews": [{"buffer": 0, "byteLength": len(body), "byteStride": 20}],
        "meshes": [{"primitives": [{"attributes": {"POSITION": 0, "COLOR_0": 1}, "mode": 0}, {"attributes": {"POSITION": 0}, "mode": 4}]}, {"primitives": [{"attributes": {"POSITION": 0}, "mode": 0}]}],
    }
    (a, shade, _), (b, none, _) = glb.clouds(file(head, body))
    assert a.tolist() == b.tolist() == [[float(k), 1.0, 2.0] for k in range(10)] and none is None
    assert shade[:, 2].tolist() == [255] * 10 and shade[:, 0].tolist() == [round(k * 6553 / 65535 * 255) for k in range(10)]


def test_what_is_no_cloud_raises():
    good = glb.pack(np.zeros((3, 3)))
    for bad in (b"", b"glTF", b"x" * 40, good[:20], struct.pack("<III", glb.MAGIC, 1, 12)):
        with pytest.raises(ValueError):
            list(glb.clouds(bad))
    head, body = glb.chunks(good)
    head["accessors"][0]["count"] = 99
    with pytest.raises(ValueError, match="past"):
        list(glb.clouds(file(head, body)))


@pytest.mark.parametrize("odd", [None, [], [[1, 2, 3, 4]] * 3, [[1, 2, 3]] * 4, [[1, 2, 3, "4"]] * 4, [[1, 2, 3, True]] * 4, [[float("inf"), 0, 0, 0]] * 4])
def test_odd_alignments_count_as_none(odd):
    assert glb.alignment({"scenes": [{"extras": {"hf_alignment": odd}}]}) is None
    assert glb.alignment({}) is None


def test_matrices(spark):
    d = np.random.default_rng(2)
    a, b, v = d.normal(size=(4, 4)), d.normal(size=(4, 4)), d.normal(size=3)
    df = spark.createDataFrame([(a.ravel().tolist(), b.ravel().tolist(), *v.tolist())], "a array<double>, b array<double>, x double, y double, z double")
    at = vectors.vector(*(F.col(c) for c in "xyz"))
    r = df.select(vectors.transformed(vectors.matrix_product(F.col("a"), F.col("b")), at).alias("m"), vectors.camera_centre(F.col("a")).alias("c"), vectors.transformed(vectors.scaled_about(at, F.lit(3.0)), vectors.vector(F.lit(1), F.lit(1), F.lit(1))).alias("s"), vectors.transformed(F.array(*[F.lit(0.0)] * 16), at).alias("n")).first()
    h = a @ b @ np.append(v, 1)
    assert tuple(r.m) == pytest.approx(h[:3] / h[3]) and tuple(r.c) == pytest.approx(-a[:3, :3].T @ a[:3, 3]) and tuple(r.s) == pytest.approx(v + 3 * (1 - v))
    assert tuple(r.n) == (None, None, None)


def test_files_of_roads_are_fewer_than_roads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "folder", lambda s, label: f"file://{tmp_path}/{label}")
    roads = files.geojson_roads(spark, "/root/testdata/sf0.001").select("road").distinct().count()
    assert len(list(tmp_path.glob("roads/*.txt"))) * 4 < roads or roads < files.ROADS_IN_FILE
    monkeypatch.setattr(files, "ROADS_IN_FILE", 4)
    monkeypatch.setattr(files, "folder", lambda s, label: f"file://{tmp_path}/more-{label}")
    assert files.geojson_roads(spark, "/root/testdata/sf0.001").select("road").distinct().count() == roads
