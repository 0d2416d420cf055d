"""Readers and writers: round trips over files made here."""

from __future__ import annotations

import json

import numpy as np
import pytest
from terraloom.sources import clouds, sinks, vectors

from .conftest import rows


def cloud(n=300, seed=1):
    r = np.random.default_rng(seed)
    return {"x": r.uniform(0, 90, n).round(3), "y": r.uniform(0, 90, n).round(3), "z": r.uniform(-3, 10, n).round(3), "intensity": r.uniform(0, 1, n), "return_number": r.integers(1, 3, n), "num_returns": r.integers(3, 5, n), "class": r.choice([2, 5, 6, 7], n)}


def test_las(spark, tmp_path):
    c = cloud()
    (tmp_path / "a.las").write_bytes(clouds.encode_las(c))
    got = clouds.read(spark, str(tmp_path), "las").toPandas()
    keep = c["class"] != 7
    assert len(got) == keep.sum() and sorted(got.x.round(3)) == sorted(c["x"][keep])
    assert set(got["class"]) == {2, 5, 6} and got.intensity.between(0, 1).all() and set(got.num_returns) <= {3, 4}
    assert clouds.read(spark, str(tmp_path), "las", keep_noise=True).count() == 300
    assert clouds.read(spark, str(tmp_path), "las", keep_noise=True, box=(0, 0, 45, 90)).count() == (c["x"] <= 45).sum()
    h = clouds.headers(spark, str(tmp_path)).first()
    assert h.points == 300 and h.minx == pytest.approx(c["x"].min(), abs=1e-3)
    with pytest.raises(ValueError):
        clouds.decode_las(b"LASX" + bytes(300))


def test_kitti(spark, tmp_path):
    c = cloud(50)
    (tmp_path / "a.bin").write_bytes(clouds.encode_kitti(c))
    got = clouds.read(spark, str(tmp_path), "bin").toPandas()
    assert np.allclose(sorted(got.x), sorted(c["x"]), atol=1e-4)
    k, i = clouds.decode_kitti_labels(clouds.encode_kitti_labels(c["class"], np.arange(50)))
    assert k.tolist() == c["class"].tolist() and i.tolist() == list(range(50))
    with pytest.raises(ValueError):
        clouds.decode_kitti(b"123")


def test_pcd_ply_text(spark, tmp_path):
    p = np.array([[1, 2, 3, 200], [4, 5, 6, 100], [np.nan, 0, 0, 0]], "<f4")
    head = "# .PCD\nVERSION .7\nFIELDS x y z intensity\nSIZE 4 4 4 4\nTYPE F F F F\nCOUNT 1 1 1 1\nWIDTH 3\nHEIGHT 1\nPOINTS 3\nDATA {}\n"
    (tmp_path / "a.pcd").write_bytes(head.format("binary").encode() + p.tobytes())
    (tmp_path / "b.pcd").write_bytes(head.format("ascii").encode() + b"1 2 3 200\n4 5 6 100\nnan 0 0 0\n")
    raw = b"".join(p[:, i].tobytes() for i in range(4))
    packed = b"".join(bytes([len(raw[k : k + 32]) - 1]) + raw[k : k + 32] for k in range(0, len(raw), 32))
    (tmp_path / "c.pcd").write_bytes(head.format("binary_compressed").encode() + np.array([len(packed), len(raw)], "<u4").tobytes() + packed)
    got = clouds.read(spark, str(tmp_path), "pcd").toPandas()
    assert sorted(got.x) == [1, 1, 1, 4, 4, 4] and got.intensity.max() == pytest.approx(200 / 255)
    ply = "ply\nformat {}\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar label\nend_header\n"
    (tmp_path / "a.ply").write_text(ply.format("ascii 1.0") + "1 2 3 4\n5 6 7 8\n")
    v = np.array([(1, 2, 3, 4), (5, 6, 7, 8)], [("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("label", "u1")])
    (tmp_path / "b.ply").write_bytes(ply.format("binary_little_endian 1.0").encode() + v.tobytes())
    got = clouds.read(spark, str(tmp_path), "ply").toPandas()
    assert sorted(got["class"]) == [4, 4, 8, 8]
    (tmp_path / "a.xyz").write_text("x,y,z,i,c\n1,2,3,0.5,2\n4;5;6;0.25;6\n")
    assert rows(clouds.read(spark, str(tmp_path), "xyz").select("x", "intensity", "class")) == [(1.0, 0.5, 2), (4.0, 0.25, 6)]
    with pytest.raises(ValueError, match="las"):
        clouds.adapter_for("x.foo")


def test_lzf_back_references():
    assert clouds.lzf_decompress(bytes([2]) + b"abc" + bytes([(4 << 5), 2]), 9) == b"abcabcabc"


def test_union_and_datum(spark):
    a = spark.createDataFrame([(5.0, 7.0, 1.0, 3)], "x double, y double, z double, k int")
    b = spark.createDataFrame([(6.0, 9.0, 1.0)], "x double, y double, z double")
    assert rows(clouds.union(a, b).select("x", "k", "source")) == [(5.0, 3, 0), (6.0, 0, 1)]
    assert rows(clouds.datum(clouds.union(a, b)).select("x", "y", "dx")) == [(0.0, 0.0, 5.0), (1.0, 2.0, 5.0)]


def test_geojson(spark, tmp_path):
    ring = [[0, 0], [4, 0], [4, 3], [0, 0]]
    f = lambda kind, c: {"type": "Feature", "properties": {"id": 1}, "geometry": {"type": kind, "coordinates": c}}
    doc = {"type": "FeatureCollection", "features": [f("Polygon", [ring, [[1, 1], [2, 1], [2, 2], [1, 1]]]), f("MultiPolygon", [[ring], [ring]]), f("LineString", [[0, 0], [1, 1]]), f("MultiLineString", [[[0, 0], [1, 1]], [[0, 0]]]), f("Polygon", [[[0, 0], [1, 1]]])]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    r = vectors.geojson_rings(spark, str(tmp_path / "a.json"))
    assert r.count() == 12 and r.select("ring_id").distinct().count() == 3
    line = vectors.geojson_lines(spark, str(tmp_path / "a.json"))
    assert line.count() == 4 and line.select("line_id").distinct().count() == 2


def test_obj_and_mtl(spark, tmp_path):
    (tmp_path / "a.obj").write_text("v 0 0 0\nv 1 0 0\nv 1 1 0\nv 0 1 0\nvt 0 0\nusemtl brick\nf 1/1 2/1 3/1 4/1\nf -4 -3 -2\n")
    (tmp_path / "a.mtl").write_text("newmtl brick\nKd 1 1 1\nmap_Kd brick.jpg\nnewmtl plain\nKd 0 0 0\n")
    got = vectors.read_obj(spark, str(tmp_path)).collect()
    assert len(got) == 3 and {g.material for g in got} == {"brick"}
    assert rows(vectors.read_mtl(spark, str(tmp_path)).select("material", "texture")) == [("brick", "brick.jpg"), ("plain", None)]


def test_citygml(spark, tmp_path):
    poly = lambda c: f"<gml:Polygon><gml:exterior><gml:LinearRing><gml:posList>{c}</gml:posList></gml:LinearRing></gml:exterior></gml:Polygon>"
    (tmp_path / "a.gml").write_text(
        f'<c:CityModel xmlns:c="c" xmlns:b="b" xmlns:gml="g"><b:Building gml:id="B1"><b:boundedBy><b:WallSurface>{poly("0 0 0 1 0 0 1 0 2 0 0 2 0 0 0")}<b:opening><b:Window>{poly("0 0 0 1 0 0 1 0 1 0 0 0")}</b:Window></b:opening></b:WallSurface></b:boundedBy>'
        f'<b:boundedBy><b:RoofSurface>{poly("0 0 2 1 0 2 1 1 2 0 0 2")}</b:RoofSurface></b:boundedBy></b:Building></c:CityModel>'
    )
    v = vectors.read_citygml(spark, str(tmp_path))
    assert v.count() == 9 and rows(vectors.citygml_summary(v)) == [("RoofSurface", 1, 1), ("WallSurface", 1, 1)]
    doc = json.loads(sinks.cityjson(v.where("ring = 0").select("building", "surface", "kind", "ord", "x", "y", "z")).first().json)
    assert doc["type"] == "CityJSON" and len(doc["CityObjects"]["B1"]["geometry"][0]["boundaries"]) == 2
    assert max(max(f[0]) for f in doc["CityObjects"]["B1"]["geometry"][0]["boundaries"]) < len(doc["vertices"])


def test_archive_and_gltf(spark, tmp_path):
    t = spark.createDataFrame([("brick", *[float(i) for i in range(9)]), ("slate", *[float(i * i) for i in range(9)])], "material string, " + ", ".join(f"{p}{c} double" for p in "abc" for c in "xyz"))
    sinks.write_archive({"tris": t}, f"{tmp_path}/w", {"made": "here"})
    assert rows(sinks.inspect(spark, f"{tmp_path}/w").select("name", "n")) == [("tris", 2)]
    assert rows(sinks.read_archive(spark, f"{tmp_path}/w")["tris"]) == rows(t)
    g = sinks.gltf(t)
    assert len(g["meshes"][0]["primitives"]) == 2 and g["buffers"][0]["byteLength"] == 72
    sinks.write_seed({"tris": t}, f"{tmp_path}/s")
    assert spark.read.json(f"{tmp_path}/s/tris").count() == 2


def test_png():
    import zlib

    image = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    blob = sinks.png(image)
    at = blob.index(b"IDAT")
    size = int.from_bytes(blob[at - 4 : at], "big")
    raw = np.frombuffer(zlib.decompress(blob[at + 4 : at + 4 + size]), np.uint8).reshape(2, 13)
    assert blob.startswith(b"\x89PNG") and (np.cumsum(raw[:, 1:], axis=0, dtype=np.uint8).reshape(2, 4, 3) == image).all()  # rows are differences to the row above
