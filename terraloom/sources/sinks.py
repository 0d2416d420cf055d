"""What is written: table archives with a manifest, glTF, CityJSON, PNG, seeds."""

from __future__ import annotations

import base64
import json
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = "terraloom-world 1"


def write_archive(tables: dict[str, DataFrame], path: str, notes: dict[str, str] | None = None) -> None:
    """Each table as Parquet under path, and a manifest with their columns and row counts, written last."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        rows.append((name, df.schema.json(), spark.read.parquet(f"{path}/{name}").count()))
    manifest = spark.createDataFrame([(FORMAT, json.dumps(notes or {}, sort_keys=True), *r) for r in rows], "format string, notes string, name string, columns string, n long")
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """(name, n, columns) by the manifest alone."""
    return spark.read.json(f"{path}/manifest").select("name", "n", "columns")


def read_archive(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables by name; nothing is read before it is used."""
    return {r["name"]: spark.read.parquet(f"{path}/{r['name']}") for r in inspect(spark, path).collect()}


def png(image: np.ndarray) -> bytes:
    """A PNG of an image (h, w) or (h, w, 3 or 4) of bytes. Every row is told by its differences to the row above."""
    pixels = np.atleast_3d(np.asarray(image, np.uint8))
    height, width, channels = pixels.shape
    colour_type = {1: 0, 3: 2, 4: 6}[channels]
    packer, data, above = zlib.compressobj(), bytearray(), np.zeros(width * channels, np.uint8)
    for row in pixels.reshape(height, -1):
        data += packer.compress(b"\x02")  # filter type 2: up
        data += packer.compress((row - above).tobytes())
        above = row
    data += packer.flush()
    out = bytearray(b"\x89PNG\r\n\x1a\n")
    for name, body in ((b"IHDR", struct.pack(">2I5B", width, height, 8, colour_type, 0, 0, 0)), (b"IDAT", bytes(data)), (b"IEND", b"")):
        out += len(body).to_bytes(4, "big") + name + body + zlib.crc32(body, zlib.crc32(name)).to_bytes(4, "big")
    return bytes(out)


def gltf(tris: DataFrame) -> dict:
    """A glTF 2.0 document of triangles (material, ax ... cz): a primitive for each material, moved to the mesh's middle.

    A document is one file of one scene, so its triangles are gathered here; larger worlds are written by tiles.
    """
    names = [f"{p}{c}" for p in "abc" for c in "xyz"]
    t = tris.select("material", *names).toArrow()
    material = np.array(t.column("material").to_pylist(), object)
    p = np.column_stack([t.column(n).to_numpy() for n in names]).reshape(-1, 3, 3) if t.num_rows else np.zeros((0, 3, 3))
    middle = (p.reshape(-1, 3).min(axis=0) + p.reshape(-1, 3).max(axis=0)) / 2 if len(p) else np.zeros(3)
    blob, views, accessors, primitives, kinds = b"", [], [], [], sorted(set(material.tolist()))
    for m, name in enumerate(kinds):
        v = (p[material == name].reshape(-1, 3) - middle)[:, [0, 2, 1]] * np.array([1, 1, -1])  # y up
        v = v.astype("<f4")
        views.append({"buffer": 0, "byteOffset": len(blob), "byteLength": v.nbytes, "target": 34962})
        accessors.append({"bufferView": m, "componentType": 5126, "count": len(v), "type": "VEC3", "min": v.min(axis=0).tolist(), "max": v.max(axis=0).tolist()})
        primitives.append({"attributes": {"POSITION": m}, "material": m})
        blob += v.tobytes()
    return {
        "asset": {"version": "2.0", "generator": "terraloom"}, "scene": 0, "scenes": [{"nodes": [0]}], "nodes": [{"mesh": 0, "translation": [middle[0], middle[2], -middle[1]]}],
        "meshes": [{"primitives": primitives}], "materials": [{"name": k} for k in kinds], "accessors": accessors, "bufferViews": views,
        "buffers": [{"byteLength": len(blob), "uri": "data:application/octet-stream;base64," + base64.b64encode(blob).decode()}],
    }


def cityjson(surfaces: DataFrame, quantum: float = 0.001) -> DataFrame:
    """One row, json: a CityJSON 1.1 document of rings (building, surface, kind, ord, x, y, z), vertices quantised and shared."""
    low = surfaces.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.min("z").alias("z0"))
    q = surfaces.crossJoin(F.broadcast(low)).withColumns({f"q{c}": F.round((F.col(c) - F.col(f"{c}0")) / quantum).cast("long") for c in "xyz"})  # one row
    rows = q.select("building", "surface", "kind", "ord", "qx", "qy", "qz", "x0", "y0", "z0")

    def build(pdf):
        import pandas as pd

        index: dict[tuple, int] = {}
        objects = {}
        for b, part in pdf.groupby("building"):
            kinds, faces, semantics = sorted(part["kind"].unique()), [], []
            for (_, kind), ring in part.sort_values("ord").groupby(["surface", "kind"]):
                at = [index.setdefault(v, len(index)) for v in zip(ring["qx"], ring["qy"], ring["qz"], strict=True)]
                at = at[:-1] if len(at) > 1 and at[0] == at[-1] else at
                faces.append([at])
                semantics.append(kinds.index(kind))
            objects[str(b)] = {"type": "Building", "geometry": [{"type": "MultiSurface", "lod": "2", "boundaries": faces, "semantics": {"surfaces": [{"type": k} for k in kinds], "values": semantics}}]}
        first = pdf.iloc[0]
        doc = {"type": "CityJSON", "version": "1.1", "transform": {"scale": [quantum] * 3, "translate": [float(first["x0"]), float(first["y0"]), float(first["z0"])]}, "CityObjects": objects, "vertices": [[int(x) for x in v] for v in index]}
        return pd.DataFrame({"json": [json.dumps(doc, sort_keys=True)]})

    return rows.groupBy("x0", "y0", "z0").applyInPandas(build, "json string")


def write_seed(tables: dict[str, DataFrame], path: str) -> None:
    """A seed: small tables as one JSON row each, floats to 6 places."""
    for name, df in tables.items():
        floats = {n: F.round(n, 6) for n, t in df.dtypes if t in ("double", "float")}
        df.withColumns(floats).coalesce(1).write.mode("overwrite").json(f"{path}/{name}")
