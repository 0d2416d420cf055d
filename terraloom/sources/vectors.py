"""Vector files as DataFrames: GeoJSON rings and lines, OBJ meshes, CityGML buildings."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FEATURE = "struct<type:string,coordinates:{}>"


def _features(spark: SparkSession, path: str, schema: str) -> DataFrame:
    raw = spark.read.option("multiLine", True).schema(f"features array<struct<properties:map<string,string>,geometry:{_FEATURE.format(schema)}>>").json(path)
    return raw.select(F.posexplode("features").alias("feature", "f"))


def geojson_rings(spark: SparkSession, path: str) -> DataFrame:
    """(ring_id, feature, ord, px, py, properties): exterior rings of polygons and multipolygons of at least four vertices."""
    one = _features(spark, path, "array<array<array<double>>>").where("f.geometry.type = 'Polygon'").select("feature", F.lit(0).alias("part"), "f.properties", F.element_at("f.geometry.coordinates", 1).alias("ring"))
    many = _features(spark, path, "array<array<array<array<double>>>>").where("f.geometry.type = 'MultiPolygon'").select("feature", "f.properties", F.posexplode("f.geometry.coordinates").alias("part", "p")).select("feature", "part", "properties", F.element_at("p", 1).alias("ring"))
    rings = one.unionByName(many).where(F.size("ring") >= 4).withColumn("ring_id", F.col("feature").cast("long") * 1000000 + F.col("part"))
    return rings.select("ring_id", "feature", "properties", F.posexplode("ring").alias("ord", "p")).select("ring_id", "feature", "ord", F.element_at("p", 1).alias("px"), F.element_at("p", 2).alias("py"), "properties")


def geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_id, ord, px, py, properties) of lines and multilines of at least two vertices."""
    one = _features(spark, path, "array<array<double>>").where("f.geometry.type = 'LineString'").select("feature", F.lit(0).alias("part"), "f.properties", F.col("f.geometry.coordinates").alias("line"))
    many = _features(spark, path, "array<array<array<double>>>").where("f.geometry.type = 'MultiLineString'").select("feature", "f.properties", F.posexplode("f.geometry.coordinates").alias("part", "line"))
    lines = one.unionByName(many).where(F.size("line") >= 2).withColumn("line_id", F.col("feature").cast("long") * 1000000 + F.col("part"))
    return lines.select("line_id", "properties", F.posexplode("line").alias("ord", "p")).select("line_id", "ord", F.element_at("p", 1).alias("px"), F.element_at("p", 2).alias("py"), "properties")


def parse_obj(text: str) -> tuple[np.ndarray, np.ndarray, list[tuple[str, tuple[int, int, int], tuple[int, int, int]]]]:
    """(vertices, texture vertices, triangles as (material, vertex numbers, texture numbers)): faces are fanned,
    negative numbers count from the end, -1 is no texture vertex."""
    v, vt, tri, material = [], [], [], ""
    for line in text.splitlines():
        w = line.split()
        if not w:
            continue
        if w[0] == "v":
            v.append([float(x) for x in w[1:4]])
        elif w[0] == "vt":
            vt.append([float(x) for x in w[1:3]])
        elif w[0] == "usemtl":
            material = " ".join(w[1:])
        elif w[0] == "f":
            corner = []
            for c in w[1:]:
                a, *rest = c.split("/")
                at = lambda s, n: int(s) - 1 if int(s) > 0 else n + int(s)
                corner.append((at(a, len(v)), at(rest[0], len(vt)) if rest and rest[0] else -1))
            for k in range(1, len(corner) - 1):
                t = (corner[0], corner[k], corner[k + 1])
                tri.append((material, tuple(c[0] for c in t), tuple(c[1] for c in t)))
    return np.array(v).reshape(-1, 3), np.array(vt).reshape(-1, 2), tri


def read_obj(spark: SparkSession, path: str) -> DataFrame:
    """(path, tri, material, ax, ay, az, ..., cz) of the OBJ files under path: one file is one chunk."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.obj").load(path).select("path", "content")
    names = [f"{p}{c}" for p in "abc" for c in "xyz"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column(0), batch.column(1), strict=True):
                v, _, tri = parse_obj(blob.as_py().decode("utf-8", "replace"))
                n = len(tri)
                p = v[np.array([t[1] for t in tri], int).reshape(n, 3)].reshape(n, 9) if n else np.zeros((0, 9))
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array([t[0] for t in tri], pa.string()), *[pa.array(p[:, i]) for i in range(9)]], names=["path", "tri", "material", *names])

    return files.mapInArrow(run, "path string, tri long, material string, " + ", ".join(f"{n} double" for n in names))


def read_mtl(spark: SparkSession, path: str) -> DataFrame:
    """(path, material, texture): the image of each material of the MTL files under path."""
    lines = spark.read.text(path, wholetext=True, pathGlobFilter="*.mtl").select(F.input_file_name().alias("path"), F.split("value", r"(?m)^\s*newmtl\s+").alias("m"))
    each = lines.select("path", F.explode(F.slice("m", 2, F.size("m"))).alias("m"))
    image = F.regexp_extract("m", r"(?mi)^\s*map_Kd\s+(.+?)\s*$", 1)
    return each.select("path", F.trim(F.regexp_extract("m", r"^([^\r\n]*)", 1)).alias("material"), F.when(image != "", image).alias("texture"))


def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def parse_citygml(blob: bytes) -> list[tuple]:
    """(building, surface, kind, polygon, ring, ord, x, y, z) of the boundary surfaces; ring 0 is the exterior one."""
    import io

    out = []
    for _, b in ElementTree.iterparse(io.BytesIO(blob), events=("end",)):
        if _name(b.tag) not in ("Building", "BuildingPart"):
            continue
        building = next((v for k, v in b.attrib.items() if _name(k) == "id"), "")
        surfaces = [s for s in b.iter() if _name(s.tag) in ("WallSurface", "RoofSurface", "GroundSurface", "OuterCeilingSurface", "OuterFloorSurface", "ClosureSurface")]
        for ns, s in enumerate(surfaces):
            inner = {id(x) for o in s.iter() if _name(o.tag) == "opening" for x in o.iter()}
            polygons = [p for p in s.iter() if _name(p.tag) == "Polygon" and id(p) not in inner]
            for n, p in enumerate(polygons):
                for r, ring in enumerate([x for x in p.iter() if _name(x.tag) == "LinearRing"]):
                    c = [float(x) for e in ring.iter() if _name(e.tag) in ("posList", "pos") for x in (e.text or "").split()]
                    out += [(building, ns, _name(s.tag), n, r, k, *c[3 * k : 3 * k + 3]) for k in range(len(c) // 3)]
        b.clear()
    return out


def read_citygml(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gml").load(path).select("content")
    schema = "building string, surface int, kind string, polygon int, ring int, ord int, x double, y double, z double"
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                rows = parse_citygml(blob.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 9, kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return files.mapInArrow(run, schema)


def citygml_summary(vertices: DataFrame) -> DataFrame:
    """(kind, surfaces, buildings) of what read_citygml gives."""
    return vertices.groupBy("kind").agg(F.countDistinct("building", "surface").alias("surfaces"), F.countDistinct("building").alias("buildings"))
