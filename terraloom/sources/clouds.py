"""Point-cloud files as DataFrames: LAS, KITTI, PCD, PLY and plain text.

Files are read by Spark (binaryFile), so any store that Spark reaches will do, and decoded by numpy
in Arrow batches, one file a row. Every reader gives path, x, y, z, intensity (0 to 1),
return_number, num_returns and class (a code of the file's own vocabulary, null where it has none).
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

SCHEMA = "path string, x double, y double, z double, intensity float, return_number short, num_returns short, class int"
ROWS = 1 << 16
#: ASPRS LAS classes (fixed values of the specification), by code.
ASPRS = {1: "unclassified", 2: "ground", 3: "vegetation", 4: "vegetation", 5: "vegetation", 6: "building", 7: "noise", 9: "water", 10: "rail", 11: "road", 14: "wire", 15: "pole", 17: "bridge", 18: "noise"}
#: Bytes of a LAS point by format (fixed values of the specification).
LAS_BYTES = {0: 20, 1: 28, 2: 26, 3: 34, 4: 57, 5: 63, 6: 30, 7: 36, 8: 38, 9: 59, 10: 67}

Cloud = dict[str, np.ndarray]


def las_header(blob: bytes) -> dict:
    """What a LAS header says: version, format, count, scale, offset and bounds. 375 bytes are enough."""
    if blob[:4] != b"LASF":
        raise ValueError("not a LAS file")
    one = lambda kind, at, n=1: np.frombuffer(blob, kind, n, at)
    minor = blob[25]
    count = int(one("<u8", 247)[0]) if minor >= 4 and len(blob) >= 255 and one("<u2", 94)[0] >= 375 else 0
    box = one("<f8", 179, 6)
    return {
        "version": f"{blob[24]}.{minor}", "format": blob[104] & 0x3F, "compressed": bool(blob[104] & 0x80), "length": int(one("<u2", 105)[0]), "start": int(one("<u4", 96)[0]),
        "count": count or int(one("<u4", 107)[0]), "scale": one("<f8", 131, 3), "offset": one("<f8", 155, 3), "max": box[[0, 2, 4]], "min": box[[1, 3, 5]],
    }


def decode_las(blob: bytes) -> Cloud:
    h = las_header(blob)
    if h["compressed"] or h["format"] not in LAS_BYTES:
        raise ValueError("compressed LAS, or an unknown point format")
    modern = h["format"] >= 6
    fields = [("xyz", "<i4", 3), ("intensity", "<u2"), ("returns", "u1"), ("flags", "u1"), ("class", "u1")] if modern else [("xyz", "<i4", 3), ("intensity", "<u2"), ("returns", "u1"), ("class", "u1")]
    kind = np.dtype([*fields, ("rest", f"V{h['length'] - np.dtype(fields).itemsize}")])
    p = np.frombuffer(blob, kind, h["count"], h["start"])
    xyz = p["xyz"] * h["scale"] + h["offset"]
    bits = 4 if modern else 3
    low = (1 << bits) - 1
    return {"x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "intensity": p["intensity"] / 65535, "return_number": p["returns"] & low, "num_returns": p["returns"] >> bits & low, "class": p["class"] if modern else p["class"] & 31}


def encode_las(cloud: Cloud, scale: float = 0.001) -> bytes:
    """A LAS 1.2 file of point format 0."""
    xyz = np.column_stack([cloud["x"], cloud["y"], cloud["z"]]).astype(float).reshape(-1, 3)
    offset = np.floor(xyz.min(axis=0)) if len(xyz) else np.zeros(3)
    p = np.zeros(len(xyz), np.dtype([("xyz", "<i4", 3), ("intensity", "<u2"), ("returns", "u1"), ("class", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2")]))
    p["xyz"] = np.rint((xyz - offset) / scale)
    p["intensity"] = np.rint(np.clip(np.asarray(cloud.get("intensity", np.zeros(len(xyz))), float), 0, 1) * 65535)
    p["returns"] = np.asarray(cloud.get("return_number", np.ones(len(xyz))), int) & 7 | (np.asarray(cloud.get("num_returns", np.ones(len(xyz))), int) & 7) << 3
    p["class"] = np.asarray(cloud.get("class", np.zeros(len(xyz))), int) & 31
    h = bytearray(227)
    h[0:4], h[24], h[25], h[104] = b"LASF", 1, 2, 0
    put = lambda kind, at, v: h.__setitem__(slice(at, at + np.dtype(kind).itemsize * np.size(v)), np.asarray(v, kind).tobytes())
    put("<u2", 94, 227), put("<u4", 96, 227), put("<u2", 105, 20), put("<u4", 107, len(p)), put("<f8", 131, [scale] * 3), put("<f8", 155, offset)
    if len(xyz):
        low, high = xyz.min(axis=0), xyz.max(axis=0)
        put("<f8", 179, [high[0], low[0], high[1], low[1], high[2], low[2]])
    return bytes(h) + p.tobytes()


def decode_kitti(blob: bytes) -> Cloud:
    """Sweeps of four float32 (x, y, z, intensity)."""
    if len(blob) % 16:
        raise ValueError("not a multiple of 16 bytes")
    p = np.frombuffer(blob, "<f4").reshape(-1, 4)
    return {"x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "intensity": p[:, 3]}


def encode_kitti(cloud: Cloud) -> bytes:
    return np.column_stack([cloud["x"], cloud["y"], cloud["z"], cloud.get("intensity", np.zeros(len(cloud["x"])))]).astype("<f4").tobytes()


def decode_kitti_labels(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(class, instance): the low and high 16 bits of each label."""
    v = np.frombuffer(blob, "<u4")
    return (v & 0xFFFF).astype(np.int32), (v >> 16).astype(np.int32)


def encode_kitti_labels(classes: np.ndarray, instances: np.ndarray | None = None) -> bytes:
    return (np.asarray(classes, "<u4") | (np.asarray(instances if instances is not None else np.zeros(len(classes)), "<u4") << 16)).astype("<u4").tobytes()


def lzf_decompress(data: bytes, size: int) -> bytes:
    """LZF: literal runs and back references."""
    out, at = bytearray(), 0
    while at < len(data):
        c = data[at]
        at += 1
        if c < 32:
            out += data[at : at + c + 1]
            at += c + 1
            continue
        n = c >> 5
        if n == 7:
            n += data[at]
            at += 1
        back = ((c & 31) << 8 | data[at]) + 1
        at += 1
        start = len(out) - back
        for k in range(n + 2):
            out.append(out[start + k])
    if len(out) != size:
        raise ValueError("LZF data of another size than declared")
    return bytes(out)


def _named(columns: Cloud) -> Cloud:
    """x, y, z, intensity and class out of named columns; points that aren't finite go."""
    out = {k: np.asarray(columns[k], float) for k in "xyz"}
    ok = np.isfinite(out["x"]) & np.isfinite(out["y"]) & np.isfinite(out["z"])
    if "intensity" in columns:
        v = np.asarray(columns["intensity"], float)
        out["intensity"] = v / 255 if len(v) and np.nanmax(v) > 1.5 else v
    elif {"red", "green", "blue"} <= set(columns):
        out["intensity"] = (np.asarray(columns["red"], float) + columns["green"] + columns["blue"]) / 765
    label = next((k for k in ("label", "class", "classification", "semantic", "scalar_label", "scalar_classification") if k in columns), None)
    if label:
        out["class"] = np.rint(np.asarray(columns[label], float)).astype(np.int32)
    return {k: v[ok] for k, v in out.items()}


def decode_pcd(blob: bytes) -> Cloud:
    end = blob.index(b"\n", blob.index(b"\nDATA") + 1) + 1
    head = dict(x.split(maxsplit=1) for x in blob[:end].decode("latin-1").splitlines() if x and not x.startswith("#") and " " in x)
    fields, kinds = head["FIELDS"].split(), [{"F": "f", "I": "i", "U": "u"}[t] + s for t, s in zip(head["TYPE"].split(), head["SIZE"].split(), strict=True)]
    n, body, how = int(head["POINTS"]), blob[end:], head["DATA"].strip()
    if how == "ascii":
        table = np.loadtxt(io.BytesIO(body), ndmin=2)
        return _named({f: table[:, i] for i, f in enumerate(fields)})
    kind = np.dtype([(f, "<" + k) for f, k in zip(fields, kinds, strict=True)])
    if how == "binary":
        p = np.frombuffer(body, kind, n)
        return _named({f: p[f] for f in fields})
    packed, size = np.frombuffer(body, "<u4", 2)
    raw, at, out = lzf_decompress(body[8 : 8 + int(packed)], int(size)), 0, {}
    for f in fields:  # column after column
        out[f] = np.frombuffer(raw, kind[f], n, at)
        at += n * kind[f].itemsize
    return _named(out)


def decode_ply(blob: bytes) -> Cloud:
    end = blob.index(b"end_header") + len(b"end_header")
    end = blob.index(b"\n", end) + 1
    kinds = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
    fields, n, how, inside = [], 0, "", False
    for line in blob[:end].decode("latin-1").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            how = w[1]
        elif w[:1] == ["element"]:
            inside = w[1] == "vertex"
            n = int(w[2]) if inside else n
        elif w[:1] == ["property"] and inside:
            fields.append((w[2], "<" + kinds[w[1]]))
    if how == "ascii":
        table = np.loadtxt(io.BytesIO(blob[end:]), ndmin=2, max_rows=n)
        return _named({f: table[:, i] for i, (f, _) in enumerate(fields)})
    if how != "binary_little_endian":
        raise ValueError(f"PLY format {how}")
    p = np.frombuffer(blob, np.dtype(fields), n, end)
    return _named({f: p[f] for f, _ in fields})


def decode_text(blob: bytes) -> Cloud:
    """Columns x y z, then intensity and class if there; parted by commas, semicolons or space, with or without a heading."""
    lines = blob.decode("utf-8", "replace").replace(",", " ").replace(";", " ").splitlines()

    def number(w: str) -> bool:
        try:
            float(w)
        except ValueError:
            return False
        return True

    parsed = [w for w in (x.split() for x in lines) if len(w) >= 3 and all(map(number, w))]
    t = np.array([list(map(float, w)) for w in parsed]).reshape(len(parsed), -1)
    if not len(t):
        return {k: np.zeros(0) for k in "xyz"}
    return _named({name: t[:, i] for i, name in enumerate(("x", "y", "z", "intensity", "class")[: t.shape[1]])})


DECODERS: dict[str, Callable[[bytes], Cloud]] = {"las": decode_las, "bin": decode_kitti, "pcd": decode_pcd, "ply": decode_ply, "xyz": decode_text, "txt": decode_text, "csv": decode_text}


def adapters(spark: SparkSession) -> DataFrame:
    """(extension, reader) of every format."""
    return spark.createDataFrame([(k, f.__name__) for k, f in sorted(DECODERS.items())], "extension string, reader string")


def adapter_for(path: str, kind: str | None = None) -> str:
    """The format of a path, by name or extension; an unknown one is an error that lists all."""
    kind = (kind or path.rsplit(".", 1)[-1]).lower()
    if kind not in DECODERS:
        raise ValueError(f"no reader for {kind!r}; there are {', '.join(sorted(DECODERS))}")
    return kind


def read(spark: SparkSession, path: str, kind: str | None = None, keep_noise: bool = False, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """The points of all files under path (a file, folder or pattern) of one kind.

    LAS points of ASPRS noise classes go unless keep_noise. box keeps points within it, edges
    included, while decoding.
    """
    kind = adapter_for(path, kind)
    decode = DECODERS[kind]
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(path).select("path", "content")
    noise = [c for c, n in ASPRS.items() if n == "noise"]
    kinds = {"x": pa.float64(), "y": pa.float64(), "z": pa.float64(), "intensity": pa.float32(), "return_number": pa.int16(), "num_returns": pa.int16(), "class": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column(0), batch.column(1), strict=True):
                c = decode(blob.as_py())
                keep = np.ones(len(c["x"]), bool)
                if kind == "las" and not keep_noise:
                    keep &= ~np.isin(c["class"], noise)
                if box:
                    keep &= (c["x"] >= box[0]) & (c["x"] <= box[2]) & (c["y"] >= box[1]) & (c["y"] <= box[3])
                c = {k: np.asarray(v)[keep] for k, v in c.items()}
                n = int(keep.sum())
                for at in range(0, n, ROWS):
                    m = min(ROWS, n - at)
                    columns = [pa.array([name.as_py()] * m, pa.string())] + [pa.array(c[k][at : at + m].astype(t.to_pandas_dtype())) if k in c else pa.nulls(m, t) for k, t in kinds.items()]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", *kinds])

    return files.mapInArrow(run, SCHEMA)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(tile_id, path, minx, miny, maxx, maxy, points) of the LAS files under path, by their headers alone."""

    @pandas_udf("minx double, miny double, maxx double, maxy double, points long")
    def box(head: pd.Series) -> pd.DataFrame:
        h = [las_header(bytes(b)) for b in head]
        return pd.DataFrame({"minx": [x["min"][0] for x in h], "miny": [x["min"][1] for x in h], "maxx": [x["max"][0] for x in h], "maxy": [x["max"][1] for x in h], "points": [x["count"] for x in h]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.las").load(path)
    found = files.select("path", box(F.substring("content", 1, 375)).alias("h")).select("path", "h.*")
    return found.withColumn("tile_id", F.xxhash64("path"))


def datum(points: DataFrame) -> DataFrame:
    """points moved so that the smallest x and y are 0; dx and dy say by how much. Sums of squares need it."""
    low = points.agg(F.min("x").alias("dx"), F.min("y").alias("dy"))
    return points.crossJoin(F.broadcast(low)).withColumns({"x": F.col("x") - F.col("dx"), "y": F.col("y") - F.col("dy")})  # one row


def union(*clouds: DataFrame) -> DataFrame:
    """Clouds of any channels as one, tagged by source; channels that one lacks are 0 there."""
    names = list(dict.fromkeys(c for d in clouds for c in d.columns))
    out = None
    for i, d in enumerate(clouds):
        d = d.withColumn("source", F.lit(i).cast("short"))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    numbers = [n for n, t in out.dtypes if n in names and n not in "xyz" and t not in ("string", "boolean")]
    return out.fillna(0, subset=numbers)
