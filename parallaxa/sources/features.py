"""Feature files: keypoints and descriptors of one image, written and validated byte by byte."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the two formats: magic, header layouts (name -> offset), sizes and bounds; all little-endian.
MAGIC = b"L3DFEAT\0"
KEYPOINT = np.dtype([("x", "<f4"), ("y", "<f4"), ("size", "<f4"), ("angle", "<f4"), ("response", "<f4"), ("octave", "<i4")])
LAYOUTS = {
    1: {"bytes": 160, "record": 28, "width": 32, "height": 36, "points": 40, "matrix": 48, "total": 56, "image": 64, "fingerprint": 96, "kind": 128, "extractor": 144},
    2: {"bytes": 176, "scalar": 28, "record": 32, "width": 36, "height": 40, "abilities": 44, "points": 48, "matrix": 56, "total": 64, "image": 72, "fingerprint": 104, "kind": 136, "extractor": 152},
}
MOST_FEATURES, MOST_DIMENSIONS, ABILITIES = 8192, 4096, 15

_ROW = (
    "feature_index bigint, x float, y float, size float, angle float, response float, octave int, descriptor_u8 binary, descriptor_f32 array<float>"
)


def feature_bytes(
    version: int, kind: str, extractor_version: int, image: bytes, fingerprint: bytes, width: int, height: int, points: np.ndarray, matrix: np.ndarray
) -> bytes:
    """A feature file from keypoints (KEYPOINT) and a descriptor matrix of uint8 or float32."""
    at = LAYOUTS[version]
    floats = matrix.dtype != np.uint8
    body = points.astype(KEYPOINT).tobytes() + matrix.astype("<f4" if floats else "u1").tobytes()
    head = bytearray(at["bytes"])

    def put(offset: int, value: int, size: int = 4) -> None:
        head[offset : offset + size] = int(value).to_bytes(size, "little")

    head[:8] = MAGIC
    for offset, value in ((8, version), (12, at["bytes"]), (16, len(points)), (20, matrix.shape[1]), (24, 2 if floats else 1), (at["record"], KEYPOINT.itemsize)):
        put(offset, value)
    put(at["width"], width), put(at["height"], height), put(at["extractor"], extractor_version)
    put(at["points"], at["bytes"], 8), put(at["matrix"], at["bytes"] + len(points) * KEYPOINT.itemsize, 8), put(at["total"], at["bytes"] + len(body), 8)
    if version == 2:
        put(at["scalar"], 4 if floats else 1), put(at["abilities"], ABILITIES)
    name = kind.encode("ascii")
    head[at["image"] : at["image"] + 32], head[at["fingerprint"] : at["fingerprint"] + 32] = image, fingerprint
    head[at["kind"] : at["kind"] + len(name)] = name
    return bytes(head) + body


def feature_problem(content: bytes) -> str | None:
    """Why bytes are no feature file, None if they are one."""
    if len(content) < 160:
        return "SIZE"
    if content[:8] != MAGIC:
        return "MAGIC"
    u32 = lambda o: int.from_bytes(content[o : o + 4], "little")
    u64 = lambda o: int.from_bytes(content[o : o + 8], "little")
    at = LAYOUTS.get(u32(8))
    if at is None:
        return "VERSION"
    if u32(12) != at["bytes"] or len(content) < at["bytes"]:
        return "HEADER"
    version, count, dimension, kind = u32(8), u32(16), u32(20), u32(24)
    scalar = u32(at["scalar"]) if version == 2 else 1
    if (kind, scalar) not in ({(1, 1)} if version == 1 else {(1, 1), (2, 4)}):
        return "TYPE"
    if count > MOST_FEATURES:
        return "COUNT"
    if not 0 < dimension <= MOST_DIMENSIONS or (version == 1 and dimension != 32) or (kind == 2 and dimension != 128):
        return "DIMENSION"
    name = content[at["kind"] : at["kind"] + 16]
    rest = content[at["extractor"] + 4 : at["bytes"]]
    bad = u32(at["record"]) != KEYPOINT.itemsize or not u32(at["width"]) or not u32(at["height"]) or any(rest)
    bad |= (version == 1 and (name != b"orb".ljust(16, b"\0") or u32(at["extractor"]) != 1)) or not name[0] or 0 not in name or not u32(at["extractor"])
    if bad or (version == 2 and u32(at["abilities"]) & ~ABILITIES):
        return "HEADER"
    start = at["bytes"] + count * KEYPOINT.itemsize
    if u64(at["points"]) != at["bytes"] or u64(at["matrix"]) != start or u64(at["total"]) != len(content) or len(content) != start + count * dimension * scalar:
        return "SIZE"
    points = np.frombuffer(content, KEYPOINT, count, at["bytes"])
    numbers = np.stack([points[n] for n in ("x", "y", "size", "angle", "response")]) if count else np.zeros((5, 0))
    x, y, size, angle, _ = numbers
    inside = (x >= 0) & (y >= 0) & (x < u32(at["width"])) & (y < u32(at["height"])) & (size > 0) & (angle >= 0) & (angle < 360)
    if not np.isfinite(numbers).all() or not inside.all() or (np.abs(points["octave"] + 0.5) > 128).any():
        return "KEYPOINT"
    if kind == 2 and not np.isfinite(np.frombuffer(content, "<f4", count * dimension, start)).all():
        return "DESCRIPTOR"
    return None


def feature_rows(content: bytes) -> pd.DataFrame:
    """Keypoints and descriptors of a valid feature file."""
    u32 = lambda o: int.from_bytes(content[o : o + 4], "little")
    at, count, dimension, kind = LAYOUTS[u32(8)], u32(16), u32(20), u32(24)
    points = np.frombuffer(content, KEYPOINT, count, at["bytes"])
    matrix = np.frombuffer(content, "u1" if kind == 1 else "<f4", count * dimension, at["bytes"] + points.nbytes).reshape(count, dimension)
    out = pd.DataFrame({n: points[n] for n in KEYPOINT.names})
    out.insert(0, "feature_index", np.arange(count))
    out["descriptor_u8"] = [m.tobytes() for m in matrix] if kind == 1 else None
    out["descriptor_f32"] = [m.astype(float).tolist() for m in matrix] if kind == 2 else None
    return out


def decode_features(files: DataFrame, key: str) -> DataFrame:
    """(key, problem, feature_index, keypoint and descriptor columns) from rows (key, content): a file with a problem gives
    one row that names it, an empty feature file none."""
    kind = dict(files.dtypes)[key]

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, content in zip(batch[key], batch["content"], strict=True):
                content = bytes(content) if content is not None else b""
                problem = feature_problem(content)
                rows = feature_rows(content) if problem is None else pd.DataFrame({"feature_index": [None]})
                for name in ("x", "y", "size", "angle", "response", "octave", "descriptor_u8", "descriptor_f32"):
                    if name not in rows:
                        rows[name] = None
                rows.insert(0, "problem", problem)
                rows.insert(0, key, k)
                yield rows

    return files.select(key, "content").mapInPandas(unpack, f"{key} {kind}, problem string, {_ROW}")


def encode_features(rows: DataFrame, key: str) -> DataFrame:
    """(key, problem, content): a feature file of version 2 for each key, from rows (key, kind, extractor_version, image,
    fingerprint, width, height, feature_index, keypoint columns, descriptor_u8 or descriptor_f32).

    Features are numbered in the order of their index. The format holds MOST_FEATURES features: a key with more has the
    problem COUNT, and what the format refuses otherwise is named likewise; neither has content.
    """
    kind = dict(rows.dtypes)[key]
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    crowded = sizes.where(F.col("n") > MOST_FEATURES).select(key, F.lit("COUNT").alias("problem"), F.lit(None).cast("binary").alias("content"))
    fits = rows.join(sizes.where(F.col("n") <= MOST_FEATURES).select(key), key, "left_semi")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("feature_index")
        first = pdf.iloc[0]
        points = np.zeros(len(pdf), KEYPOINT)
        for name in KEYPOINT.names:
            points[name] = pdf[name]
        floats = first["descriptor_u8"] is None
        try:
            if floats:
                matrix = np.array(pdf["descriptor_f32"].tolist(), dtype=np.float32)
            else:
                matrix = np.stack([np.frombuffer(v, np.uint8) for v in pdf["descriptor_u8"]])
            content = feature_bytes(
                2, first["kind"], first["extractor_version"], bytes(first["image"]), bytes(first["fingerprint"]), first["width"], first["height"], points, matrix
            )
            problem = feature_problem(content)
        except (TypeError, ValueError):
            content, problem = None, "DESCRIPTOR"
        return pd.DataFrame({key: [first[key]], "problem": [problem], "content": [content if problem is None else None]})

    return fits.groupBy(key).applyInPandas(pack, f"{key} {kind}, problem string, content binary").unionByName(crowded)


def read_feature_files(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the feature files below `path` as `decode_features` gives them; files that are none are named as problems.
    Spark's file scan passes over files without a single byte."""
    return decode_features(spark.read.format("binaryFile").load(path).select("path", "content"), "path")
