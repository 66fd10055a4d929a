"""Point files (PLY): the whole header and the whole body checked, to the exact end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the format: scalar types with their little-endian kinds, and the bounds of a header.
SCALARS = {
    "char": "<i1", "int8": "<i1", "uchar": "<u1", "uint8": "<u1", "short": "<i2", "int16": "<i2", "ushort": "<u2", "uint16": "<u2",
    "int": "<i4", "int32": "<i4", "uint": "<u4", "uint32": "<u4", "float": "<f4", "float32": "<f4", "double": "<f8", "float64": "<f8",
}
MOST_HEADER_BYTES, MOST_PROPERTIES = 1 << 20, 256
_BAD = "bad"


def _header(content: bytes) -> tuple[str, int, list[tuple[str, str | None, str]], int]:
    """(format, vertices, properties (name, type of a list's count, type), where the body starts)."""
    end = content.find(b"end_header", 0, MOST_HEADER_BYTES)
    if end < 0:
        raise ValueError(_BAD)
    body = content.find(b"\n", end) + 1
    lines = [line.removesuffix("\r") for line in content[:end].decode("iso-8859-1").split("\n")]
    kind = {"format ascii 1.0": "ascii", "format binary_little_endian 1.0": "binary_little_endian"}.get(lines[1] if len(lines) > 1 else "")
    if lines[0] != "ply" or kind is None or not body or content[end + 10 : body - 1] not in (b"", b"\r") or lines[-1] != "":
        raise ValueError(_BAD)
    vertices, properties = None, []
    for line in lines[2:-1]:
        match line.split():
            case ["comment" | "obj_info", *_]:
                continue
            case ["element", "vertex", n] if vertices is None and n.isascii() and n.isdigit() and int(n) > 0:
                vertices = int(n)
            case ["property", "list", count, item, name] if vertices and kind != "ascii" and SCALARS.get(count, "f")[1] != "f" and count in SCALARS and item in SCALARS:
                properties.append((name, count, item))
            case ["property", item, name] if vertices and item in SCALARS:
                properties.append((name, None, item))
            case _:
                raise ValueError(_BAD)
    for axis in "xyz":
        if [(c, SCALARS[t][1]) for n, c, t in properties if n == axis] != [(None, "f")]:
            raise ValueError(_BAD)
    if vertices is None or len(properties) > MOST_PROPERTIES:
        raise ValueError(_BAD)
    return kind, vertices, properties, body


def _ascii_body(text: bytes, vertices: int, columns: int) -> bool:
    lines = text.decode("iso-8859-1").replace("\r\n", "\n").split("\n")
    rows = [line for line in lines[:vertices]]
    if len(rows) < vertices or "".join(lines[vertices:]).strip():
        return False
    for line in rows:
        numbers = line.split()
        if len(numbers) != columns or not np.isfinite(np.array(numbers, dtype=float)).all():
            return False
    return True


def _binary_body(body: memoryview, vertices: int, properties: list[tuple[str, str | None, str]]) -> bool:
    if not any(count for _, count, _ in properties):
        row = np.dtype([(f"p{i}", SCALARS[t]) for i, (_, _, t) in enumerate(properties)])
        if len(body) != vertices * row.itemsize:
            return False
        rows = np.frombuffer(body, row)
        return all(np.isfinite(rows[f"p{i}"]).all() for i, (n, _, _) in enumerate(properties) if n in "xyz")
    at = 0
    for _ in range(vertices):
        for name, count, item in properties:
            kind = np.dtype(SCALARS[count or item])
            if at + kind.itemsize > len(body):
                return False
            value = np.frombuffer(body, kind, 1, at)[0]
            at += kind.itemsize
            if count is not None:
                if value < 0:
                    return False
                at += int(value) * np.dtype(SCALARS[item]).itemsize
            elif name in ("x", "y", "z") and not np.isfinite(value):
                return False
    return at == len(body)


def point_file(content: bytes) -> tuple[str, int] | None:
    """(format, vertices) of a whole, sound point file; None for anything else.

    One vertex element with at least one vertex and float x, y, z; further properties of any kind, lists in binary files
    only; finite coordinates; nothing after the last vertex but, in text files, blanks.
    """
    try:
        kind, vertices, properties, start = _header(content)
        if kind == "ascii":
            good = _ascii_body(content[start:], vertices, len(properties))
        else:
            good = _binary_body(memoryview(content)[start:], vertices, properties)
    except ValueError:
        return None
    return (kind, vertices) if good else None


def read_points(files: DataFrame) -> DataFrame:
    """(path, format, vertices) of point files (path, content); null where a file is none."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [point_file(c or b"") or (None, None) for c in batch.column("content").to_pylist()]
            kinds, counts = [k for k, _ in found], [n for _, n in found]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(kinds, pa.string()), pa.array(counts, pa.int64())], names=["path", "format", "vertices"])

    return files.select("path", "content").mapInArrow(check, "path string, format string, vertices bigint")
