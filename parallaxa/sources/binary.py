"""Binary payload files: match and scope files, decoded from bytes that Spark read; discovery of source files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parallaxa.operators.prefix import prefix_sum

# Fixed values of the formats: little-endian layouts, magics, sizes and bounds.
MATCH_MAGIC = b"L3DM"
MATCH_HEADER = np.dtype(
    [("magic", "S4"), ("version", "u1"), ("type", "u1"), ("reserved", "<u2"), ("count", "<u4"), ("dimension", "<u4"), ("a", "<u8"), ("b", "<u8")]
)
MATCH_ENTRY = np.dtype([("ia", "<u4"), ("ib", "<u4"), ("distance", "<f4")])
MATCH_DIMENSIONS = {1: 32, 2: 128}
MOST_MATCHES = 8192


def match_bytes(a: int, b: int, kind: int, entries: np.ndarray) -> bytes:
    header = np.array([(MATCH_MAGIC, 1, kind, 0, len(entries), MATCH_DIMENSIONS[kind], a, b)], dtype=MATCH_HEADER)
    return header.tobytes() + entries.astype(MATCH_ENTRY).tobytes()


def match_problem(content: bytes) -> str | None:
    """Why bytes are no match file, None if they are one."""
    if len(content) < MATCH_HEADER.itemsize:
        return "SIZE"
    h = np.frombuffer(content, MATCH_HEADER, 1)[0]
    if h["magic"] != MATCH_MAGIC:
        return "MAGIC"
    if h["version"] != 1:
        return "VERSION"
    if h["reserved"] != 0 or h["a"] == 0 or h["b"] == 0 or h["a"] == h["b"]:
        return "CORRUPT"
    if MATCH_DIMENSIONS.get(int(h["type"])) != h["dimension"]:
        return "TYPE"
    if h["count"] > MOST_MATCHES:
        return "COUNT"
    if len(content) != MATCH_HEADER.itemsize + int(h["count"]) * MATCH_ENTRY.itemsize:
        return "SIZE"
    e = np.frombuffer(content, MATCH_ENTRY, offset=MATCH_HEADER.itemsize)
    bad = (e["ia"] >= MOST_MATCHES) | (e["ib"] >= MOST_MATCHES) | ~np.isfinite(e["distance"]) | (e["distance"] < 0)
    return "ENTRY" if bad.any() else None


def encode_matches(entries: DataFrame, key: str) -> DataFrame:
    """(key, part, content): the match files of each key from rows (key, a, b, kind, entry_index, ia, ib, distance).

    A file holds at most MOST_MATCHES entries, so a key has as many parts as it takes, the entries in order.
    """
    unique = entries.withColumn("__copy", F.monotonically_increasing_id()).withColumn("__one", F.lit(1))
    placed, _ = prefix_sum(unique, [key], ["entry_index", "ia", "ib", "distance", "__copy"], "__one", "__place")
    parts = placed.withColumn("part", F.expr(f"__place div {MOST_MATCHES}").cast("bigint")).drop("__copy", "__one")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__place")
        rows = np.zeros(len(pdf), dtype=MATCH_ENTRY)
        for n in MATCH_ENTRY.names:
            rows[n] = pdf[n]
        first = pdf.iloc[0]
        content = match_bytes(int(first["a"]), int(first["b"]), int(first["kind"]), rows)
        return pd.DataFrame({key: [first[key]], "part": [first["part"]], "content": [content]})

    return parts.groupBy(key, "part").applyInPandas(pack, f"{key} bigint, part bigint, content binary")


def decode_matches(files: DataFrame, key: str) -> DataFrame:
    """(key, problem, a, b, entry_index, ia, ib, distance) from rows (key, content).

    A file with a problem gives one row that names it; an empty match file gives none; null content is a SIZE problem.
    Where the rows have a `part` too, entries are numbered through the parts of a key.
    """
    columns = [key, F.col("part") if "part" in files.columns else F.lit(0).cast("bigint").alias("part"), "content"]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, problems, sides, sizes, entries = [], [], [], [], []
            firsts = np.array(batch.column("part").to_pylist(), dtype=np.int64) * MOST_MATCHES
            for k, content in zip(batch.column(key).to_pylist(), batch.column("content").to_pylist(), strict=True):
                content = content or b""
                problem = match_problem(content)
                h = None if problem else np.frombuffer(content, MATCH_HEADER, 1)[0]
                e = np.zeros(1, MATCH_ENTRY) if problem else np.frombuffer(content, MATCH_ENTRY, offset=MATCH_HEADER.itemsize)
                keys.append(k)
                problems.append(problem)
                sides.append((0, 0) if problem else (int(h["a"]), int(h["b"])))
                sizes.append(len(e))
                entries.append(e)
            if not keys:
                continue
            rows, file_no = np.concatenate(entries), np.repeat(np.arange(len(keys)), sizes)
            starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
            both = np.array(sides, dtype=np.int64)[file_no]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys, pa.int64()).take(pa.array(file_no)),
                    pa.array(problems, pa.string()).take(pa.array(file_no)),
                    pa.array(both[:, 0]),
                    pa.array(both[:, 1]),
                    pa.array(np.arange(len(rows)) - starts + firsts[file_no]),
                    *[pa.array(rows[n].astype(t)) for n, t in (("ia", np.int64), ("ib", np.int64), ("distance", np.float32))],
                ],
                names=[key, "problem", "a", "b", "entry_index", "ia", "ib", "distance"],
            )

    schema = f"{key} bigint, problem string, a bigint, b bigint, entry_index bigint, ia bigint, ib bigint, distance float"
    return files.select(*columns).mapInArrow(unpack, schema)


def discover(spark: SparkSession, roots: list[str], kinds: dict[str, str]) -> DataFrame:
    """(path, kind, size, sha256) of the files below `roots` with a known extension, in path order, each content hashed
    once. A root named twice is an error, as its files would count twice; links that lead to no file are none."""
    if len({r.rstrip("/") for r in roots}) < len(roots):
        raise ValueError("a root is named twice")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(roots)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.lit(None).cast("string")
    for e, k in kinds.items():
        kind = F.when(ext == e, k).otherwise(kind)
    found = files.select("path", kind.alias("kind"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))
    return found.where("kind is not null").orderBy("path")


# Scope files: a magic, a version, a count and ascending ids, all little-endian.
SCOPE_HEAD = b"L3DTSCP1" + (1).to_bytes(4, "little")
MOST_SCOPE_IDS = 10_000_000


def _little(value: Column) -> Column:
    """Hex of a BIGINT, lowest byte first."""
    big = F.lpad(F.hex(value), 16, "0")
    return F.concat(*[F.substring(big, at, 2) for at in range(15, 0, -2)])


def encode_scopes(members: DataFrame, scope: str, member: str) -> DataFrame:
    """(scope, ids, problem, content, sha256): the scope file of each scope's distinct ids.

    The format holds at most MOST_SCOPE_IDS ids above 0: a scope with more (COUNT) or with other ids (ENTRY) has a
    problem and no content.
    """
    rows = members.select(scope, F.col(member).cast("bigint").alias("id")).where("id is not null").distinct()
    sizes = rows.groupBy(scope).agg(F.count(F.lit(1)).alias("ids"), F.min("id").alias("least"))
    problem = F.when(F.col("ids") > MOST_SCOPE_IDS, "COUNT").when(F.col("least") <= 0, "ENTRY")
    checked = sizes.select(scope, "ids", problem.alias("problem"))
    fits = rows.join(checked.where("problem is null").select(F.col(scope).alias("__s")), F.col(scope).eqNullSafe(F.col("__s")), "left_semi")
    bodies = fits.groupBy(scope).agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), _little), "").alias("body"))
    bodies = bodies.select(F.col(scope).alias("__s"), "body")
    content = F.unhex(F.concat(F.lit(SCOPE_HEAD.hex()), _little(F.col("ids")), F.col("body")))
    found = checked.join(bodies, F.col(scope).eqNullSafe(F.col("__s")), "left").withColumn("content", content)
    return found.select(scope, "ids", "problem", "content", F.sha2("content", 256).alias("sha256"))


def scope_ids(content: bytes) -> np.ndarray | str:
    """The ids of a scope file, or why the bytes are none."""
    if len(content) < 20:
        return "SIZE"
    if content[:8] != SCOPE_HEAD[:8]:
        return "MAGIC"
    if content[8:12] != SCOPE_HEAD[8:]:
        return "VERSION"
    count = int.from_bytes(content[12:20], "little")
    if count == 0 or count > MOST_SCOPE_IDS:
        return "COUNT"
    if len(content) != 20 + 8 * count:
        return "SIZE"
    ids = np.frombuffer(content, "<u8", count, 20)
    return "ENTRY" if ids[0] == 0 or (ids[1:] <= ids[:-1]).any() or ids[-1] >= 2**63 else ids.astype(np.int64)


def decode_scopes(files: DataFrame, scope: str) -> DataFrame:
    """(scope, problem, id) from rows (scope, content); a file with a problem gives one row that names it."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, content in enumerate(batch.column("content").to_pylist()):
                found = scope_ids(content or b"")
                n = 1 if isinstance(found, str) else len(found)
                ids = pa.nulls(1, pa.int64()) if isinstance(found, str) else pa.array(found)
                why = pa.array([found] * n if isinstance(found, str) else [None] * n, pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(scope).take(pa.array([i] * n)), why, ids], names=[scope, "problem", "id"])

    kind = dict(files.dtypes)[scope]
    return files.select(scope, "content").mapInArrow(unpack, f"{scope} {kind}, problem string, id bigint")
