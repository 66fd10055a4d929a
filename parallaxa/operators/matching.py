"""The two nearest train rows of every query row within a pair of sets, and the ratio test."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Feature indexes of a set that one block spans.
BLOCK = 4096
#: Queries compared at a time, which bounds the distances held.
_CHUNK = 512


def descriptor_blocks(rows: DataFrame, set_id: str, index: str, kind: str, payload: str) -> DataFrame:
    """(set, kind, block, features): the descriptors of a set in blocks of BLOCK feature indexes."""
    block = F.floor(F.col(index) / BLOCK)
    packed = F.struct(F.col(index).cast("bigint").alias("i"), F.col(payload).alias("v"))
    return rows.groupBy(F.col(set_id).alias("set"), F.col(kind).alias("kind"), block.alias("block")).agg(F.collect_list(packed).alias("features"))


def _matrix(features: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Indexes in order, and their descriptors as rows: bits as 64-bit words, vectors as float64."""
    ids = features.field("i").to_numpy()
    values = features.field("v")
    if pa.types.is_binary(values.type):
        x = np.frombuffer(b"".join(values.to_pylist()), dtype=np.uint64).reshape(len(ids), -1)
    else:
        x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    return ids[order], x[order]


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Differing bits of words, squared Euclidean distances of vectors."""
    if q.dtype == np.uint64:
        return sum(np.bitwise_count(q[:, None, w] ^ x[None, :, w]).astype(np.float64) for w in range(q.shape[1]))
    return np.maximum((q * q).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * (q @ x.T), 0)


def _best_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            sides = [_matrix(batch.column(c)[row].values) for c in ("queries", "trains")]
            (qi, q), (ti, t) = sides
            out: list[list[np.ndarray]] = []
            for at in range(0, len(qi), _CHUNK):
                d = _distances(q[at : at + _CHUNK], t)
                n = np.arange(len(d))
                for _ in range(min(2, len(ti))):
                    best = np.argmin(d, axis=1)  # of equals the first: the smaller index
                    out.append([qi[at + n], ti[best], d[n, best]])
                    d[n, best] = np.inf
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            if q.dtype != np.uint64:
                columns[2] = np.sqrt(columns[2])
            pair = pa.array(np.full(len(columns[0]), batch.column("pair_id")[row].as_py()))
            yield pa.RecordBatch.from_arrays([pair, *map(pa.array, columns)], names=["pair_id", "query_index", "train_index", "distance"])


def two_nearest(pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(pair_id, query_index, train_index, d1, d2) for every query of the sets `a` of (pair_id, a, b) among those of `b`.

    Sets meet block by block: a pair costs the shuffle of its packed blocks, never of its pairs of rows. A task compares
    two blocks by whole-matrix operations and keeps the two nearest of each query; what is left is at most two rows
    for each query and train block. Equal distances take the smaller train index; d2 is null where there is one
    neighbour. Sets of different kinds, and sets without descriptors, have no matches.
    """
    queries = blocks.select(F.col("set").alias("a"), "kind", F.col("features").alias("queries"))
    trains = blocks.select(F.col("set").alias("b"), "kind", F.col("features").alias("trains"))
    met = pairs.join(queries, "a").join(trains, ["b", "kind"]).select("pair_id", "queries", "trains")
    near = met.mapInArrow(_best_two, "pair_id bigint, query_index bigint, train_index bigint, distance double")
    best = near.groupBy("pair_id", "query_index").agg(F.array_sort(F.collect_list(F.struct("distance", "train_index"))).alias("x"))
    return best.select(
        "pair_id", "query_index", F.col("x")[0]["train_index"].alias("train_index"), F.col("x")[0]["distance"].alias("d1"), F.get("x", F.lit(1))["distance"].alias("d2")
    )


def ratio_test(d1: Column, d2: Column, ratio: float) -> Column:
    """Strictly below the ratio, in single precision; a second distance of 0 rejects, a single neighbour passes."""
    return d2.isNull() | ((d2 != 0) & (d1.cast("float") < F.lit(ratio).cast("float") * d2.cast("float")))
