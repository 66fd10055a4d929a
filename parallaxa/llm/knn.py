"""The k nearest vectors of every vector, over balanced posting lists.

A sample is split into balanced lists by trees of two-means cuts: first into cells, then, cell by cell in tasks of their
own, into lists, so that the lists grow in number with the data. The list centroids form a neighbour graph that every
task searches in memory. A vector is a member of its nearest lists (replicas at the boundary) and asks its nearest lists
(probes), both cut off where a centroid is much farther than the nearest one. Spark shuffles vectors by list, crowded
lists in blocks of queries and members; each compares its queries with its members by one matrix product, with exact
distances.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallaxa.llm.topn import top_n
from parallaxa.plans.lineage import Cut, cut


@dataclass(frozen=True)
class Space:
    """Vectors of one kind: `metric` hamming (payload: packed bits) or l2, and the radius within which they count."""

    metric: str
    dimension: int
    radius: float

    def decode(self, payloads: pa.Array) -> np.ndarray:
        """Float32 rows whose squared distances order as the metric does (bits become -1 and 1)."""
        n = len(payloads)
        flat = np.frombuffer(b"".join(payloads.to_pylist()), dtype=np.uint8)
        if self.metric == "hamming":
            bits = np.unpackbits(flat.reshape(n, -1), axis=1).astype(np.float32)
            return bits * 2 - 1
        if len(flat) == n * self.dimension:
            return flat.reshape(n, -1).astype(np.float32)
        rows = [np.frombuffer(p, np.uint8 if len(p) == self.dimension else np.float32) for p in payloads.to_pylist()]
        return np.stack(rows).astype(np.float32)

    def whole(self, payloads: pa.Array) -> bool:
        """Whether all payloads are bits or bytes, by their length."""
        return self.metric == "hamming" or pa.compute.max(pa.compute.binary_length(payloads)).as_py() == self.dimension

    def sides(self, x: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """The rows as queries and as members: the product of the two is minus the squared distance. In float64 unless
        the values are whole and small enough for float32 to be exact."""
        top = float(np.abs(x).max(initial=0)) if self.metric == "l2" else 1.0
        kind = np.float32 if whole and 2 * top * top * x.shape[1] < 2**24 else np.float64
        x = x.astype(kind, copy=False)
        size = np.einsum("ij,ij->i", x, x)[:, None]
        one = np.ones((len(x), 1), dtype=kind)
        return np.concatenate([2 * x, -size, one], axis=1), np.concatenate([x, one, -size], axis=1)

    def within(self, q: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column, squared distance) of the pairs of query and member sides within the radius, of crowded rows
        only the k + 1 nearest and their equals."""
        minus = q @ x.T
        close = minus >= -self.squared_radius * (1 + 1e-12)
        if len(x) > k + 1 and np.count_nonzero(close) > 64 * len(q):
            close &= minus >= np.partition(minus, len(x) - k - 1, axis=1)[:, len(x) - k - 1][:, None]
        at = np.flatnonzero(close)
        r, c = np.divmod(at, len(x))
        return r, c, np.maximum(-minus.ravel()[at].astype(np.float64), 0)

    @property
    def squared_radius(self) -> float:
        return 4.0 * self.radius if self.metric == "hamming" else self.radius * self.radius

    def distance(self, squared: np.ndarray) -> np.ndarray:
        return squared / 4 if self.metric == "hamming" else np.sqrt(squared)


@dataclass(frozen=True)
class Index:
    """Parameters of the posting lists. A space has a list for every `list_rows` rows, but at most `most_lists`, which
    bounds what is broadcast; they are fitted on `sample_per_list` rows each. Where a list has more than `block_members`
    members or `block_queries` queries, by what the sample lets expect, both are split into blocks that meet pairwise."""

    list_rows: int = 300
    most_lists: int = 65_536
    replicas: int = 3
    probes: int = 12
    replica_ratio: float = 1.2
    probe_ratio: float = 1.3
    degree: int = 256
    sample_per_list: int = 8
    lists_per_cell: int = 256
    block_members: int = 4096
    block_queries: int = 16_384
    seed: int = 5


@dataclass
class Lists:
    """Centroids of a space, their neighbours, and into how many blocks the queries and the members of each are split."""

    centroids: np.ndarray
    neighbours: np.ndarray
    query_blocks: np.ndarray
    member_blocks: np.ndarray
    norms: np.ndarray = field(init=False)
    entries: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.norms = (self.centroids**2).sum(1)
        # lists stand in the order of the tree, so that every so-many-th one is a spread of entry points
        step = max(1, int(math.sqrt(len(self.centroids)) / 2))
        self.entries = np.arange(0, len(self.centroids), step)

    def search(self, q: np.ndarray, wanted: int, beam: int = 1, steps: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids of each row by a greedy walk in the graph: (ids, squared distances), nearest first.

        Rows start at their nearest entry point. A step looks at all neighbours of the current centroid and moves to
        the nearest; a row whose centroid has no nearer neighbour stops there, and then looks around the `beam` nearest
        of what it has found, too. Rows at the same centroid step together, so that each step is a few matrix products.
        """
        m, n = len(self.centroids), len(q)
        wanted = min(wanted, m)
        norm = (q * q).sum(1)
        ids = np.full((n, wanted), -1)
        dist = np.full((n, wanted), np.inf, dtype=np.float32)

        def look(rows: np.ndarray, at: int, merge: bool) -> None:
            around = self.neighbours[at]
            around = np.append(around[around >= 0], at)
            d = norm[rows][:, None] + self.norms[around][None, :] - 2 * (q[rows] @ self.centroids[around].T)
            found = np.broadcast_to(around, d.shape)
            if merge:
                d[(found[:, :, None] == ids[rows][:, None, :]).any(2)] = np.inf
                d, found = np.concatenate([dist[rows], d], axis=1), np.concatenate([ids[rows], found], axis=1)
            take = min(wanted, d.shape[1])
            near = np.argpartition(d, take - 1, axis=1)[:, :take] if take < d.shape[1] else np.tile(np.arange(take), (len(rows), 1))
            near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1), 1)
            ids[rows, :take] = np.take_along_axis(found, near, 1)
            dist[rows, :take] = np.take_along_axis(d, near, 1)

        def together(active: np.ndarray, at: np.ndarray, merge: bool) -> None:
            order = active[np.argsort(at[active], kind="stable")]
            for rows in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                look(rows, int(at[rows[0]]), merge)

        now = self.entries[np.argmin(self.norms[self.entries][None, :] - 2 * (q @ self.centroids[self.entries].T), axis=1)]
        active = np.arange(n)
        for _ in range(steps):
            if not len(active):
                break
            together(active, now, False)
            moved = active[ids[active, 0] != now[active]]
            now[moved] = ids[moved, 0]
            active = moved
        if m > self.neighbours.shape[1] + 1:  # else one look has seen all
            seen = [now]
            for place in range(1, min(beam, wanted)):
                at = ids[:, place].copy()
                fresh = (at >= 0) & ~np.any([at == s for s in seen], axis=0)
                together(np.flatnonzero(fresh), at, True)
                seen.append(at)
        return ids, np.maximum(dist, 0)


def balanced_centroids(sample: np.ndarray, leaf: int, seed: int) -> np.ndarray:
    """Centroids of the leaves, of at most `leaf` rows, of a tree of two-means cuts that keep a third on either side."""
    rng = np.random.default_rng(seed)
    stack, leaves = [np.arange(len(sample))], []
    while stack:
        rows = stack.pop()
        if len(rows) <= leaf:
            leaves.append(rows)
            continue
        x = sample[rows]
        a = x[rng.integers(len(x))]
        b = x[np.argmax(((x - a) ** 2).sum(1))]
        for _ in range(5):
            side = x @ (b - a) - (b @ b - a @ a) / 2
            right = side > 0
            if right.all() or not right.any():
                break
            a, b = x[~right].mean(0), x[right].mean(0)
        side = x @ (b - a)
        order = np.argsort(side, kind="stable")
        natural = int((side <= (b @ b - a @ a) / 2).sum())
        at = min(max(natural, int(len(rows) * 0.35)), int(len(rows) * 0.65))
        at = min(max(at, 1), len(rows) - 1)
        stack += [rows[order[at:]], rows[order[:at]]]
    return np.stack([sample[r].mean(0) for r in leaves]).astype(np.float32)


def nearest_centroids(centroids: np.ndarray, first: int, last: int, degree: int) -> np.ndarray:
    """The `degree` nearest other centroids of those numbered from `first` up to `last`; -1 where there are fewer."""
    m = len(centroids)
    found = np.full((last - first, max(1, degree)), -1, dtype=np.int32)
    d = (centroids**2).sum(1)[None, :] - 2 * (centroids[first:last] @ centroids.T)
    d[np.arange(last - first), np.arange(first, last)] = np.inf
    take = min(degree, m - 1)
    if take:
        found[:, :take] = np.argpartition(d, take - 1, axis=1)[:, :take]
    return found


def _chosen(ids: np.ndarray, squared: np.ndarray, ratio: float, most: int) -> np.ndarray:
    """Of the lists in order of distance, those within `ratio` times the distance of the nearest, at most `most`."""
    ok = squared <= (ratio * ratio) * squared[:, :1] + 1e-6
    ok[:, most:] = False
    return ok & (ids >= 0)


_ASSIGNED = "space int, list_no int, block int, role int, major bigint, minor bigint, payload binary"
_QUERY, _MEMBER = 1, 2


def _roles(lists: Lists, x: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lists found, asks, holds) of each row."""
    ids, squared = lists.search(x, index.probes)
    return ids, _chosen(ids, squared, index.probe_ratio, index.probes), _chosen(ids, squared, index.replica_ratio, index.replicas)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a batch by space, a few thousand at a time."""
    of = batch.column("space").to_numpy()
    for s in np.unique(of):
        for part in np.array_split(np.flatnonzero(of == s), max(1, (of == s).sum() // 8192)):
            yield int(s), batch.take(pa.array(part))


def _assign(spaces: list[Space], shared, index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = {s: Lists(*parts) for s, parts in shared.value.items()}
        for batch in batches:
            for s, rows in _parts(batch):
                mine = lists[s]
                ids, asks, holds = _roles(mine, spaces[s].decode(rows.column("payload")), index)
                who, where = np.nonzero(asks | holds)
                role = asks[who, where] * _QUERY + holds[who, where] * _MEMBER
                list_no = ids[who, where]
                block = np.zeros(len(who), dtype=np.int64)
                across, down = mine.member_blocks[list_no], mine.query_blocks[list_no]
                crowded = across * down > 1
                if crowded.any():  # a query meets every block of members, a member every block of queries
                    spread = (rows.column("minor").to_numpy() + 31 * rows.column("major").to_numpy())[who]
                    out = [(who[~crowded], list_no[~crowded], block[~crowded], role[~crowded])]
                    for kind, times in ((_QUERY, across), (_MEMBER, down)):
                        some = np.flatnonzero(crowded & ((role & kind) > 0))
                        n = times[some]
                        again = np.repeat(some, n)
                        other = np.arange(len(again)) - np.repeat(np.cumsum(n) - n, n)
                        if kind == _QUERY:
                            at = (spread[again] % down[again]) * across[again] + other
                        else:
                            at = other * across[again] + spread[again] % across[again]
                        out.append((who[again], list_no[again], at, np.full(len(again), kind)))
                    who, list_no, block, role = (np.concatenate(c) for c in zip(*out, strict=True))
                out = rows.take(pa.array(who))
                yield pa.RecordBatch.from_arrays(
                    [
                        out.column("space"),
                        pa.array(list_no, pa.int32()),
                        pa.array(block, pa.int32()),
                        pa.array(role, pa.int32()),
                        out.column("major"),
                        out.column("minor"),
                        out.column("payload"),
                    ],
                    names=["space", "list_no", "block", "role", "major", "minor", "payload"],
                )

    return run


def _loads(spaces: list[Space], shared, index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = {s: Lists(*parts) for s, parts in shared.value.items()}
        counts = {s: np.zeros((2, len(v.centroids)), dtype=np.int64) for s, v in lists.items()}
        for batch in batches:
            for s, rows in _parts(batch):
                ids, asks, holds = _roles(lists[s], spaces[s].decode(rows.column("payload")), index)
                for i, chosen in enumerate((asks, holds)):
                    counts[s][i] += np.bincount(ids[chosen], minlength=counts[s].shape[1])
        for s, (asked, held) in counts.items():
            some = np.flatnonzero(asked + held)
            columns = [np.full(len(some), s, np.int32), some.astype(np.int32), asked[some], held[some]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["space", "list_no", "asked", "held"])

    return run


_FOUND = "major bigint, minor bigint, distance double, other_major bigint, other_minor bigint"


def _compare(spaces: list[Space], k: int):
    def run(table: pa.Table) -> pa.Table:
        space = spaces[table["space"][0].as_py()]
        role = table["role"].to_numpy()
        queries = table.filter(pa.array((role & _QUERY) > 0)).combine_chunks()
        members = table.filter(pa.array((role & _MEMBER) > 0)).combine_chunks()
        out: list[list[np.ndarray]] = []
        if queries.num_rows and members.num_rows:
            payloads = table["payload"].combine_chunks()
            whole = space.whole(payloads)
            x = space.sides(space.decode(members["payload"].combine_chunks()), whole)[1]
            x_id = (members["major"].to_numpy(), members["minor"].to_numpy())
            for i in range(0, queries.num_rows, 1024):
                part = queries.slice(i, 1024)
                q_id = (part["major"].to_numpy(), part["minor"].to_numpy())
                r, c, squared = space.within(space.sides(space.decode(part["payload"].combine_chunks()), whole)[0], x, k)
                other = (q_id[0][r] != x_id[0][c]) | (q_id[1][r] != x_id[1][c])
                r, c, squared = r[other], c[other], squared[other]
                order = np.lexsort((x_id[1][c], x_id[0][c], squared, r))
                r, c, squared = r[order], c[order], squared[order]
                starts = np.flatnonzero(np.r_[True, r[1:] != r[:-1]]) if len(r) else np.zeros(0, dtype=np.int64)
                place = np.arange(len(r)) - np.repeat(starts, np.diff(np.r_[starts, len(r)]))
                r, c, squared = r[place < k], c[place < k], squared[place < k]
                out.append([q_id[0][r], q_id[1][r], space.distance(squared), x_id[0][c], x_id[1][c]])
        columns = [np.concatenate(parts) for parts in zip(*out, strict=True)] if out else [np.zeros(0)] * 5
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        names = ["major", "minor", "distance", "other_major", "other_minor"]
        return pa.table({n: pa.array(c.astype(t.to_pandas_dtype()), t) for n, c, t in zip(names, columns, kinds, strict=True)})

    return run


def pack_floats(vector: Column, dimension: Column) -> Column:
    """Payload of a float vector: one byte for each element if all are whole from 0 to 255, else float32 bytes.

    Null for a null vector, a length other than `dimension`, and null or non-finite elements.
    """

    def packed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for vectors, dims in batches:
            starts, lengths = vectors.offsets.to_numpy()[:-1], np.diff(vectors.offsets.to_numpy())
            wanted = dims.fill_null(-1).to_numpy(zero_copy_only=False)
            values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float32)  # null elements become NaN
            fits = vectors.is_valid().to_numpy(zero_copy_only=False) & (lengths == wanted)
            out: list[bytes | None] = [None] * len(vectors)
            for d in np.unique(wanted[fits]):
                rows = np.flatnonzero(fits & (wanted == d))
                x = values[starts[rows][:, None] + np.arange(d)]
                sound = np.isfinite(x).all(axis=1)
                small = sound & ((x >= 0) & (x <= 255) & (x == np.floor(x))).all(axis=1)
                for some, cells in ((small, x[small].astype(np.uint8)), (sound & ~small, x[sound & ~small] + np.float32(0))):
                    width, flat = int(d) * cells.itemsize, cells.tobytes()
                    for i, row in enumerate(rows[some]):
                        out[row] = flat[i * width : (i + 1) * width]
            yield pa.array(out, pa.binary())

    def pack(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from packed(batches)

    return F.arrow_udf(pack, "binary")(vector, dimension)


def fit_index(units: DataFrame, counts: dict[int, int], spaces: list[Space], index: Index) -> dict[int, tuple]:
    """The parts of Lists of every space: at most `most_lists` each, so they may be broadcast.

    The sample (`sample_per_list` rows a list) is spread over cells by a first tree on a part of it; then every cell is
    split into its lists, and every stretch of centroids finds its neighbours, in a task of its own.
    """
    spark = units.sparkSession
    lists = {s: max(1, min(index.most_lists, math.ceil(n / index.list_rows))) for s, n in counts.items()}
    fractions = {s: min(1.0, lists[s] * index.sample_per_list / n) for s, n in counts.items()}
    draw = F.pmod(F.xxhash64("major", "minor"), F.lit(1 << 40)) / float(1 << 40)

    def drawn(rows: DataFrame, shares: dict[int, float]) -> DataFrame:
        share = F.lit(0.0)
        for s, fraction in shares.items():
            share = F.when(F.col("space") == s, F.lit(fraction)).otherwise(share)
        return rows.where(draw < share)

    sample = cut(drawn(units.select("space", "major", "minor", "payload"), fractions), "sample")
    cells = {s: math.ceil(m / index.lists_per_cell) for s, m in lists.items()}
    leaf = {s: max(1, math.ceil(counts[s] * fractions[s] / lists[s])) for s in counts}

    def split(pdf: pd.DataFrame, s: int, most: int) -> np.ndarray:
        pdf = pdf.sort_values(["major", "minor"])
        return balanced_centroids(spaces[s].decode(pa.array(pdf["payload"], pa.binary())), most, index.seed)

    def first_cuts(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        s = int(key[0])
        return pd.DataFrame({"centroid": list(split(pdf, s, max(1, math.ceil(len(pdf) / cells[s]))))}).assign(space=s)

    several = {s: fractions[s] / 8 for s, c in cells.items() if c > 1}
    coarse: dict[int, np.ndarray] = {}
    if several:
        found = drawn(sample.df, several).groupBy("space").applyInPandas(first_cuts, "space int, centroid array<float>").toPandas()
        coarse = {int(s): np.stack(part["centroid"].to_list()).astype(np.float32) for s, part in found.groupby("space")}
    shared_cells = spark.sparkContext.broadcast(coarse)

    def into_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, rows in _parts(batch):
                c = shared_cells.value.get(s)
                cell = np.zeros(rows.num_rows, dtype=np.int32)
                if c is not None:
                    cell = np.argmin((c**2).sum(1)[None, :] - 2 * (spaces[s].decode(rows.column("payload")) @ c.T), axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(cell)], names=[*rows.schema.names, "cell"])

    def cell_lists(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        found = split(pdf, int(key[0]), leaf[int(key[0])])
        return pd.DataFrame({"centroid": list(found), "place": np.arange(len(found))}).assign(space=int(key[0]), cell=int(key[1]))

    tagged = sample.df.mapInArrow(into_cells, "space int, major bigint, minor bigint, payload binary, cell int")
    fitted = tagged.groupBy("space", "cell").applyInPandas(cell_lists, "space int, cell int, place int, centroid array<float>").toPandas()
    fitted = fitted.sort_values(["space", "cell", "place"])
    centroids = {int(s): np.stack(part["centroid"].to_list()).astype(np.float32) for s, part in fitted.groupby("space")}
    shared_centroids = spark.sparkContext.broadcast(centroids)
    stretches = [(s, i, min(i + 1024, len(c))) for s, c in centroids.items() for i in range(0, len(c), 1024)]

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s, first, last in pdf.itertuples(index=False):
                near = nearest_centroids(shared_centroids.value[s], first, last, index.degree)
                yield pd.DataFrame({"space": s, "list_no": np.arange(first, last), "near": list(near)})

    todo = spark.createDataFrame(stretches, "space int, first int, last int").repartition(max(1, len(stretches)))
    graph = todo.mapInPandas(around, "space int, list_no int, near array<int>").toPandas().sort_values(["space", "list_no"])
    one = {s: np.ones(len(c), dtype=np.int64) for s, c in centroids.items()}
    parts = {int(s): (centroids[int(s)], np.stack(g["near"].to_list()), one[int(s)], one[int(s)]) for s, g in graph.groupby("space")}
    shared = spark.sparkContext.broadcast(parts)
    loads = sample.df.mapInArrow(_loads(spaces, shared, index), "space int, list_no int, asked bigint, held bigint")
    loads = loads.groupBy("space", "list_no").agg(F.sum("asked").alias("asked"), F.sum("held").alias("held")).toPandas()
    blocks = {s: (one[s].copy(), one[s].copy()) for s in parts}
    for s, part in loads.groupby("space"):
        at = part["list_no"].to_numpy()
        for out, column, most in zip(blocks[int(s)], ("asked", "held"), (index.block_queries, index.block_members), strict=True):
            out[at] = np.maximum(1, np.ceil(part[column].to_numpy() / fractions[int(s)] / most)).astype(np.int64)
    sample.drop()
    for b in (shared_cells, shared_centroids, shared):
        b.unpersist()
    return {s: (c, near, *blocks[s]) for s, (c, near, *_) in parts.items()}


@dataclass
class Neighbours:
    """`units`: space, major, minor, ids (the first k + 1 records of equal payload), one row a distinct payload.
    `near`: major, minor, others (sorted structs distance, major, minor). `rows`: all records that take part."""

    units: DataFrame
    near: DataFrame
    rows: DataFrame
    k: int
    held: list[Cut]

    def per_record(self) -> DataFrame:
        """(major, minor, distance, other_major, other_minor): up to k nearest others of every record, ties by id."""
        k = self.k
        several = self.units.where(F.size("ids") > 1)
        ids_of = several.select(F.col("major").alias("o_major"), F.col("minor").alias("o_minor"), F.col("ids").alias("o_ids"))
        others = (
            self.near.select("major", "minor", F.explode("others").alias("o"))
            .select("major", "minor", "o.distance", F.col("o.major").alias("o_major"), F.col("o.minor").alias("o_minor"))
            .join(ids_of, ["o_major", "o_minor"], "left")
            .withColumn("o_ids", F.coalesce("o_ids", F.array(F.struct(F.col("o_major").alias("major"), F.col("o_minor").alias("minor")))))
            .select("major", "minor", "distance", F.explode("o_ids").alias("id"))
            .select("major", "minor", F.struct("distance", "id").alias("x"))
        )
        copies = several.select(
            "major", "minor", F.explode("ids").alias("id")
        ).select("major", "minor", F.struct(F.lit(0.0).alias("distance"), "id").alias("x"))
        known = others.unionByName(copies).groupBy("major", "minor").agg(F.array_sort(F.collect_list("x")).alias("xs"))
        own = several.select("major", "minor", "ids")
        lists = known.join(own, ["major", "minor"], "left").withColumn(
            "ids", F.coalesce("ids", F.array(F.struct("major", "minor")))
        )
        firsts = lists.select("xs", F.explode("ids").alias("me")).select(
            "me", F.explode(F.slice(F.filter("xs", lambda x: x["id"] != F.col("me")), 1, k)).alias("x")
        )
        # records beyond the first k + 1 of equal payload: their neighbours are the first k of these
        full = self.units.where(F.size("ids") > k).select(F.col("space").alias("s"), F.col("payload").alias("p"), "ids")
        rest = (
            self.rows.join(full, (F.col("space") == F.col("s")) & (F.col("payload") == F.col("p")))
            .select(F.struct("major", "minor").alias("me"), "ids")
            .where(~F.array_contains("ids", F.col("me")))
            .distinct()
            .select("me", F.explode(F.slice("ids", 1, k)).alias("id"))
            .select("me", F.struct(F.lit(0.0).alias("distance"), "id").alias("x"))
        )
        return firsts.unionByName(rest).select(
            F.col("me.major").alias("major"),
            F.col("me.minor").alias("minor"),
            "x.distance",
            F.col("x.id.major").alias("other_major"),
            F.col("x.id.minor").alias("other_minor"),
        )


def nearest(rows: DataFrame, spaces: list[Space], k: int, index: Index | None = None) -> Neighbours:
    """The k nearest others of every record within its space and the space's radius.

    `rows`: space (position in `spaces`), major, minor, payload; rows with a null in any of these take no part, and
    repeated rows count once. Equal distances are ordered by (major, minor). Records of equal payload are searched once
    and have distance 0 from each other, however many they are. A space with one record, and an empty table, give no
    neighbours. Recall depends on `index`; the distances of what is found are exact.
    """
    index = index or Index()
    valid = rows.select("space", "major", "minor", "payload").dropna()
    base = cut(valid, "vectors")
    first = top_n(
        base.df.withColumn("n", F.lit(k + 1)), ["space", "payload"], [("major", "ascending"), ("minor", "ascending")], ["major", "minor"], "n"
    )
    grouped = first.groupBy("space", "payload").agg(F.array_sort(F.collect_list(F.struct("major", "minor"))).alias("ids"))
    units = cut(
        grouped.select("space", F.col("ids")[0]["major"].alias("major"), F.col("ids")[0]["minor"].alias("minor"), "ids", "payload"),
        "units",
    )
    counts = {r["space"]: r["count"] for r in units.df.groupBy("space").count().collect()}
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(fit_index(units.df, counts, spaces, index))
    assigned = units.df.select("space", "major", "minor", "payload").mapInArrow(_assign(spaces, shared, index), _ASSIGNED)
    found = assigned.groupBy("space", "list_no", "block").applyInArrow(_compare(spaces, k), _FOUND)
    near = found.groupBy("major", "minor").agg(
        F.slice(
            F.array_sort(
                F.collect_set(F.struct("distance", F.col("other_major").alias("major"), F.col("other_minor").alias("minor")))
            ),
            1,
            k,
        ).alias("others")
    )
    kept = cut(near, "near")
    return Neighbours(units.df, kept.df, base.df, k, [base, units, kept])
