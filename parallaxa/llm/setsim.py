"""All similar pairs between set-valued records: minwise signatures, bands, exact verification."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallaxa.plans.lineage import Cut, cut


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _band_hashes(bands: int, rows: int, seed: int):
    rng = np.random.default_rng(seed)
    factor = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for sets in batches:
            n = len(sets)
            if not n:
                yield pa.array([], pa.list_(pa.int64()))
                continue
            values = _mix(sets.flatten().to_numpy().astype(np.int64).view(np.uint64))
            lengths = sets.value_lengths().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
            out = np.empty((n, bands), dtype=np.uint64)
            with np.errstate(over="ignore"):
                for band in range(bands):
                    h = np.full(n, np.uint64(band + 1))
                    for i in range(band * rows, (band + 1) * rows):
                        least = np.minimum.reduceat(values * factor[i] + shift[i], starts)
                        h = _mix(h ^ least) + np.uint64(0x9E3779B97F4A7C15)
                    out[:, band] = h
            ends = np.arange(0, (n + 1) * bands, bands, dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(out.view(np.int64).ravel()))

    def hashes(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from run(batches)

    return F.arrow_udf(hashes, "array<bigint>")


def _alike_in_size(a: Column, b: Column, threshold: float) -> Column:
    """Whether sets of these sizes can be so similar at all."""
    return F.least(a, b) >= F.lit(threshold - 1e-9) * F.greatest(a, b)


def _pairs_within(space: list[str], grouped: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a < b) of the bounded lists `ids` (structs id, size) whose sizes allow the similarity."""
    ids = F.array_sort("ids")
    pairs = F.flatten(
        F.transform(
            ids,
            lambda a, i: F.transform(
                F.filter(F.slice(ids, i + 2, F.size(ids)), lambda b: _alike_in_size(a["size"], b["size"], threshold)),
                lambda b: F.struct(a["id"].alias("a"), b["id"].alias("b")),
            ),
        )
    )
    return grouped.where(F.size("ids") > 1).select(*space, F.explode(pairs).alias("p")).select(*space, "p.a", "p.b").distinct()


def _joined_on(rows: DataFrame, key: list[str], space: list[str], threshold: float) -> DataFrame:
    """Pairs (a < b) of rows (key, id, size) with one key and sizes that allow the similarity."""
    a = rows.select(*key, F.col("id").alias("a"), F.col("size").alias("size_a"))
    b = rows.select(*key, F.col("id").alias("b"), F.col("size").alias("size_b"))
    met = a.join(b, key).where("a < b").where(_alike_in_size(F.col("size_a"), F.col("size_b"), threshold))
    return met.select(*space, "a", "b")


def _prefix_pairs(sets: DataFrame, space: list[str], threshold: float, most: int) -> DataFrame:
    """Exact candidates without hot buckets: records that share one of their rarest elements, or two of them.

    Two sets of similarity t or more share an element among the first size - ceil(t * size) + 1 of each, in one
    common order; with the rarest first, the lists per element stay short. Sets that share none but elements of more
    than `most` records must, if their sizes ask for an overlap of two or more, share a second element among one more
    of each: they meet on such pairs of elements. Sets too small for that are compared on the element alone.
    """
    kinds, outer, space = sets.select(*space).schema, space, ["__space"]  # one text for the space, which joins on nulls too
    sets = sets.withColumn("__space", F.to_json(F.struct(*outer)))
    flat = sets.select(*space, "id", F.explode("elements").alias("e"), F.size("elements").alias("size"))
    often = flat.groupBy(*space, "e").agg(F.count(F.lit(1)).alias("n"))
    ranked = (
        flat.join(often, [*space, "e"])
        .groupBy(*space, "id", "size")
        .agg(F.array_sort(F.collect_list(F.struct("n", "e"))).alias("es"))
    )
    keep = F.col("size") - F.ceil(F.lit(threshold) * F.col("size")).cast("int") + 1
    listed = cut(ranked.select(*space, "id", "size", F.transform("es", lambda x: x["e"]).alias("es"), keep.alias("keep")), "ranked").df
    prefix = listed.select(*space, "id", "size", F.explode(F.slice("es", F.lit(1), F.col("keep"))).alias("e"))
    lists = prefix.groupBy(*space, "e").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).drop("n")
    crowded = prefix.join(lists, [*space, "e"], "left_semi")
    single = _joined_on(prefix.join(lists, [*space, "e"], "left_anti"), [*space, "e"], space, threshold)
    small = _joined_on(crowded.where(F.col("size") <= (1 + threshold) / threshold), [*space, "e"], space, threshold)
    again = listed.select(*space, "id", F.explode(F.slice("es", F.lit(1), F.col("keep") + 1)).alias("e2"))
    double = crowded.join(again, [*space, "id"]).where("e <> e2")
    found = single.union(small).union(_joined_on(double, [*space, "e", "e2"], space, threshold)).distinct()
    return found.withColumn("__space", F.from_json("__space", kinds)).select(*[F.col("__space")[s].alias(s) for s in outer], "a", "b")


@dataclass
class SimilarSets:
    """`pairs`: space, a, b, overlap, size_a, size_b of classes of equal sets (a < b, named by their smallest id).
    `members`: space, id, class_id, size. `held`: the written tables that these read."""

    pairs: DataFrame
    members: DataFrame
    held: list[Cut]


def similar_sets(
    postings: DataFrame,
    space: Sequence[str],
    record: str,
    element: str,
    threshold: float,
    bands: int = 50,
    rows: int = 2,
    element_cap: int | None = None,
    max_bucket: int = 1000,
    seed: int = 11,
) -> SimilarSets:
    """All pairs of records of one space whose element sets have a Jaccard similarity of at least `threshold`.

    `postings` has a row for each element of a record; record and element are BIGINT. Rows with a null record or
    element are void, repeated rows count once, null space values form a space, records without elements have no
    pairs, an empty table gives empty results, and columns not named are not read.

    Records with equal sets form a class first, so that copies are neither compared nor expanded. Each class gets
    `bands` hashes of `rows` minwise values; classes that share a band are candidates, once each, and every candidate
    is verified on the exact sets. A pair of similarity s is missed with probability (1 - s**rows)**bands: 2e-4 at
    0.4 for the defaults. If `element_cap` says that an element has at most so many records and that is within
    `max_bucket`, no band bucket can be larger; otherwise larger buckets are counted and their records compared by
    `_prefix_pairs`, which loses nothing.
    """
    space = list(space)
    rows_in = postings.select(*space, F.col(record).cast("bigint").alias("id"), F.col(element).cast("bigint").alias("e"))
    sets = (
        rows_in.dropna(subset=["id", "e"])
        .groupBy(*space, "id")
        .agg(F.array_sort(F.collect_set("e")).alias("elements"))
        .withColumn("print", F.md5(F.concat_ws(",", F.col("elements").cast("array<string>"))))
    )
    kept = cut(sets, "sets")
    classes = kept.df.groupBy(*space, "print").agg(
        F.min("id").alias("class_id"), F.min_by("elements", "id").alias("elements")
    )
    named = cut(classes, "classes")
    members = (
        kept.df.select(*space, "id", "print", F.size("elements").alias("size"))
        .join(named.df.select(*[F.col(s).alias(f"__{s}") for s in space], F.col("print").alias("__p"), "class_id"),
              _same(space) & (F.col("print") == F.col("__p")))
        .select(*space, "id", "class_id", "size")
    )
    whole = named.df.select(*space, F.col("class_id").alias("id"), "elements")
    banded = whole.select(
        *space, F.struct("id", F.size("elements").alias("size")).alias("id"), F.posexplode(_band_hashes(bands, rows, seed)(F.col("elements"))).alias("band", "hash")
    )
    bucket = [*space, "band", "hash"]
    if element_cap is not None and element_cap <= max_bucket:
        candidates = _pairs_within(space, banded.groupBy(*bucket).agg(F.collect_list("id").alias("ids")), threshold)
    else:
        written = cut(banded, "bands")
        large = written.df.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_bucket).drop("n")
        large = large.select(*[F.col(s).alias(f"__{s}") for s in space], F.col("band").alias("__band"), F.col("hash").alias("__hash"))
        on = _same(space) & (F.col("band") == F.col("__band")) & (F.col("hash") == F.col("__hash"))
        small = written.df.join(large, on, "left_anti")
        hot = written.df.join(large, on, "left_semi").select(*space, "id.id").distinct()
        hot = hot.select(*[F.col(s).alias(f"__{s}") for s in space], F.col("id").alias("__id"))
        hot_sets = whole.join(hot, _same(space) & (F.col("id") == F.col("__id")), "left_semi")
        candidates = (
            _pairs_within(space, small.groupBy(*bucket).agg(F.collect_list("id").alias("ids")), threshold)
            .union(_prefix_pairs(hot_sets, space, threshold, max_bucket))
            .distinct()
        )

    def side(name: str) -> DataFrame:
        return whole.select(
            *[F.col(s).alias(f"__{s}") for s in space], F.col("id").alias(name), F.col("elements").alias(f"set_{name}")
        )

    checked = candidates
    for name in ("a", "b"):
        mine = side(f"__{name}")
        checked = checked.join(mine, _same(space) & (F.col(name) == F.col(f"__{name}"))).drop(f"__{name}", *[f"__{s}" for s in space])
    pairs = (
        checked.select(
            *space,
            "a",
            "b",
            F.size(F.array_intersect("set___a", "set___b")).alias("overlap"),
            F.size("set___a").alias("size_a"),
            F.size("set___b").alias("size_b"),
        )
        .where(F.col("overlap") >= F.lit(threshold) * (F.col("size_a") + F.col("size_b") - F.col("overlap")) - 1e-9)
    )
    return SimilarSets(pairs, members, [kept, named])


def _same(space: list[str]):
    on = F.lit(True)
    for s in space:
        on = on & F.col(s).eqNullSafe(F.col(f"__{s}"))
    return on
