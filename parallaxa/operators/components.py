"""Connected components of edge lists by minimum propagation and contraction, and what tracks need of them."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallaxa.plans.lineage import Cut, cut


def _mixed(x: Column, mask: int) -> Column:
    """A one-to-one scrambling of BIGINTs (xor and shifts), so that minima fall at random places."""
    x = x.bitwiseXOR(F.lit(mask))
    for left, right, again in ((13, 7, 17), (23, 17, 26)):
        x = x.bitwiseXOR(F.shiftleft(x, left))
        x = x.bitwiseXOR(F.shiftrightunsigned(x, right))
        x = x.bitwiseXOR(F.shiftleft(x, again))
    return x


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least_within(edges: DataFrame, hops: int, value: Callable[[Column], Column]) -> DataFrame:
    """(x, low): the least `value` among the vertices within `hops` steps of each vertex, by that many rounds of
    minimum propagation. A round takes the least label of the neighbours: from the second on, theirs include one's own.
    """
    both = both_ways(edges)
    now = both.groupBy(F.col("u").alias("x")).agg(F.least(value(F.col("x")), F.min(value(F.col("v")))).alias("low"))
    for _ in range(hops - 1):
        around = now.select(F.col("x").alias("v"), "low")
        now = both.join(around, "v").groupBy(F.col("u").alias("x")).agg(F.min("low").alias("low"))
    return now


def _contracted(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges between the names (x, low) of their ends; edges within one name are gone, and with them all components
    that have one name by now."""
    of_u = names.select(F.col("x").alias("u"), F.col("low").alias("a"))
    of_v = names.select(F.col("x").alias("v"), F.col("low").alias("b"))
    ends = edges.join(of_u, "u").join(of_v, "v").where("a <> b")
    return ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def propagate(
    edges: DataFrame, shrunk: tuple[int, int] | None = None, seed: int = 7, first_hops: int = 4, hops: int = 2
) -> DataFrame:
    """(v, low): the smallest vertex of each vertex's component, from edges (u, v) with u <> v.

    `shrunk` is a vertex that stands for others, with the smallest of those. First, `first_hops` rounds of minimum
    propagation over the vertices themselves: components no deeper than that, by far the most, are labelled then and
    take no further part. In what is left, vertices of one label merge, and the same goes on over scrambled names,
    `hops` rounds at a time. The scrambling is new each time, so that chains in id order shrink by a constant factor
    too: the jobs grow with the logarithm of the longest chain, where propagation alone takes a round for every step
    of it. Minima combine before the shuffle, so a vertex with very many edges is no single task's work there.
    """
    rnd = random.Random(seed)
    own = (lambda x: x) if shrunk is None else (lambda x: F.when(x == shrunk[0], F.lit(shrunk[1])).otherwise(x))
    base = cut(_least_within(edges.select("u", "v"), first_hops, own), "names")
    rest = cut(_contracted(edges.select("u", "v"), base.df), "contracted")
    levels: list[Cut] = []
    while rest.df.head(1):
        mask = rnd.getrandbits(63)
        names = cut(_least_within(rest.df, hops, lambda x: _mixed(x, mask)), "names")
        following = cut(_contracted(rest.df, names.df), "contracted")
        levels.append(names)
        rest.drop()
        rest = following
    rest.drop()
    if not levels:
        return base.df.select(F.col("x").alias("v"), "low")
    final = levels[-1].df.select("x", F.col("low").alias("name"))
    for names in reversed(levels[:-1]):
        later = final.select(F.col("x").alias("low"), F.col("name").alias("later"))
        final = names.df.join(later, "low", "left").select("x", F.coalesce("later", "low").alias("name"))
    merged = cut(final, "members")
    for names in levels:
        names.drop()
    lows = merged.df.groupBy("name").agg(F.min("x").alias("least"))
    found = cut(merged.df.join(lows, "name").select(F.col("x").alias("low"), "least"), "lows")
    merged.drop()
    return base.df.join(found.df, "low", "left").select(F.col("x").alias("v"), F.coalesce("least", "low").alias("low"))


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(v, low) for every vertex that an edge names; null ends void the edge, a loop makes a component of one."""
    rows = edges.select(F.col(u).cast("bigint").alias("u"), F.col(v).cast("bigint").alias("v")).dropna()
    kept = cut(rows.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    return labelled(kept.df)


@dataclass
class CodedPairs:
    """Pairs of vertices (major, minor) as distinct edges u <= v of BIGINT codes in the same order; loops included.

    A code holds the two parts side by side where they fit into 63 bits; wider or negative parts are numbered in order.
    """

    edges: DataFrame
    shift: int | None
    vertices: DataFrame | None = None
    held: list[Cut] = field(default_factory=list)

    def decode(self, labels: DataFrame) -> DataFrame:
        """(major, minor, group_major, group_minor) from labels (v, low)."""
        if self.shift is not None:
            low_bits = F.lit((1 << self.shift) - 1)
            return labels.select(
                F.shiftright("v", self.shift).alias("major"), F.col("v").bitwiseAND(low_bits).alias("minor"),
                F.shiftright("low", self.shift).alias("group_major"), F.col("low").bitwiseAND(low_bits).alias("group_minor"),
            )
        own = self.vertices.select("major", "minor", F.col("code").alias("v"))
        group = self.vertices.select(F.col("major").alias("group_major"), F.col("minor").alias("group_minor"), F.col("code").alias("low"))
        return labels.join(own, "v").join(group, "low").select("major", "minor", "group_major", "group_minor")


def coded_pairs(pairs: DataFrame, side_a: Sequence[str], side_b: Sequence[str]) -> CodedPairs:
    """Codes of pairs whose sides are columns (major, minor); a pair with a null part is void."""
    (ma, na), (mb, nb) = side_a, side_b
    rows = pairs.select(*(F.col(c).cast("bigint").alias(x) for c, x in ((ma, "ma"), (na, "na"), (mb, "mb"), (nb, "nb")))).dropna()
    swap = F.struct("ma", "na") > F.struct("mb", "nb")
    ordered = rows.select(
        F.when(swap, F.col("mb")).otherwise(F.col("ma")).alias("ma"),
        F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"),
        F.when(swap, F.col("ma")).otherwise(F.col("mb")).alias("mb"),
        F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb"),
    ).distinct()
    raw = cut(ordered, "pairs")
    bounds = raw.df.agg(
        F.max(F.greatest("ma", "mb")).alias("major"), F.max(F.greatest("na", "nb")).alias("minor"), F.min(F.least("ma", "mb", "na", "nb")).alias("least")
    ).head()
    shift = max(1, int(bounds["minor"] or 0).bit_length())
    if bounds["least"] is None or (bounds["least"] >= 0 and int(bounds["major"]).bit_length() + shift <= 63):
        code = lambda major, minor: F.shiftleft(F.col(major), shift).bitwiseOR(F.col(minor))
        return CodedPairs(raw.df.select(code("ma", "na").alias("u"), code("mb", "nb").alias("v")), shift, held=[raw])
    ends = raw.df.select(F.col("ma").alias("major"), F.col("na").alias("minor")).union(raw.df.select("mb", "nb"))
    names = cut(ends.distinct().orderBy("major", "minor").withColumn("code", F.monotonically_increasing_id()), "vertices")
    a = names.df.select(F.col("major").alias("ma"), F.col("minor").alias("na"), F.col("code").alias("u"))
    b = names.df.select(F.col("major").alias("mb"), F.col("minor").alias("nb"), F.col("code").alias("v"))
    coded = cut(raw.df.join(a, ["ma", "na"]).join(b, ["mb", "nb"]).select("u", "v"), "coded")
    raw.drop()
    return CodedPairs(coded.df, None, names.df, [names, coded])


def labelled(kept: DataFrame) -> DataFrame:
    """(v, low) of distinct edges u <= v, where a loop makes a component of one."""
    linked = kept.where("u <> v")
    alone = kept.where("u = v").select("v").join(both_ways(linked).select("v"), "v", "left_anti")
    return propagate(linked).unionByName(alone.select("v", F.col("v").alias("low")))


def pair_components(pairs: DataFrame, side_a: Sequence[str], side_b: Sequence[str]) -> DataFrame:
    """(major, minor, group_major, group_minor): components of pairs of two-part vertices, ids of any width."""
    coded = coded_pairs(pairs, side_a, side_b)
    return coded.decode(labelled(coded.edges))


def accepted_tracks(members: DataFrame, track: str, image: str, meta: str) -> DataFrame:
    """(track, size, images, accepted): a component counts whole or not at all.

    It needs two members, one kind of extractor, and no two members in one image.
    """
    return members.groupBy(track).agg(
        F.count(F.lit(1)).alias("size"), F.count_distinct(image).alias("images"), F.count_distinct(meta).alias("metas")
    ).select(
        track,
        "size",
        "images",
        ((F.col("size") >= 2) & (F.col("metas") == 1) & (F.col("images") == F.col("size"))).alias("accepted"),
    )
