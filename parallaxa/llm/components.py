"""Pairwise matches to groups: peel the giant component, label the rest by minimum propagation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parallaxa.operators.components import both_ways, coded_pairs, propagate
from parallaxa.plans.lineage import Cut, cut


def peel(edges: DataFrame, max_rounds: int) -> tuple[list[Cut], int, bool]:
    """Breadth-first search by frontier joins from the vertex of highest degree.

    Returns the frontiers, the start vertex, and whether the component was exhausted within `max_rounds`.
    """
    both = both_ways(edges)
    start = both.groupBy("u").count().orderBy(F.desc("count"), "u").head()[0]
    # the hub's own edges are a filter, not a join: no task receives them all by key
    first = both.where(F.col("u") == start).select("v").union(edges.sparkSession.createDataFrame([(start,)], "v bigint"))
    frontiers = [cut(first.distinct(), "frontier")]
    for _ in range(max_rounds):
        # a neighbour of the last frontier lies in it, in the one before, or is new
        near = frontiers[-1].df if len(frontiers) == 1 else frontiers[-1].df.union(frontiers[-2].df)
        reached = (
            both.where(F.col("u") != start)
            .join(frontiers[-1].df.where(F.col("v") != start).select(F.col("v").alias("u")), "u", "left_semi")
            .select("v")
            .distinct()
            .join(near, "v", "left_anti")
        )
        frontiers.append(cut(reached, "frontier"))
        if not frontiers[-1].df.head(1):
            return frontiers, start, True
    return frontiers, start, False


def connected_groups(
    pairs: DataFrame,
    side_a: Sequence[str] = ("major_a", "minor_a"),
    side_b: Sequence[str] = ("major_b", "minor_b"),
    peel_rounds: int = 12,
) -> DataFrame:
    """(major, minor, group_major, group_minor) for every vertex named by a pair.

    Vertices are pairs of BIGINT (of each side the major, then the minor part) and groups are named by their smallest
    member. A pair with a null part is void; repeated and reversed pairs count once; a vertex paired only with itself
    is a group of one; an empty input gives an empty result; further columns are not read.

    The giant component is peeled by breadth-first joins from the vertex of highest degree and anti-joined away. If it
    is deeper than `peel_rounds`, what was reached shrinks to its start vertex and goes on with the rest: the result is
    the same. The rest is labelled by minimum propagation; chains that are longer than its rounds are contracted.
    """
    coded = coded_pairs(pairs, side_a, side_b)
    kept = coded.edges
    edges = kept.where("u <> v")
    loops = kept.where("u = v").select("u")
    alone = loops.join(both_ways(edges).select("u").distinct(), "u", "left_anti").select(F.col("u").alias("v"), F.col("u").alias("low"))
    labels = alone
    if edges.head(1):
        frontiers, start, exhausted = peel(edges, peel_rounds)
        seen = frontiers[0].df
        for f in frontiers[1:]:
            seen = seen.union(f.df)
        smallest = seen.agg(F.min("v")).head()[0]
        mark = seen.select(F.col("v").alias("u"))
        if exhausted:
            rest = cut(edges.join(mark, "u", "left_anti"), "rest")
            found = propagate(rest.df)
            giant = F.lit(smallest)
        else:
            in_u = mark.withColumn("in_u", F.lit(True))
            in_v = seen.withColumn("in_v", F.lit(True))
            rest = cut(
                edges.join(in_u, "u", "left")
                .join(in_v, "v", "left")
                .where("in_u is null or in_v is null")
                .select(
                    F.when(F.col("in_u"), F.lit(start)).otherwise(F.col("u")).alias("u"),
                    F.when(F.col("in_v"), F.lit(start)).otherwise(F.col("v")).alias("v"),
                )
                .distinct(),
                "rest",
            )
            found = propagate(rest.df, (start, smallest))
            row = found.where(F.col("v") == start).head()
            giant = F.lit(row["low"] if row else smallest)
            found = found.where(F.col("v") != start)
        rest.drop()
        labels = labels.unionByName(found).unionByName(seen.select("v", giant.cast("bigint").alias("low")))
    return coded.decode(labels)
