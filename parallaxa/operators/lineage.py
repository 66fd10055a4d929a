"""Lineage between a frozen base and its extension."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lineage_states(base: DataFrame, extension: DataFrame, key: str, child: str) -> DataFrame:
    """(key, descendants, descendant, state): EXACT if a base key has one descendant, else MISSING or SPLIT."""
    found = extension.groupBy(key).agg(F.count_distinct(child).alias("n"), F.min(child).alias("descendant"))
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return base.join(found, key, "left").select(
        key, n.alias("descendants"), "descendant", F.when(n == 0, "MISSING").when(n > 1, "SPLIT").otherwise("EXACT").alias("state")
    )


def merged_keys(extension: DataFrame, key: str, child: str) -> DataFrame:
    """(child, keys): descendants that several base keys lead to."""
    return extension.groupBy(child).agg(F.count_distinct(key).alias("keys")).where("keys > 1")


def affected_groups(changed: DataFrame, members: DataFrame, group: str, item: str) -> DataFrame:
    """Groups with a changed item: all that has to be computed again."""
    return members.join(changed.select(item).distinct(), item, "left_semi").select(group).distinct()


def lineage_verdicts(base: DataFrame, extension: DataFrame, track: str, component: str, key: Sequence[str]) -> DataFrame:
    """(track, component, descendant, state) for every base track.

    base: track, component and the keys of its members; extension: track and keys, each key on one track. DUPLICATE:
    a key of the track is on several extension rows. MISSING: a key is on none. SPLIT: its keys are on several tracks.
    Otherwise all are on one descendant: EXACT for the smallest base track that leads there, for any other MERGE if it
    is of the same component, else CROSS_COMPONENT_BRIDGE. The descendant is null where there isn't exactly one.
    """
    key = list(key)
    found = extension.groupBy(*key).agg(F.min(track).alias("__to"), F.count(F.lit(1)).alias("__rows"))
    fate = (
        base.join(found, key, "left")
        .groupBy(track)
        .agg(
            F.max(component).alias(component),
            F.count_if(F.col("__rows") > 1).alias("__twice"),
            F.count_if(F.col("__to").isNull()).alias("__lost"),
            F.min("__to").alias("__low"),
            F.max("__to").alias("__high"),
        )
    )
    single = (F.col("__twice") == 0) & (F.col("__lost") == 0) & (F.col("__low") == F.col("__high"))
    fate = fate.withColumn("descendant", F.when(single, F.col("__low")))
    firsts = (
        fate.where("descendant is not null")
        .groupBy("descendant")
        .agg(F.min(track).alias("__first"), F.min_by(component, track).alias("__component"))
    )
    state = (
        F.when(F.col("__twice") > 0, "DUPLICATE")
        .when(F.col("__lost") > 0, "MISSING")
        .when(F.col("descendant").isNull(), "SPLIT")
        .when(F.col("__first") == F.col(track), "EXACT")
        .when(F.col("__component").eqNullSafe(F.col(component)), "MERGE")
        .otherwise("CROSS_COMPONENT_BRIDGE")
    )
    return fate.join(firsts, "descendant", "left").select(track, component, "descendant", state.alias("state"))


def extended(kept: DataFrame, rows: DataFrame, changed: DataFrame, group: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results of all groups after an extension: `compute` over the rows of the changed groups only, the others as they
    were `kept`; `recomputed` says which. Without changes nothing is computed again."""
    touched = changed.select(group).where(F.col(group).isNotNull()).distinct()
    again = compute(rows.join(touched, group, "left_semi")).withColumn("recomputed", F.lit(True))
    return kept.join(touched, group, "left_anti").withColumn("recomputed", F.lit(False)).unionByName(again)
