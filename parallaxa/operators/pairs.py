"""Unordered pairs and unique best partners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs (a <= b); null sides void a pair."""
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct()


def shared_count(df: DataFrame, group: str, item: str, least: int = 1) -> DataFrame:
    """(a, b, shared): pairs of items with the number of groups both are in, by a self-join within the group."""
    rows = df.select(group, item).dropna().distinct()
    left, right = rows.withColumnRenamed(item, "a"), rows.withColumnRenamed(item, "b")
    pairs = left.join(right, group).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)


def mutual_unique(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs whose two ends have no other partner."""
    links = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(edges.select(F.col(b).alias("x"), F.col(a).alias("y")))
    single = links.distinct().groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("y")).where("n = 1")
    other = single.select(F.col("x").alias("y"), F.col("y").alias("x2"))
    return single.join(other, "y").where("x = x2 and x < y").select(F.col("x").alias(a), F.col("y").alias(b))


def unique_best(df: DataFrame, group: Sequence[str], item: str, strength: str) -> DataFrame:
    """(group..., top, ties, best): the strongest item of each group, null where the top is tied; strengths above 0 count."""
    best = df.where(F.col(strength) > 0).groupBy(*group, strength).agg(F.count(F.lit(1)).alias("ties"), F.min(item).alias("first"))
    return best.groupBy(*group).agg(
        F.max(strength).alias("top"), F.max_by("ties", strength).alias("ties"), F.max_by("first", strength).alias("first")
    ).select(*group, "top", "ties", F.when(F.col("ties") == 1, F.col("first")).alias("best"))


def rank_in(df: DataFrame, group: Sequence[str], order: Sequence[Column], out: str = "place") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
