"""Grids over points: quotas, coverage and one-to-one association within a radius."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallaxa.functions.geometry import spatial_cell
from parallaxa.plans.lineage import cut


def quota_selection(df: DataFrame, image: Sequence[str], cell: Sequence[str], order: Sequence[Column], per_cell: int, most: int) -> DataFrame:
    """The best rows of each image: at most `per_cell` of a cell, then at most `most` in all, in one order."""
    in_cell = F.row_number().over(Window.partitionBy(*image, *cell).orderBy(*order))
    in_image = F.row_number().over(Window.partitionBy(*image).orderBy(*order))
    return df.withColumn("in_cell", in_cell).where(F.col("in_cell") <= per_cell).withColumn("place", in_image).where(F.col("place") <= most)


def coverage(df: DataFrame, image: Sequence[str], cell: Sequence[str], total: int, megapixels: Column) -> DataFrame:
    """(image..., points, occupied, ratio, density)."""
    return df.groupBy(*image).agg(
        F.count(F.lit(1)).alias("points"), F.count_distinct(*cell).alias("occupied"), F.max(megapixels).alias("__mpx")
    ).select(
        *image, "points", "occupied", (F.col("occupied") / F.lit(total)).alias("ratio"), (F.col("points") / F.col("__mpx")).alias("density")
    )


def near_points(a: DataFrame, b: DataFrame, group: str, radius: float) -> DataFrame:
    """(group, a_index, b_index, d2): pairs of points (index, x, y) of a group within `radius`, borders included.

    The points of `a` probe the 3 x 3 cells around them, so that the range join is an equi-join on cells.
    """
    left = a.select(
        group, F.col("index").alias("a_index"), F.col("x").alias("ax"), F.col("y").alias("ay"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("o"),
    )
    left = left.withColumn("cx", spatial_cell(F.col("ax"), radius) + F.col("o.i")).withColumn("cy", spatial_cell(F.col("ay"), radius) + F.col("o.j"))
    right = b.select(
        group, F.col("index").alias("b_index"), F.col("x").alias("bx"), F.col("y").alias("by"),
        spatial_cell(F.col("x"), radius).alias("cx"), spatial_cell(F.col("y"), radius).alias("cy"),
    )
    dx, dy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    return (
        left.join(right, [group, "cx", "cy"])
        .withColumn("d2", dx * dx + dy * dy)
        .where(F.col("d2") <= radius * radius)
        .select(group, "a_index", "b_index", "d2")
    )


def greedy_association(near: DataFrame, group: str) -> DataFrame:
    """One-to-one partners: points of `a` in index order take their nearest free partner, ties by smaller index.

    Without going through a group in order: every point of `a` asks its nearest partner left, every partner holds the
    smallest index that asked it, and all pairs of that partner with larger indexes are struck off, as whoever takes it
    in the end is no larger. Once nothing is struck off, what is asked is held. Each round is two aggregations and a
    join over the pairs left; pairs are distinct.
    """
    left = cut(near.select(group, "a_index", "b_index", "d2").where(F.col(group).isNotNull()), "near")
    while True:
        asked = left.df.groupBy(group, "a_index").agg(F.min(F.struct("d2", "b_index")).alias("best"))
        asked = asked.select(group, "a_index", "best.b_index", "best.d2")
        held = asked.groupBy(group, "b_index").agg(F.min("a_index").alias("holder"))
        judged = left.df.join(held, [group, "b_index"], "left").withColumn("off", F.coalesce(F.col("a_index") > F.col("holder"), F.lit(False)))
        marked = cut(judged, "judged")
        if not marked.df.where("off").head(1):
            marked.drop()
            return asked
        following = cut(marked.df.where("not off").select(group, "a_index", "b_index", "d2"), "near")
        marked.drop()
        left.drop()
        left = following
