"""Violations of keys, references and rules, counted in as few passes as the tables allow."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallaxa.operators.components import components
from parallaxa.plans.lineage import cut


def rule_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) of row rules, all in one pass; a null outcome is no violation."""
    counts = df.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules]))
    return counts.select(pairs.alias("p")).select("p.rule", "p.violations")


def orphans(child: DataFrame, parent: DataFrame, columns: dict[str, str], name: str) -> DataFrame:
    """(rule, violations): distinct child keys without a parent; `columns` maps child to parent, null keys are none."""
    keys = child.select(*columns).dropna().distinct()
    there = parent.select(*[F.col(p).alias(c) for c, p in columns.items()])
    missing = keys.join(there, list(columns), "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")


def duplicate_keys(df: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """(rule, violations): keys that more than one different row has (repeated equal rows are one row)."""
    twice = df.distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return twice.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations")


def all_checks(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def underconstrained(observations: DataFrame, component: str, camera: str, landmark: str) -> DataFrame:
    """(component, cameras, landmarks, observations, mask): bit 0 too few equations (2 obs < 6 cam + 3 lmk - 7), bit 1 a
    landmark seen once, bit 2 a camera with fewer than three observations."""
    rows = observations.select(component, camera, landmark).dropna()
    per = [rows.groupBy(component, c).agg(F.count(F.lit(1)).alias("n")) for c in (camera, landmark)]
    cameras = per[0].groupBy(component).agg(F.count(F.lit(1)).alias("cameras"), F.sum("n").alias("observations"), F.min("n").alias("weakest_camera"))
    landmarks = per[1].groupBy(component).agg(F.count(F.lit(1)).alias("landmarks"), F.min("n").alias("weakest_landmark"))
    dof = 2 * F.col("observations") < 6 * F.col("cameras") + 3 * F.col("landmarks") - 7
    mask = dof.cast("int") + 2 * (F.col("weakest_landmark") < 2).cast("int") + 4 * (F.col("weakest_camera") < 3).cast("int")
    return cameras.join(landmarks, component).select(component, "cameras", "landmarks", "observations", mask.alias("mask"))


def structural_mask(observations: DataFrame, component: str, camera: str, landmark: str) -> DataFrame:
    """(component, cameras, landmarks, observations, mask): bit 0 too few equations (2 obs < 6 cam + 3 lmk - 7), bit 1 a
    landmark seen by fewer than two cameras, bit 2 a camera that sees fewer than three landmarks, the anchor (the
    smallest camera) excepted, bit 3 parts that nothing connects. Repeated observations count for bit 0 only."""
    o = observations.select(F.col(component).alias("g"), F.col(camera).alias("c"), F.col(landmark).alias("l")).dropna()
    edges = o.groupBy("g", "c", "l").agg(F.count(F.lit(1)).alias("n"))
    cameras = edges.groupBy("g", "c").agg(F.count(F.lit(1)).alias("seen"), F.sum("n").alias("n"))
    landmarks = edges.groupBy("g", "l").agg(F.count(F.lit(1)).alias("seen"))
    # an edge joins the number of its camera with that of its landmark; numbers are given once and written
    sides = cameras.select("g", F.lit(0).alias("side"), F.col("c").alias("x"), "seen", "n").unionByName(
        landmarks.select("g", F.lit(1).alias("side"), F.col("l").alias("x"), "seen", F.lit(0).cast("bigint").alias("n"))
    )
    vertices = cut(sides.withColumn("v", F.monotonically_increasing_id()), "vertices").df
    of_c = vertices.where("side = 0").select("g", F.col("x").alias("c"), F.col("v").alias("u"))
    of_l = vertices.where("side = 1").select("g", F.col("x").alias("l"), "v")
    parts = components(edges.join(of_c, ["g", "c"]).join(of_l, ["g", "l"]).select("u", "v"))
    anchors = cameras.groupBy("g").agg(F.min("c").alias("anchor"))
    is_camera = F.col("side") == 0
    found = (
        vertices.join(parts, "v")
        .join(anchors, "g")
        .groupBy("g")
        .agg(
            F.count_if(is_camera).alias("cameras"),
            F.count_if(~is_camera).alias("landmarks"),
            F.sum("n").alias("observations"),
            F.min(F.when(~is_camera, F.col("seen"))).alias("weakest_landmark"),
            F.min(F.when(is_camera & (F.col("x") != F.col("anchor")), F.col("seen"))).alias("weakest_camera"),
            (F.min("low") != F.max("low")).alias("apart"),
        )
    )
    weak = F.coalesce(F.col("weakest_camera") < 3, F.lit(False))
    dof = 2 * F.col("observations") < 6 * F.col("cameras") + 3 * F.col("landmarks") - 7
    bits = [dof, F.col("weakest_landmark") < 2, weak, F.col("apart")]
    mask = reduce(Column.__add__, [b.cast("int") * (1 << i) for i, b in enumerate(bits)])
    return found.select(F.col("g").alias(component), "cameras", "landmarks", "observations", mask.alias("mask"))
