"""Running sums, running maxima and previous rows over groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallaxa.plans.lineage import Cut, cut


def prefix_scan(
    df: DataFrame, group: Sequence[str], order: Sequence[str], outs: dict[str, tuple[str, str]], partitions: int | None = None
) -> tuple[DataFrame, Cut]:
    """Adds a column for each of `outs` (name -> (kind, column)) over the earlier rows of the same group.

    Kinds: `sum` (0 for the first row, null values count as 0), `max` (null for the first), `previous` (the value of
    the row before, null for the first). A window over a group that holds a third of all rows would be one task. Here
    the rows are range-partitioned by (group, order), so that a large group spreads over several blocks; the windows
    run within (group, block), and only what groups that cross a block boundary carry is passed on. The broadcast
    tables have at most two rows for each block, whatever the data. `order` must be unique within a group. Null group
    values form a group of their own. An empty input gives an empty result. Returns the table and the written cut it
    reads.
    """
    group, order = list(group), list(order)
    ranged = df.repartitionByRange(partitions, *group, *order) if partitions else df.repartitionByRange(*group, *order)
    blocks = cut(ranged.withColumn("__block", F.spark_partition_id()), "prefix")
    rows = blocks.df
    key = F.struct(*group)
    edges = rows.groupBy("__block").agg(F.min(key).alias("__low"), F.max(key).alias("__high"))
    crossing = (
        edges.select(F.col("__low").alias("__g"))
        .unionByName(edges.select(F.col("__high").alias("__g")))
        .groupBy("__g")
        .count()
        .where("count > 1")
    )
    whole = {
        "sum": lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))),
        "max": lambda c: F.max(c),
        "previous": lambda c: F.max_by(F.struct(F.col(c).alias("v")), F.struct(*order)),
    }
    totals = (
        rows.join(F.broadcast(crossing), key.eqNullSafe(F.col("__g")), "left_semi")
        .groupBy("__block", *group)
        .agg(*[whole[kind](c).alias(f"__t_{out}") for out, (kind, c) in outs.items()])
    )
    blocks_before = Window.partitionBy(*group).orderBy("__block")
    earlier_blocks = blocks_before.rowsBetween(Window.unboundedPreceding, -1)
    over_blocks = {
        "sum": lambda t: F.sum(t).over(earlier_blocks),
        "max": lambda t: F.max(t).over(earlier_blocks),
        "previous": lambda t: F.lag(t).over(blocks_before),
    }
    carry = totals.select(
        F.col("__block").alias("__b"),
        F.struct(*group).alias("__g"),
        F.lag(F.lit(True)).over(blocks_before).alias("__goes_on"),
        *[over_blocks[kind](f"__t_{out}").alias(f"__c_{out}") for out, (kind, _) in outs.items()],
    ).where("__goes_on")
    within = Window.partitionBy("__block", *group).orderBy(*order)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    here = {
        "sum": lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).over(earlier),
        "max": lambda c: F.max(c).over(earlier),
        "previous": lambda c: F.lag(F.struct(F.col(c).alias("v"))).over(within),
    }
    both = {
        "sum": lambda h, c: F.coalesce(h, F.lit(0)) + F.coalesce(c, F.lit(0)),
        "max": lambda h, c: F.greatest(h, c),
        "previous": lambda h, c: F.coalesce(h, c)["v"],
    }
    scanned = rows.select("*", *[here[kind](c).alias(f"__h_{out}") for out, (kind, c) in outs.items()])
    joined = scanned.join(F.broadcast(carry), (F.col("__block") == F.col("__b")) & key.eqNullSafe(F.col("__g")), "left")
    found: list[Column] = [both[kind](F.col(f"__h_{out}"), F.col(f"__c_{out}")).alias(out) for out, (kind, _) in outs.items()]
    return joined.select(*df.columns, *found), blocks


def prefix_sum(
    df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, out: str, partitions: int | None = None
) -> tuple[DataFrame, Cut]:
    """Adds `out`: the sum of `value` over the earlier rows of the same group (0 for the first); see `prefix_scan`."""
    return prefix_scan(df, group, order, {out: ("sum", value)}, partitions)


def positions(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Adds `out`: the BIGINT position, from 0, of each row in its group; no group means one order over all rows."""
    group = list(group) or ["__all"]
    placed, _ = prefix_sum(df.withColumn("__all", F.lit(0)).withColumn("__one", F.lit(1)), group, order, "__one", out)
    return placed.withColumn(out, F.col(out).cast("bigint")).drop("__all", "__one")
