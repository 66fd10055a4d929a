"""Residual statistics, the three medians, robust cost, splits and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallaxa.operators.prefix import positions


def rmse(error: Column) -> Column:
    return F.sqrt(F.avg(error * error))


def exact_median(x: Column) -> Column:
    """Interpolates between the two middle values."""
    return F.percentile(x, 0.5)


def upper_median(df: DataFrame, group: Sequence[str], value: str, out: str) -> DataFrame:
    """Element n div 2 of the sorted values, by positions over range blocks, so that no group is one task's."""
    rows = df.where(F.col(value).isNotNull()).select(*group, value).withColumn("__copy", F.monotonically_increasing_id())
    placed = positions(rows, group, [value, "__copy"], "__place")
    sizes = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("__n"))
    return placed.join(sizes, list(group)).where(F.expr("__place = __n div 2")).select(*group, F.col(value).alias(out))


def huber_cost(squared: Column) -> Column:
    """Half the sum of the robust loss with threshold 2: s up to 4, then 4 sqrt(s) - 4."""
    return F.sum(F.when(squared <= 4, squared).otherwise(4 * F.sqrt(squared) - 4)) / 2


def holdout(df: DataFrame, strata: Sequence[str], order: Sequence[str], every: int = 5, out: str = "holdout") -> DataFrame:
    """Every fifth row of a stratum, by position in `order`, is held out; a stratum may be of any size."""
    return positions(df, strata, order, "__place").withColumn(out, F.col("__place") % every == every - 1).drop("__place")


def gates(checks: dict[str, Column]) -> Column:
    """Names of the failed checks joined by ';', OK if none failed; a null check fails."""
    failed = F.concat_ws(";", *[F.when(F.coalesce(~c, F.lit(True)), F.lit(name)) for name, c in checks.items()])
    return F.when(failed == "", "OK").otherwise(failed)
