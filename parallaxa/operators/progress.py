"""Folds over ordered samples: deltas, smoothed rates, streaks, remaining time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallaxa.operators.prefix import prefix_scan

#: Fixed values of the smoothed rate: weights of the past and of the new sample, seconds until a task counts as stalled.
KEEP, TAKE, STALL_SECONDS = 0.65, 0.35, 5


def monotone_delta(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Difference to the previous sample, null for the first and where the counter went back."""
    scanned, _ = prefix_scan(df, key, order, {"__before": ("previous", value)})
    return scanned.withColumn(out, F.when(F.col(value) >= F.col("__before"), F.col(value) - F.col("__before"))).drop("__before")


def last_samples(df: DataFrame, key: Sequence[str], order: Sequence[str], n: int, aggs: dict[str, Column]) -> DataFrame:
    """Aggregates over a ring of the last n samples of a key."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(-(n - 1), 0)
    for name, agg in aggs.items():
        df = df.withColumn(name, agg.over(w))
    return df


def smoothed_rate(df: DataFrame, key: str, order: Sequence[str], seconds: str, completed: str) -> DataFrame:
    """(key, rate, positive, last_completed): a smoothed rate over the samples of a key in order.

    Only positive work over positive time moves the rate; work or time that goes back starts afresh. The rate after n
    moves since the last fresh start is a weighted sum of them: the first counts whole, each later one with TAKE, and
    all fade by KEEP for every move after them. So the fold is two scans over range blocks and one sum, whatever the
    number of samples of a key.
    """
    rows = df.select(key, *[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.col(seconds).cast("double").alias("s"), F.col(completed).cast("double").alias("c"))
    place = [f"o{i}" for i in range(len(order))]
    seen, _ = prefix_scan(rows.withColumn("one", F.lit(1)), [key], place, {"s0": ("previous", "s"), "c0": ("previous", "c"), "n": ("sum", "one")})
    fresh = F.col("s0").isNull() | (F.col("c") < F.col("c0")) | (F.col("s") < F.col("s0"))
    moves = ~fresh & (F.col("c") > F.col("c0")) & (F.col("s") > F.col("s0"))
    steps = seen.select(
        key, *place, "c", "n", fresh.alias("fresh"), moves.cast("bigint").alias("move"), F.when(moves, (F.col("c") - F.col("c0")) / (F.col("s") - F.col("s0"))).alias("x")
    )
    counted, _ = prefix_scan(steps, [key], place, {"moves": ("sum", "move")})
    last = counted.groupBy(key).agg(
        F.max_by("c", "n").alias("last_completed"),
        F.max_by(F.struct("n", F.col("moves").alias("m")), F.when(F.col("fresh"), F.col("n"))).alias("start"),
        F.sum("move").alias("all"),
    )
    since = counted.where("move = 1").join(last.select(key, "start", "all"), key).where("n > start.n")
    nth = F.col("moves") - F.col("start.m")
    weight = F.pow(F.lit(KEEP), F.col("all") - F.col("moves") - 1) * F.when(nth == 0, 1.0).otherwise(TAKE)
    rates = since.groupBy(key).agg(F.sum(F.col("x") * weight).alias("rate"), F.count(F.lit(1)).alias("positive"))
    found = last.join(rates, key, "left")
    return found.select(key, F.coalesce("rate", F.lit(0.0)).alias("rate"), F.coalesce("positive", F.lit(0)).cast("bigint").alias("positive"), "last_completed")


def streaks(df: DataFrame, key: Sequence[str], order: Sequence[str], flag: Column, out: str) -> DataFrame:
    """Length of the run of equal flags that ends at each row (gaps and islands)."""
    marked = df.withColumn("__flag", F.coalesce(flag, F.lit(False))).withColumn("__one", F.lit(1))
    before, _ = prefix_scan(marked, key, order, {"__last": ("previous", "__flag"), "__n": ("sum", "__one")})
    begins = F.col("__last").isNull() | (F.col("__last") != F.col("__flag"))
    begun = before.withColumn("__at", F.when(begins, F.col("__n")))
    runs, _ = prefix_scan(begun, key, order, {"__start": ("max", "__at")})
    return runs.withColumn(out, (F.col("__n") - F.coalesce("__at", "__start") + 1).cast("bigint")).drop("__flag", "__one", "__last", "__n", "__at", "__start")


def percent_done(done: Column, total: Column) -> Column:
    """Whole percents; 100 only at the exact end, null for an empty total."""
    share = F.floor(done.cast("decimal(38,0)") * 100 / total).cast("int")
    return F.when(total > 0, F.when(done >= total, 100).otherwise(F.least(F.lit(99), share)))


def remaining_seconds(done: Column, total: Column, rate: Column, positive: Column) -> Column:
    """Seconds left, rounded up; null until two positive samples."""
    return F.when((positive >= 2) & (rate > 0), F.ceil((total - done) / rate)).cast("bigint")
