"""Idempotent publication over plain tables: anti-joins, conflict checks, guards and cursors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    on = F.lit(True)
    for c in columns:
        on = on & left[c].eqNullSafe(right[c])
    return on


def insert_new(existing: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of `incoming` whose key is not there yet, one of each key (insert-or-ignore)."""
    fresh = incoming.dropDuplicates(list(key))
    return fresh.join(existing, _same(fresh, existing, key), "left_anti")


def upsert_state(existing: DataFrame, incoming: DataFrame, key: Sequence[str], content: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(key..., keep..., state) of every incoming row: new, same, or conflict if the stored content differs (nulls are equal)."""
    stored = existing.select(*[F.col(c).alias(f"__{c}") for c in (*key, *content)], F.lit(True).alias("__there"))
    on = F.lit(True)
    for c in key:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    equal = F.lit(True)
    for c in content:
        equal = equal & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return incoming.join(stored, on, "left").select(
        *key, *keep, F.when(F.col("__there").isNull(), "new").when(equal, "same").otherwise("conflict").alias("state")
    )


def guarded(rows: DataFrame, guard: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows that may be written because the guard table has their key (a semi-join)."""
    return rows.join(guard, list(key), "left_semi")


def divides(pairs: DataFrame, group: str, item: str, required: DataFrame) -> DataFrame:
    """Groups that have every item of `required` (relational division by counting matches, without a cross join)."""
    wanted = required.select(item).distinct()
    total = wanted.agg(F.count(F.lit(1)).alias("__total"))
    has = pairs.join(wanted, item, "left_semi").groupBy(group).agg(F.count_distinct(item).alias("__has"))
    return has.join(F.broadcast(total), F.col("__has") == F.col("__total"), "left_semi").select(group)


def advance(cursor: Column, candidate: Column, expected: Column) -> Column:
    """Compare-and-set of a monotone cursor: moves to the larger value only from the expected one, else stays."""
    return F.when(cursor.eqNullSafe(expected), F.greatest(cursor, candidate)).otherwise(cursor)
