"""Ordered pages, lookups and content identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyset_page(df: DataFrame, key: Sequence[str], after: Sequence | None, size: int, scope: Column | None = None) -> DataFrame:
    """The next `size` rows in key order after the key `after` (all from the start if None).

    The predicate on the first key column reaches the files; the page is a distributed top-k, never a full sort.
    """
    key = list(key)
    if scope is not None:
        df = df.where(scope)
    if after is not None:
        beyond = F.lit(False)
        for c, a in reversed(list(zip(key, after, strict=True))):
            beyond = (F.col(c) > a) | ((F.col(c) == a) & beyond)
        df = df.where((F.col(key[0]) >= after[0]) & beyond)
    return df.orderBy(*key).limit(size)


def first_delivery(df: DataFrame, arrival: str = "ingested_at") -> DataFrame:
    """One row of those that agree in everything but `arrival`, with its earliest arrival."""
    rest = [c for c in df.columns if c != arrival]
    return df.groupBy(*rest).agg(F.min(arrival).alias(arrival)).select(*df.columns)


def latest_by(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of every key by `order`."""
    w = Window.partitionBy(*key).orderBy(*[c.desc_nulls_last() for c in order])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def identity(columns: Sequence[Column], magic: str) -> Column:
    """SHA-256 (hex) over a magic and the parts of a record, each with its length before it; nulls differ from empties."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(F.lit(magic), *parts), 256)


def content_assets(df: DataFrame, content: str, key: str) -> DataFrame:
    """Content-addressed publication: (sha256, first key, copies) of every distinct content; null contents are none."""
    rows = df.where(F.col(content).isNotNull()).withColumn("sha256", F.sha2(F.col(content), 256))
    return rows.groupBy("sha256").agg(F.min(key).alias("first_key"), F.count(F.lit(1)).alias("copies"))


def scope_hash(df: DataFrame, group: str, id_column: str, magic: str, fan: int = 4096) -> DataFrame:
    """(group, scope_hash): SHA-256 over a magic and the distinct ids of a group in order, by blocks of `fan` ids and
    blocks of `fan` blocks, so that no row ever holds a whole group. Null ids are left out."""
    level = df.where(F.col(id_column).isNotNull()).select(group, F.col(id_column).cast("bigint").alias("at")).distinct()
    level = level.withColumn("text", F.col("at").cast("string"))
    for _ in range(2):
        parts = F.array_sort(F.collect_list(F.struct("at", "text")))
        level = level.groupBy(group, F.floor(F.col("at") / fan).alias("block")).agg(F.sha2(F.array_join(F.transform(parts, lambda p: p["text"]), ","), 256).alias("h"))
        level = level.select(group, F.col("block").alias("at"), F.concat_ws(":", F.col("block").cast("string"), "h").alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("at", "text")))
    return level.groupBy(group).agg(F.sha2(F.concat(F.lit(magic), F.array_join(F.transform(parts, lambda p: p["text"]), ",")), 256).alias("scope_hash"))
