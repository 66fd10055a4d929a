"""Bucket index over binary descriptors: postings, bucket sizes, evidence and the best candidates of every set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallaxa.functions.bits import KEY_BITS, TABLES, bucket_key
from parallaxa.plans.lineage import Cut, cut


def postings(descriptors: DataFrame, keep: Sequence[str], word_column: str, tables: int = TABLES, key_bits: int = KEY_BITS) -> DataFrame:
    """(keep..., table_no, bucket_key): one posting for each descriptor and table."""
    entries = F.array(
        *[F.struct(F.lit(t).alias("table_no"), bucket_key(F.col(word_column), t, key_bits).alias("bucket_key")) for t in range(tables)]
    )
    return descriptors.select(*keep, F.explode(entries).alias("p")).select(*keep, "p.table_no", "p.bucket_key")


def evidence(index: DataFrame, space: Sequence[str], set_id: str, feature: str, limits: DataFrame) -> DataFrame:
    """(space..., query, candidate, evidence): distinct query features that share a usable bucket with the candidate.

    `limits` (space..., most) bounds the postings of a bucket, the asker's own included; buckets above it, and those of
    spaces without a limit, are dropped before the self-join, which bounds the pairs of a bucket.
    """
    bucket = [*space, "table_no", "bucket_key"]
    sizes = index.groupBy(*bucket).agg(F.count(F.lit(1)).alias("size"), F.min(set_id).alias("first"), F.max(set_id).alias("last"))
    # a bucket of one set pairs nobody
    usable = sizes.join(limits, list(space)).where("size <= most and first <> last").select(*bucket)
    kept = index.join(usable, bucket, "left_semi")
    asks = kept.select(*bucket, F.col(set_id).alias("query"), F.col(feature).alias("query_feature"))
    has = kept.select(*bucket, F.col(set_id).alias("candidate")).distinct()
    met = asks.join(has, bucket).where("query <> candidate").select(*space, "query", "candidate", "query_feature").distinct()
    return met.groupBy(*space, "query", "candidate").agg(F.count(F.lit(1)).alias("evidence"))


def best_candidates(found: DataFrame, space: Sequence[str], k: Column | int) -> DataFrame:
    """The first k of each query by score, evidence, image and set id; `found` has score and image_id."""
    order = [F.desc("score"), F.desc("evidence"), F.asc("image_id"), F.asc("candidate")]
    w = Window.partitionBy(*space, "query").orderBy(*order)
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def pending_members(due: DataFrame, held: DataFrame, key: Sequence[str]) -> DataFrame:
    """Members that an index should hold and doesn't yet."""
    return due.join(held, list(key), "left_anti")


def published_generation(new: DataFrame, generation: int) -> Cut:
    """A new, immutable generation (visual_index_id, generation, table_no, bucket_key, feature_set_id, feature_index): files
    that each hold a stretch of the total order of postings, sorted by it, so that a bucket is one range of one file."""
    order = ["visual_index_id", "table_no", "bucket_key", "feature_set_id", "feature_index"]
    rows = new.select("visual_index_id", F.lit(generation).alias("generation"), *order[1:])
    return cut(rows.repartitionByRange(*order).sortWithinPartitions(*order), f"generation-{generation}")
