"""Micro-batches, index generations, frozen scopes and affected parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from parallaxa.catalog.relational import feature_sets, match_results
from parallaxa.operators.lineage import affected_groups, merged_keys
from parallaxa.plans.lineage import Folder
from parallaxa.plans.registry import Registry
from parallaxa.plans.tables import table
from parallaxa.streaming.cursor import Sink, micro_batches, windowed_counts

REGISTRY = Registry()


@REGISTRY.query(
    "st01_micro_batches",
    "SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users, max(event_id) AS cursor FROM events GROUP BY 1",
)
def st01(spark, sf_dir):
    """Events through durable batches: what was published, read back, is the whole input once."""
    schema = table(spark, sf_dir, "events").schema
    folder = Folder(spark, "events").path
    sink = Sink(f"{folder}/rows")
    micro_batches(
        spark, f"{sf_dir}/events.parquet*", schema, sink, f"{folder}/cursor", lambda rows: rows.select("event_id", "user_id", "event_type")
    )
    published = sink.read(spark, table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").schema)
    return published.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"), F.max("event_id").alias("cursor")
    )


@REGISTRY.query(
    "st02_windowed_counts",
    "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS events FROM events GROUP BY ALL",
)
def st02(spark, sf_dir):
    """Extension beyond the cursor model: event-time windows, the same plan for a batch and a stream."""
    rows = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    counts = windowed_counts(rows, "ts", "event_type", "1 day", "1 hour")
    return counts.withColumn("start", F.col("start").cast("timestamp_ntz"))


@REGISTRY.query(
    "st04_index_generations",
    """SELECT visual_index_id, generation, count(*) AS sets FROM (SELECT visual_index_id, feature_set_id, min(generation) AS generation
FROM visual_index_postings WHERE feature_set_id IS NOT NULL GROUP BY 1, 2) GROUP BY 1, 2""",
)
def st04(spark, sf_dir):
    """Sets that each immutable generation of an index brought in."""
    rows = table(spark, sf_dir, "visual_index_postings").where("feature_set_id is not null").select("visual_index_id", "generation", "feature_set_id")
    first = rows.groupBy("visual_index_id", "feature_set_id").agg(F.min("generation").alias("generation"))
    return first.groupBy("visual_index_id", "generation").agg(F.count(F.lit(1)).alias("sets"))


@REGISTRY.query(
    "st10_frozen_scope",
    """WITH cut AS (SELECT scanset_id, max(created_at) AS frozen_at FROM feature_sets GROUP BY 1)
SELECT f.scanset_id, count(DISTINCT CASE WHEN ingested_at <= frozen_at THEN feature_set_id END) AS inside,
  count(DISTINCT CASE WHEN ingested_at > frozen_at THEN feature_set_id END) AS late FROM feature_sets f JOIN cut c ON c.scanset_id = f.scanset_id GROUP BY 1""",
)
def st10(spark, sf_dir):
    """Rows that had arrived when the last set of the scan was made, and those a frozen scope leaves to the next run."""
    rows = table(spark, sf_dir, "feature_sets").select("scanset_id", "feature_set_id", "created_at", "ingested_at")
    frozen = rows.groupBy("scanset_id").agg(F.max("created_at").alias("frozen_at"))
    there = F.col("ingested_at") <= F.col("frozen_at")
    return rows.join(frozen, "scanset_id").groupBy("scanset_id").agg(
        F.count_distinct(F.when(there, F.col("feature_set_id"))).alias("inside"), F.count_distinct(F.when(~there, F.col("feature_set_id"))).alias("late")
    )


@REGISTRY.query(
    "st11_affected_scans",
    """SELECT DISTINCT f.scanset_id FROM feature_sets f WHERE f.feature_set_id IN (
  SELECT feature_set_id_a FROM match_results WHERE created_at >= TIMESTAMP '2023-06-01' UNION SELECT feature_set_id_b FROM match_results WHERE created_at >= TIMESTAMP '2023-06-01')""",
)
def st11(spark, sf_dir):
    """Scan sets with a set in a newer result: all that an extension has to compute again."""
    new = table(spark, sf_dir, "match_results").where("created_at >= timestamp_ntz '2023-06-01 00:00:00'")
    changed = new.select(F.explode(F.array("feature_set_id_a", "feature_set_id_b")).alias("feature_set_id")).where("feature_set_id is not null")
    return affected_groups(changed, feature_sets(spark, sf_dir, "feature_set_id", "scanset_id"), "scanset_id", "feature_set_id")


@REGISTRY.query(
    "j17_merged_lineage",
    """SELECT feature_set_id_b AS child, count(DISTINCT feature_set_id_a) AS keys FROM match_results
WHERE result_status = 1 AND feature_set_id_b IS NOT NULL GROUP BY 1 HAVING count(DISTINCT feature_set_id_a) > 1""",
)
def j17_merged(spark, sf_dir):
    """Sets that several others lead to."""
    rows = match_results(spark, sf_dir, "feature_set_id_a", "feature_set_id_b", "result_status").where("result_status = 1 and feature_set_id_b is not null")
    return merged_keys(rows, "feature_set_id_a", "feature_set_id_b").withColumnRenamed("feature_set_id_b", "child")
