"""Aggregates, ranks, splits, residual metrics and ordered folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parallaxa.catalog.relational import feature_sets, match_results
from parallaxa.functions.geometry import angle_class, grid_cell, image_region
from parallaxa.functions.vectors import finite
from parallaxa.operators.grid import coverage, quota_selection
from parallaxa.operators.metrics import exact_median, gates, holdout, huber_cost, rmse, upper_median
from parallaxa.operators.pairs import shared_count
from parallaxa.operators.progress import last_samples, monotone_delta, percent_done, smoothed_rate, streaks
from parallaxa.operators.prefix import positions
from parallaxa.operators.scans import scope_hash
from parallaxa.plans.registry import Registry
from parallaxa.plans.tables import table

REGISTRY = Registry()
_VALID = """(SELECT DISTINCT match_result_id, entry_index, feature_index_a, feature_index_b, distance FROM matches
  WHERE distance IS NOT NULL AND isfinite(distance) AND feature_index_a IS NOT NULL AND feature_index_b IS NOT NULL)"""


def valid_matches(spark, sf_dir):
    """Entries with both indexes and a finite distance, each once."""
    rows = table(spark, sf_dir, "matches").select("match_result_id", "entry_index", "feature_index_a", "feature_index_b", "distance")
    ok = finite(F.col("distance")) & F.col("feature_index_a").isNotNull() & F.col("feature_index_b").isNotNull()
    return rows.where(ok).distinct()


@REGISTRY.query(
    "a01_group_count",
    """SELECT t.task_id, count(c.query_feature_set_id) AS candidates FROM visual_index_tasks t
LEFT JOIN visual_index_candidates c ON c.task_id = t.task_id GROUP BY 1""",
)
def a01(spark, sf_dir):
    tasks = table(spark, sf_dir, "visual_index_tasks").select("task_id")
    found = table(spark, sf_dir, "visual_index_candidates").groupBy("task_id").agg(F.count("query_feature_set_id").alias("n"))
    return tasks.join(found, "task_id", "left").select("task_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("candidates"))


@REGISTRY.query(
    "a03_contiguous_prefix",
    """SELECT match_result_id, count(DISTINCT entry_index) AS entries, min(entry_index) AS first_entry, max(entry_index) AS last_entry,
  min(entry_index) = 0 AND max(entry_index) + 1 = count(DISTINCT entry_index) AS contiguous,
  count(CASE WHEN feature_index_a IS NULL OR feature_index_b IS NULL THEN 1 END) AS bad
FROM (SELECT DISTINCT match_result_id, entry_index, feature_index_a, feature_index_b FROM matches) GROUP BY 1""",
)
def a03(spark, sf_dir):
    """Proof that the entries of a result are exactly 0 to n - 1, from one pass of conditional counts."""
    rows = table(spark, sf_dir, "matches").select("match_result_id", "entry_index", "feature_index_a", "feature_index_b").distinct()
    return rows.groupBy("match_result_id").agg(
        F.count_distinct("entry_index").alias("entries"),
        F.min("entry_index").alias("first_entry"),
        F.max("entry_index").alias("last_entry"),
        ((F.min("entry_index") == 0) & (F.max("entry_index") + 1 == F.count_distinct("entry_index"))).alias("contiguous"),
        F.count_if(F.expr("feature_index_a is null or feature_index_b is null")).alias("bad"),
    )


@REGISTRY.query(
    "a04_membership_progress",
    """SELECT visual_index_id, count(DISTINCT feature_set_id) AS total, count(DISTINCT CASE WHEN generation <= 1 THEN feature_set_id END) AS completed
FROM visual_index_postings WHERE feature_set_id IS NOT NULL GROUP BY 1""",
)
def a04(spark, sf_dir):
    rows = table(spark, sf_dir, "visual_index_postings").where("feature_set_id is not null").select("visual_index_id", "generation", "feature_set_id")
    per_set = rows.groupBy("visual_index_id", "feature_set_id").agg(F.min("generation").alias("g"))
    return per_set.groupBy("visual_index_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.expr("g <= 1")).alias("completed"))


@REGISTRY.query(
    "a06_next_id",
    """SELECT scanset_id, max(feature_set_id) + 1 AS next_id FROM feature_sets GROUP BY 1""",
)
def a06(spark, sf_dir):
    return table(spark, sf_dir, "feature_sets").groupBy("scanset_id").agg((F.coalesce(F.max("feature_set_id"), F.lit(0)) + 1).alias("next_id"))


@REGISTRY.query(
    "a09_shared_tracks",
    """WITH o AS (SELECT DISTINCT l_orderkey AS track, l_suppkey AS image FROM lineitem)
SELECT x.image AS a, y.image AS b, count(*) AS shared FROM o x JOIN o y ON x.track = y.track AND x.image < y.image
GROUP BY 1, 2 HAVING count(*) >= 2""",
)
def a09(spark, sf_dir):
    """Tracks that two images share; a track (here: an order) has few images, so its pairs stay few."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("track"), F.col("l_suppkey").alias("image"))
    return shared_count(rows, "track", "image", 2)


@REGISTRY.query(
    "a11_medians",
    f"""WITH r AS (SELECT match_result_id, distance::DOUBLE AS d, row_number() OVER (PARTITION BY match_result_id ORDER BY distance) AS p,
  count(*) OVER (PARTITION BY match_result_id) AS n FROM {_VALID})
SELECT match_result_id, round(sqrt(avg(d * d)), 5) AS rmse, round(quantile_cont(d, 0.5), 5) AS median, round(max(CASE WHEN p = n // 2 + 1 THEN d END), 5) AS upper_median,
  round(max(d), 5) AS largest FROM r GROUP BY 1""",
)
def a11(spark, sf_dir):
    """Interpolated median, upper median (element n div 2) and maximum of the distances of each result."""
    rows = valid_matches(spark, sf_dir).select("match_result_id", F.col("distance").cast("double").alias("d"))
    stats = rows.groupBy("match_result_id").agg(
        F.round(rmse(F.col("d")), 5).alias("rmse"), F.round(exact_median(F.col("d")), 5).alias("median"), F.round(F.max("d"), 5).alias("largest")
    )
    upper = upper_median(rows, ["match_result_id"], "d", "u").select("match_result_id", F.round("u", 5).alias("upper_median"))
    return stats.join(upper, "match_result_id")


@REGISTRY.query(
    "a14_robust_cost",
    f"""SELECT match_result_id, count(*) AS residuals,
  round(sum(CASE WHEN d * d / 1000 <= 4 THEN d * d / 1000 ELSE 4 * sqrt(d * d / 1000) - 4 END) / 2, 4) AS cost
FROM (SELECT match_result_id, distance::DOUBLE AS d FROM {_VALID}) GROUP BY 1""",
)
def a14(spark, sf_dir):
    s = F.col("distance").cast("double") * F.col("distance").cast("double") / 1000
    return valid_matches(spark, sf_dir).groupBy("match_result_id").agg(F.count(F.lit(1)).alias("residuals"), F.round(huber_cost(s), 4).alias("cost"))


@REGISTRY.query(
    "a16_support_gates",
    """WITH s AS (SELECT DISTINCT feature_set_id, scanset_id, feature_count, coverage_ratio, feature_density_per_megapixel AS density FROM feature_sets),
g AS (SELECT scanset_id, count(*) AS sets, count(CASE WHEN coverage_ratio >= 0.5 THEN 1 END) AS covered,
  max(feature_count) / greatest(1, min(feature_count)) AS ratio, count(CASE WHEN density IS NULL THEN 1 END) AS unknown FROM s GROUP BY 1)
SELECT scanset_id, sets, covered, unknown, CASE WHEN concat_ws(';', CASE WHEN NOT sets >= 6 THEN 'SETS' END, CASE WHEN NOT covered >= 3 THEN 'COVERAGE' END,
  CASE WHEN NOT ratio >= 1.5 THEN 'RATIO' END, CASE WHEN NOT unknown = 0 THEN 'UNKNOWN' END) = '' THEN 'OK' ELSE
  concat_ws(';', CASE WHEN NOT sets >= 6 THEN 'SETS' END, CASE WHEN NOT covered >= 3 THEN 'COVERAGE' END,
  CASE WHEN NOT ratio >= 1.5 THEN 'RATIO' END, CASE WHEN NOT unknown = 0 THEN 'UNKNOWN' END) END AS failed FROM g""",
)
def a16(spark, sf_dir):
    sets = feature_sets(spark, sf_dir, "feature_set_id", "scanset_id", "feature_count", "coverage_ratio", "feature_density_per_megapixel")
    g = sets.groupBy("scanset_id").agg(
        F.count(F.lit(1)).alias("sets"),
        F.count_if(F.expr("coverage_ratio >= 0.5")).alias("covered"),
        (F.max("feature_count") / F.greatest(F.lit(1), F.min("feature_count"))).alias("ratio"),
        F.count_if(F.expr("feature_density_per_megapixel is null")).alias("unknown"),
    )
    checks = {"SETS": F.col("sets") >= 6, "COVERAGE": F.col("covered") >= 3, "RATIO": F.col("ratio") >= 1.5, "UNKNOWN": F.col("unknown") == 0}
    return g.select("scanset_id", "sets", "covered", "unknown", gates(checks).alias("failed"))


_POINTS = f"""(SELECT match_result_id, entry_index, distance::DOUBLE AS response, (feature_index_a % 64)::INT AS x, (feature_index_b % 64)::INT AS y FROM {_VALID})"""


def points(spark, sf_dir):
    """Matched features as points of a 64 x 64 plane: the low bits of the two indexes."""
    return valid_matches(spark, sf_dir).select(
        "match_result_id", "entry_index", F.col("distance").cast("double").alias("response"),
        (F.col("feature_index_a") % 64).cast("int").alias("x"), (F.col("feature_index_b") % 64).cast("int").alias("y"),
    )


@REGISTRY.query(
    "a17_grid_coverage",
    f"""SELECT match_result_id, count(*) AS points, count(DISTINCT (x // 8) * 8 + y // 8) AS occupied,
  round(count(DISTINCT (x // 8) * 8 + y // 8) / 64.0, 6)::DOUBLE AS ratio, round(count(*) / 0.25, 6)::DOUBLE AS density FROM {_POINTS} GROUP BY 1""",
)
def a17(spark, sf_dir):
    rows = points(spark, sf_dir)
    cells = [grid_cell(F.col(c), F.lit(64.0), 8) for c in ("x", "y")]
    rows = rows.withColumn("cx", cells[0]).withColumn("cy", cells[1])
    found = coverage(rows, ["match_result_id"], ["cx", "cy"], 64, F.lit(0.25))
    return found.withColumn("ratio", F.round("ratio", 6)).withColumn("density", F.round("density", 6))


@REGISTRY.query(
    "w03_grid_quota",
    f"""WITH c AS (SELECT *, row_number() OVER (PARTITION BY match_result_id, x // 8, y // 8 ORDER BY response DESC, y, x, entry_index) AS in_cell FROM {_POINTS}),
p AS (SELECT *, row_number() OVER (PARTITION BY match_result_id ORDER BY response DESC, y, x, entry_index) AS place FROM c WHERE in_cell <= 2)
SELECT match_result_id, entry_index, place FROM p WHERE place <= 16""",
)
def w03(spark, sf_dir):
    rows = points(spark, sf_dir)
    rows = rows.withColumn("cx", grid_cell(F.col("x"), F.lit(64.0), 8)).withColumn("cy", grid_cell(F.col("y"), F.lit(64.0), 8))
    order = [F.desc("response"), F.asc("y"), F.asc("x"), F.asc("entry_index")]
    kept = quota_selection(rows, ["match_result_id"], ["cx", "cy"], order, 2, 16)
    return kept.select("match_result_id", "entry_index", F.col("place").cast("bigint").alias("place"))


@REGISTRY.query(
    "f21_regions_and_angles",
    f"""SELECT match_result_id, CASE WHEN x / 64.0 BETWEEN 1.0/3 AND 2.0/3 AND y / 64.0 BETWEEN 1.0/3 AND 2.0/3 THEN 4
  ELSE (x / 64.0 >= 0.5)::INT + 2 * (y / 64.0 >= 0.5)::INT END AS region,
  CASE WHEN x < 20 OR x > 60 THEN -1 WHEN x <= 35 THEN 0 WHEN x <= 50 THEN 1 ELSE 2 END AS angle, count(*) AS points FROM {_POINTS} GROUP BY ALL""",
)
def f21(spark, sf_dir):
    rows = points(spark, sf_dir)
    region = image_region(F.col("x") / 64, F.col("y") / 64).cast("int")
    return rows.groupBy("match_result_id", region.alias("region"), angle_class(F.col("x")).alias("angle")).agg(F.count(F.lit(1)).alias("points"))


@REGISTRY.query(
    "a20_batch_ring",
    """SELECT event_id, max(ceil(value)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)::BIGINT AS peak,
  count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS samples FROM events""",
)
def a20(spark, sf_dir):
    """Worst case over a ring of the last eight samples of each key."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.ceil("value").alias("need"))
    ring = last_samples(rows, ["user_id"], ["ts", "event_id"], 8, {"peak": F.max("need"), "samples": F.count(F.lit(1))})
    return ring.select("event_id", F.col("peak").cast("bigint").alias("peak"), "samples")


@REGISTRY.query(
    "a22_view_totals",
    """SELECT descriptor_type, count(*) AS sets, sum(feature_count)::BIGINT AS features FROM (SELECT DISTINCT feature_set_id, feature_count, descriptor_type, extractor_kind FROM feature_sets)
WHERE contains(extractor_kind, 'sift') GROUP BY 1""",
)
def a22(spark, sf_dir):
    sets = feature_sets(spark, sf_dir, "feature_set_id", "feature_count", "descriptor_type", "extractor_kind").where(F.col("extractor_kind").contains("sift"))
    return sets.groupBy("descriptor_type").agg(F.count(F.lit(1)).alias("sets"), F.sum("feature_count").alias("features"))


@REGISTRY.query(
    "a23_summary_counters",
    """SELECT matcher_kind, count(*) AS deliveries, count(DISTINCT match_result_id) AS results, count(CASE WHEN result_status = 1 THEN 1 END) AS matched,
  count(CASE WHEN feature_set_id_a IS NULL OR feature_set_id_b IS NULL THEN 1 END) AS sideless, count(CASE WHEN feature_set_id_a = feature_set_id_b THEN 1 END) AS selfish,
  count(CASE WHEN feature_set_id_a > feature_set_id_b THEN 1 END) AS swapped FROM match_results GROUP BY 1""",
)
def a23(spark, sf_dir):
    return table(spark, sf_dir, "match_results").groupBy("matcher_kind").agg(
        F.count(F.lit(1)).alias("deliveries"),
        F.count_distinct("match_result_id").alias("results"),
        F.count_if(F.expr("result_status = 1")).alias("matched"),
        F.count_if(F.expr("feature_set_id_a is null or feature_set_id_b is null")).alias("sideless"),
        F.count_if(F.expr("feature_set_id_a = feature_set_id_b")).alias("selfish"),
        F.count_if(F.expr("feature_set_id_a > feature_set_id_b")).alias("swapped"),
    )


@REGISTRY.query(
    "a26_scope_hash",
    """WITH b AS (SELECT scanset_id, feature_set_id // 4096 AS block, sha256(string_agg(feature_set_id::VARCHAR, ',' ORDER BY feature_set_id)) AS h
  FROM (SELECT DISTINCT scanset_id, feature_set_id FROM feature_sets WHERE feature_set_id IS NOT NULL) GROUP BY 1, 2),
c AS (SELECT scanset_id, block // 4096 AS block, sha256(string_agg(block || ':' || h, ',' ORDER BY block)) AS h FROM b GROUP BY 1, 2)
SELECT scanset_id, sha256('SCOPE001' || string_agg(block || ':' || h, ',' ORDER BY block)) AS scope_hash FROM c GROUP BY 1""",
)
def a26(spark, sf_dir):
    """Identity of a frozen input: a hash over the ordered hashes of its blocks of ids."""
    return scope_hash(table(spark, sf_dir, "feature_sets"), "scanset_id", "feature_set_id", "SCOPE001")


@REGISTRY.query(
    "w01_holdout_split",
    """SELECT feature_set_id, (row_number() OVER (PARTITION BY scanset_id, extractor_kind ORDER BY sha, feature_set_id) - 1) % 5 = 4 AS holdout
FROM (SELECT DISTINCT feature_set_id, scanset_id, extractor_kind, lower(hex(source_image_sha256)) AS sha FROM feature_sets)""",
)
def w01(spark, sf_dir):
    sets = table(spark, sf_dir, "feature_sets").select("feature_set_id", "scanset_id", "extractor_kind", F.lower(F.hex("source_image_sha256")).alias("sha")).distinct()
    return holdout(sets, ["scanset_id", "extractor_kind"], ["sha", "feature_set_id"]).select("feature_set_id", "holdout")


@REGISTRY.query(
    "w04_canonical_positions",
    """SELECT scanset_id, feature_set_id, (row_number() OVER (PARTITION BY scanset_id ORDER BY feature_set_id) - 1)::BIGINT AS position
FROM (SELECT DISTINCT scanset_id, feature_set_id FROM feature_sets)""",
)
def w04(spark, sf_dir):
    """Positions 0 to n - 1 of a group; a scan set may be of any size, so they come from prefix sums over blocks."""
    return positions(feature_sets(spark, sf_dir, "scanset_id", "feature_set_id"), ["scanset_id"], ["feature_set_id"], "position")


@REGISTRY.query(
    "w05_counter_delta",
    """SELECT event_id, coalesce(CASE WHEN c >= p THEN c - p END, -1) AS delta FROM (SELECT event_id, c, lag(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p
FROM (SELECT event_id, user_id, ts, floor(value)::BIGINT AS c FROM events))""",
)
def w05(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.floor("value").alias("c"))
    return monotone_delta(rows, ["user_id"], ["ts", "event_id"], "c", "delta").select("event_id", F.coalesce("delta", F.lit(-1)).alias("delta"))


@REGISTRY.query(
    "w06_smoothed_rate",
    """WITH RECURSIVE s AS (SELECT user_id, epoch(ts)::DOUBLE AS t, floor(value * 100)::DOUBLE AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f AS (
  SELECT user_id, n, t, c, 0.0::DOUBLE AS rate, 0::BIGINT AS positive FROM s WHERE n = 1
  UNION ALL
  SELECT s.user_id, s.n, s.t, s.c,
    CASE WHEN s.c < f.c OR s.t < f.t THEN 0.0 WHEN s.c > f.c AND s.t > f.t THEN
      CASE WHEN f.positive = 0 THEN (s.c - f.c) / (s.t - f.t) ELSE f.rate * 0.65 + (s.c - f.c) / (s.t - f.t) * 0.35 END ELSE f.rate END,
    CASE WHEN s.c < f.c OR s.t < f.t THEN 0 WHEN s.c > f.c AND s.t > f.t THEN f.positive + 1 ELSE f.positive END
  FROM f JOIN s ON s.user_id = f.user_id AND s.n = f.n + 1
)
SELECT user_id, round(rate, 6) AS rate, positive FROM f WHERE (user_id, n) IN (SELECT user_id, max(n) FROM s GROUP BY 1)""",
)
def w06(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "user_id", "event_id", "ts", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.floor(F.col("value") * 100).alias("c")
    )
    return smoothed_rate(rows, "user_id", ["ts", "event_id"], "t", "c").select("user_id", F.round("rate", 6).alias("rate"), "positive")


@REGISTRY.query(
    "w12_streaks",
    """WITH f AS (SELECT event_id, user_id, ts, event_type = 'error' AS bad FROM events),
b AS (SELECT *, CASE WHEN bad IS DISTINCT FROM lag(bad) OVER w THEN 1 ELSE 0 END AS new FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM b)
SELECT event_id, bad, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS streak FROM r""",
)
def w12(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("event_type") == "error").alias("bad"))
    return streaks(rows, ["user_id"], ["ts", "event_id"], F.col("bad"), "streak").select("event_id", "bad", "streak")


@REGISTRY.query(
    "f16_percent_done",
    """WITH p AS (SELECT r.match_result_id, r.match_count AS total, count(m.entry_index) AS done FROM (SELECT DISTINCT match_result_id, match_count FROM match_results WHERE match_count > 0) r
LEFT JOIN (SELECT DISTINCT match_result_id, entry_index FROM matches) m ON m.match_result_id = r.match_result_id GROUP BY 1, 2)
SELECT match_result_id, CASE WHEN done >= total THEN 100 ELSE least(99, floor(done * 100 / total)::INT) END AS percent FROM p""",
)
def f16(spark, sf_dir):
    results = match_results(spark, sf_dir, "match_result_id", "match_count").where("match_count > 0")
    done = table(spark, sf_dir, "matches").select("match_result_id", "entry_index").distinct().groupBy("match_result_id").agg(F.count("entry_index").alias("done"))
    rows = results.join(done, "match_result_id", "left").withColumn("done", F.coalesce("done", F.lit(0)))
    return rows.select("match_result_id", percent_done(F.col("done"), F.col("match_count")).alias("percent"))


@REGISTRY.query(
    "t05_seed_pairs",
    f"""SELECT least(feature_set_id_a, feature_set_id_b) AS a, greatest(feature_set_id_a, feature_set_id_b) AS b, count(*) AS shared
FROM {_VALID} m JOIN (SELECT DISTINCT match_result_id, feature_set_id_a, feature_set_id_b FROM match_results WHERE result_status = 1 AND feature_set_id_a <> feature_set_id_b) r USING (match_result_id)
GROUP BY 1, 2 ORDER BY shared DESC, a, b LIMIT 32""",
)
def t05(spark, sf_dir):
    results = match_results(spark, sf_dir, "match_result_id", "feature_set_id_a", "feature_set_id_b", "result_status").where("result_status = 1 and feature_set_id_a <> feature_set_id_b")
    a, b = F.least("feature_set_id_a", "feature_set_id_b"), F.greatest("feature_set_id_a", "feature_set_id_b")
    return (
        valid_matches(spark, sf_dir).join(results, "match_result_id").groupBy(a.alias("a"), b.alias("b")).agg(F.count(F.lit(1)).alias("shared"))
        .orderBy(F.desc("shared"), "a", "b").limit(32)
    )


@REGISTRY.query(
    "t11_prefix_cap",
    """SELECT query_feature_set_id, feature_set_id, place FROM (SELECT query_feature_set_id, feature_set_id,
  row_number() OVER (PARTITION BY query_feature_set_id ORDER BY feature_set_id) AS place
FROM (SELECT DISTINCT query_feature_set_id, feature_set_id FROM visual_index_candidates WHERE feature_set_id IS NOT NULL)) WHERE place <= 64""",
)
def t11(spark, sf_dir):
    """The first 64 proposals of a group in pair order, where the cap is part of the result."""
    rows = table(spark, sf_dir, "visual_index_candidates").where("feature_set_id is not null").select("query_feature_set_id", "feature_set_id").distinct()
    w = Window.partitionBy("query_feature_set_id").orderBy("feature_set_id")
    return rows.withColumn("place", F.row_number().over(w).cast("bigint")).where("place <= 64")
