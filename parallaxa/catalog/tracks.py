"""Tracks from matched features: masks, components, acceptance, structure; and integrity of what is stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from parallaxa.catalog.relational import feature_sets, match_results
from parallaxa.catalog.statistics import _VALID, valid_matches
from parallaxa.functions.bits import inlier_masks
from parallaxa.operators.components import accepted_tracks, components, pair_components
from parallaxa.operators.integrity import all_checks, duplicate_keys, orphans, rule_violations, structural_mask, underconstrained
from parallaxa.plans.registry import Registry
from parallaxa.plans.tables import table

REGISTRY = Registry()

_SET_EDGES = """SELECT DISTINCT feature_set_id_a AS u, feature_set_id_b AS v FROM match_results
  WHERE result_status = 1 AND feature_set_id_a IS NOT NULL AND feature_set_id_b IS NOT NULL"""


@REGISTRY.query(
    "g01_components",
    f"""WITH RECURSIVE e AS ({_SET_EDGES}), l AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach AS (SELECT u AS node, u AS low FROM l UNION SELECT l.v, r.low FROM reach r JOIN l ON l.u = r.node WHERE r.low < l.v)
SELECT node AS feature_set_id, min(low) AS component FROM reach GROUP BY 1""",
)
def g01(spark, sf_dir):
    edges = table(spark, sf_dir, "match_results").where("result_status = 1").select("feature_set_id_a", "feature_set_id_b")
    found = components(edges, "feature_set_id_a", "feature_set_id_b")
    return found.select(F.col("v").alias("feature_set_id"), F.col("low").alias("component"))


_NODE_EDGES = """SELECT DISTINCT {'s': r.feature_set_id_a, 'i': m.feature_index_a} AS u, {'s': r.feature_set_id_b, 'i': m.feature_index_b} AS v
  FROM matches m JOIN match_results r ON r.match_result_id = m.match_result_id
  WHERE r.result_status = 1 AND r.feature_set_id_a IS NOT NULL AND r.feature_set_id_b IS NOT NULL
  AND m.feature_index_a IS NOT NULL AND m.feature_index_b IS NOT NULL"""
_TRACKS = f"""e AS ({_NODE_EDGES}), l AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach AS (SELECT u AS node, u AS low FROM l UNION SELECT l.v, r.low FROM reach r JOIN l ON l.u = r.node WHERE r.low < l.v),
t AS (SELECT node, min(low) AS track FROM reach GROUP BY 1)"""


def track_members(spark, sf_dir):
    """(feature_set_id, feature_index, track_set_id, track_index): each matched feature, and the smallest of its component."""
    results = match_results(spark, sf_dir, "match_result_id", "feature_set_id_a", "feature_set_id_b", "result_status")
    entries = table(spark, sf_dir, "matches").select("match_result_id", "feature_index_a", "feature_index_b")
    rows = entries.join(results.where("result_status = 1").drop("result_status").dropna(), "match_result_id")
    found = pair_components(rows, ("feature_set_id_a", "feature_index_a"), ("feature_set_id_b", "feature_index_b"))
    return found.toDF("feature_set_id", "feature_index", "track_set_id", "track_index")


@REGISTRY.query(
    "g02_track_acceptance",
    f"""WITH RECURSIVE {_TRACKS}
SELECT t.track.s AS track_set_id, t.track.i AS track_index, count(*) AS size, count(DISTINCT f.image_id) AS images,
  count(*) >= 2 AND count(DISTINCT f.meta) = 1 AND count(DISTINCT f.image_id) = count(*) AS accepted
FROM t JOIN (SELECT DISTINCT feature_set_id, image_id, extractor_kind || '/' || extractor_version AS meta FROM feature_sets) f ON f.feature_set_id = t.node.s
GROUP BY 1, 2""",
)
def g02(spark, sf_dir):
    """A component is a track whole or not at all: one kind of extractor, no image twice, two members."""
    members = track_members(spark, sf_dir).select(F.struct("track_set_id", "track_index").alias("track"), "feature_set_id")
    sets = feature_sets(spark, sf_dir, "feature_set_id", "image_id", "extractor_kind", "extractor_version")
    sets = sets.select("feature_set_id", "image_id", F.concat_ws("/", "extractor_kind", F.col("extractor_version").cast("string")).alias("meta"))
    return accepted_tracks(members.join(sets, "feature_set_id"), "track", "image_id", "meta").select("track.*", "size", "images", "accepted")


@REGISTRY.query(
    "s07_observed_tracks",
    f"""WITH RECURSIVE {_TRACKS}
SELECT DISTINCT d.feature_set_id, d.feature_index, t.track.s AS track_set_id, t.track.i AS track_index
FROM descriptors d JOIN t ON t.node.s = d.feature_set_id AND t.node.i = d.feature_index""",
)
def s07_tracks(spark, sf_dir):
    """The track of every described feature that is on one: lookup by (set, index)."""
    asked = table(spark, sf_dir, "descriptors").select("feature_set_id", "feature_index").distinct()
    return asked.join(track_members(spark, sf_dir), ["feature_set_id", "feature_index"])


@REGISTRY.query(
    "g04_inlier_masks",
    f"""WITH i AS (SELECT DISTINCT match_result_id AS id, entry_index AS e FROM {_VALID} WHERE distance < 100 AND entry_index >= 0),
b AS (SELECT id, e // 32768 AS part, (e % 32768) // 8 AS byte, sum(1 << (e % 8)::INT)::INT AS v, count(*) AS n FROM i GROUP BY 1, 2, 3),
m AS (SELECT id, part, max(byte) AS last, sum(n)::BIGINT AS inliers FROM b GROUP BY 1, 2)
SELECT m.id AS match_result_id, m.part, m.inliers, string_agg(printf('%02X', coalesce(b.v, 0)), '' ORDER BY r.byte) AS mask
FROM m CROSS JOIN LATERAL (SELECT unnest(range(m.last + 1)) AS byte) r LEFT JOIN b ON b.id = m.id AND b.part = m.part AND b.byte = r.byte GROUP BY 1, 2, 3""",
)
def g04(spark, sf_dir):
    """Inliers packed into bit masks, lowest bit first, one for every 32,768 entries of a result."""
    inliers = valid_matches(spark, sf_dir).where("distance < 100 and entry_index >= 0").select("match_result_id", "entry_index").distinct()
    return inlier_masks(inliers, "match_result_id", "entry_index")


@REGISTRY.query(
    "g06_underconstrained",
    """WITH o AS (SELECT l_suppkey AS component, l_orderkey AS camera, l_partkey AS landmark FROM lineitem),
c AS (SELECT component, count(*) AS cameras, sum(n)::BIGINT AS observations, min(n) AS weakest FROM (SELECT component, camera, count(*) AS n FROM o GROUP BY 1, 2) GROUP BY 1),
l AS (SELECT component, count(*) AS landmarks, min(n) AS weakest FROM (SELECT component, landmark, count(*) AS n FROM o GROUP BY 1, 2) GROUP BY 1)
SELECT c.component, cameras, landmarks, observations, (2 * observations < 6 * cameras + 3 * landmarks - 7)::INT + 2 * (l.weakest < 2)::INT + 4 * (c.weakest < 3)::INT AS mask
FROM c JOIN l ON l.component = c.component""",
)
def g06(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("component"), F.col("l_orderkey").alias("camera"), F.col("l_partkey").alias("landmark"))
    return underconstrained(rows, "component", "camera", "landmark")


@REGISTRY.query(
    "g06_structural_mask",
    """WITH RECURSIVE o AS (SELECT l_suppkey AS g, l_orderkey AS c, l_partkey AS l FROM lineitem WHERE l_suppkey IS NOT NULL AND l_orderkey IS NOT NULL AND l_partkey IS NOT NULL),
e AS (SELECT DISTINCT g, c, l FROM o),
k AS (SELECT DISTINCT a.g, a.c AS u, b.c AS v FROM e a JOIN e b ON a.g = b.g AND a.l = b.l),
reach AS (SELECT g, min(c) AS v FROM e GROUP BY 1 UNION SELECT k.g, k.v FROM reach r JOIN k ON k.g = r.g AND k.u = r.v),
cams AS (SELECT g, c, count(*) AS seen, c = min(c) OVER (PARTITION BY g) AS anchor FROM e GROUP BY g, c),
lmks AS (SELECT g, l, count(*) AS seen FROM e GROUP BY g, l),
n AS (SELECT g, count(*) AS observations FROM o GROUP BY 1),
a AS (SELECT g, count(*) AS cameras, count(*) FILTER (seen < 3 AND NOT anchor) AS weak FROM cams GROUP BY 1),
b AS (SELECT g, count(*) AS landmarks, count(*) FILTER (seen < 2) AS weak FROM lmks GROUP BY 1),
r AS (SELECT g, count(*) AS reached FROM reach GROUP BY 1)
SELECT g AS component, cameras, landmarks, observations,
  (2 * observations < 6 * cameras + 3 * landmarks - 7)::INT + 2 * (b.weak > 0)::INT + 4 * (a.weak > 0)::INT + 8 * (reached < cameras)::INT AS mask
FROM a JOIN b USING (g) JOIN n USING (g) JOIN r USING (g)""",
)
def g06_structural(spark, sf_dir):
    """The mask of g06_underconstrained by distinct edges, with the anchor left out and parts that nothing connects."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("component"), F.col("l_orderkey").alias("camera"), F.col("l_partkey").alias("landmark"))
    return structural_mask(rows, "component", "camera", "landmark")


@REGISTRY.query(
    "q04_references",
    """SELECT 'entry_without_result' AS rule, count(DISTINCT match_result_id) AS violations FROM matches m
  WHERE match_result_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM match_results r WHERE r.match_result_id = m.match_result_id)
UNION ALL SELECT 'entry_of_unmatched', count(DISTINCT match_result_id) FROM matches m
  WHERE match_result_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM match_results r WHERE r.match_result_id = m.match_result_id AND r.result_status = 1)
UNION ALL SELECT 'side_a_without_set', count(DISTINCT feature_set_id_a) FROM match_results r
  WHERE feature_set_id_a IS NOT NULL AND NOT EXISTS (SELECT 1 FROM feature_sets f WHERE f.feature_set_id = r.feature_set_id_a)
UNION ALL SELECT 'posting_without_set', count(DISTINCT feature_set_id) FROM visual_index_postings p
  WHERE feature_set_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM feature_sets f WHERE f.feature_set_id = p.feature_set_id)
UNION ALL SELECT 'candidate_without_task', count(DISTINCT task_id) FROM visual_index_candidates c
  WHERE task_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM visual_index_tasks t WHERE t.task_id = c.task_id)
UNION ALL SELECT 'base_without_row', count(DISTINCT base_reconstruction_id) FROM incremental_reconstructions c
  WHERE base_reconstruction_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM incremental_reconstructions t WHERE t.reconstruction_id = c.base_reconstruction_id)""",
)
def q04(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    one = {"match_result_id": "match_result_id"}
    return all_checks(
        [
            orphans(t("matches"), t("match_results"), one, "entry_without_result"),
            orphans(t("matches"), t("match_results").where("result_status = 1"), one, "entry_of_unmatched"),
            orphans(t("match_results"), t("feature_sets"), {"feature_set_id_a": "feature_set_id"}, "side_a_without_set"),
            orphans(t("visual_index_postings"), t("feature_sets"), {"feature_set_id": "feature_set_id"}, "posting_without_set"),
            orphans(t("visual_index_candidates"), t("visual_index_tasks"), {"task_id": "task_id"}, "candidate_without_task"),
            orphans(t("incremental_reconstructions"), t("incremental_reconstructions"), {"base_reconstruction_id": "reconstruction_id"}, "base_without_row"),
        ]
    )


@REGISTRY.query(
    "q05_keys",
    """SELECT 'entry' AS rule, count(*) AS violations FROM (SELECT match_result_id, entry_index FROM (SELECT DISTINCT match_result_id, entry_index, feature_index_a, feature_index_b FROM matches) GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'query_once', count(*) FROM (SELECT match_result_id, feature_index_a FROM (SELECT DISTINCT match_result_id, entry_index, feature_index_a FROM matches) GROUP BY ALL HAVING count(*) > 1)
UNION ALL SELECT 'set_identity', count(*) FROM (SELECT image_id, extractor_kind, extractor_version FROM (SELECT DISTINCT feature_set_id, image_id, extractor_kind, extractor_version FROM feature_sets) GROUP BY ALL HAVING count(*) > 1)""",
)
def q05(spark, sf_dir):
    entries, sets = table(spark, sf_dir, "matches"), table(spark, sf_dir, "feature_sets")
    return all_checks(
        [
            duplicate_keys(entries.select("match_result_id", "entry_index", "feature_index_a", "feature_index_b"), ["match_result_id", "entry_index"], "entry"),
            duplicate_keys(entries.select("match_result_id", "entry_index", "feature_index_a"), ["match_result_id", "feature_index_a"], "query_once"),
            duplicate_keys(sets.select("feature_set_id", "image_id", "extractor_kind", "extractor_version"), ["image_id", "extractor_kind", "extractor_version"], "set_identity"),
        ]
    )


@REGISTRY.query(
    "q09_constraints",
    """SELECT 'asset_columns_null_together' AS rule, count(*) FILTER (NOT ((match_asset_sha256 IS NULL) = (match_asset_path IS NULL) AND (match_asset_path IS NULL) = (match_asset_size_bytes IS NULL))) AS violations FROM match_results
UNION ALL SELECT 'unmatched_has_no_asset', count(*) FILTER (NOT ((result_status = 0) = (match_asset_path IS NULL))) FROM match_results
UNION ALL SELECT 'asset_size', count(*) FILTER (NOT match_asset_size_bytes = 32 + 12 * match_count) FROM match_results
UNION ALL SELECT 'sides_in_order', count(*) FILTER (NOT feature_set_id_a < feature_set_id_b) FROM match_results
UNION ALL SELECT 'status_code', count(*) FILTER (NOT result_status IN (0, 1)) FROM match_results""",
)
def q09(spark, sf_dir):
    null = lambda c: F.col(c).isNull()
    together = (null("match_asset_sha256") == null("match_asset_path")) & (null("match_asset_path") == null("match_asset_size_bytes"))
    rules = {
        "asset_columns_null_together": together,
        "unmatched_has_no_asset": (F.col("result_status") == 0) == null("match_asset_path"),
        "asset_size": F.col("match_asset_size_bytes") == 32 + 12 * F.col("match_count"),
        "sides_in_order": F.col("feature_set_id_a") < F.col("feature_set_id_b"),
        "status_code": F.col("result_status").isin(0, 1),
    }
    return rule_violations(table(spark, sf_dir, "match_results"), rules)


@REGISTRY.query(
    "q06_entry_sides",
    f"""SELECT m.match_result_id, count(*) AS entries, count(CASE WHEN m.feature_index_a >= a.feature_count OR m.feature_index_b >= b.feature_count OR m.feature_index_a < 0 OR m.feature_index_b < 0 THEN 1 END) AS outside
FROM {_VALID} m JOIN (SELECT DISTINCT match_result_id, feature_set_id_a, feature_set_id_b FROM match_results) r ON r.match_result_id = m.match_result_id
JOIN (SELECT DISTINCT feature_set_id, feature_count FROM feature_sets) a ON a.feature_set_id = r.feature_set_id_a
JOIN (SELECT DISTINCT feature_set_id, feature_count FROM feature_sets) b ON b.feature_set_id = r.feature_set_id_b GROUP BY 1""",
)
def q06(spark, sf_dir):
    """Entries whose indexes their sets don't have."""
    results = match_results(spark, sf_dir, "match_result_id", "feature_set_id_a", "feature_set_id_b")
    sets = feature_sets(spark, sf_dir, "feature_set_id", "feature_count")
    a = sets.select(F.col("feature_set_id").alias("feature_set_id_a"), F.col("feature_count").alias("na"))
    b = sets.select(F.col("feature_set_id").alias("feature_set_id_b"), F.col("feature_count").alias("nb"))
    rows = valid_matches(spark, sf_dir).join(results, "match_result_id").join(a, "feature_set_id_a").join(b, "feature_set_id_b")
    outside = F.expr("feature_index_a >= na or feature_index_b >= nb or feature_index_a < 0 or feature_index_b < 0")
    return rows.groupBy("match_result_id").agg(F.count(F.lit(1)).alias("entries"), F.count_if(outside).alias("outside"))
