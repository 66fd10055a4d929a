"""Scans, lookups, joins, set operations and idempotent publication over the project's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from parallaxa.functions.text import ascii_contains, natural_key, normalized_relative
from parallaxa.operators.merge import divides, guarded, insert_new, upsert_state
from parallaxa.operators.pairs import mutual_unique, ordered_pairs, unique_best
from parallaxa.operators.prefix import positions
from parallaxa.operators.scans import content_assets, identity, keyset_page
from parallaxa.plans.registry import Registry
from parallaxa.plans.tables import table

REGISTRY = Registry()
_SETS = "(SELECT DISTINCT * EXCLUDE (ingested_at) FROM feature_sets)"
_RESULTS = "(SELECT DISTINCT * EXCLUDE (ingested_at) FROM match_results)"


def feature_sets(spark, sf_dir, *columns):
    """Distinct feature sets: a row delivered again repeats all columns but its arrival."""
    return table(spark, sf_dir, "feature_sets").select(*columns).distinct()


def match_results(spark, sf_dir, *columns):
    return table(spark, sf_dir, "match_results").select(*columns).distinct()


@REGISTRY.query(
    "s02_keyset_page",
    """SELECT DISTINCT feature_set_id, image_id, extractor_kind FROM feature_sets
WHERE feature_set_id > 2000 ORDER BY feature_set_id, image_id, extractor_kind LIMIT 256""",
)
def s02(spark, sf_dir):
    rows = feature_sets(spark, sf_dir, "feature_set_id", "image_id", "extractor_kind")
    return keyset_page(rows, ["feature_set_id", "image_id", "extractor_kind"], None, 256, F.col("feature_set_id") > 2000)


@REGISTRY.query(
    "s03_scoped_page",
    """SELECT DISTINCT feature_set_id, scanset_id, feature_count FROM feature_sets
WHERE scanset_id = 2 AND feature_set_id > 1500 ORDER BY feature_set_id LIMIT 256""",
)
def s03(spark, sf_dir):
    rows = feature_sets(spark, sf_dir, "feature_set_id", "scanset_id", "feature_count")
    return keyset_page(rows, ["feature_set_id"], [1500], 256, F.col("scanset_id") == 2)


@REGISTRY.query(
    "s04_composite_page",
    """SELECT DISTINCT match_result_id, entry_index FROM matches
WHERE match_result_id > 900 OR (match_result_id = 900 AND entry_index > 2)
ORDER BY match_result_id, entry_index LIMIT 256""",
)
def s04(spark, sf_dir):
    rows = table(spark, sf_dir, "matches").select("match_result_id", "entry_index").distinct()
    return keyset_page(rows, ["match_result_id", "entry_index"], [900, 2], 256)


@REGISTRY.query(
    "s05_point_lookup",
    "SELECT event_id, user_id, event_type, value FROM events WHERE event_id = 4242",
)
def s05(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_id = 4242").select("event_id", "user_id", "event_type", "value")


@REGISTRY.query(
    "s06_identity_lookup",
    f"""SELECT sha256('MATCHID1' || length(candidate_pair_id::VARCHAR) || ':' || candidate_pair_id || length(matcher_kind) || ':' || matcher_kind
  || length(matcher_version::VARCHAR) || ':' || matcher_version) AS identity,
  min(match_result_id) AS first_result, count(DISTINCT match_result_id) AS results
FROM {_RESULTS} GROUP BY 1""",
)
def s06(spark, sf_dir):
    rows = match_results(spark, sf_dir, "match_result_id", "candidate_pair_id", "matcher_kind", "matcher_version")
    parts = [F.col(c) for c in ("candidate_pair_id", "matcher_kind", "matcher_version")]
    return (
        rows.withColumn("identity", identity(parts, "MATCHID1"))
        .groupBy("identity")
        .agg(F.min("match_result_id").alias("first_result"), F.count_distinct("match_result_id").alias("results"))
    )


@REGISTRY.query(
    "s07_track_by_observation",
    """SELECT l.l_partkey AS track_id, o.o_custkey AS feature_set_id, count(*) AS observations
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey GROUP BY ALL HAVING count(*) > 1""",
)
def s07(spark, sf_dir):
    observed = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("track_id"))
    images = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("feature_set_id"))
    return observed.join(images, "l_orderkey").groupBy("track_id", "feature_set_id").agg(F.count(F.lit(1)).alias("observations")).where("observations > 1")


@REGISTRY.query(
    "s17_content_assets",
    "SELECT sha256(text) AS sha256, min(doc_id) AS first_key, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
)
def s17(spark, sf_dir):
    return content_assets(table(spark, sf_dir, "documents"), "text", "doc_id")


@REGISTRY.query(
    "pred02_substring_filter", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'widget')"
)
def p02(spark, sf_dir):
    return table(spark, sf_dir, "part").where(ascii_contains(F.col("p_name"), "WIDGET")).select("p_partkey", "p_name")


@REGISTRY.query(
    "pred03_scope_filter",
    f"""SELECT c.task_id, c.query_feature_set_id, count(*) AS kept
FROM (SELECT DISTINCT * EXCLUDE (ingested_at) FROM visual_index_candidates) c
JOIN visual_index_tasks t ON t.task_id = c.task_id
JOIN (SELECT DISTINCT feature_set_id, scanset_id, image_id FROM feature_sets) q ON q.feature_set_id = c.query_feature_set_id
WHERE (t.scanset_filter = 0 OR (t.scanset_filter = 1 AND c.scanset_id = q.scanset_id) OR (t.scanset_filter = 2 AND c.scanset_id <> q.scanset_id))
  AND NOT (t.exclude_same_asset AND c.same_image_asset) AND c.image_id <> q.image_id AND c.feature_set_id <> c.query_feature_set_id
GROUP BY ALL""",
)
def p03(spark, sf_dir):
    """Any, same or other scan set; without the asker itself, its image and, where asked for, its asset."""
    c = table(spark, sf_dir, "visual_index_candidates").drop("ingested_at").distinct()
    tasks = table(spark, sf_dir, "visual_index_tasks").select("task_id", "scanset_filter", "exclude_same_asset")
    asker = feature_sets(spark, sf_dir, "feature_set_id", "scanset_id", "image_id").select(
        F.col("feature_set_id").alias("query_feature_set_id"), F.col("scanset_id").alias("q_scanset"), F.col("image_id").alias("q_image")
    )
    scope = (
        F.when(F.col("scanset_filter") == 0, True)
        .when(F.col("scanset_filter") == 1, F.col("scanset_id") == F.col("q_scanset"))
        .otherwise(F.col("scanset_id") != F.col("q_scanset"))
    )
    return (
        c.join(tasks, "task_id")
        .join(asker, "query_feature_set_id")
        .where(scope & ~(F.col("exclude_same_asset") & F.col("same_image_asset")))
        .where("image_id <> q_image and feature_set_id <> query_feature_set_id")
        .groupBy("task_id", "query_feature_set_id")
        .agg(F.count(F.lit(1)).alias("kept"))
    )


@REGISTRY.query(
    "pred12_path_validity",
    """SELECT result_status, match_asset_path IS NULL AS missing,
  regexp_matches(coalesce(match_asset_path, ''), '^[^/]+(/[^/]+)*$') AND NOT regexp_matches(coalesce(match_asset_path, ''), '(^|/)\\.\\.?(/|$)') AS valid,
  count(*) AS rows FROM match_results GROUP BY ALL""",
)
def p12(spark, sf_dir):
    path = F.col("match_asset_path")
    return (
        table(spark, sf_dir, "match_results")
        .groupBy("result_status", path.isNull().alias("missing"), normalized_relative(path).alias("valid"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


@REGISTRY.query(
    "j02_image_pairs",
    f"""SELECT least(a.image_id, b.image_id) AS image_a, greatest(a.image_id, b.image_id) AS image_b, count(DISTINCT r.match_result_id) AS results,
  sum(r.match_count)::BIGINT AS matches
FROM {_RESULTS} r JOIN (SELECT DISTINCT feature_set_id, image_id FROM feature_sets) a ON a.feature_set_id = r.feature_set_id_a
JOIN (SELECT DISTINCT feature_set_id, image_id FROM feature_sets) b ON b.feature_set_id = r.feature_set_id_b
WHERE r.result_status = 1 GROUP BY 1, 2""",
)
def j02(spark, sf_dir):
    results = match_results(
        spark, sf_dir, "match_result_id", "feature_set_id_a", "feature_set_id_b", "result_status", "match_count", "created_at", "match_asset_path"
    ).where("result_status = 1")
    sets = feature_sets(spark, sf_dir, "feature_set_id", "image_id")
    a = sets.select(F.col("feature_set_id").alias("feature_set_id_a"), F.col("image_id").alias("ia"))
    b = sets.select(F.col("feature_set_id").alias("feature_set_id_b"), F.col("image_id").alias("ib"))
    return (
        results.join(a, "feature_set_id_a")
        .join(b, "feature_set_id_b")
        .groupBy(F.least("ia", "ib").alias("image_a"), F.greatest("ia", "ib").alias("image_b"))
        .agg(F.count_distinct("match_result_id").alias("results"), F.sum("match_count").alias("matches"))
    )


@REGISTRY.query(
    "j03_optional_parts",
    f"""SELECT r.match_result_id, count(m.match_result_id) AS entries FROM (SELECT DISTINCT match_result_id FROM match_results) r
LEFT JOIN (SELECT DISTINCT * FROM matches) m ON m.match_result_id = r.match_result_id GROUP BY 1""",
)
def j03(spark, sf_dir):
    entries = table(spark, sf_dir, "matches").distinct().groupBy("match_result_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        match_results(spark, sf_dir, "match_result_id")
        .join(entries, "match_result_id", "left")
        .select("match_result_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("entries"))
    )


@REGISTRY.query(
    "j04_index_pending",
    """SELECT DISTINCT t.visual_index_id, f.feature_set_id
FROM feature_sets f JOIN visual_index_tasks t ON t.extractor_kind = f.extractor_kind AND t.extractor_version = f.extractor_version
  AND t.descriptor_type = f.descriptor_type AND t.descriptor_dimension = f.descriptor_dimension
WHERE NOT EXISTS (SELECT 1 FROM visual_index_postings p WHERE p.visual_index_id = t.visual_index_id AND p.feature_set_id = f.feature_set_id)""",
)
def j04(spark, sf_dir):
    """Feature sets that an index of their own descriptor identity doesn't hold yet."""
    like = ["extractor_kind", "extractor_version", "descriptor_type", "descriptor_dimension"]
    wanted = table(spark, sf_dir, "visual_index_tasks").select("visual_index_id", *like).distinct()
    sets = feature_sets(spark, sf_dir, "feature_set_id", *like)
    held = table(spark, sf_dir, "visual_index_postings").select("visual_index_id", "feature_set_id").distinct()
    return sets.join(wanted, like).select("visual_index_id", "feature_set_id").distinct().join(held, ["visual_index_id", "feature_set_id"], "left_anti")


@REGISTRY.query(
    "j05_relational_division",
    """SELECT query_feature_set_id FROM visual_index_candidates WHERE task_id IN (301, 302)
GROUP BY 1 HAVING count(DISTINCT task_id) = 2""",
)
def j05(spark, sf_dir):
    """Query sets that every task of the first index has answered."""
    tasks = table(spark, sf_dir, "visual_index_tasks").where("visual_index_id = 1").select("task_id")
    pairs = table(spark, sf_dir, "visual_index_candidates").select("query_feature_set_id", "task_id")
    return divides(pairs, "query_feature_set_id", "task_id", tasks)


@REGISTRY.query(
    "j06_semi_join",
    f"""SELECT match_result_id, feature_set_id_a, feature_set_id_b FROM {_RESULTS} r
WHERE EXISTS (SELECT 1 FROM feature_sets f WHERE f.feature_set_id = r.feature_set_id_a)
  AND EXISTS (SELECT 1 FROM feature_sets f WHERE f.feature_set_id = r.feature_set_id_b)
GROUP BY ALL""",
)
def j06(spark, sf_dir):
    ids = feature_sets(spark, sf_dir, "feature_set_id")
    rows = match_results(spark, sf_dir, "match_result_id", "feature_set_id_a", "feature_set_id_b")
    for side in ("feature_set_id_a", "feature_set_id_b"):
        rows = guarded(rows, ids.withColumnRenamed("feature_set_id", side), [side])
    return rows


@REGISTRY.query(
    "j08_theta_pairs",
    f"""SELECT a.image_id, a.feature_set_id AS first_set, b.feature_set_id AS second_set
FROM (SELECT DISTINCT feature_set_id, image_id FROM feature_sets) a JOIN (SELECT DISTINCT feature_set_id, image_id FROM feature_sets) b
ON a.image_id = b.image_id AND a.feature_set_id < b.feature_set_id""",
)
def j08(spark, sf_dir):
    sets = feature_sets(spark, sf_dir, "feature_set_id", "image_id")
    a, b = sets.withColumnRenamed("feature_set_id", "first_set"), sets.withColumnRenamed("feature_set_id", "second_set")
    return a.join(b, "image_id").where("first_set < second_set")


@REGISTRY.query(
    "j13_exact_tokens",
    """SELECT t.task_id, count(DISTINCT f.feature_set_id) AS sets FROM visual_index_tasks t
LEFT JOIN feature_sets f ON f.extractor_kind = t.extractor_kind AND f.extractor_version = t.extractor_version GROUP BY 1""",
)
def j13(spark, sf_dir):
    tasks = table(spark, sf_dir, "visual_index_tasks").select("task_id", "extractor_kind", "extractor_version")
    sets = feature_sets(spark, sf_dir, "feature_set_id", "extractor_kind", "extractor_version")
    return tasks.join(sets, ["extractor_kind", "extractor_version"], "left").groupBy("task_id").agg(F.count_distinct("feature_set_id").alias("sets"))


@REGISTRY.query(
    "j14_alias_resolution",
    """SELECT d.source AS alias, w.source AS name, count(*) AS documents FROM documents d
LEFT JOIN source_weights w ON w.source = regexp_replace(lower(trim(d.source)), '[\\s-]+', '_', 'g') GROUP BY ALL""",
)
def j14(spark, sf_dir):
    """Spellings of a source and the profile they stand for; equality after folding, null where there is none."""
    names = table(spark, sf_dir, "source_weights").select(F.col("source").alias("name"))
    seen = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("alias")).agg(F.count(F.lit(1)).alias("documents"))
    folded = F.regexp_replace(F.lower(F.trim("alias")), r"[\s-]+", "_")
    return seen.join(names, folded == F.col("name"), "left").select("alias", "name", "documents")


@REGISTRY.query(
    "j17_lineage",
    f"""WITH base AS (SELECT DISTINCT candidate_pair_id FROM match_results),
ext AS (SELECT DISTINCT candidate_pair_id, match_result_id FROM match_results WHERE result_status = 1)
SELECT b.candidate_pair_id, count(e.match_result_id) AS descendants, coalesce(min(e.match_result_id), 0) AS descendant,
  CASE WHEN count(e.match_result_id) = 0 THEN 'MISSING' WHEN count(e.match_result_id) > 1 THEN 'SPLIT' ELSE 'EXACT' END AS state
FROM base b LEFT JOIN ext e ON e.candidate_pair_id = b.candidate_pair_id GROUP BY 1""",
)
def j17(spark, sf_dir):
    from parallaxa.operators.lineage import lineage_states

    base = match_results(spark, sf_dir, "candidate_pair_id")
    extension = match_results(spark, sf_dir, "candidate_pair_id", "match_result_id", "result_status").where("result_status = 1")
    return lineage_states(base, extension, "candidate_pair_id", "match_result_id").fillna(0, ["descendant"])


@REGISTRY.query(
    "t04_user_sorts",
    """SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) AS by_name,
  row_number() OVER (ORDER BY p_size DESC, p_name, p_partkey) AS by_size FROM part""",
)
def t04(spark, sf_dir):
    """Positions in two user orders, from distributed sorts rather than one global window."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", (-F.col("p_size")).alias("down"))
    by_name = positions(part, [], ["p_name", "p_partkey"], "n").select("p_partkey", (F.col("n") + 1).alias("by_name"))
    by_size = positions(part, [], ["down", "p_name", "p_partkey"], "n").select("p_partkey", (F.col("n") + 1).alias("by_size"))
    return by_name.join(by_size, "p_partkey")


@REGISTRY.query(
    "t08_natural_order",
    """SELECT s_nationkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY regexp_extract(s_name, '[0-9]+')::BIGINT, s_name) AS place FROM supplier""",
)
def t08(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", "s_name", natural_key(F.col("s_name")).alias("key"))
    placed = positions(rows, ["s_nationkey"], ["key", "s_name"], "n")
    return placed.select("s_nationkey", "s_name", (F.col("n") + 1).alias("place"))


@REGISTRY.query(
    "t09_ambiguity_probe",
    f"""SELECT candidate_pair_id, CASE WHEN n = 0 THEN 'REQUIRED' WHEN n = 1 THEN 'RESOLVED' ELSE 'SELECTION_REQUIRED' END AS state
FROM (SELECT candidate_pair_id, count(DISTINCT CASE WHEN result_status = 1 THEN match_result_id END) AS n FROM match_results GROUP BY 1)""",
)
def t09(spark, sf_dir):
    n = F.count_distinct(F.when(F.col("result_status") == 1, F.col("match_result_id")))
    return (
        table(spark, sf_dir, "match_results")
        .groupBy("candidate_pair_id")
        .agg(n.alias("n"))
        .select("candidate_pair_id", F.when(F.col("n") == 0, "REQUIRED").when(F.col("n") == 1, "RESOLVED").otherwise("SELECTION_REQUIRED").alias("state"))
    )


@REGISTRY.query(
    "u01_union",
    """SELECT feature_set_id FROM visual_index_postings WHERE feature_set_id IS NOT NULL
UNION SELECT feature_set_id FROM visual_index_candidates WHERE feature_set_id IS NOT NULL""",
)
def u01(spark, sf_dir):
    a, b = (table(spark, sf_dir, t).select("feature_set_id") for t in ("visual_index_postings", "visual_index_candidates"))
    return a.union(b).where("feature_set_id is not null").distinct()


@REGISTRY.query(
    "u02_set_equality",
    """WITH a AS (SELECT DISTINCT visual_index_id, feature_set_id FROM visual_index_postings WHERE feature_set_id IS NOT NULL),
b AS (SELECT DISTINCT t.visual_index_id, f.feature_set_id FROM feature_sets f JOIN visual_index_tasks t ON t.extractor_kind = f.extractor_kind
  AND t.extractor_version = f.extractor_version AND t.descriptor_dimension = f.descriptor_dimension)
SELECT coalesce(a.visual_index_id, b.visual_index_id) AS visual_index_id, count(*) FILTER (a.feature_set_id IS NULL) AS missing,
  count(*) FILTER (b.feature_set_id IS NULL) AS extra, count(*) FILTER (a.feature_set_id IS NULL OR b.feature_set_id IS NULL) = 0 AS equal
FROM a FULL JOIN b ON a.visual_index_id = b.visual_index_id AND a.feature_set_id = b.feature_set_id GROUP BY 1""",
)
def u02(spark, sf_dir):
    """Whether each index holds exactly the sets of its identity, by one full join."""
    key = ["visual_index_id", "feature_set_id"]
    held = table(spark, sf_dir, "visual_index_postings").select(*key).where("feature_set_id is not null").distinct()
    like = ["extractor_kind", "extractor_version", "descriptor_dimension"]
    tasks = table(spark, sf_dir, "visual_index_tasks").select("visual_index_id", *like).distinct()
    due = feature_sets(spark, sf_dir, "feature_set_id", *like).join(tasks, like).select(*key).distinct()
    both = held.withColumn("a", F.lit(1)).join(due.withColumn("b", F.lit(1)), key, "full")
    missing, extra = F.count_if(F.col("a").isNull()), F.count_if(F.col("b").isNull())
    return both.groupBy("visual_index_id").agg(missing.alias("missing"), extra.alias("extra"), (missing + extra == 0).alias("equal"))


@REGISTRY.query(
    "u04_canonical_pairs",
    """SELECT DISTINCT least(feature_set_id_a, feature_set_id_b) AS feature_set_id_a, greatest(feature_set_id_a, feature_set_id_b) AS feature_set_id_b
FROM match_results WHERE feature_set_id_a IS NOT NULL AND feature_set_id_b IS NOT NULL""",
)
def u04(spark, sf_dir):
    return ordered_pairs(table(spark, sf_dir, "match_results"), "feature_set_id_a", "feature_set_id_b")


@REGISTRY.query(
    "u05_insert_new_pairs",
    """WITH incoming AS (SELECT DISTINCT least(query_feature_set_id, feature_set_id) AS a, greatest(query_feature_set_id, feature_set_id) AS b
  FROM visual_index_candidates WHERE feature_set_id IS NOT NULL AND query_feature_set_id IS NOT NULL),
there AS (SELECT DISTINCT least(feature_set_id_a, feature_set_id_b) AS a, greatest(feature_set_id_a, feature_set_id_b) AS b
  FROM match_results WHERE feature_set_id_a IS NOT NULL AND feature_set_id_b IS NOT NULL)
SELECT i.a, i.b FROM incoming i ANTI JOIN there t ON t.a = i.a AND t.b = i.b""",
)
def u05(spark, sf_dir):
    """Candidate pairs that have no result yet: find before insert as one anti-join."""
    pairs = table(spark, sf_dir, "visual_index_candidates").select(F.col("query_feature_set_id").alias("a"), F.col("feature_set_id").alias("b"))
    there = table(spark, sf_dir, "match_results").select(F.col("feature_set_id_a").alias("a"), F.col("feature_set_id_b").alias("b"))
    return insert_new(ordered_pairs(there, "a", "b"), ordered_pairs(pairs, "a", "b"), ["a", "b"])


@REGISTRY.query(
    "u06_upsert_states",
    """WITH d AS (SELECT DISTINCT least(feature_set_id_a, feature_set_id_b) AS a, greatest(feature_set_id_a, feature_set_id_b) AS b, match_result_id, matcher_kind, match_count, ingested_at
  FROM match_results WHERE feature_set_id_a IS NOT NULL AND feature_set_id_b IS NOT NULL),
s AS (SELECT a, b, min(struct_pack(at := ingested_at, id := match_result_id, k := matcher_kind, n := match_count)) AS s FROM d GROUP BY 1, 2)
SELECT d.match_result_id, d.ingested_at, CASE WHEN d.ingested_at = s.s.at AND d.match_result_id = s.s.id THEN 'new'
  WHEN d.matcher_kind IS NOT DISTINCT FROM s.s.k AND d.match_count IS NOT DISTINCT FROM s.s.n THEN 'same' ELSE 'conflict' END AS state
FROM d JOIN s ON s.a = d.a AND s.b = d.b""",
)
def u06(spark, sf_dir):
    """Each delivered result of a pair of sets against the one stored first: equal content is idempotent, other content
    a conflict."""
    rows = table(spark, sf_dir, "match_results").where("feature_set_id_a is not null and feature_set_id_b is not null")
    a, b = F.least("feature_set_id_a", "feature_set_id_b"), F.greatest("feature_set_id_a", "feature_set_id_b")
    rows = rows.select(a.alias("a"), b.alias("b"), "match_result_id", "matcher_kind", "match_count", "ingested_at").distinct()
    first = rows.groupBy("a", "b").agg(F.min(F.struct("ingested_at", "match_result_id", "matcher_kind", "match_count")).alias("s")).select("a", "b", "s.*")
    later = rows.join(first.select("match_result_id", "ingested_at"), ["match_result_id", "ingested_at"], "left_anti")
    states = upsert_state(first, later, ["a", "b"], ["matcher_kind", "match_count"], ["match_result_id", "ingested_at"])
    return states.drop("a", "b").unionByName(first.select("match_result_id", "ingested_at", F.lit("new").alias("state")))


@REGISTRY.query(
    "u11_duplicates",
    """SELECT match_result_id, entry_index, count(*) AS copies FROM matches GROUP BY 1, 2 HAVING count(*) > 1""",
)
def u11(spark, sf_dir):
    return table(spark, sf_dir, "matches").groupBy("match_result_id", "entry_index").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


@REGISTRY.query(
    "w08_mutual_unique",
    """WITH e AS (SELECT DISTINCT least(feature_set_id_a, feature_set_id_b) AS a, greatest(feature_set_id_a, feature_set_id_b) AS b
  FROM match_results WHERE result_status = 1 AND feature_set_id_a <> feature_set_id_b),
both_ways AS (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e),
deg AS (SELECT x, count(*) AS n FROM both_ways GROUP BY 1)
SELECT e.a, e.b FROM e JOIN deg p ON p.x = e.a AND p.n = 1 JOIN deg q ON q.x = e.b AND q.n = 1""",
)
def w08(spark, sf_dir):
    edges = table(spark, sf_dir, "match_results").where("result_status = 1 and feature_set_id_a <> feature_set_id_b")
    return mutual_unique(edges.select(F.col("feature_set_id_a").alias("a"), F.col("feature_set_id_b").alias("b")), "a", "b")


@REGISTRY.query(
    "w09_unique_best",
    """WITH c AS (SELECT DISTINCT task_id, query_feature_set_id, feature_set_id, evidence_count FROM visual_index_candidates
  WHERE feature_set_id IS NOT NULL AND evidence_count > 0),
top AS (SELECT task_id, query_feature_set_id, max(evidence_count) AS top FROM c GROUP BY 1, 2)
SELECT t.task_id, t.query_feature_set_id, t.top, count(*) AS ties, CASE WHEN count(*) = 1 THEN min(c.feature_set_id) ELSE 0 END AS best
FROM top t JOIN c ON c.task_id = t.task_id AND c.query_feature_set_id IS NOT DISTINCT FROM t.query_feature_set_id AND c.evidence_count = t.top
GROUP BY ALL""",
)
def w09(spark, sf_dir):
    c = table(spark, sf_dir, "visual_index_candidates").select("task_id", "query_feature_set_id", "feature_set_id", "evidence_count").distinct()
    best = unique_best(c.where("feature_set_id is not null"), ["task_id", "query_feature_set_id"], "feature_set_id", "evidence_count")
    return best.fillna(0, ["best"])
