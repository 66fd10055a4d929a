"""Snapshot checks, correspondences, lineage verdicts and index maintenance over the project's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from parallaxa.catalog.relational import feature_sets, match_results
from parallaxa.catalog.similarity import _KEYS, binary_descriptors
from parallaxa.catalog.statistics import _VALID, valid_matches
from parallaxa.operators.components import components
from parallaxa.operators.lineage import extended, lineage_verdicts
from parallaxa.operators.lsh import pending_members, postings, published_generation
from parallaxa.operators.prefix import positions
from parallaxa.plans.registry import Registry
from parallaxa.plans.tables import table

REGISTRY = Registry()

#: The moment at which the base of the extensions below was frozen.
_FROZEN = "2024-03-01"
_OLD = f"created_at < TIMESTAMP '{_FROZEN}'"


@REGISTRY.query(
    "q01_component_keys",
    """WITH d AS (SELECT scanset_id, min(image_id) AS key, count(DISTINCT image_id) AS n FROM visual_index_candidates WHERE scanset_id IS NOT NULL GROUP BY 1),
s AS (SELECT scanset_id, min(image_id) AS key, count(DISTINCT image_id) AS n FROM feature_sets WHERE scanset_id IS NOT NULL GROUP BY 1)
SELECT scanset_id, coalesce(d.key = s.key, FALSE) AS key_equal, coalesce(d.n = s.n, FALSE) AS count_equal FROM d FULL JOIN s USING (scanset_id)""",
)
def q01(spark, sf_dir):
    """Whether what the candidates say of a scan set (smallest image, number of images) is what its sets say."""
    of = lambda name, k, n: (
        table(spark, sf_dir, name).select("scanset_id", "image_id").where("scanset_id is not null").distinct()
        .groupBy("scanset_id").agg(F.min("image_id").alias(k), F.count("image_id").alias(n))
    )
    both = of("visual_index_candidates", "dk", "dn").join(of("feature_sets", "sk", "sn"), "scanset_id", "full")
    equal = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return both.select("scanset_id", equal("dk", "sk").alias("key_equal"), equal("dn", "sn").alias("count_equal"))


@REGISTRY.query(
    "q02_landmark_flags",
    """WITH r AS (SELECT DISTINCT match_result_id, feature_set_id_a AS a, feature_set_id_b AS b FROM match_results WHERE result_status = 1 AND feature_set_id_a IS NOT NULL AND feature_set_id_b IS NOT NULL),
f AS (SELECT feature_set_id, min(scanset_id) AS c FROM feature_sets GROUP BY 1)
SELECT r.match_result_id, coalesce(fa.c = fb.c, FALSE) AND EXISTS (SELECT 1 FROM matches m WHERE m.match_result_id = r.match_result_id) AS valid
FROM r LEFT JOIN f fa ON fa.feature_set_id = r.a LEFT JOIN f fb ON fb.feature_set_id = r.b""",
)
def q02(spark, sf_dir):
    """Whether each matched result has entries and both its sets are registered in one component (scan set)."""
    rows = match_results(spark, sf_dir, "match_result_id", "feature_set_id_a", "feature_set_id_b", "result_status").where("result_status = 1").dropna()
    of = table(spark, sf_dir, "feature_sets").groupBy("feature_set_id").agg(F.min("scanset_id").alias("c"))
    for side in ("a", "b"):
        rows = rows.join(of.select(F.col("feature_set_id").alias(f"feature_set_id_{side}"), F.col("c").alias(f"c{side}")), f"feature_set_id_{side}", "left")
    there = table(spark, sf_dir, "matches").select("match_result_id").distinct().withColumn("there", F.lit(True))
    valid = F.coalesce((F.col("ca") == F.col("cb")) & F.col("there"), F.lit(False))
    return rows.join(there, "match_result_id", "left").select("match_result_id", valid.alias("valid"))


@REGISTRY.query(
    "q03_observation_flags",
    """SELECT p.feature_set_id, p.feature_index, d.feature_index IS NOT NULL AS member FROM (SELECT DISTINCT feature_set_id, feature_index FROM visual_index_postings WHERE feature_set_id IS NOT NULL) p
LEFT JOIN (SELECT DISTINCT feature_set_id, feature_index FROM descriptors) d ON d.feature_set_id = p.feature_set_id AND d.feature_index = p.feature_index""",
)
def q03(spark, sf_dir):
    """Whether each indexed feature is a described one."""
    key = ["feature_set_id", "feature_index"]
    described = table(spark, sf_dir, "descriptors").select(*key).distinct().withColumn("there", F.lit(True))
    seen = table(spark, sf_dir, "visual_index_postings").where("feature_set_id is not null").select(*key).distinct()
    return seen.join(described, key, "left").select(*key, F.coalesce("there", F.lit(False)).alias("member"))


_DECLARED = "(SELECT DISTINCT match_result_id, match_count, feature_set_id_a, feature_set_id_b FROM match_results WHERE result_status = 1)"


@REGISTRY.query(
    "q08_ordinals",
    f"""SELECT r.match_result_id, r.match_count AS declared, count(m.entry_index) AS rows, count(DISTINCT m.entry_index) AS ordinals,
  coalesce(count(m.entry_index) = r.match_count AND count(DISTINCT m.entry_index) = r.match_count AND min(m.entry_index) = 0 AND max(m.entry_index) = r.match_count - 1, FALSE) AS complete,
  coalesce(bool_and(m.entry_index BETWEEN 0 AND 8191 AND isfinite(m.distance) AND m.distance >= 0), FALSE) AS sound
FROM {_DECLARED} r LEFT JOIN (SELECT DISTINCT match_result_id, entry_index, feature_index_a, feature_index_b, distance FROM matches) m ON m.match_result_id = r.match_result_id
GROUP BY r.match_result_id, r.match_count, r.feature_set_id_a, r.feature_set_id_b""",
)
def q08(spark, sf_dir):
    """Whether the entries of a result are as many as declared, numbered 0 to n - 1 once each, and each sound."""
    declared = match_results(spark, sf_dir, "match_result_id", "match_count", "feature_set_id_a", "feature_set_id_b", "result_status").where("result_status = 1")
    rows = table(spark, sf_dir, "matches").select("match_result_id", "entry_index", "feature_index_a", "feature_index_b", "distance").distinct()
    finite = F.col("distance").isNotNull() & ~F.isnan("distance") & (F.abs("distance") != float("inf")) & (F.col("distance") >= 0)
    sound = F.when(F.col("distance").isNull(), None).otherwise(F.col("entry_index").between(0, 8191) & finite)
    counted = rows.groupBy("match_result_id").agg(
        F.count("entry_index").alias("rows"), F.count_distinct("entry_index").alias("ordinals"), F.min("entry_index").alias("low"),
        F.max("entry_index").alias("high"), F.bool_and(sound).alias("sound"),
    )
    n = F.col("match_count")
    complete = (F.col("rows") == n) & (F.col("ordinals") == n) & (F.col("low") == 0) & (F.col("high") == n - 1)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    false = lambda c, name: F.coalesce(c, F.lit(False)).alias(name)
    return declared.join(counted, "match_result_id", "left").select(
        "match_result_id", n.alias("declared"), zero("rows"), zero("ordinals"), false(complete, "complete"), false(F.col("sound"), "sound")
    )


@REGISTRY.query(
    "q06_snapshot",
    f"""WITH f AS (SELECT DISTINCT feature_set_id, feature_count, scanset_id FROM feature_sets)
SELECT r.match_result_id, count(m.entry_index) = r.match_count AS counts_equal, coalesce(a.scanset_id = b.scanset_id, FALSE) AS one_component,
  coalesce(bool_and(m.feature_index_a BETWEEN 0 AND a.feature_count - 1 AND m.feature_index_b BETWEEN 0 AND b.feature_count - 1), FALSE) AS inside,
  count(DISTINCT m.feature_index_a) = count(m.entry_index) AND count(DISTINCT m.feature_index_b) = count(m.entry_index) AS seen_once
FROM {_DECLARED} r LEFT JOIN f a ON a.feature_set_id = r.feature_set_id_a LEFT JOIN f b ON b.feature_set_id = r.feature_set_id_b
LEFT JOIN {_VALID} m ON m.match_result_id = r.match_result_id GROUP BY r.match_result_id, r.match_count, a.scanset_id, b.scanset_id, r.feature_set_id_a, r.feature_set_id_b""",
)
def q06(spark, sf_dir):
    """A result as a snapshot: as many entries as declared, both sets in one component, indexes that their sets have,
    no feature seen twice."""
    declared = match_results(spark, sf_dir, "match_result_id", "match_count", "feature_set_id_a", "feature_set_id_b", "result_status").where("result_status = 1")
    sets = feature_sets(spark, sf_dir, "feature_set_id", "feature_count", "scanset_id")
    for s in ("a", "b"):
        side = sets.select(F.col("feature_set_id").alias(f"feature_set_id_{s}"), F.col("feature_count").alias(f"n{s}"), F.col("scanset_id").alias(f"c{s}"))
        declared = declared.join(side, f"feature_set_id_{s}", "left")
    entries = valid_matches(spark, sf_dir)
    inside = F.col("feature_index_a").between(0, F.col("na") - 1) & F.col("feature_index_b").between(0, F.col("nb") - 1)
    counted = declared.join(entries, "match_result_id", "left").groupBy("match_result_id", "match_count", "feature_set_id_a", "feature_set_id_b", "ca", "cb").agg(
        F.count("entry_index").alias("n"), F.count_distinct("feature_index_a").alias("da"), F.count_distinct("feature_index_b").alias("db"),
        F.bool_and(F.when(F.col("entry_index").isNotNull(), inside)).alias("inside"),
    )
    return counted.select(
        "match_result_id", (F.col("n") == F.col("match_count")).alias("counts_equal"), F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)).alias("one_component"),
        F.coalesce("inside", F.lit(False)).alias("inside"), ((F.col("da") == F.col("n")) & (F.col("db") == F.col("n"))).alias("seen_once"),
    )


_SIDES = f"""r AS (SELECT DISTINCT match_result_id, feature_set_id_a AS a, feature_set_id_b AS b, {_OLD} AS old FROM match_results
  WHERE result_status = 1 AND feature_set_id_a IS NOT NULL AND feature_set_id_b IS NOT NULL AND feature_set_id_a <> feature_set_id_b),
e AS (SELECT r.old, r.a AS s, m.feature_index_a AS i, r.b AS s2, m.feature_index_b AS i2 FROM {_VALID} m JOIN r USING (match_result_id)
  UNION SELECT r.old, r.b, m.feature_index_b, r.a, m.feature_index_a FROM {_VALID} m JOIN r USING (match_result_id)),
landmarks AS (SELECT DISTINCT s, i FROM e WHERE old), registered AS (SELECT DISTINCT s FROM landmarks),
found AS (SELECT DISTINCT e.s AS feature_set_id, e.i AS feature_index, e.s2 AS landmark_set_id, e.i2 AS landmark_index FROM e
  JOIN landmarks l ON l.s = e.s2 AND l.i = e.i2 WHERE NOT e.old AND NOT EXISTS (SELECT 1 FROM registered g WHERE g.s = e.s))"""


def _correspondences(spark, sf_dir):
    results = match_results(spark, sf_dir, "match_result_id", "feature_set_id_a", "feature_set_id_b", "result_status", "created_at").where(
        "result_status = 1 and feature_set_id_a is not null and feature_set_id_b is not null and feature_set_id_a <> feature_set_id_b"
    )
    old = F.col("created_at") < F.lit(_FROZEN).cast("timestamp_ntz")
    rows = valid_matches(spark, sf_dir).join(results.withColumn("old", old), "match_result_id")
    end = lambda x, y: F.struct(
        F.col(f"feature_set_id_{x}").alias("s"), F.col(f"feature_index_{x}").alias("i"), F.col(f"feature_set_id_{y}").alias("s2"), F.col(f"feature_index_{y}").alias("i2")
    )
    ends = rows.select("old", F.explode(F.array(end("a", "b"), end("b", "a"))).alias("x")).select("old", "x.*").distinct()
    landmarks = ends.where("old").select("s", "i").distinct()
    registered = landmarks.select("s").distinct()
    later = ends.where("not old").join(registered, "s", "left_anti")
    found = later.join(landmarks.select(F.col("s").alias("s2"), F.col("i").alias("i2")), ["s2", "i2"], "left_semi")
    return found.select(
        F.col("s").alias("feature_set_id"), F.col("i").alias("feature_index"), F.col("s2").alias("landmark_set_id"), F.col("i2").alias("landmark_index")
    ).distinct()


@REGISTRY.query("j19_correspondences", f"WITH {_SIDES} SELECT * FROM found")
def j19(spark, sf_dir):
    """Features of sets that are not registered yet, with the landmarks of the frozen base that they were matched to."""
    return _correspondences(spark, sf_dir)


@REGISTRY.query(
    "t06_registration_order",
    f"""WITH {_SIDES}, s AS (SELECT feature_set_id, count(DISTINCT feature_index) AS support FROM found GROUP BY 1 HAVING count(DISTINCT feature_index) >= 2)
SELECT feature_set_id, support, row_number() OVER (ORDER BY support DESC, feature_set_id) - 1 AS place FROM s""",
)
def t06(spark, sf_dir):
    """The order in which sets are registered: most supported first, then by id; fewer than two supports don't do."""
    support = _correspondences(spark, sf_dir).select("feature_set_id", "feature_index").distinct().groupBy("feature_set_id").agg(F.count(F.lit(1)).alias("support"))
    rows = support.where("support >= 2").withColumn("less", -F.col("support"))
    return positions(rows, [], ["less", "feature_set_id"], "place").drop("less")


_SET_GRAPH = """{n}e AS (SELECT DISTINCT feature_set_id_a AS u, feature_set_id_b AS v FROM match_results
  WHERE result_status = 1 AND feature_set_id_a IS NOT NULL AND feature_set_id_b IS NOT NULL{when}),
{n}l AS (SELECT u, v FROM {n}e UNION SELECT v, u FROM {n}e),
{n}r AS (SELECT u AS node, u AS low FROM {n}l UNION SELECT l.v, r.low FROM {n}r r JOIN {n}l l ON l.u = r.node WHERE r.low < l.v),
{n}t AS (SELECT node, min(low) AS track FROM {n}r GROUP BY 1)"""


@REGISTRY.query(
    "j17_track_lineage",
    f"""WITH RECURSIVE {_SET_GRAPH.format(n="b", when=f" AND {_OLD}")}, {_SET_GRAPH.format(n="x", when="")},
c AS (SELECT feature_set_id, min(scanset_id) AS component FROM feature_sets GROUP BY 1),
j AS (SELECT bt.track, max(c.component) AS component, count(*) FILTER (xt.node IS NULL) AS lost, count(DISTINCT xt.track) AS n, min(xt.track) AS descendant
  FROM bt LEFT JOIN xt ON xt.node = bt.node LEFT JOIN c ON c.feature_set_id = bt.track GROUP BY 1),
s AS (SELECT descendant, min(track) AS first, min_by(component, track) AS component FROM j WHERE lost = 0 AND n = 1 GROUP BY 1)
SELECT j.track, CASE WHEN lost = 0 AND n = 1 THEN j.descendant END AS descendant, CASE WHEN lost > 0 THEN 'MISSING' WHEN n > 1 THEN 'SPLIT' WHEN s.first = j.track THEN 'EXACT'
  WHEN s.component IS NOT DISTINCT FROM j.component THEN 'MERGE' ELSE 'CROSS_COMPONENT_BRIDGE' END AS state FROM j LEFT JOIN s ON s.descendant = j.descendant""",
)
def j17_tracks(spark, sf_dir):
    """What became of each track of the frozen base in the extended graph."""
    rows = match_results(spark, sf_dir, "feature_set_id_a", "feature_set_id_b", "result_status", "created_at").where("result_status = 1")
    tracks = lambda df: components(df, "feature_set_id_a", "feature_set_id_b").select(F.col("low").alias("track"), F.col("v").alias("member"))
    base = tracks(rows.where(F.col("created_at") < F.lit(_FROZEN).cast("timestamp_ntz")))
    of = table(spark, sf_dir, "feature_sets").groupBy(F.col("feature_set_id").alias("track")).agg(F.min("scanset_id").alias("component"))
    return lineage_verdicts(base.join(of, "track", "left"), tracks(rows), "track", "component", ["member"]).select("track", "descendant", "state")


@REGISTRY.query(
    "st11_extended_scans",
    f"""WITH r AS (SELECT DISTINCT f.scanset_id, m.match_result_id, m.match_count, {_OLD.replace("created_at", "m.created_at")} AS old FROM match_results m
  JOIN (SELECT DISTINCT feature_set_id, scanset_id FROM feature_sets) f ON f.feature_set_id = m.feature_set_id_a WHERE m.result_status = 1)
SELECT scanset_id, count(*) AS results, sum(match_count)::BIGINT AS matches, count(*) FILTER (NOT old) > 0 AS recomputed FROM r GROUP BY 1""",
)
def st11_extended(spark, sf_dir):
    """Counts of every scan set: those that newer results touch computed again, the others kept from the frozen base."""
    sets = feature_sets(spark, sf_dir, "feature_set_id", "scanset_id").withColumnRenamed("feature_set_id", "feature_set_id_a")
    rows = match_results(spark, sf_dir, "match_result_id", "feature_set_id_a", "match_count", "result_status", "created_at").where("result_status = 1").join(sets, "feature_set_id_a")
    old = F.col("created_at") < F.lit(_FROZEN).cast("timestamp_ntz")
    count = lambda df: df.groupBy("scanset_id").agg(F.count(F.lit(1)).alias("results"), F.sum("match_count").alias("matches"))
    return extended(count(rows.where(old)), rows, rows.where(~old).select("scanset_id"), "scanset_id", count)


@REGISTRY.query(
    "t02_posting_order",
    """SELECT visual_index_id, table_no, bucket_key, feature_set_id, feature_index, generation,
  row_number() OVER (PARTITION BY visual_index_id ORDER BY table_no, bucket_key, feature_set_id, feature_index, generation) - 1 AS place
FROM (SELECT DISTINCT * FROM visual_index_postings WHERE bucket_key IS NOT NULL AND feature_set_id IS NOT NULL)""",
)
def t02(spark, sf_dir):
    """The total order of an index's postings, which its segments are sorted by."""
    rows = table(spark, sf_dir, "visual_index_postings").where("bucket_key is not null and feature_set_id is not null").distinct()
    return positions(rows, ["visual_index_id"], ["table_no", "bucket_key", "feature_set_id", "feature_index", "generation"], "place")


@REGISTRY.query(
    "st04_index_update",
    f"""WITH held AS (SELECT DISTINCT visual_index_id, feature_set_id FROM visual_index_postings WHERE generation <= 20),
due AS (SELECT DISTINCT t.visual_index_id, f.feature_set_id FROM feature_sets f JOIN visual_index_tasks t ON t.extractor_kind = f.extractor_kind
  AND t.extractor_version = f.extractor_version AND t.descriptor_type = f.descriptor_type AND t.descriptor_dimension = f.descriptor_dimension
  WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.visual_index_id = t.visual_index_id AND h.feature_set_id = f.feature_set_id))
SELECT d.visual_index_id, 21 AS generation, k.table_no, k.bucket_key, k.feature_set_id, k.feature_index FROM {_KEYS} k JOIN due d ON d.feature_set_id = k.feature_set_id""",
)
def st04_update(spark, sf_dir):
    """The next generation of each index as of its twentieth: postings of the sets it lacks, published sorted, read back."""
    like = ["extractor_kind", "extractor_version", "descriptor_type", "descriptor_dimension"]
    wanted = table(spark, sf_dir, "visual_index_tasks").select("visual_index_id", *like).distinct()
    due = feature_sets(spark, sf_dir, "feature_set_id", *like).join(wanted, like).select("visual_index_id", "feature_set_id").distinct()
    held = table(spark, sf_dir, "visual_index_postings").where("generation <= 20").select("visual_index_id", "feature_set_id").distinct()
    new = binary_descriptors(spark, sf_dir).join(pending_members(due, held, ["visual_index_id", "feature_set_id"]), "feature_set_id")
    keyed = postings(new, ["visual_index_id", "feature_set_id", "feature_index"], "w")
    return published_generation(keyed, 21).df
