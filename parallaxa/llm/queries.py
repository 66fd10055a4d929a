"""The registered queries of this package."""

from __future__ import annotations

from pyspark.sql import functions as F

from parallaxa.llm.abuse import score_texts
from parallaxa.llm.bpe import encode_corpus
from parallaxa.llm.components import connected_groups
from parallaxa.llm.knn import Space, nearest, pack_floats
from parallaxa.llm.mixture import mix
from parallaxa.llm.setsim import similar_sets
from parallaxa.llm.topn import top_n
from parallaxa.plans.lineage import cut
from parallaxa.plans.registry import Registry
from parallaxa.plans.tables import table

REGISTRY = Registry()


@REGISTRY.query(
    "p1_found",
    """
WITH RECURSIVE pairs AS (
  SELECT DISTINCT r.feature_set_id_a AS ma, m.feature_index_a AS na, r.feature_set_id_b AS mb, m.feature_index_b AS nb
  FROM matches m JOIN match_results r ON r.match_result_id = m.match_result_id
  WHERE r.result_status = 1 AND r.feature_set_id_a IS NOT NULL AND r.feature_set_id_b IS NOT NULL
    AND m.feature_index_a IS NOT NULL AND m.feature_index_b IS NOT NULL
), links AS (
  SELECT {'s': ma, 'i': na} AS u, {'s': mb, 'i': nb} AS v FROM pairs
  UNION SELECT {'s': mb, 'i': nb}, {'s': ma, 'i': na} FROM pairs
), reach AS (
  SELECT u AS node, u AS low FROM links
  UNION
  SELECT l.v, r.low FROM reach r JOIN links l ON l.u = r.node WHERE r.low < l.v
)
SELECT node.s AS feature_set_id, node.i AS feature_index, min(low).s AS group_feature_set_id, min(low).i AS group_feature_index
FROM reach GROUP BY node
""",
)
def p1_found(spark, sf_dir):
    results = (
        table(spark, sf_dir, "match_results")
        .where("result_status = 1 and feature_set_id_a is not null and feature_set_id_b is not null")
        .select("match_result_id", "feature_set_id_a", "feature_set_id_b")
        .distinct()
    )
    matches = table(spark, sf_dir, "matches").select("match_result_id", "feature_index_a", "feature_index_b")
    pairs = matches.where("feature_index_a is not null and feature_index_b is not null").join(results, "match_result_id")
    groups = connected_groups(
        pairs, ("feature_set_id_a", "feature_index_a"), ("feature_set_id_b", "feature_index_b")
    )
    return groups.select(
        F.col("major").alias("feature_set_id"),
        F.col("minor").alias("feature_index"),
        F.col("group_major").alias("group_feature_set_id"),
        F.col("group_minor").alias("group_feature_index"),
    )


@REGISTRY.query(
    "p3_found",
    """
WITH best AS (
  SELECT *, row_number() OVER (
    PARTITION BY task_id, query_feature_set_id, feature_set_id
    ORDER BY score DESC NULLS LAST, evidence_count DESC NULLS LAST, image_id ASC NULLS LAST) AS copy
  FROM visual_index_candidates WHERE score IS NOT NULL AND NOT isnan(score) AND feature_set_id IS NOT NULL
), ranked AS (
  SELECT *, row_number() OVER (
    PARTITION BY task_id, query_feature_set_id
    ORDER BY score DESC, evidence_count DESC NULLS LAST, image_id ASC NULLS LAST, feature_set_id ASC) AS place
  FROM best WHERE copy = 1
)
SELECT r.task_id, r.query_feature_set_id, r.feature_set_id
FROM ranked r JOIN visual_index_tasks t ON t.task_id = r.task_id WHERE r.place <= t.top_k
""",
)
def p3_found(spark, sf_dir):
    tasks = table(spark, sf_dir, "visual_index_tasks").select("task_id", "top_k").distinct()
    candidates = table(spark, sf_dir, "visual_index_candidates").join(tasks, "task_id")
    return top_n(
        candidates,
        ["task_id", "query_feature_set_id"],
        [("score", "descending"), ("evidence_count", "descending"), ("image_id", "ascending")],
        ["feature_set_id"],
        "top_k",
    ).select("task_id", "query_feature_set_id", "feature_set_id")


@REGISTRY.query("p6_ids")
def p6_ids(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_corpus(documents).select("doc_id", "ids")


_SETS = """
WITH postings AS (
  SELECT DISTINCT * FROM visual_index_postings WHERE bucket_key IS NOT NULL AND feature_set_id IS NOT NULL
), limits AS (SELECT DISTINCT visual_index_id, max_bucket_postings FROM visual_index_tasks),
small AS (
  SELECT p.visual_index_id, l.max_bucket_postings, p.table_no, p.bucket_key
  FROM postings p JOIN limits l ON l.visual_index_id = p.visual_index_id
  GROUP BY ALL HAVING count(*) <= l.max_bucket_postings
), sets AS (
  SELECT DISTINCT s.*, p.feature_set_id AS f
  FROM postings p JOIN small s ON s.visual_index_id = p.visual_index_id AND s.table_no IS NOT DISTINCT FROM p.table_no
    AND s.bucket_key = p.bucket_key
), sizes AS (SELECT visual_index_id, max_bucket_postings, f, count(*) AS n FROM sets GROUP BY ALL),
shared AS (
  SELECT a.visual_index_id, a.max_bucket_postings, a.f AS fa, b.f AS fb, count(*) AS evidence
  FROM sets a JOIN sets b ON a.visual_index_id = b.visual_index_id AND a.max_bucket_postings = b.max_bucket_postings
    AND a.table_no IS NOT DISTINCT FROM b.table_no AND a.bucket_key = b.bucket_key AND a.f < b.f
  GROUP BY ALL
)
SELECT t.task_id, s.fa AS feature_set_id_a, s.fb AS feature_set_id_b{more}
FROM shared s JOIN sizes x ON x.visual_index_id = s.visual_index_id AND x.max_bucket_postings = s.max_bucket_postings AND x.f = s.fa
JOIN sizes y ON y.visual_index_id = s.visual_index_id AND y.max_bucket_postings = s.max_bucket_postings AND y.f = s.fb
JOIN visual_index_tasks t ON t.visual_index_id = s.visual_index_id AND t.max_bucket_postings = s.max_bucket_postings
WHERE s.evidence >= t.minimum_evidence_count AND 5 * s.evidence >= 2 * (x.n + y.n - s.evidence)
"""


def _evidence(spark, sf_dir):
    """Similar pairs of feature sets of each task, with the number of buckets that both are in."""
    tasks = table(spark, sf_dir, "visual_index_tasks").select(
        "task_id", "visual_index_id", "max_bucket_postings", "minimum_evidence_count"
    )
    limits = tasks.select("visual_index_id", "max_bucket_postings").distinct()
    bucket = ["visual_index_id", "table_no", "bucket_key"]
    postings = (
        table(spark, sf_dir, "visual_index_postings")
        .where("bucket_key is not null and feature_set_id is not null")
        .distinct()
        .withColumn("table_no", F.coalesce("table_no", F.lit(-1)))
    )
    written = cut(postings.select(*bucket, "feature_set_id"), "postings")
    counts = written.df.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"))
    space = ["visual_index_id", "max_bucket_postings"]
    large = counts.join(limits, "visual_index_id").where("n > max_bucket_postings").select(*bucket, "max_bucket_postings")
    # an element is the bucket's number within its index: 3 bits of table above 32 bits of key
    small = (
        written.df.join(limits, "visual_index_id")
        .join(large, [*bucket, "max_bucket_postings"], "left_anti")
        .select(
            *space,
            "feature_set_id",
            F.shiftleft(F.col("table_no").cast("bigint"), 32).bitwiseOR(F.col("bucket_key")).alias("element"),
        )
    )
    cap = tasks.agg(F.max("max_bucket_postings")).head()[0] or 0
    found = similar_sets(small, space, "feature_set_id", "element", 0.4, element_cap=cap)
    classes = found.pairs.select(*space, F.col("a").alias("class_a"), F.col("b").alias("class_b"), "overlap").unionByName(
        found.members.groupBy(*space, "class_id", "size")
        .count()
        .where("count > 1")
        .select(*space, F.col("class_id").alias("class_a"), F.col("class_id").alias("class_b"), F.col("size").alias("overlap"))
    )
    a = found.members.select(*space, F.col("id").alias("a"), F.col("class_id").alias("class_a"))
    b = found.members.select(*space, F.col("id").alias("b"), F.col("class_id").alias("class_b"))
    pairs = (
        classes.join(a, [*space, "class_a"]).join(b, [*space, "class_b"]).where("class_a <> class_b or a < b")
    )
    return pairs.join(tasks, space).where("overlap >= minimum_evidence_count").select(
        "task_id",
        F.least("a", "b").alias("feature_set_id_a"),
        F.greatest("a", "b").alias("feature_set_id_b"),
        F.col("overlap").cast("bigint").alias("evidence_count"),
    )


@REGISTRY.query("p5_found", _SETS.format(more=""))
def p5_found(spark, sf_dir):
    return _evidence(spark, sf_dir).drop("evidence_count")


@REGISTRY.query("p5_evidence", _SETS.format(more=", s.evidence AS evidence_count"))
def p5_evidence(spark, sf_dir):
    return _evidence(spark, sf_dir)


#: Distances up to which a neighbour counts: differing bits (type 1) and Euclidean (type 2). Fixed values.
_RADIUS = {1: 40, 2: 150}


def _neighbours(spark, sf_dir, k=5):
    descriptors = table(spark, sf_dir, "descriptors").where(F.col("descriptor_type").isin(*_RADIUS))
    kinds = sorted(
        (r["descriptor_type"], r["descriptor_dimension"])
        for r in descriptors.select("descriptor_type", "descriptor_dimension").distinct().dropna().collect()
    )
    spaces = [
        Space("hamming", 8 * dim, _RADIUS[kind]) if kind == 1 else Space("l2", dim, _RADIUS[kind]) for kind, dim in kinds
    ]
    number = F.lit(None).cast("int")
    for i, (kind, dim) in enumerate(kinds):
        number = F.when((F.col("descriptor_type") == kind) & (F.col("descriptor_dimension") == dim), i).otherwise(number)
    bits = F.when(F.octet_length("descriptor_u8") == F.col("descriptor_dimension"), F.col("descriptor_u8"))
    packed = pack_floats(
        F.when(F.col("descriptor_type") == 2, F.col("descriptor_f32")), F.col("descriptor_dimension")
    )
    rows = descriptors.select(
        number.alias("space"),
        F.col("feature_set_id").alias("major"),
        F.col("feature_index").alias("minor"),
        F.when(F.col("descriptor_type") == 1, bits).otherwise(packed).alias("payload"),
    )
    return nearest(rows, spaces, k).per_record()


_NEAR = """
WITH valid AS (
  SELECT DISTINCT feature_set_id AS s, feature_index AS i, descriptor_type AS t, descriptor_dimension AS d,
    descriptor_u8 AS u, descriptor_f32 AS f
  FROM descriptors
  WHERE (descriptor_type = 1 AND octet_length(descriptor_u8) = descriptor_dimension)
    OR (descriptor_type = 2 AND len(descriptor_f32) = descriptor_dimension
      AND len(list_filter(descriptor_f32, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), near AS (
  SELECT a.s, a.i, b.s AS s2, b.i AS i2, bit_count(xor(a.u::BIT, b.u::BIT))::DOUBLE AS distance
  FROM valid a JOIN valid b ON a.t = 1 AND b.t = 1 AND a.d = b.d AND (a.s <> b.s OR a.i <> b.i)
  WHERE bit_count(xor(a.u::BIT, b.u::BIT)) <= 40
  UNION ALL
  SELECT a.s, a.i, b.s, b.i, list_distance(a.f::DOUBLE[], b.f::DOUBLE[])
  FROM valid a JOIN valid b ON a.t = 2 AND b.t = 2 AND a.d = b.d AND (a.s <> b.s OR a.i <> b.i)
  WHERE list_distance(a.f::DOUBLE[], b.f::DOUBLE[]) <= 150
), ranked AS (SELECT *, row_number() OVER (PARTITION BY s, i ORDER BY distance, s2, i2) AS place FROM near)
"""


@REGISTRY.query(
    "p4_found",
    _NEAR
    + """SELECT DISTINCT
  CASE WHEN (s, i) < (s2, i2) THEN s ELSE s2 END AS feature_set_id_a,
  CASE WHEN (s, i) < (s2, i2) THEN i ELSE i2 END AS feature_index_a,
  CASE WHEN (s, i) < (s2, i2) THEN s2 ELSE s END AS feature_set_id_b,
  CASE WHEN (s, i) < (s2, i2) THEN i2 ELSE i END AS feature_index_b
FROM ranked WHERE place <= 5""",
)
def p4_found(spark, sf_dir):
    me, other = F.struct("major", "minor"), F.struct(F.col("other_major").alias("major"), F.col("other_minor").alias("minor"))
    pairs = _neighbours(spark, sf_dir).select(F.least(me, other).alias("a"), F.greatest(me, other).alias("b"))
    return pairs.select(
        F.col("a.major").alias("feature_set_id_a"),
        F.col("a.minor").alias("feature_index_a"),
        F.col("b.major").alias("feature_set_id_b"),
        F.col("b.minor").alias("feature_index_b"),
    ).distinct()


@REGISTRY.query(
    "p4_neighbours",
    _NEAR
    + """SELECT s AS feature_set_id, i AS feature_index, s2 AS neighbour_feature_set_id, i2 AS neighbour_feature_index,
  round(distance, 6) AS distance FROM ranked WHERE place <= 5""",
)
def p4_neighbours(spark, sf_dir):
    return _neighbours(spark, sf_dir).select(
        F.col("major").alias("feature_set_id"),
        F.col("minor").alias("feature_index"),
        F.col("other_major").alias("neighbour_feature_set_id"),
        F.col("other_minor").alias("neighbour_feature_index"),
        F.round("distance", 6).alias("distance"),
    )


def source_name(column: str = "source"):
    """One spelling of a source: blanks cut off, lower case, hyphens and inner blanks as underscores; empty as null."""
    plain = F.regexp_replace(F.lower(F.trim(column)), r"[\s\-]+", "_")
    return F.when(plain != "", plain)


def _scored(spark, sf_dir, *keep):
    documents = table(spark, sf_dir, "documents").withColumn("source", source_name())
    return score_texts(documents, table(spark, sf_dir, "review_labels"), keep=keep).rows


@REGISTRY.query("p8_found")
def p8_found(spark, sf_dir):
    return _scored(spark, sf_dir).where("abusive").select("doc_id")


@REGISTRY.query("p8_scores")
def p8_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", F.round("score", 6).alias("score"), "abusive")


@REGISTRY.query("p8_rates")
def p8_rates(spark, sf_dir):
    """Documents, cases and rate of every source, documents without a source included."""
    return (
        _scored(spark, sf_dir, "source")
        .groupBy("source")
        .agg(
            F.count(F.lit(1)).alias("documents"),
            F.count_if("abusive").alias("cases"),
            F.round(F.avg(F.col("abusive").cast("double")), 6).alias("rate"),
            F.round(F.avg("score"), 6).alias("mean_score"),
        )
    )


def _mixture(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", source_name().alias("source"), "text")
    weights = table(spark, sf_dir, "source_weights").withColumn("source", source_name())
    return mix(documents, weights)


@REGISTRY.query("p7_mixture")
def p7_mixture(spark, sf_dir):
    """How often each document occurs in the mixture (documents that don't are left out)."""
    return _mixture(spark, sf_dir).copies.where("copies > 0").select(
        "doc_id", "source", "tokens", F.round("rate", 6).alias("rate"), "copies"
    )


@REGISTRY.query("p7_shares")
def p7_shares(spark, sf_dir):
    return _mixture(spark, sf_dir).shares
