"""Bucket keys and candidates, nearest neighbours with the ratio test, spatial association, vectors and cameras."""

from __future__ import annotations

from pyspark.sql import functions as F

from parallaxa.catalog.relational import feature_sets, match_results
from parallaxa.catalog.statistics import _VALID, valid_matches
from parallaxa.functions.bits import words
from parallaxa.functions.geometry import parallax, project, quaternion_of_rotation, rotation_of_quaternion, undistort
from parallaxa.functions.vectors import all_finite, canonical_matrix, root_normalised
from parallaxa.operators.grid import greedy_association, near_points
from parallaxa.operators.lsh import best_candidates, evidence, postings
from parallaxa.operators.matching import descriptor_blocks, ratio_test, two_nearest
from parallaxa.plans.lineage import cut
from parallaxa.plans.registry import Registry
from parallaxa.plans.tables import table

REGISTRY = Registry()

_BINARY = """(SELECT DISTINCT feature_set_id, feature_index, descriptor_u8 AS u FROM descriptors
  WHERE descriptor_type = 1 AND descriptor_dimension = 32 AND octet_length(descriptor_u8) = 32)"""
_FLOAT = """(SELECT DISTINCT feature_set_id, feature_index, descriptor_dimension AS d, descriptor_f32 AS f FROM descriptors
  WHERE descriptor_type = 2 AND len(descriptor_f32) = descriptor_dimension
  AND len(list_filter(descriptor_f32, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""
_KEYS = f"""(SELECT feature_set_id, feature_index, t::INT AS table_no, list_sum(list_transform(range(24), lambda b:
    get_bit(u::BIT, (((t * 41 + b * 11) & 255) // 8 * 8 + 7 - ((t * 41 + b * 11) & 7))::INT)::BIGINT << b))::BIGINT AS bucket_key
  FROM {_BINARY}, range(6) r(t))"""


def binary_descriptors(spark, sf_dir):
    """Valid binary descriptors, each once, as four BIGINT words."""
    rows = table(spark, sf_dir, "descriptors").where("descriptor_type = 1 and descriptor_dimension = 32 and octet_length(descriptor_u8) = 32")
    return rows.select("feature_set_id", "feature_index", "descriptor_u8").distinct().select("feature_set_id", "feature_index", words(F.col("descriptor_u8")).alias("w"))


def float_descriptors(spark, sf_dir):
    rows = table(spark, sf_dir, "descriptors").where("descriptor_type = 2 and size(descriptor_f32) = descriptor_dimension")
    return rows.where(all_finite(F.col("descriptor_f32"))).select("feature_set_id", "feature_index", F.col("descriptor_dimension").alias("d"), F.col("descriptor_f32").alias("f")).distinct()


@REGISTRY.query("f01_bucket_keys", f"SELECT * FROM {_KEYS}")
def f01(spark, sf_dir):
    return postings(binary_descriptors(spark, sf_dir), ["feature_set_id", "feature_index"], "w")


@REGISTRY.query(
    "j11_lsh_candidates",
    f"""WITH p AS (SELECT k.*, f.extractor_kind, f.extractor_version FROM {_KEYS} k
  JOIN (SELECT DISTINCT feature_set_id, extractor_kind, extractor_version FROM feature_sets) f USING (feature_set_id)),
s AS (SELECT extractor_kind, extractor_version, max(max_bucket_postings) AS most, max(top_k) AS k FROM visual_index_tasks GROUP BY 1, 2),
b AS (SELECT extractor_kind, extractor_version, table_no, bucket_key FROM p JOIN s USING (extractor_kind, extractor_version) GROUP BY ALL HAVING count(*) <= max(s.most)),
u AS (SELECT p.* FROM p JOIN b USING (extractor_kind, extractor_version, table_no, bucket_key)),
e AS (SELECT a.extractor_kind, a.extractor_version, a.feature_set_id AS query, c.feature_set_id AS candidate, count(DISTINCT a.feature_index) AS evidence
  FROM u a JOIN u c USING (extractor_kind, extractor_version, table_no, bucket_key) WHERE a.feature_set_id <> c.feature_set_id GROUP BY ALL),
n AS (SELECT feature_set_id AS query, count(DISTINCT feature_index) AS features FROM {_BINARY} GROUP BY 1),
r AS (SELECT e.*, round(e.evidence / n.features, 9) AS score, i.image_id, row_number() OVER (PARTITION BY e.extractor_kind, e.extractor_version, e.query
    ORDER BY round(e.evidence / n.features, 9) DESC, e.evidence DESC, i.image_id, e.candidate) AS place
  FROM e JOIN n USING (query) JOIN (SELECT DISTINCT feature_set_id AS candidate, image_id FROM feature_sets) i USING (candidate))
SELECT query, candidate, evidence, score, place FROM r JOIN s USING (extractor_kind, extractor_version) WHERE place <= s.k""",
)
def j11(spark, sf_dir):
    """The best candidate sets of every query set by shared buckets, within one extractor identity. Bucket keys are
    computed once and written; the bound of the buckets and the number of candidates are the index settings'."""
    kind = ["extractor_kind", "extractor_version"]
    sets = feature_sets(spark, sf_dir, "feature_set_id", "image_id", *kind)
    keyed = postings(binary_descriptors(spark, sf_dir), ["feature_set_id", "feature_index"], "w").join(sets.drop("image_id").distinct(), "feature_set_id")
    index = cut(keyed, "postings")
    settings = table(spark, sf_dir, "visual_index_tasks").groupBy(*kind).agg(F.max("max_bucket_postings").alias("most"), F.max("top_k").alias("k"))
    found = evidence(index.df, kind, "feature_set_id", "feature_index", settings.select(*kind, "most"))
    size = index.df.where("table_no = 0").select("feature_set_id", "feature_index").distinct().groupBy(F.col("feature_set_id").alias("query")).agg(F.count(F.lit(1)).alias("features"))
    images = sets.select(F.col("feature_set_id").alias("candidate"), "image_id").distinct()
    scored = found.join(size, "query").join(images, "candidate").withColumn("score", F.round(F.col("evidence") / F.col("features"), 9))
    best = best_candidates(scored.join(settings.drop("most"), kind), kind, F.col("k"))
    return best.select("query", "candidate", "evidence", "score", F.col("place").cast("bigint").alias("place"))


_PAIRS = """(SELECT DISTINCT match_result_id AS pair_id, feature_set_id_a AS a, feature_set_id_b AS b FROM match_results
  WHERE feature_set_id_a IS NOT NULL AND feature_set_id_b IS NOT NULL AND feature_set_id_a <> feature_set_id_b)"""


def _set_pairs(spark, sf_dir):
    rows = match_results(spark, sf_dir, "match_result_id", "feature_set_id_a", "feature_set_id_b")
    return rows.dropna().where("feature_set_id_a <> feature_set_id_b").select(
        F.col("match_result_id").alias("pair_id"), F.col("feature_set_id_a").alias("a"), F.col("feature_set_id_b").alias("b")
    )


def _ratio_sql(rows: str, same: str, distance: str, ratio: float) -> str:
    return f"""WITH c AS (SELECT p.pair_id, x.feature_index AS query_index, y.feature_index AS train_index, {distance} AS distance
  FROM {_PAIRS} p JOIN {rows} x ON x.feature_set_id = p.a JOIN {rows} y ON y.feature_set_id = p.b {same}),
r AS (SELECT *, row_number() OVER w AS place, lead(distance) OVER w AS d2 FROM c WINDOW w AS (PARTITION BY pair_id, query_index ORDER BY distance, train_index))
SELECT pair_id, query_index, train_index, round(distance, 6)::DOUBLE AS d1, d2 IS NULL OR (d2 <> 0 AND distance::FLOAT < {ratio}::FLOAT * d2::FLOAT) AS accepted
FROM r WHERE place = 1"""


def _ratio_matches(spark, sf_dir, descriptors, kind, payload, ratio):
    blocks = descriptor_blocks(descriptors, "feature_set_id", "feature_index", kind, payload)
    best = two_nearest(_set_pairs(spark, sf_dir), blocks)
    return best.select("pair_id", "query_index", "train_index", F.round("d1", 6).alias("d1"), ratio_test(F.col("d1"), F.col("d2"), ratio).alias("accepted"))


@REGISTRY.query("j09_binary_ratio_matches", _ratio_sql(_BINARY, "", "bit_count(xor(x.u::BIT, y.u::BIT))::DOUBLE", 0.75))
def j09_binary(spark, sf_dir):
    rows = table(spark, sf_dir, "descriptors").where("descriptor_type = 1 and descriptor_dimension = 32 and octet_length(descriptor_u8) = 32")
    rows = rows.select("feature_set_id", "feature_index", "descriptor_dimension", "descriptor_u8").distinct()
    return _ratio_matches(spark, sf_dir, rows, "descriptor_dimension", "descriptor_u8", 0.75)


@REGISTRY.query("j09_float_ratio_matches", _ratio_sql(_FLOAT, "AND y.d = x.d", "list_distance(x.f::DOUBLE[], y.f::DOUBLE[])", 0.7))
def j09_float(spark, sf_dir):
    return _ratio_matches(spark, sf_dir, float_descriptors(spark, sf_dir), "d", "f", 0.7)


@REGISTRY.query(
    "f04_root_normalised",
    f"""SELECT feature_set_id, feature_index, round(list_aggregate(list_transform(f, lambda x: sqrt(x::DOUBLE / list_sum(f::DOUBLE[]))), 'max'), 6) AS largest,
  round(sqrt(f[1]::DOUBLE / list_sum(f::DOUBLE[])), 6) AS first FROM {_FLOAT} WHERE list_sum(f::DOUBLE[]) > 0""",
)
def f04(spark, sf_dir):
    r = root_normalised(F.col("f"))
    rows = float_descriptors(spark, sf_dir).withColumn("r", r)
    return rows.where(F.aggregate("f", F.lit(0.0), lambda s, x: s + x) > 0).select(
        "feature_set_id", "feature_index", F.round(F.array_max("r"), 6).alias("largest"), F.round(F.col("r")[0], 6).alias("first")
    )


@REGISTRY.query(
    "f08_canonical_matrix",
    f"""WITH m AS (SELECT feature_set_id, feature_index, list_transform(f[1:9], lambda x: x::DOUBLE - 100) AS m FROM {_FLOAT}),
n AS (SELECT *, sqrt(list_sum(list_transform(m, lambda x: x * x))) AS norm, list_max(list_transform(m, lambda x: abs(x))) AS top FROM m),
s AS (SELECT *, CASE WHEN list_filter(m, lambda x: abs(x) = top)[1] < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sign FROM n)
SELECT feature_set_id, feature_index, round(m[1] * sign / norm, 6) + 0.0 AS m00, round(m[5] * sign / norm, 6) + 0.0 AS m11, round(m[9] * sign / norm, 6) + 0.0 AS m22 FROM s WHERE norm > 0""",
)
def f08(spark, sf_dir):
    """The first nine elements, less 100, as a 3 x 3 matrix of unit norm and canonical sign."""
    m = F.transform(F.slice("f", 1, 9), lambda x: x.cast("double") - 100)
    rows = float_descriptors(spark, sf_dir).withColumn("m", canonical_matrix(m)).where("m is not null")
    return rows.select("feature_set_id", "feature_index", *[(F.round(F.col("m")[i], 6) + F.lit(0.0)).alias(n) for i, n in ((0, "m00"), (4, "m11"), (8, "m22"))])


_SIDE = """(SELECT match_result_id, entry_index, feature_index_{s} % 64 AS x, feature_index_{s} // 64 % 64 AS y FROM {v})"""
_NEAR = f"""near AS (SELECT a.match_result_id, a.entry_index AS a_index, b.entry_index AS b_index, ((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))::DOUBLE AS d2
FROM {_SIDE.format(s="a", v=_VALID)} a JOIN {_SIDE.format(s="b", v=_VALID)} b ON a.match_result_id = b.match_result_id
WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 64 GROUP BY ALL)"""


def _near(spark, sf_dir):
    """Points of side a and of side b of each result that are within 8 of each other; an index is a place on a raster of
    64 columns."""
    rows = valid_matches(spark, sf_dir)
    side = lambda s: rows.select(
        "match_result_id", F.col("entry_index").alias("index"), (F.col(f"feature_index_{s}") % 64).alias("x"), F.expr(f"feature_index_{s} div 64 % 64").alias("y")
    )
    return near_points(side("a"), side("b"), "match_result_id", 8.0).withColumn("d2", F.col("d2").cast("double")).distinct()


@REGISTRY.query("j12_near_points", f"WITH {_NEAR} SELECT * FROM near")
def j12(spark, sf_dir):
    return _near(spark, sf_dir)


@REGISTRY.query(
    "j12_greedy_association",
    f"""WITH RECURSIVE {_NEAR}, one AS (SELECT match_result_id AS r, a_index AS a, b_index AS b, min(d2) AS d FROM near GROUP BY ALL),
c AS (SELECT r, a, row_number() OVER (PARTITION BY r ORDER BY a) AS n, list(struct_pack(d := d, b := b) ORDER BY d, b) AS cs FROM one GROUP BY r, a),
g AS (SELECT DISTINCT r, 0::BIGINT AS n, []::BIGINT[] AS used, NULL::BIGINT AS a, NULL::STRUCT(d DOUBLE, b BIGINT) AS p FROM c
UNION ALL SELECT r, n, CASE WHEN x IS NULL THEN used ELSE list_append(used, x.b) END, a, x
  FROM (SELECT g.r, c.n, g.used, c.a, list_filter(c.cs, lambda y: NOT list_contains(g.used, y.b))[1] AS x FROM g JOIN c ON c.r = g.r AND c.n = g.n + 1))
SELECT r AS match_result_id, a AS a_index, p.b AS b_index, p.d AS d2 FROM g WHERE p IS NOT NULL""",
)
def j12_greedy(spark, sf_dir):
    """One-to-one partners within the radius, as points of side a would choose them in index order."""
    near = _near(spark, sf_dir).groupBy("match_result_id", "a_index", "b_index").agg(F.min("d2").alias("d2"))
    return greedy_association(near, "match_result_id")


_CAMERA = {"fx": 1200.0, "fy": 1190.0, "cx": 960.0, "cy": 540.0, "k1": -0.12, "k2": 0.03, "p1": 0.001, "p2": -0.0007}
_PROJECT = """WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS px, embedding[2]::DOUBLE AS py, embedding[3]::DOUBLE + 1 AS pz FROM embeddings),
n AS (SELECT vec_id, px / pz AS x, py / pz AS y, (px / pz) * (px / pz) + (py / pz) * (py / pz) AS r2 FROM e WHERE pz > 1e-9)"""


@REGISTRY.query(
    "f11_projection",
    _PROJECT
    + """SELECT vec_id, round(1200.0::DOUBLE * (x * (1 - 0.12::DOUBLE * r2 + 0.03::DOUBLE * r2 * r2) + 2 * 0.001::DOUBLE * x * y - 0.0007::DOUBLE * (r2 + 2 * x * x)) + 960, 4) AS u,
  round(1190.0::DOUBLE * (y * (1 - 0.12::DOUBLE * r2 + 0.03::DOUBLE * r2 * r2) + 0.001::DOUBLE * (r2 + 2 * y * y) - 2 * 0.0007::DOUBLE * x * y) + 540, 4) AS v, TRUE AS restored FROM n""",
)
def f11(spark, sf_dir):
    """Pixels of points through a distorting camera, and whether undoing the distortion gives the point back."""
    k = {n: F.lit(v) for n, v in _CAMERA.items()}
    e = table(spark, sf_dir, "embeddings").select(
        "vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(("px", "py"))], (F.col("embedding")[2].cast("double") + 1).alias("pz")
    )
    u, v = project([F.col("px"), F.col("py"), F.col("pz")], k)
    pix = e.select("vec_id", u.alias("u"), v.alias("v"), (F.col("px") / F.col("pz")).alias("x"), (F.col("py") / F.col("pz")).alias("y")).where("u is not null")
    x, y = undistort(F.col("u"), F.col("v"), k, rounds=25)
    back = (F.abs(x - F.col("x")) < 1e-6) & (F.abs(y - F.col("y")) < 1e-6)
    return pix.select("vec_id", F.round("u", 4).alias("u"), F.round("v", 4).alias("v"), back.alias("restored"))


@REGISTRY.query(
    "f12_quaternions",
    """WITH q AS (SELECT vec_id, embedding[1]::DOUBLE AS w, embedding[2]::DOUBLE AS x, embedding[3]::DOUBLE AS y, embedding[4]::DOUBLE AS z,
  sqrt(embedding[1]::DOUBLE ** 2 + embedding[2]::DOUBLE ** 2 + embedding[3]::DOUBLE ** 2 + embedding[4]::DOUBLE ** 2) AS n FROM embeddings)
SELECT vec_id, round(w / n * s, 5) + 0.0 AS w, round(x / n * s, 5) + 0.0 AS x, round(y / n * s, 5) + 0.0 AS y, round(z / n * s, 5) + 0.0 AS z
FROM (SELECT *, CASE WHEN w < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS s FROM q)""",
)
def f12(spark, sf_dir):
    """Quaternion to rotation and back, with the canonical sign."""
    q = [F.col("embedding")[i].cast("double") for i in range(4)]
    n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    e = table(spark, sf_dir, "embeddings").select("vec_id", *[(c / n).alias(f"q{i}") for i, c in enumerate(q)])
    rotated = e.select("vec_id", *[c.alias(f"r{i}") for i, c in enumerate(rotation_of_quaternion(*[F.col(f"q{i}") for i in range(4)]))])
    back = rotated.select("vec_id", quaternion_of_rotation([F.col(f"r{i}") for i in range(9)]).alias("q"))
    return back.select("vec_id", *[(F.round(F.col("q")[c], 5) + F.lit(0.0)).alias(c) for c in "wxyz"])


@REGISTRY.query(
    "f14_parallax",
    """SELECT a.vec_id AS a, b.vec_id AS b, round(acos(list_cosine_similarity(a.embedding[1:3]::DOUBLE[], b.embedding[1:3]::DOUBLE[])), 5) AS angle
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def f14(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"v{i}") for i in range(3)])
    a = e.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), *[F.col(f"v{i}").alias(f"a{i}") for i in range(3)])
    b = e.select(F.col("vec_id").alias("b"), *[F.col(f"v{i}").alias(f"b{i}") for i in range(3)])
    angle = parallax([F.col(f"a{i}") for i in range(3)], [F.col(f"b{i}") for i in range(3)])
    return a.join(b, "b").select("a", "b", F.round(angle, 5).alias("angle"))

