"""Payload files and geometric kernels over derived data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from parallaxa.catalog.relational import match_results
from parallaxa.catalog.statistics import _VALID, valid_matches
from parallaxa.functions.vectors import all_finite
from parallaxa.operators.geometry import estimable, triangulate
from parallaxa.operators.prefix import positions
from parallaxa.plans.lineage import Folder, cut
from parallaxa.plans.registry import Registry
from parallaxa.plans.tables import table
from parallaxa.sources.binary import decode_matches, decode_scopes, encode_matches, encode_scopes
from parallaxa.sources.features import decode_features, encode_features
from parallaxa.sources.text import manifest_problems, new_imports, read_manifest, write_manifest

REGISTRY = Registry()


@REGISTRY.query(
    "s11_match_files",
    f"""SELECT m.match_result_id, r.feature_set_id_a AS a, r.feature_set_id_b AS b, row_number() OVER (PARTITION BY m.match_result_id ORDER BY m.entry_index) - 1 AS entry_index,
  m.feature_index_a AS ia, m.feature_index_b AS ib, round(m.distance::DOUBLE, 4) AS distance
FROM {_VALID} m JOIN (SELECT DISTINCT match_result_id, feature_set_id_a, feature_set_id_b FROM match_results WHERE result_status = 1 AND feature_set_id_a <> feature_set_id_b) r USING (match_result_id)
WHERE m.distance >= 0 AND m.feature_index_a BETWEEN 0 AND 8191 AND m.feature_index_b BETWEEN 0 AND 8191""",
)
def s11(spark, sf_dir):
    """Every result's entries as match files, decoded again; what no file can hold is in s11_match_file_problems."""
    back = _decoded(_match_rows(spark, sf_dir)).where("problem is null").drop("problem")
    return back.withColumn("distance", F.round(F.col("distance").cast("double"), 4))


_FITS = "distance >= 0 and ia between 0 and 8191 and ib between 0 and 8191"


def _match_rows(spark, sf_dir):
    results = match_results(spark, sf_dir, "match_result_id", "feature_set_id_a", "feature_set_id_b", "result_status").where("result_status = 1 and feature_set_id_a <> feature_set_id_b")
    return valid_matches(spark, sf_dir).join(results, "match_result_id").select(
        "match_result_id", F.col("feature_set_id_a").alias("a"), F.col("feature_set_id_b").alias("b"), F.lit(1).alias("kind"),
        "entry_index", F.col("feature_index_a").alias("ia"), F.col("feature_index_b").alias("ib"), "distance",
    )


def _decoded(rows):
    return decode_matches(encode_matches(rows.where(_FITS), "match_result_id"), "match_result_id")


@REGISTRY.query(
    "s11_match_file_problems",
    f"""SELECT m.match_result_id, 'ENTRY' AS problem, count(*) AS rows
FROM {_VALID} m JOIN (SELECT DISTINCT match_result_id, feature_set_id_a, feature_set_id_b FROM match_results WHERE result_status = 1 AND feature_set_id_a <> feature_set_id_b) r USING (match_result_id)
WHERE NOT (m.distance >= 0 AND m.feature_index_a BETWEEN 0 AND 8191 AND m.feature_index_b BETWEEN 0 AND 8191) GROUP BY 1""",
)
def s11_problems(spark, sf_dir):
    """Entries that the format has no room for, and files that don't decode, counted for each result."""
    rows = _match_rows(spark, sf_dir)
    refused = rows.where(f"not ({_FITS})").select("match_result_id", F.lit("ENTRY").alias("problem"))
    broken = _decoded(rows).where("problem is not null").select("match_result_id", "problem")
    return refused.unionByName(broken).groupBy("match_result_id", "problem").agg(F.count(F.lit(1)).alias("rows"))


@REGISTRY.query(
    "s16_manifest",
    """SELECT filename, size_bytes, source_path FROM (SELECT match_asset_path AS source_path, regexp_extract(match_asset_path, '[^/]+$') AS filename, match_asset_size_bytes AS size_bytes
FROM match_results WHERE match_asset_path IS NOT NULL) GROUP BY ALL""",
)
def s16(spark, sf_dir):
    """The manifest of the match assets, written and read back."""
    return read_manifest(spark, _manifest(spark, sf_dir))


def _assets(spark, sf_dir):
    rows = match_results(spark, sf_dir, "match_asset_path", "match_asset_size_bytes").where("match_asset_path is not null")
    name = F.element_at(F.split("match_asset_path", "/"), -1)
    return rows.select(name.alias("filename"), F.col("match_asset_size_bytes").alias("size_bytes"), F.col("match_asset_path").alias("source_path"))


def _manifest(spark, sf_dir):
    path = f"{Folder(spark, 'manifest').path}/rows"
    write_manifest(_assets(spark, sf_dir), path)
    return path


@REGISTRY.query(
    "s16_manifest_problems",
    """WITH m AS (SELECT DISTINCT regexp_extract(match_asset_path, '[^/]+$') AS filename, match_asset_size_bytes AS size, match_asset_path FROM match_results WHERE match_asset_path IS NOT NULL)
SELECT filename, 'DUPLICATE' AS problem, count(*) AS rows FROM m GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT filename, 'SIZE', count(*) FROM m WHERE size IS NULL OR size < 0 GROUP BY 1""",
)
def s16_problems(spark, sf_dir):
    return manifest_problems(_assets(spark, sf_dir))


@REGISTRY.query(
    "s15_new_imports",
    """WITH f AS (SELECT DISTINCT match_asset_path AS path, match_asset_size_bytes AS length, created_at FROM match_results WHERE match_asset_path IS NOT NULL),
n AS (SELECT regexp_extract(path, '[^/]+$') || '.jpg' AS filename, min(struct_pack(path := path || '.jpg', length := length)) AS x FROM f GROUP BY 1)
SELECT filename, x.length AS size_bytes, x.path AS source_path FROM n
WHERE filename NOT IN (SELECT regexp_extract(path, '[^/]+$') || '.jpg' FROM f WHERE created_at < TIMESTAMP '2024-03-01')""",
)
def s15(spark, sf_dir):
    """What an import adds to the manifest of the older assets; the assets stand for image files."""
    rows = match_results(spark, sf_dir, "match_asset_path", "match_asset_size_bytes", "created_at").where("match_asset_path is not null")
    files = rows.select(F.concat("match_asset_path", F.lit(".jpg")).alias("path"), F.col("match_asset_size_bytes").alias("length"), "created_at")
    old = files.where(F.col("created_at") < F.lit("2024-03-01").cast("timestamp_ntz"))
    return new_imports(files, old.select(F.element_at(F.split("path", "/"), -1).alias("filename")).distinct())


_LE8 = "concat(substr(h, 15, 2), substr(h, 13, 2), substr(h, 11, 2), substr(h, 9, 2), substr(h, 7, 2), substr(h, 5, 2), substr(h, 3, 2), substr(h, 1, 2))"


@REGISTRY.query(
    "s13_scope_files",
    f"""WITH i AS (SELECT DISTINCT scanset_id, feature_set_id AS id FROM feature_sets WHERE feature_set_id IS NOT NULL),
b AS (SELECT scanset_id, count(*) AS ids, string_agg({_LE8}, '' ORDER BY id) AS body FROM (SELECT *, printf('%016X', id) AS h FROM i) GROUP BY 1),
c AS (SELECT scanset_id, ids, body, printf('%016X', ids) AS h FROM b)
SELECT scanset_id, ids, sha256(unhex('4C33445453435031' || '01000000' || {_LE8} || body)) AS sha256, ids AS restored FROM c""",
)
def s13(spark, sf_dir):
    """The scope file of every scan set, byte by byte, and the ids that come back from it."""
    written = cut(encode_scopes(table(spark, sf_dir, "feature_sets"), "scanset_id", "feature_set_id"), "scopes").df
    back = decode_scopes(written, "scanset_id").where("problem is null").groupBy("scanset_id").agg(F.count_distinct("id").alias("restored"))
    return written.join(back, "scanset_id").select("scanset_id", "ids", "sha256", "restored")


@REGISTRY.query(
    "s08_feature_files",
    """SELECT feature_set_id, row_number() OVER (PARTITION BY feature_set_id ORDER BY feature_index, hex(u)) - 1 AS feature_index, hex(u) AS descriptor,
  (feature_index % 64)::FLOAT AS x, (feature_index % 48)::FLOAT AS y
FROM (SELECT DISTINCT feature_set_id, feature_index, descriptor_u8 AS u FROM descriptors WHERE descriptor_type = 1 AND octet_length(descriptor_u8) = 32 AND feature_index >= 0)""",
)
def s08(spark, sf_dir):
    """Binary descriptors of each set as a feature file, validated and decoded again; keypoints lie on a 64 x 48 raster."""
    rows = table(spark, sf_dir, "descriptors").where("descriptor_type = 1 and octet_length(descriptor_u8) = 32 and feature_index >= 0")
    rows = rows.select("feature_set_id", "feature_index", "descriptor_u8").distinct().withColumn("copy", F.hex("descriptor_u8"))
    numbered = positions(rows, ["feature_set_id"], ["feature_index", "copy"], "place")
    return _featured(numbered, F.hex("descriptor_u8"))


@REGISTRY.query(
    "s09_float_feature_files",
    """SELECT feature_set_id, row_number() OVER (PARTITION BY feature_set_id ORDER BY feature_index, f) - 1 AS feature_index, round(list_sum(f::DOUBLE[]), 3)::VARCHAR AS descriptor,
  (feature_index % 64)::FLOAT AS x, (feature_index % 48)::FLOAT AS y
FROM (SELECT DISTINCT feature_set_id, feature_index, descriptor_f32 AS f FROM descriptors WHERE descriptor_type = 2 AND len(descriptor_f32) = 128
  AND len(list_filter(descriptor_f32, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND feature_index >= 0)""",
)
def s09(spark, sf_dir):
    """The same for vectors of 128 elements, which are checked for being finite."""
    rows = table(spark, sf_dir, "descriptors").where("descriptor_type = 2 and size(descriptor_f32) = 128 and feature_index >= 0").where(all_finite(F.col("descriptor_f32")))
    rows = rows.select("feature_set_id", "feature_index", "descriptor_f32").distinct()
    numbered = positions(rows, ["feature_set_id"], ["feature_index", "descriptor_f32"], "place")
    total = F.aggregate("descriptor_f32", F.lit(0.0), lambda s, x: s + x)
    return _featured(numbered, F.round(total, 3).cast("string"))


def _featured(numbered, descriptor):
    one = lambda v, kind: F.lit(v).cast(kind)
    vectors = [c for c in ("descriptor_u8", "descriptor_f32") if c not in numbered.columns]
    for c in vectors:
        numbered = numbered.withColumn(c, F.lit(None).cast("binary" if c.endswith("u8") else "array<float>"))
    rows = numbered.select(
        "feature_set_id", F.lit("orb").alias("kind"), F.lit(1).alias("extractor_version"), F.unhex(F.lit("00" * 32)).alias("image"), F.unhex(F.lit("11" * 32)).alias("fingerprint"),
        F.lit(64).alias("width"), F.lit(48).alias("height"), F.col("place").alias("feature_index"), (F.col("feature_index") % 64).cast("float").alias("x"),
        (F.col("feature_index") % 48).cast("float").alias("y"), one(1, "float").alias("size"), one(0, "float").alias("angle"), one(1, "float").alias("response"),
        one(0, "int").alias("octave"), "descriptor_u8", "descriptor_f32",
    )
    back = decode_features(encode_features(rows, "feature_set_id"), "feature_set_id").where("problem is null")
    return back.select("feature_set_id", "feature_index", descriptor.alias("descriptor"), "x", "y")


@REGISTRY.query(
    "k05_estimable_pairs",
    f"""SELECT match_result_id, count(*) AS matches, count(DISTINCT feature_index_a) AS distinct_a, count(DISTINCT feature_index_b) AS distinct_b,
  count(DISTINCT feature_index_a) >= 7 AND count(DISTINCT feature_index_b) >= 7 AND count(*) >= 16 AS estimable FROM {_VALID} GROUP BY 1""",
)
def k05(spark, sf_dir):
    rows = valid_matches(spark, sf_dir).groupBy("match_result_id").agg(
        F.count(F.lit(1)).alias("matches"), F.count_distinct("feature_index_a").alias("distinct_a"), F.count_distinct("feature_index_b").alias("distinct_b")
    )
    return rows.withColumn("estimable", estimable(F.col("distinct_a"), F.col("distinct_b"), F.col("matches")))


@REGISTRY.query(
    "k07_triangulation",
    "SELECT vec_id, round(embedding[1]::DOUBLE, 5) + 0.0 AS x, round(embedding[2]::DOUBLE, 5) + 0.0 AS y, round(embedding[3]::DOUBLE + 2, 5) + 0.0 AS z, TRUE AS depth_ok FROM embeddings",
)
def k07(spark, sf_dir):
    """Points seen by two cameras a third apart, found again from their pixels."""
    p = [F.col("embedding")[i].cast("double") for i in range(3)]
    z = p[2] + 2
    views = table(spark, sf_dir, "embeddings").select(
        "vec_id", (p[0] / z).alias("u1"), (p[1] / z).alias("v1"), ((p[0] - 0.3) / z).alias("u2"), (p[1] / z).alias("v2")
    )
    p1 = np.hstack([np.eye(3), np.zeros((3, 1))])
    p2 = np.hstack([np.eye(3), np.array([[-0.3], [0.0], [0.0]])])
    found = triangulate(views, p1, p2, "vec_id")
    return found.select("vec_id", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("x", "y", "z")], "depth_ok")
