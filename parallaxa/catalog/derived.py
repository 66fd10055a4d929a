"""Rule tables, evidence, anchors, canonical orders, cross checks and further aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from parallaxa.catalog.relational import feature_sets, match_results
from parallaxa.catalog.statistics import _VALID, valid_matches
from parallaxa.catalog.tracks import _TRACKS, track_members
from parallaxa.functions.classify import graded, pair_evidence, seed_of
from parallaxa.functions.text import human_size, pressure_basis_points, same_stem
from parallaxa.operators.components import components
from parallaxa.operators.merge import advance
from parallaxa.operators.prefix import positions, prefix_scan
from parallaxa.operators.progress import remaining_seconds
from parallaxa.operators.scans import first_delivery, keyset_page, latest_by
from parallaxa.plans.registry import Registry
from parallaxa.plans.tables import table

REGISTRY = Registry()


@REGISTRY.query(
    "s10_range_reader",
    """SELECT DISTINCT feature_set_id, feature_index, descriptor_type, octet_length(descriptor_u8)::INT AS bytes FROM descriptors
WHERE descriptor_type = 1 AND descriptor_u8 IS NOT NULL AND feature_index >= 10 ORDER BY feature_set_id, feature_index, bytes LIMIT 256""",
)
def s10(spark, sf_dir):
    rows = table(spark, sf_dir, "descriptors").where("descriptor_type = 1 and descriptor_u8 is not null and feature_index >= 10")
    rows = rows.select("feature_set_id", "feature_index", "descriptor_type", F.octet_length("descriptor_u8").alias("bytes")).distinct()
    return keyset_page(rows, ["feature_set_id", "feature_index", "bytes"], None, 256)


@REGISTRY.query(
    "s12_bucket_ranges",
    """SELECT visual_index_id, table_no, bucket_key >> 28 AS slice, count(*) AS postings, min(bucket_key) AS first_key, max(bucket_key) AS last_key
FROM (SELECT DISTINCT * FROM visual_index_postings WHERE bucket_key IS NOT NULL) GROUP BY ALL""",
)
def s12(spark, sf_dir):
    """Slices of the sorted index: what a segment's key range holds."""
    rows = table(spark, sf_dir, "visual_index_postings").where("bucket_key is not null").distinct()
    return rows.groupBy("visual_index_id", "table_no", F.shiftright("bucket_key", 28).alias("slice")).agg(
        F.count(F.lit(1)).alias("postings"), F.min("bucket_key").alias("first_key"), F.max("bucket_key").alias("last_key")
    )


@REGISTRY.query(
    "s18_typed_fields",
    """SELECT doc_id, regexp_extract(text, '([A-Z]{2}[0-9]{3,})', 1) AS serial, coalesce(nullif(regexp_extract(text, '([0-9]{1,6}) (cm|grams|euros)', 1), '')::INT, -1) AS quantity,
  regexp_extract(text, '([0-9]{1,6}) (cm|grams|euros)', 2) AS unit FROM documents WHERE text IS NOT NULL""",
)
def s18(spark, sf_dir):
    """Typed, nullable fields scanned from content."""
    quantity = F.regexp_extract("text", "([0-9]{1,6}) (cm|grams|euros)", 1)
    return table(spark, sf_dir, "documents").where("text is not null").select(
        "doc_id",
        F.regexp_extract("text", "([A-Z]{2}[0-9]{3,})", 1).alias("serial"),
        F.when(quantity == "", -1).otherwise(F.expr("try_cast(regexp_extract(text, '([0-9]{1,6}) (cm|grams|euros)', 1) as int)")).alias("quantity"),
        F.regexp_extract("text", "([0-9]{1,6}) (cm|grams|euros)", 2).alias("unit"),
    )


@REGISTRY.query(
    "pred06_equal_state",
    """SELECT lower(hex(scientific_identity)) AS identity, lower(hex(parameter_fingerprint)) AS fingerprint, count(DISTINCT reconstruction_id) AS reconstructions, min(reconstruction_id) AS reused
FROM incremental_reconstructions GROUP BY scientific_identity, parameter_fingerprint, extension_track_set_id, calibration_scope_id, incremental_kind, incremental_version""",
)
def p06(spark, sf_dir):
    """Rows whose whole state is equal, nulls being equal to nulls: the first would be reused."""
    state = ["scientific_identity", "parameter_fingerprint", "extension_track_set_id", "calibration_scope_id", "incremental_kind", "incremental_version"]
    return (
        table(spark, sf_dir, "incremental_reconstructions")
        .groupBy(*state)
        .agg(F.count_distinct("reconstruction_id").alias("reconstructions"), F.min("reconstruction_id").alias("reused"))
        .select(F.lower(F.hex("scientific_identity")).alias("identity"), F.lower(F.hex("parameter_fingerprint")).alias("fingerprint"), "reconstructions", "reused")
    )


@REGISTRY.query(
    "pred08_graded_quality",
    """WITH s AS (SELECT DISTINCT feature_set_id, coverage_ratio AS c, feature_density_per_megapixel AS d, feature_count AS n FROM feature_sets),
g AS (SELECT feature_set_id, CASE WHEN c < 0.55 THEN 'COVERAGE_VERY_LOW' WHEN c < 0.65 THEN 'COVERAGE_LOW' END AS r1,
  CASE WHEN d < 150 THEN 'DENSITY_VERY_LOW' WHEN d < 250 THEN 'DENSITY_LOW' END AS r2, CASE WHEN n < 100 THEN 'FEW_FEATURES' WHEN n < 1000 THEN 'FEATURES_LOW' END AS r3,
  c < 0.55 OR d < 150 OR n < 100 AS severe FROM s)
SELECT feature_set_id, CASE WHEN coalesce(severe, FALSE) THEN 3 WHEN coalesce(r1, r2, r3) IS NOT NULL THEN 2 ELSE 1 END AS grade,
  CASE WHEN concat_ws(';', r1, r2, r3) = '' THEN 'OK' ELSE concat_ws(';', r1, r2, r3) END AS reasons FROM g""",
)
def p08(spark, sf_dir):
    sets = feature_sets(spark, sf_dir, "feature_set_id", "coverage_ratio", "feature_density_per_megapixel", "feature_count")
    c, d, n = F.col("coverage_ratio"), F.col("feature_density_per_megapixel"), F.col("feature_count")
    grade, reasons = graded(
        [("COVERAGE_VERY_LOW", c < 0.55, "COVERAGE_LOW", c < 0.65), ("DENSITY_VERY_LOW", d < 150, "DENSITY_LOW", d < 250), ("FEW_FEATURES", n < 100, "FEATURES_LOW", n < 1000)]
    )
    return sets.select("feature_set_id", grade.alias("grade"), reasons.alias("reasons"))


@REGISTRY.query(
    "f07_seeds",
    """SELECT DISTINCT feature_set_id, (get_byte0 + 256 * get_byte1 + 65536 * get_byte2 + 16777216 * (get_byte3 % 128))::BIGINT AS seed FROM (
SELECT feature_set_id, ('0x' || substr(h, 1, 2))::BIGINT AS get_byte0, ('0x' || substr(h, 3, 2))::BIGINT AS get_byte1, ('0x' || substr(h, 5, 2))::BIGINT AS get_byte2, ('0x' || substr(h, 7, 2))::BIGINT AS get_byte3
FROM (SELECT feature_set_id, hex(parameter_fingerprint) AS h FROM feature_sets))""",
)
def f07(spark, sf_dir):
    return table(spark, sf_dir, "feature_sets").select("feature_set_id", seed_of(F.col("parameter_fingerprint")).alias("seed")).distinct()


@REGISTRY.query(
    "f09_pair_evidence",
    """WITH d AS (SELECT doc_id, item_id, reviewer_id, rating, lang, source, sha256(text) AS content FROM documents),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, coalesce((a.content = b.content)::INT, 0) + 2 * coalesce((a.item_id = b.item_id)::INT, 0) + 4 * coalesce((a.rating = b.rating)::INT, 0)
    + 8 * coalesce((a.lang = b.lang)::INT, 0) + 16 * coalesce((a.source = b.source)::INT, 0) AS evidence,
  coalesce((a.content <> b.content)::INT, 0) + 2 * coalesce((a.item_id <> b.item_id)::INT, 0) AS contradictions, coalesce(a.content = b.content, FALSE) AS strong
  FROM d a JOIN d b ON a.reviewer_id = b.reviewer_id AND a.item_id = b.item_id AND a.doc_id < b.doc_id)
SELECT a, b, evidence, contradictions, CASE WHEN contradictions > 0 THEN 3 WHEN strong THEN 2 WHEN evidence > 0 THEN 1 ELSE 0 END AS decision,
  CASE WHEN contradictions > 0 THEN 0 WHEN strong THEN 100 WHEN evidence > 0 THEN bit_count(evidence) ELSE 0 END::INT AS strength FROM p""",
)
def f09(spark, sf_dir):
    """Evidence that two reviews of one reviewer and item are the same: equal fields, contradictions, decision."""
    d = table(spark, sf_dir, "documents").select("doc_id", "item_id", "reviewer_id", "rating", "lang", "source", F.sha2("text", 256).alias("content"))
    a = d.select(*[F.col(c).alias(f"l_{c}") for c in d.columns])
    b = d.select(*[F.col(c).alias(f"r_{c}") for c in d.columns])
    pairs = a.join(b, (F.col("l_reviewer_id") == F.col("r_reviewer_id")) & (F.col("l_item_id") == F.col("r_item_id"))).where("l_doc_id < r_doc_id")
    found = pair_evidence({"content": 0, "item_id": 1, "rating": 2, "lang": 3, "source": 4}, ["content", "item_id"], "content")
    return pairs.select(F.col("l_doc_id").alias("a"), F.col("r_doc_id").alias("b"), found.alias("f")).select("a", "b", "f.*")


@REGISTRY.query(
    "f17_elapsed",
    """SELECT match_result_id, min(epoch_us(ingested_at) - epoch_us(created_at)) // 1000000 AS seconds, count(*) AS deliveries FROM match_results GROUP BY 1""",
)
def f17(spark, sf_dir):
    gap = F.unix_micros(F.col("ingested_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))
    rows = table(spark, sf_dir, "match_results").select("match_result_id", gap.alias("gap"))
    return rows.groupBy("match_result_id").agg(F.min("gap").alias("gap"), F.count(F.lit(1)).alias("deliveries")).select("match_result_id", F.expr("gap div 1000000").alias("seconds"), "deliveries")


@REGISTRY.query(
    "f18_asset_sizes",
    """SELECT CASE WHEN b < 1024 THEN b || ' B' WHEN b < 1048576 THEN printf('%.1f KiB', b / 1024.0) ELSE printf('%.1f MiB', b / 1048576.0) END AS size, count(*) AS assets
FROM (SELECT DISTINCT match_asset_path, match_asset_size_bytes AS b FROM match_results WHERE match_asset_size_bytes IS NOT NULL) GROUP BY 1""",
)
def f18(spark, sf_dir):
    rows = match_results(spark, sf_dir, "match_asset_path", "match_asset_size_bytes").where("match_asset_size_bytes is not null")
    return rows.groupBy(human_size(F.col("match_asset_size_bytes")).alias("size")).agg(F.count(F.lit(1)).alias("assets"))


@REGISTRY.query(
    "f20_pressure_lines",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN -1 ELSE round(least(value, 999) * 100)::INT END AS basis_points FROM events""",
)
def f20(spark, sf_dir):
    """Pressure lines written from samples and parsed again; a repeated token makes a line invalid."""
    token = F.concat(F.lit("avg10="), F.format_string("%.2f", F.least(F.col("value"), F.lit(999.0))))
    line = F.concat(F.lit("some "), token, F.when(F.col("event_type") == "error", F.concat(F.lit(" "), token)).otherwise(F.lit(" avg60=0.00")))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(pressure_basis_points(line), F.lit(-1)).alias("basis_points"))


@REGISTRY.query(
    "a15_probe_maxima",
    """SELECT label, round(max(abs(embedding[1]::DOUBLE)), 6) AS center, round(max(greatest(abs(embedding[2]::DOUBLE), abs(embedding[3]::DOUBLE), abs(embedding[4]::DOUBLE), abs(embedding[5]::DOUBLE))), 6) AS edge,
  round(max(greatest(abs(embedding[6]::DOUBLE), abs(embedding[7]::DOUBLE), abs(embedding[8]::DOUBLE), abs(embedding[9]::DOUBLE))), 6) AS corner FROM embeddings GROUP BY 1""",
)
def a15(spark, sf_dir):
    """Largest deviation at nine probes: centre, edges, corners."""
    probes = table(spark, sf_dir, "embeddings").select("label", F.posexplode(F.slice("embedding", 1, 9)).alias("i", "v"))
    size = F.abs(F.col("v").cast("double"))
    worst = lambda lo, hi: F.round(F.max(F.when(F.col("i").between(lo, hi), size)), 6)
    return probes.groupBy("label").agg(worst(0, 0).alias("center"), worst(1, 4).alias("edge"), worst(5, 8).alias("corner"))


@REGISTRY.query(
    "a18_view_residuals",
    f"""SELECT r.feature_set_id_a AS view, count(*) AS residuals, round(sqrt(avg(m.distance::DOUBLE * m.distance)), 5) AS rmse, round(max(m.distance::DOUBLE), 5) AS worst, count(CASE WHEN m.distance > 150 THEN 1 END) AS high
FROM {_VALID} m JOIN (SELECT DISTINCT match_result_id, feature_set_id_a FROM match_results WHERE feature_set_id_a IS NOT NULL) r USING (match_result_id) GROUP BY 1""",
)
def a18(spark, sf_dir):
    sides = match_results(spark, sf_dir, "match_result_id", "feature_set_id_a").where("feature_set_id_a is not null")
    d = F.col("distance").cast("double")
    return valid_matches(spark, sf_dir).join(sides, "match_result_id").groupBy(F.col("feature_set_id_a").alias("view")).agg(
        F.count(F.lit(1)).alias("residuals"), F.round(F.sqrt(F.avg(d * d)), 5).alias("rmse"), F.round(F.max(d), 5).alias("worst"), F.count_if(F.col("distance") > 150).alias("high")
    )


@REGISTRY.query(
    "a21_mean_rates",
    """SELECT event_id, (sum(v) OVER w // count(*) OVER w)::BIGINT AS mean_rate FROM (SELECT *, floor(value * 100)::BIGINT AS v FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""",
)
def a21(spark, sf_dir):
    """Whole mean of at most eight rates; the sum is a decimal and can't overflow."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-7, 0)
    v = F.floor(F.col("value") * 100).cast("decimal(38,0)")
    return table(spark, sf_dir, "events").select("event_id", F.floor(F.sum(v).over(w) / F.count(F.lit(1)).over(w)).cast("bigint").alias("mean_rate"))


@REGISTRY.query(
    "a24_remaining_capacity",
    """SELECT t.visual_index_id, max(t.max_features_per_set) * 200 - count(DISTINCT p.feature_set_id) AS remaining FROM visual_index_tasks t
LEFT JOIN visual_index_postings p ON p.visual_index_id = t.visual_index_id GROUP BY 1""",
)
def a24(spark, sf_dir):
    capacity = table(spark, sf_dir, "visual_index_tasks").groupBy("visual_index_id").agg((F.max("max_features_per_set") * 200).alias("capacity"))
    used = table(spark, sf_dir, "visual_index_postings").groupBy("visual_index_id").agg(F.count_distinct("feature_set_id").alias("used"))
    return capacity.join(used, "visual_index_id", "left").select("visual_index_id", (F.col("capacity") - F.coalesce("used", F.lit(0))).alias("remaining"))


@REGISTRY.query(
    "w10_anchors",
    """WITH a AS (SELECT label, min(vec_id) AS pose_anchor FROM embeddings GROUP BY 1),
d AS (SELECT e.label, e.vec_id, a.pose_anchor, round(list_distance(e.embedding[1:3]::DOUBLE[], x.embedding[1:3]::DOUBLE[]), 6) AS far,
  [abs(e.embedding[1]::DOUBLE - x.embedding[1]), abs(e.embedding[2]::DOUBLE - x.embedding[2]), abs(e.embedding[3]::DOUBLE - x.embedding[3])] AS delta
  FROM embeddings e JOIN a ON a.label = e.label JOIN embeddings x ON x.vec_id = a.pose_anchor),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY far DESC, vec_id) AS n FROM d)
SELECT label, pose_anchor, vec_id AS scale_anchor, far, list_position(delta, list_max(delta))::INT AS axis FROM r WHERE n = 1""",
)
def w10(spark, sf_dir):
    """The smallest id of a group, the member farthest from it (ties: smaller id), and the first axis on which they
    differ most."""
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", *[F.col("embedding")[i].cast("double").alias(f"c{i}") for i in range(3)])
    first = e.groupBy("label").agg(F.min_by(F.struct(*[f"c{i}" for i in range(3)]), "vec_id").alias("a"), F.min("vec_id").alias("pose_anchor"))
    delta = [F.abs(F.col(f"c{i}") - F.col(f"a.c{i}")) for i in range(3)]
    far = F.round(F.sqrt(delta[0] * delta[0] + delta[1] * delta[1] + delta[2] * delta[2]), 6)
    axis = F.array_position(F.array(*delta), F.greatest(*delta)).cast("int")
    d = e.join(first, "label").select("label", "pose_anchor", "vec_id", far.alias("far"), axis.alias("axis"))
    best = d.groupBy("label", "pose_anchor").agg(F.max_by(F.struct("vec_id", "far", "axis"), F.struct("far", (-F.col("vec_id")).alias("n"))).alias("b"))
    return best.select("label", "pose_anchor", F.col("b.vec_id").alias("scale_anchor"), F.col("b.far").alias("far"), F.col("b.axis").alias("axis"))


@REGISTRY.query(
    "w11_newest_first",
    """SELECT event_id, user_id, event_type FROM events ORDER BY CASE WHEN event_type = 'error' THEN 0 ELSE 1 END, ts DESC, event_id DESC LIMIT 64""",
)
def w11(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return rows.orderBy(F.when(F.col("event_type") == "error", 0).otherwise(1), F.desc("ts"), F.desc("event_id")).limit(64).drop("ts")


@REGISTRY.query(
    "t03_canonical_entries",
    f"""SELECT match_result_id, entry_index, row_number() OVER (PARTITION BY match_result_id ORDER BY feature_index_a, distance, feature_index_b, entry_index) AS place,
  count(*) OVER (PARTITION BY match_result_id, feature_index_a) = 1 AS unique_query FROM {_VALID}""",
)
def t03(spark, sf_dir):
    """Entries of a result in query, distance, train order, and whether each query occurs once."""
    rows = valid_matches(spark, sf_dir)
    copies = rows.groupBy("match_result_id", "feature_index_a").agg((F.count(F.lit(1)) == 1).alias("unique_query"))
    placed = positions(rows, ["match_result_id"], ["feature_index_a", "distance", "feature_index_b", "entry_index"], "n")
    return placed.join(copies, ["match_result_id", "feature_index_a"]).select("match_result_id", "entry_index", (F.col("n") + 1).alias("place"), "unique_query")


@REGISTRY.query(
    "t07_track_order",
    f"""WITH RECURSIVE {_TRACKS}
SELECT track.s AS track_set_id, track.i AS track_index, count(*) AS members, row_number() OVER (ORDER BY track) - 1 AS position FROM t GROUP BY track""",
)
def t07(spark, sf_dir):
    """Positions of tracks in lexicographic order of their members: disjoint sorted lists order as their first members."""
    key = ["track_set_id", "track_index"]
    return positions(track_members(spark, sf_dir).groupBy(*key).agg(F.count(F.lit(1)).alias("members")), [], key, "position")


@REGISTRY.query(
    "u03_first_delivery",
    "SELECT match_result_id, entry_index, count(*) AS copies FROM (SELECT DISTINCT * FROM matches) GROUP BY 1, 2",
)
def u03(spark, sf_dir):
    rows = table(spark, sf_dir, "matches").distinct()
    return rows.groupBy("match_result_id", "entry_index").agg(F.count(F.lit(1)).alias("copies"))


@REGISTRY.query(
    "u07_earliest_arrival",
    "SELECT reconstruction_id, min(ingested_at) AS ingested_at, count(*) AS deliveries FROM incremental_reconstructions GROUP BY 1",
)
def u07(spark, sf_dir):
    rows = table(spark, sf_dir, "incremental_reconstructions").select("reconstruction_id", "base_reconstruction_id", "ingested_at")
    deliveries = rows.groupBy("reconstruction_id").agg(F.count(F.lit(1)).alias("deliveries"))
    return first_delivery(rows).select("reconstruction_id", "ingested_at").join(deliveries, "reconstruction_id")


@REGISTRY.query(
    "u09_cursor_steps",
    """SELECT calibration_scope_id, reconstruction_id, ingested_at, greatest(coalesce(p, reconstruction_id), reconstruction_id) AS cursor, p IS NULL OR reconstruction_id > p AS moved
FROM (SELECT *, max(reconstruction_id) OVER (PARTITION BY calibration_scope_id ORDER BY ingested_at, reconstruction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p
  FROM (SELECT DISTINCT calibration_scope_id, reconstruction_id, ingested_at FROM incremental_reconstructions))""",
)
def u09(spark, sf_dir):
    """The monotone cursor of each scope after each delivery, and whether the delivery moved it: late rows do not."""
    rows = table(spark, sf_dir, "incremental_reconstructions").select("calibration_scope_id", "reconstruction_id", "ingested_at").distinct()
    scanned, _ = prefix_scan(rows, ["calibration_scope_id"], ["ingested_at", "reconstruction_id"], {"p": ("max", "reconstruction_id")})
    cursor = advance(F.col("p"), F.col("reconstruction_id"), F.col("p"))
    moved = F.col("p").isNull() | (F.col("reconstruction_id") > F.col("p"))
    return scanned.select("calibration_scope_id", "reconstruction_id", "ingested_at", cursor.alias("cursor"), moved.alias("moved"))


@REGISTRY.query(
    "u10_repaired_results",
    """SELECT match_result_id, match_asset_path FROM (SELECT match_result_id, coalesce(match_asset_path, '') AS match_asset_path,
  row_number() OVER (PARTITION BY match_result_id ORDER BY ingested_at DESC, match_asset_path DESC) AS n FROM match_results) WHERE n = 1""",
)
def u10(spark, sf_dir):
    """The state after every delivery replaced what it repairs: the last one counts."""
    rows = table(spark, sf_dir, "match_results").select("match_result_id", "ingested_at", F.coalesce("match_asset_path", F.lit("")).alias("match_asset_path"))
    return latest_by(rows, ["match_result_id"], [F.col("ingested_at"), F.col("match_asset_path")]).drop("ingested_at")


@REGISTRY.query(
    "g03_node_metadata",
    """SELECT feature_set_id, count(DISTINCT extractor_kind || '/' || extractor_version) AS kinds, count(DISTINCT image_id) AS images,
  count(DISTINCT extractor_kind || '/' || extractor_version) = 1 AND count(DISTINCT image_id) = 1 AS consistent FROM feature_sets GROUP BY 1""",
)
def g03(spark, sf_dir):
    """Contradicting deliveries of one node make it unusable."""
    meta = F.concat_ws("/", "extractor_kind", F.col("extractor_version").cast("string"))
    rows = table(spark, sf_dir, "feature_sets").groupBy("feature_set_id").agg(F.count_distinct(meta).alias("kinds"), F.count_distinct("image_id").alias("images"))
    return rows.withColumn("consistent", (F.col("kinds") == 1) & (F.col("images") == 1))


@REGISTRY.query(
    "g03_edge_problems",
    """WITH bad AS (SELECT feature_set_id FROM feature_sets GROUP BY 1 HAVING count(DISTINCT extractor_kind || '/' || extractor_version) > 1 OR count(DISTINCT image_id) > 1),
r AS (SELECT DISTINCT match_result_id, feature_set_id_a AS a, feature_set_id_b AS b FROM match_results WHERE result_status = 1)
SELECT match_result_id, CASE WHEN a IS NULL OR b IS NULL THEN 'SIDE' WHEN a = b THEN 'SELF' WHEN a IN (SELECT * FROM bad) OR b IN (SELECT * FROM bad) THEN 'CONTRADICTION'
  WHEN NOT EXISTS (SELECT 1 FROM feature_sets f WHERE f.feature_set_id = a) OR NOT EXISTS (SELECT 1 FROM feature_sets f WHERE f.feature_set_id = b) THEN 'UNKNOWN' ELSE 'OK' END AS state FROM r""",
)
def g03_edges(spark, sf_dir):
    """Why a matched result may not become an edge: a side missing, a set against itself, a contradicted or unknown set."""
    nodes = g03(spark, sf_dir).select("feature_set_id", "consistent")
    rows = match_results(spark, sf_dir, "match_result_id", "feature_set_id_a", "feature_set_id_b", "result_status").where("result_status = 1")
    for side in ("a", "b"):
        rows = rows.join(nodes.select(F.col("feature_set_id").alias(f"feature_set_id_{side}"), F.col("consistent").alias(f"ok_{side}")), f"feature_set_id_{side}", "left")
    a, b = F.col("feature_set_id_a"), F.col("feature_set_id_b")
    wrong = F.coalesce(~F.col("ok_a"), F.lit(False)) | F.coalesce(~F.col("ok_b"), F.lit(False))
    state = F.when(a.isNull() | b.isNull(), "SIDE").when(a == b, "SELF").when(wrong, "CONTRADICTION").when(F.col("ok_a").isNull() | F.col("ok_b").isNull(), "UNKNOWN")
    return rows.select("match_result_id", state.otherwise("OK").alias("state"))


@REGISTRY.query(
    "f10_same_stems",
    """WITH a AS (SELECT DISTINCT match_asset_path AS p, candidate_pair_id AS c FROM match_results WHERE match_asset_path IS NOT NULL)
SELECT x.c AS candidate_pair_id, x.p AS first_path, y.p AS second_path,
  regexp_replace(regexp_extract(x.p, '[^/]*$'), '\\.[^.]*$', '') = regexp_replace(regexp_extract(y.p, '[^/]*$'), '\\.[^.]*$', '') AS same
FROM a x JOIN a y ON x.c = y.c AND x.p < y.p""",
)
def f10(spark, sf_dir):
    """Assets of one candidate pair, and whether their names agree up to the last dot."""
    rows = match_results(spark, sf_dir, "match_asset_path", "candidate_pair_id").where("match_asset_path is not null")
    a, b = rows.withColumnRenamed("match_asset_path", "first_path"), rows.withColumnRenamed("match_asset_path", "second_path")
    pairs = a.join(b, "candidate_pair_id").where("first_path < second_path")
    return pairs.withColumn("same", same_stem(F.col("first_path"), F.col("second_path")))


@REGISTRY.query(
    "f19_remaining_seconds",
    """WITH p AS (SELECT r.match_result_id, r.match_count AS total, count(m.entry_index) AS done, r.seconds FROM (SELECT match_result_id, match_count, min(epoch_us(ingested_at) - epoch_us(created_at)) // 1000000 AS seconds
  FROM match_results WHERE match_count > 0 GROUP BY 1, 2) r LEFT JOIN (SELECT DISTINCT match_result_id, entry_index FROM matches) m ON m.match_result_id = r.match_result_id GROUP BY 1, 2, 4)
SELECT match_result_id, CASE WHEN done > total THEN 'ERROR' WHEN done = total THEN 'COMPLETE' WHEN done < 2 OR seconds <= 0 THEN 'WARMING' ELSE 'KNOWN' END AS state,
  CASE WHEN done = total THEN 0 WHEN done < 2 OR seconds <= 0 OR done > total THEN NULL ELSE ceil((total - done) / (done / seconds::DOUBLE))::BIGINT END AS seconds FROM p""",
)
def f19(spark, sf_dir):
    """How long a result's missing entries would take at the rate of those that are there, and whether that is known."""
    gap = F.unix_micros(F.col("ingested_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))
    declared = table(spark, sf_dir, "match_results").where("match_count > 0").select("match_result_id", F.col("match_count").alias("total"), gap.alias("gap"))
    declared = declared.groupBy("match_result_id", "total").agg(F.min("gap").alias("gap")).withColumn("seconds", F.expr("gap div 1000000"))
    there = table(spark, sf_dir, "matches").select("match_result_id", "entry_index").distinct().groupBy("match_result_id").agg(F.count("entry_index").alias("n"))
    p = declared.join(there, "match_result_id", "left").withColumn("done", F.coalesce("n", F.lit(0)).cast("bigint"))
    done, total = F.col("done"), F.col("total")
    rate = F.when((done >= 2) & (F.col("seconds") > 0), done / F.col("seconds"))
    state = F.when(done > total, "ERROR").when(done == total, "COMPLETE").when(rate.isNull(), "WARMING").otherwise("KNOWN")
    left = F.when(done == total, F.lit(0).cast("bigint")).when(done < total, remaining_seconds(done, total, rate, done))
    return p.select("match_result_id", state.alias("state"), left.alias("seconds"))


@REGISTRY.query(
    "g05_image_components",
    """WITH RECURSIVE e AS (SELECT DISTINCT a.image_id AS u, b.image_id AS v FROM match_results r
  JOIN (SELECT DISTINCT feature_set_id, image_id FROM feature_sets) a ON a.feature_set_id = r.feature_set_id_a
  JOIN (SELECT DISTINCT feature_set_id, image_id FROM feature_sets) b ON b.feature_set_id = r.feature_set_id_b WHERE r.result_status = 1),
l AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach AS (SELECT u AS node, u AS low FROM l UNION SELECT l.v, r.low FROM reach r JOIN l ON l.u = r.node WHERE r.low < l.v),
t AS (SELECT node, min(low) AS component FROM reach GROUP BY 1)
SELECT component AS component_key, count(*) AS registered FROM t GROUP BY 1""",
)
def g05(spark, sf_dir):
    """Images linked by matched results; a component's key is its smallest image."""
    sets = feature_sets(spark, sf_dir, "feature_set_id", "image_id")
    rows = match_results(spark, sf_dir, "feature_set_id_a", "feature_set_id_b", "result_status").where("result_status = 1")
    for side in ("a", "b"):
        rows = rows.join(sets.select(F.col("feature_set_id").alias(f"feature_set_id_{side}"), F.col("image_id").alias(f"image_{side}")), f"feature_set_id_{side}")
    return components(rows, "image_a", "image_b").groupBy(F.col("low").alias("component_key")).agg(F.count(F.lit(1)).alias("registered"))


@REGISTRY.query(
    "j18_cross_check",
    f"""SELECT r.match_result_id, r.match_count AS declared, count(m.entry_index) AS found, r.match_count = count(m.entry_index) AS agrees
FROM (SELECT DISTINCT match_result_id, match_count FROM match_results WHERE result_status = 1) r LEFT JOIN {_VALID} m USING (match_result_id) GROUP BY 1, 2""",
)
def j18(spark, sf_dir):
    """What a result declares against the entries that are there."""
    declared = match_results(spark, sf_dir, "match_result_id", "match_count", "result_status").where("result_status = 1")
    found = valid_matches(spark, sf_dir).groupBy("match_result_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return declared.join(found, "match_result_id", "left").select("match_result_id", F.col("match_count").alias("declared"), n.alias("found"), (F.col("match_count") == n).alias("agrees"))


@REGISTRY.query(
    "a10_support_counts",
    f"""SELECT fs AS feature_set_id, count(DISTINCT idx) AS supported FROM (
  SELECT r.feature_set_id_a AS fs, m.feature_index_a AS idx FROM {_VALID} m JOIN (SELECT DISTINCT match_result_id, feature_set_id_a FROM match_results WHERE result_status = 1) r USING (match_result_id)
  UNION ALL SELECT r.feature_set_id_b, m.feature_index_b FROM {_VALID} m JOIN (SELECT DISTINCT match_result_id, feature_set_id_b FROM match_results WHERE result_status = 1) r USING (match_result_id))
WHERE fs IS NOT NULL GROUP BY 1 HAVING count(DISTINCT idx) >= 6""",
)
def a10(spark, sf_dir):
    """Features of a set that a match supports; six and more make it a candidate for registration."""
    results = match_results(spark, sf_dir, "match_result_id", "feature_set_id_a", "feature_set_id_b", "result_status").where("result_status = 1")
    rows = valid_matches(spark, sf_dir).join(results, "match_result_id")
    sides = F.array(*[F.struct(F.col(f"feature_set_id_{s}").alias("fs"), F.col(f"feature_index_{s}").alias("idx")) for s in ("a", "b")])
    flat = rows.select(F.explode(sides).alias("x")).select("x.fs", "x.idx").where("fs is not null")
    return flat.groupBy(F.col("fs").alias("feature_set_id")).agg(F.count_distinct("idx").alias("supported")).where("supported >= 6")


@REGISTRY.query(
    "st09_throughput_trials",
    """SELECT event_id, coalesce(value >= 1.05 * lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), FALSE) AS improved FROM events""",
)
def st09(spark, sf_dir):
    """Whether a sample improved on the one before by the five percent that keep a trial."""
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.col("value") >= 1.05 * before, F.lit(False)).alias("improved"))
