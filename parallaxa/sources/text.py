"""Text sources and sinks: manifests and imports, reports, reconstruction exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallaxa.functions.geometry import undistort
from parallaxa.operators.prefix import positions

#: Columns of a manifest, extensions of images that are imported.
MANIFEST = "filename string, size_bytes bigint, source_path string"
IMAGES = ("jpg", "jpeg", "png", "tif", "tiff", "heic")


def read_manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """Tab-separated rows below one header; a row that doesn't fit the schema fails the read."""
    return spark.read.csv(path, sep="\t", schema=schema, mode="FAILFAST", header=True, quote="", enforceSchema=False)


def write_manifest(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", mode="errorifexists", header=True, quote="")


def manifest_problems(manifest: DataFrame) -> DataFrame:
    """(filename, problem, rows): names that are no plain file name (NAME), rows without a source (SOURCE) or with a size
    that is missing or below 0 (SIZE), and names on several rows (DUPLICATE)."""
    name = F.coalesce("filename", F.lit(""))
    rules = [
        (~name.rlike(r"^[^/\\\x00-\x1f]+$") | name.isin(".", ".."), "NAME"),
        (F.coalesce(F.length("source_path"), F.lit(0)) == 0, "SOURCE"),
        (F.coalesce(F.col("size_bytes") < 0, F.lit(True)), "SIZE"),
    ]
    found = F.array_compact(F.array(*[F.when(bad, F.lit(problem)) for bad, problem in rules]))
    rows = manifest.select("filename", F.explode(found).alias("problem")).groupBy("filename", "problem").agg(F.count(F.lit(1)).alias("rows"))
    twice = manifest.groupBy("filename").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return rows.unionByName(twice.select("filename", F.lit("DUPLICATE").alias("problem"), "rows"))


def new_imports(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(filename, size_bytes, source_path): what an import of `files` (path, length) adds to a manifest: images by their
    extension whose name isn't there yet, of several with one name the first by path."""
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    images = files.where(extension.isin(*IMAGES)).select(name.alias("filename"), F.struct("path", "length").alias("f"))
    first = images.groupBy("filename").agg(F.min("f").alias("f"))
    fresh = first.join(manifest.select("filename"), "filename", "left_anti")
    return fresh.select("filename", F.col("f.length").alias("size_bytes"), F.col("f.path").alias("source_path"))


def write_report(df: DataFrame, path: str, decimals: int = 2) -> None:
    """CSV with a header and fixed decimals, never over an existing report."""
    columns = [
        F.format_string(f"%.{decimals}f", F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes
    ]
    df.select(*columns).write.csv(path, header=True, mode="errorifexists")


def _number(df: DataFrame, key: str, out: str) -> DataFrame:
    """Numbers 1 to n in key order; keys are unique."""
    return positions(df.select(key).distinct(), [], [key], "n").select(key, (F.col("n") + 1).alias(out))


def export_reconstruction(cameras: DataFrame, images: DataFrame, points: DataFrame, observations: DataFrame, path: str) -> None:
    """Writes cameras, images and points3D text folders with ids numbered from 1 in id order.

    cameras: camera_id, width, height, fx, fy, cx, cy and, if they distort, k1, k2, p1, p2; images: image_id, camera_id,
    qw, qx, qy, qz, tx, ty, tz, name; points: point_id, x, y, z, error; observations: point_id, image_id, x, y. Numbers
    have 16 decimals. Pixels are written without distortion, the principal point half a pixel further, as the format
    counts from pixel corners. An image lists its observations in the order of its points; a point names each by its
    image and its place in that list.
    """
    num = lambda c: F.format_string("%.16e", c.cast("double"))
    col = lambda c: num(F.col(c))
    for c in ("k1", "k2", "p1", "p2"):
        if c not in cameras.columns:
            cameras = cameras.withColumn(c, F.lit(0.0))
    cam = cameras.join(_number(cameras, "camera_id", "cam_no"), "camera_id")
    cam.orderBy("cam_no").select(
        F.concat_ws(" ", "cam_no", F.lit("PINHOLE"), "width", "height", col("fx"), col("fy"), num(F.col("cx") + 0.5), num(F.col("cy") + 0.5))
    ).write.text(f"{path}/cameras")
    lens = cam.select("camera_id", "cam_no", *[F.col(c).alias(f"__{c}") for c in ("fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2")])
    img = images.join(_number(images, "image_id", "img_no"), "image_id").join(lens, "camera_id")
    pts = points.join(_number(points, "point_id", "pt_no"), "point_id")
    k = {c: F.col(f"__{c}") for c in ("fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2")}
    met = observations.join(pts.select("point_id", "pt_no"), "point_id").join(img.select("image_id", "img_no", *[f"__{c}" for c in k]), "image_id")
    u, v = undistort(F.col("x"), F.col("y"), k)
    straight = met.select("image_id", "point_id", "pt_no", "img_no", "x", "y", (u * k["fx"] + k["cx"]).alias("ux"), (v * k["fy"] + k["cy"]).alias("uy"))
    seen = positions(straight, ["img_no"], ["pt_no", "x", "y"], "place")
    lists = seen.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("place", "ux", "uy", "pt_no"))).alias("os"))
    text = F.array_join(F.transform("os", lambda o: F.concat_ws(" ", num(o["ux"]), num(o["uy"]), o["pt_no"].cast("string"))), " ")
    pose = F.concat_ws(" ", "img_no", *[col(c) for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")], "cam_no", "name")
    img.join(lists, "image_id", "left").orderBy("img_no").select(
        F.concat(pose, F.lit("\n"), F.coalesce(text, F.lit("")))
    ).write.text(f"{path}/images")
    tracks = seen.groupBy("point_id").agg(F.array_sort(F.collect_list(F.struct("img_no", "place"))).alias("is"))
    views = F.array_join(F.transform("is", lambda i: F.concat_ws(" ", i["img_no"].cast("string"), i["place"].cast("string"))), " ")
    pts.join(tracks, "point_id", "left").orderBy("pt_no").select(
        F.concat_ws(" ", "pt_no", *[col(c) for c in ("x", "y", "z")], F.lit("0 0 0"), col("error"), views)
    ).write.text(f"{path}/points3D")
