import numpy as np
import pytest
from pyspark.sql import functions as F

from parallaxa.sources.binary import MATCH_ENTRY, MOST_MATCHES, decode_matches, decode_scopes, discover, encode_matches, encode_scopes, match_bytes
from parallaxa.sources.features import KEYPOINT, LAYOUTS, MOST_FEATURES, decode_features, encode_features, feature_bytes, feature_problem, read_feature_files
from parallaxa.sources.points import read_points
from parallaxa.sources.text import export_reconstruction, manifest_problems, new_imports, read_manifest, write_manifest, write_report


def test_match_files(spark):
    e = np.array([(1, 2, 0.5), (3, 4, 7.0)], dtype=MATCH_ENTRY)
    good = match_bytes(10, 20, 1, e)
    bad = bytearray(good)
    bad[-4:] = np.array([np.nan], "<f4").tobytes()
    files = [(1, good), (2, good[:-1]), (3, b"XXXX" + good[4:]), (4, match_bytes(5, 5, 1, e)), (5, bytes(bad)), (6, None), (7, match_bytes(1, 2, 2, e[:0]))]
    for i in range(32):  # a flipped bit in any header byte but the sides is found
        if i < 16:
            broken = bytearray(good)
            broken[i] ^= 0x40
            files.append((100 + i, bytes(broken)))
    got = decode_matches(spark.createDataFrame(files, "k bigint, content binary"), "k").collect()
    rows = [r for r in got if r.problem is None]
    assert [(r.k, r.a, r.b, r.entry_index, r.ia, r.ib, r.distance) for r in rows] == [(1, 10, 20, 0, 1, 2, 0.5), (1, 10, 20, 1, 3, 4, 7.0)]
    assert {r.k: r.problem for r in got if r.problem and r.k < 100} == {2: "SIZE", 3: "MAGIC", 4: "CORRUPT", 5: "ENTRY", 6: "SIZE"}
    assert len({r.k for r in got if r.k >= 100}) == 16


def test_match_files_of_many_entries(spark):
    n = 2 * MOST_MATCHES + 5
    rows = spark.range(n).selectExpr("1L as k", "10L as a", "20L as b", "1 as kind", "id * 3 as entry_index", "id % 8192 as ia", "id % 7 as ib", "float(id) as distance")
    rows = rows.unionByName(rows.limit(3).withColumn("k", F.lit(2).cast("bigint")))
    files = encode_matches(rows, "k")
    assert sorted(files.groupBy("k").count().collect()) == [(1, 3), (2, 1)]
    got = decode_matches(files, "k")
    assert got.where("problem is not null").count() == 0
    one = got.where("k = 1").orderBy("entry_index").collect()
    assert [(r.entry_index, r.ia, r.distance) for r in one] == [(i, i % 8192, float(i)) for i in range(n)]


def feature_file(version, floats=False, n=3):
    points = np.zeros(n, KEYPOINT)
    points["x"], points["octave"], points["size"] = np.arange(n), np.arange(n) - 1, 1
    dim = 128 if floats else 32
    matrix = (np.arange(n * dim) % 251).astype("<f4" if floats else "u1").reshape(n, dim)
    return feature_bytes(version, "orb", 1, b"\x07" * 32, b"\x09" * 32, 640, 480, points, matrix), matrix


@pytest.mark.parametrize(("version", "floats"), [(1, False), (2, False), (2, True)])
def test_feature_files(spark, tmp_path, version, floats):
    content, matrix = feature_file(version, floats)
    (tmp_path / "good").write_bytes(content)
    (tmp_path / "cut").write_bytes(content[:-1])
    rows = read_feature_files(spark, str(tmp_path)).orderBy("path", "feature_index").collect()
    assert {r.path.rsplit("/")[-1]: r.problem for r in rows} == {"good": None, "cut": "SIZE"}
    good = [r for r in rows if r.problem is None]
    assert [(r.feature_index, r.x, r.octave) for r in good] == [(0, 0.0, -1), (1, 1.0, 0), (2, 2.0, 1)]
    assert list(good[2].descriptor_f32 if floats else bytes(good[2].descriptor_u8)) == list(matrix[2])


@pytest.mark.parametrize("version", [1, 2])
def test_any_broken_header_byte_of_a_feature_file_is_found(version):
    content, _ = feature_file(version)
    assert feature_problem(content) is None
    at = LAYOUTS[version]
    free = {*range(at["image"], at["image"] + 32), *range(at["fingerprint"], at["fingerprint"] + 32)}
    for name in ("width", "height", *(("extractor", "abilities") if version == 2 else ())):
        free |= set(range(at[name], at[name] + 4))  # may have other values
    free |= set(range(at["kind"], at["kind"] + 16)) if version == 2 else set()
    for i in range(at["bytes"]):
        broken = bytearray(content)
        broken[i] ^= 0x41
        if i not in free:
            assert feature_problem(bytes(broken)) is not None, i
    assert [feature_problem(c) for c in (b"XXXXXXX\0" + content[8:], content + b"x", content[:100])] == ["MAGIC", "SIZE", "SIZE"]
    bad = bytearray(content)
    bad[at["bytes"] : at["bytes"] + 4] = np.array([-1.0], "<f4").tobytes()
    assert feature_problem(bytes(bad)) == "KEYPOINT"
    floats = bytearray(feature_file(2, True)[0])
    floats[-4:] = np.array([np.inf], "<f4").tobytes()
    assert feature_problem(bytes(floats)) == "DESCRIPTOR"


def test_too_many_features_are_reported(spark):
    rows = spark.range(MOST_FEATURES + 1).selectExpr(
        "5L as k", "'orb' as kind", "1 as extractor_version", "unhex(repeat('00', 32)) as image", "unhex(repeat('00', 32)) as fingerprint", "9 as width", "9 as height",
        "id as feature_index", "1f as x", "1f as y", "1f as size", "0f as angle", "0f as response", "0 as octave", "unhex(repeat('ab', 32)) as descriptor_u8",
        "cast(null as array<float>) as descriptor_f32",
    )
    rows = rows.unionByName(rows.where("feature_index < 4").withColumn("k", F.lit(6).cast("bigint")))
    rows = rows.unionByName(rows.where("feature_index < 1 and k = 6").withColumn("k", F.lit(7).cast("bigint")).withColumn("x", F.lit(99.0).cast("float")))
    files = encode_features(rows, "k").cache()
    assert {r.k: r.problem for r in files.collect()} == {5: "COUNT", 6: None, 7: "KEYPOINT"}
    assert decode_features(files, "k").where("problem is null").groupBy("k").count().collect() == [(6, 4)]


def test_scope_files(spark):
    rows = spark.createDataFrame([("a", 5), ("a", 3), ("a", 5), ("b", 2**40), ("c", 0), (None, 7), ("d", None)], "s string, i bigint")
    files = {r.s: r for r in encode_scopes(rows, "s", "i").collect()}
    assert {s: r.problem for s, r in files.items()} == {"a": None, "b": None, "c": "ENTRY", None: None}
    good = bytes(files["a"].content)
    assert good == b"L3DTSCP1" + bytes([1, 0, 0, 0, 2]) + bytes(7) + bytes([3]) + bytes(7) + bytes([5]) + bytes(7)
    broken = [("SIZE", good[:-1]), ("SIZE", b""), ("MAGIC", b"X" + good[1:]), ("VERSION", good[:8] + b"\2" + good[9:]), ("COUNT", good[:12] + bytes(8) + good[20:]), ("ENTRY", good[:20] + good[28:] + good[20:28])]
    df = spark.createDataFrame([("good", good), *[(f"{i}{w}", c) for i, (w, c) in enumerate(broken)]], "s string, content binary")
    got = decode_scopes(df, "s").collect()
    assert [r.id for r in got if r.s == "good"] == [3, 5] and all(r.s[1:] == r.problem for r in got if r.problem) and len(got) == 2 + len(broken)


def test_discovery_and_text(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, text in (("a.JPG", "x"), ("deep/b.arw", "x"), ("c.txt", "y")):
        (tmp_path / "in" / name).write_text(text)
    found = discover(spark, [str(tmp_path / "in")], {"jpg": "JPEG", "jpeg": "JPEG", "arw": "RAW"}).collect()
    assert sorted(r.kind for r in found) == ["JPEG", "RAW"] and len({r.sha256 for r in found}) == 1
    with pytest.raises(ValueError, match="twice"):
        discover(spark, [str(tmp_path), f"{tmp_path}/"], {"jpg": "JPEG"})
    df = spark.createDataFrame([('a"b', 1, "x/y"), ("c", 2, "z")], "filename string, size_bytes bigint, source_path string")
    write_manifest(df, str(tmp_path / "m"))
    assert {tuple(r) for r in read_manifest(spark, str(tmp_path / "m")).collect()} == {('a"b', 1, "x/y"), ("c", 2, "z")}
    bad = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b/c", 1, "x"), ("d", -1, ""), (None, None, None)], df.schema)
    assert {tuple(r) for r in manifest_problems(bad).collect()} == {
        ("a", "DUPLICATE", 2), ("b/c", "NAME", 1), ("d", "SIZE", 1), ("d", "SOURCE", 1), (None, "NAME", 1), (None, "SIZE", 1), (None, "SOURCE", 1),
    }
    files = spark.createDataFrame([("/p/a.JPG", 3), ("/q/a.JPG", 4), ("/p/c", 1), ("/p/old.png", 1), ("/p/n.tiff", 9)], "path string, length bigint")
    old = spark.createDataFrame([("old.png", 1, "x")], df.schema)
    assert {tuple(r) for r in new_imports(files, old).collect()} == {("a.JPG", 3, "/p/a.JPG"), ("n.tiff", 9, "/p/n.tiff")}
    write_report(spark.createDataFrame([(1, 2.005)], "i int, v double"), str(tmp_path / "r"))
    assert spark.read.text(str(tmp_path / "r")).orderBy("value").collect()[-1][0] == "i,v"
    with pytest.raises(Exception, match="(?i)exist"):
        write_report(df, str(tmp_path / "r"))


def test_point_files(spark):
    xyz = "property float x\nproperty float y\nproperty double z\n"
    head = lambda kind, n, more="": f"ply\nformat {kind} 1.0\ncomment {'long ' * 2000}\nelement vertex {n}\n{xyz}{more}end_header\n".encode()
    body = np.zeros(3, [("x", "<f4"), ("y", "<f4"), ("z", "<f8")]).tobytes()
    good = head("binary_little_endian", 3) + body
    listed = head("binary_little_endian", 2, "property list uchar int f\n") + (bytes(16) + b"\2" + bytes(8)) + (bytes(16) + b"\0")
    text = head("ascii", 2) + b"1 2 3\n4 5 6e3\n\n "
    nan = head("binary_little_endian", 3) + np.full(4, np.nan, "<f4").tobytes() + body[16:]
    cases = {
        "good": (good, 3), "lists": (listed, 2), "text": (text, 2), "windows": (text.replace(b"\n", b"\r\n"), 2), "short": (good[:-1], None), "long": (good + b"x", None),
        "none": (head("binary_little_endian", 0), None), "nan": (nan, None), "text short": (text[:-12], None), "text long": (text + b"7", None),
        "text list": (head("ascii", 1, "property list uchar int f\n") + b"1 2 3 1 1\n", None), "two": (good.replace(b"end_header", b"element face 1\nend_header"), None),
        "no z": (good.replace(b"double z", b"double w"), None), "int x": (good.replace(b"float x", b"int x"), None), "cut head": (b"ply\n", None), "empty": (b"", None), "null": (None, None),
    }
    got = read_points(spark.createDataFrame([(k, c) for k, (c, _) in cases.items()], "path string, content binary")).collect()
    assert {r.path: r.vertices for r in got} == {k: n for k, (_, n) in cases.items()}


def test_reconstruction_export(spark, tmp_path):
    lens = {"fx": 800.0, "fy": 810.0, "cx": 320.0, "cy": 240.0, "k1": -0.1, "k2": 0.02, "p1": 0.001, "p2": -0.001}
    cams = spark.createDataFrame([(7, 640, 480, *lens.values())], "camera_id int, width int, height int, " + ", ".join(f"{c} double" for c in lens))
    imgs = spark.createDataFrame([(5, 7, "b"), (3, 7, "a")], "image_id int, camera_id int, name string")
    imgs = imgs.select("*", *[F.lit(0.0).alias(c) for c in ("qw", "qx", "qy", "qz", "tx", "ty", "tz")])
    pts = spark.createDataFrame([(9, 1.0, 2.0, 3.0, 0.1), (8, 1.0, 2.0, 3.0, 0.1), (20, 0.0, 0.0, 1.0, 0.0)], "point_id int, x double, y double, z double, error double")
    x, y = 0.2, -0.1
    r2 = x * x + y * y
    bend = 1 - 0.1 * r2 + 0.02 * r2 * r2
    u = 800 * (x * bend + 2 * 0.001 * x * y - 0.001 * (r2 + 2 * x * x)) + 320
    v = 810 * (y * bend + 0.001 * (r2 + 2 * y * y) - 2 * 0.001 * x * y) + 240
    obs = spark.createDataFrame([(9, 5, u, v), (9, 3, 3.0, 4.0), (8, 5, 5.0, 6.0)], "point_id int, image_id int, x double, y double")
    export_reconstruction(cams, imgs, pts, obs, str(tmp_path / "o"))
    read = lambda n: [r[0] for r in spark.read.text(str(tmp_path / "o" / n)).collect()]
    assert read("cameras")[0].split()[-2:] == [f"{320.5:.16e}", f"{240.5:.16e}"]
    lines = read("images")
    at = next(i for i, l in enumerate(lines) if l.endswith(" 1 b"))
    two = lines[at + 1].split()
    assert two[2] == "1" and two[5] == "2"  # in the order of the points
    assert float(two[3]) == pytest.approx(800 * x + 320, abs=1e-4) and float(two[4]) == pytest.approx(810 * y + 240, abs=1e-4)
    points = {l.split()[0]: l.split()[8:] for l in read("points3D")}
    assert points == {"1": ["2", "0"], "2": ["1", "0", "2", "1"], "3": []}
