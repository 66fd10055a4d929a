import random

from pyspark.sql import functions as F

from parallaxa.functions.bits import bucket_key, descriptor_bit, hamming, pack_bits, set_bits, words
from parallaxa.functions.text import ascii_contains, human_size, natural_key, normalized_relative, pressure_basis_points, same_stem
from parallaxa.functions.vectors import all_finite, canonical_matrix, root_normalised
from parallaxa.operators.merge import advance, divides, insert_new, upsert_state
from parallaxa.operators.metrics import gates, upper_median
from parallaxa.operators.pairs import mutual_unique, unique_best
from parallaxa.operators.progress import percent_done, remaining_seconds, smoothed_rate


def test_bits(spark):
    rnd = random.Random(1)
    rows = [(bytearray(rnd.randbytes(32)), bytearray(rnd.randbytes(32))) for _ in range(20)] + [(bytearray(b"\xff" * 32), bytearray(32))]
    df = spark.createDataFrame(rows, "a binary, b binary").select("a", "b", words(F.col("a")).alias("wa"), words(F.col("b")).alias("wb"))
    got = df.select("a", "b", hamming(F.col("wa"), F.col("wb")).alias("h"), descriptor_bit(F.col("wa"), 77).alias("bit"), bucket_key(F.col("wa"), 3).alias("key"))
    bit = lambda v, i: v[i // 8] >> (i % 8) & 1
    for r in got.collect():
        assert r.h == sum(bin(x ^ y).count("1") for x, y in zip(r.a, r.b, strict=True))
        assert r.bit == bit(r.a, 77)
        assert r.key == sum(bit(r.a, (3 * 41 + b * 11) % 256) << b for b in range(24))


def test_masks_round_trip(spark):
    rows = [([True] + [False] * 8 + [True],), ([],), ([False] * 3,), ([True] * 16,)]
    df = spark.createDataFrame(rows, "flags array<boolean>")
    got = df.select("flags", F.unhex(pack_bits(F.col("flags"))).alias("m")).select("flags", "m", set_bits(F.when(F.octet_length("m") > 0, F.col("m"))).alias("is"))
    for r in got.collect():
        assert (r["is"] or []) == [i for i, f in enumerate(r.flags) if f]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()[0]


def test_text(spark):
    s = lambda v: F.lit(v)
    assert one(spark, ascii_contains(s("IMG_Ä.JPG"), "img_")) and not one(spark, ascii_contains(s("É"), "é"))
    assert one(spark, ascii_contains(s("x"), ""))
    assert one(spark, natural_key(s("img9")) < natural_key(s("IMG10"))) and one(spark, natural_key(s("a")) > natural_key(s("1")))
    assert [one(spark, normalized_relative(s(p))) for p in ("a/b.c", "/a", "a//b", "a/../b", "", None, "a/.b")] == [True, False, False, False, False, False, True]
    assert one(spark, same_stem(s("x/a.b.jpg"), s("y/a.b.arw"))) and not one(spark, same_stem(s("a.jpg"), s("b.jpg")))
    assert [one(spark, human_size(s(n))) for n in (0, 1023, 1536, 3 << 20, 5 << 30)] == ["0 B", "1023 B", "1.5 KiB", "3.0 MiB", "5.0 GiB"]
    assert one(spark, pressure_basis_points(s("some avg10=1.25 avg60=0.10"))) == 125
    assert one(spark, pressure_basis_points(s("avg10=1.25 avg10=1.25"))) is None and one(spark, pressure_basis_points(s("xavg10=1.25"))) is None


def test_vectors(spark):
    nan = float("nan")
    df = spark.createDataFrame([([0.0, 0.0],), ([1.0, 3.0],), ([nan],), ([None],)], "v array<double>")
    got = df.select(all_finite(F.col("v")).alias("ok"), root_normalised(F.col("v")).alias("r")).collect()
    assert [r.ok for r in got] == [True, True, False, False]
    assert got[0].r == [0.0, 0.0] and got[1].r == [0.5, 0.75**0.5]
    m = one(spark, canonical_matrix(F.array(*[F.lit(float(x)) for x in (0, 3, 0, -4, 0, 0, 0, 0, 0)])))
    assert m == [0.0, -0.6, 0.0, 0.8, 0.0, 0.0, 0.0, 0.0, 0.0]


def test_publication(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (None, "n")], "k int, c string")
    new = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (3, "c"), (None, "n")], "k int, c string")
    assert {tuple(r) for r in insert_new(old, new, ["k"]).collect()} == {(3, "c")}
    assert sorted((r.k or 0, r.state) for r in upsert_state(old, new, ["k"], ["c"]).collect()) == [(0, "same"), (1, "same"), (2, "conflict"), (2, "conflict"), (3, "new")]
    pairs = spark.createDataFrame([("x", 1), ("x", 2), ("x", 2), ("y", 1), ("z", 3)], "g string, i int")
    need = spark.createDataFrame([(1,), (2,), (2,)], "i int")
    assert [r.g for r in divides(pairs, "g", "i", need).collect()] == ["x"]
    assert one(spark, advance(F.lit(4), F.lit(9), F.lit(4))) == 9 and one(spark, advance(F.lit(4), F.lit(9), F.lit(3))) == 4


def test_pairs_and_metrics(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (3, 4), (4, 5), (6, 6)], "a int, b int")
    assert {tuple(r) for r in mutual_unique(e, "a", "b").collect()} == {(1, 2)}
    c = spark.createDataFrame([("g", 1, 5), ("g", 2, 5), ("h", 3, 7), ("h", 4, 1), ("i", 5, 0)], "g string, i int, s int")
    assert {tuple(r) for r in unique_best(c, ["g"], "i", "s").collect()} == {("g", 5, 2, None), ("h", 7, 1, 3)}
    v = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 9.0), ("b", 4.0), ("b", None)], "g string, v double")
    assert {tuple(r) for r in upper_median(v, ["g"], "v", "m").collect()} == {("a", 3.0), ("b", 4.0)}
    assert one(spark, gates({"A": F.lit(True), "B": F.lit(None).cast("boolean"), "C": F.lit(False)})) == "B;C"
    assert one(spark, percent_done(F.lit(999), F.lit(1000))) == 99 and one(spark, percent_done(F.lit(0), F.lit(0))) is None


def test_smoothed_rate_starts_afresh(spark):
    rows = [(1, t, c) for t, c in ((0, 0), (1, 10), (2, 20), (2, 25), (3, 5), (4, 9), (5, 13))] + [(2, 0, 3)]
    df = spark.createDataFrame(rows, "k int, t int, c int")
    got = {r.k: r for r in smoothed_rate(df, "k", ["t", "c"], "t", "c").collect()}
    assert (got[1].rate, got[1].positive) == (4.0, 2) and (got[2].rate, got[2].positive) == (0.0, 0)
    assert one(spark, remaining_seconds(F.lit(1), F.lit(10), F.lit(4.0), F.lit(2))) == 3
