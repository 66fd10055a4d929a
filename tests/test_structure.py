import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from parallaxa.functions.bits import inlier_masks
from parallaxa.operators.components import pair_components
from parallaxa.operators.lineage import extended, lineage_verdicts
from parallaxa.operators.matching import descriptor_blocks, two_nearest
from parallaxa.operators.prefix import positions, prefix_scan
from parallaxa.operators.progress import monotone_delta, streaks
from parallaxa.plans.lineage import cut, scratch, shared_folder


def test_lineage_verdicts(spark):
    base = {1: ("c", "ab"), 2: ("c", "de"), 3: ("c", "f"), 4: ("d", "g"), 5: ("c", "hi"), 6: ("c", "jk"), 7: ("c", "l"), 8: (None, "m"), 9: (None, "n")}
    tracks = {10: "abf", 20: "dg", 30: "e", 40: "i", 50: "l", 60: "lmn", 70: "jk"}
    rows = [(t, c, k) for t, (c, ks) in base.items() for k in ks]
    ext = [(t, k) for t, ks in tracks.items() for k in ks]
    got = lineage_verdicts(spark.createDataFrame(rows, "track bigint, component string, k string"), spark.createDataFrame(ext, "track bigint, k string"), "track", "component", ["k"]).collect()
    assert {r.track: (r.descendant, r.state) for r in got} == {
        1: (10, "EXACT"), 2: (None, "SPLIT"), 3: (10, "MERGE"), 4: (20, "EXACT"), 5: (None, "MISSING"), 6: (70, "EXACT"), 7: (None, "DUPLICATE"),
        8: (60, "EXACT"), 9: (60, "MERGE"),
    }
    across = spark.createDataFrame([(1, "c", "a"), (2, "d", "b")], "track bigint, component string, k string")
    one = spark.createDataFrame([(10, "a"), (10, "b")], "track bigint, k string")
    assert [r.state for r in lineage_verdicts(across, one, "track", "component", ["k"]).orderBy("track").collect()] == ["EXACT", "CROSS_COMPONENT_BRIDGE"]


def test_only_changed_groups_are_computed_again(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5), (None, 7)], "g string, v int")
    kept = spark.createDataFrame([("a", 1), ("b", 99)], "g string, total bigint")  # 99: as stored, not what the rows say
    found = extended(kept, rows, rows.where("v = 2 or v = 7"), "g", lambda df: df.groupBy("g").agg(F.sum("v").alias("total")))
    assert {tuple(r) for r in found.collect()} == {("a", 3, True), ("b", 99, False)}


@pytest.mark.parametrize("partitions", [1, 6])
def test_scans_over_blocks(spark, partitions):
    rnd = random.Random(8)
    rows = [(None if i % 4 == 0 else "h" if i % 4 < 3 else f"g{i % 7}", i, rnd.choice([None, 1, 5, 9, 2])) for i in range(240)]
    df = spark.createDataFrame(rows, "g string, o int, v bigint")
    got, _ = prefix_scan(df, ["g"], ["o"], {"s": ("sum", "v"), "m": ("max", "v"), "p": ("previous", "v"), "q": ("previous", "o")}, partitions)
    for r in got.collect():
        before = [(o, v) for g, o, v in rows if g == r.g and o < r.o]
        known = [v for _, v in before if v is not None]
        assert (r.s, r.m) == (sum(known), max(known, default=None))
        assert (r.p, r.q) == ((before[-1][1], before[-1][0]) if before else (None, None))
    assert sorted(r.n for r in positions(df, [], ["o"], "n").collect()) == list(range(240))
    assert positions(df.limit(0), ["g"], ["o"], "n").count() == 0


def test_deltas_and_streaks_of_a_hot_key(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice("aab"), i, rnd.randrange(9), rnd.choice([True, True, False, None])) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, t int, v int, f boolean")
    deltas = {r.t: r.d for r in monotone_delta(df, ["k"], ["t"], "v", "d").collect()}
    runs = {r.t: r.n for r in streaks(df, ["k"], ["t"], F.col("f"), "n").collect()}
    for k in "ab":
        mine = [r for r in rows if r[0] == k]
        length = 0
        for i, (_, t, v, f) in enumerate(mine):
            assert deltas[t] == (v - mine[i - 1][2] if i and v >= mine[i - 1][2] else None)
            length = length + 1 if i and bool(mine[i - 1][3]) == bool(f) else 1
            assert runs[t] == length


def test_two_nearest_across_blocks(spark):
    rng = np.random.default_rng(4)
    sets = {s: {int(i): rng.integers(0, 4, 8, dtype=np.uint8) for i in rng.choice(9000, n, replace=False)} for s, n in ((1, 40), (2, 50), (3, 1), (4, 0))}
    data = [(s, i, 8, bytearray(v.tobytes()), [float(x) for x in v]) for s, m in sets.items() for i, v in m.items()]
    df = spark.createDataFrame(data, "s bigint, i bigint, d int, u binary, f array<float>")
    pairs = spark.createDataFrame([(7, 1, 2), (8, 2, 3), (9, 1, 4)], "pair_id bigint, a bigint, b bigint")
    for payload, far in (("u", lambda x, y: int(np.bitwise_count(x ^ y).sum())), ("f", lambda x, y: float(np.sqrt(((x.astype(float) - y) ** 2).sum())))):
        got = {(r.pair_id, r.query_index): r for r in two_nearest(pairs, descriptor_blocks(df, "s", "i", "d", payload)).collect()}
        assert set(got) == {(p, i) for p, a, b in ((7, 1, 2), (8, 2, 3)) for i in sets[a]}
        for (p, i), r in got.items():
            a, b = {7: (1, 2), 8: (2, 3)}[p]
            near = sorted((far(sets[a][i], v), j) for j, v in sets[b].items())
            assert (r.train_index, pytest.approx(r.d1)) == (near[0][1], near[0][0])
            assert r.d2 == (pytest.approx(near[1][0]) if len(near) > 1 else None)


def test_masks(spark):
    rows = [(1, 0), (1, 9), (1, 40_000), (2, 7), (3, 32_767)]
    got = {(r.k, r.part): (r.inliers, r.mask) for r in inlier_masks(spark.createDataFrame(rows, "k int, p bigint"), "k", "p").collect()}
    assert got[1, 0] == (2, "0102") and got[2, 0] == (1, "80") and got[1, 1] == (1, "00" * 904 + "01")
    assert got[3, 0][1] == "00" * 4095 + "80"


def test_components_of_wide_pairs(spark):
    rows = [(2**62, 1, 5, 2**40), (5, 2**40, -7, 0), (1, 1, 1, 1), (None, 1, 1, 1)]
    got = pair_components(spark.createDataFrame(rows, "a bigint, i bigint, b bigint, j bigint"), ("a", "i"), ("b", "j")).collect()
    assert {tuple(r) for r in got} == {(2**62, 1, -7, 0), (5, 2**40, -7, 0), (-7, 0, -7, 0), (1, 1, 1, 1)}


def test_shared_folder_and_scratch(spark):
    with scratch():
        held = cut(spark.range(5))
        assert held.df.count() == 5
    with pytest.raises(Exception, match="(?i)exist|not found"):
        spark.read.parquet(held.path).count()
    remote = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: None), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="x"))
    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_folder(remote)
