import random

from pyspark.sql import functions as F

from parallaxa.operators.components import accepted_tracks, components


def roots(n, edges):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        up[q] = p
    return [root(x) for x in range(n)]


def test_every_graph_of_six_vertices(spark):
    """All 32,768 graphs in one table: vertex mask * 8 + i."""
    pairs = [(i, j) for i in range(6) for j in range(i)]
    masks = spark.range(1 << len(pairs)).withColumnRenamed("id", "mask")
    bits = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(j).alias("j")) for k, (i, j) in enumerate(pairs)])
    edges = (
        masks.select("mask", F.explode(bits).alias("b"))
        .where(F.expr("shiftright(mask, b.k) & 1 = 1"))
        .select((F.col("mask") * 8 + F.col("b.i")).alias("u"), (F.col("mask") * 8 + F.col("b.j")).alias("v"))
    )
    got = {}
    for r in components(edges).collect():
        got.setdefault(r.v // 8, {})[r.v % 8] = r.low % 8
    for mask in range(1 << len(pairs)):
        edges_of = [p for k, p in enumerate(pairs) if mask >> k & 1]
        low = roots(6, edges_of)
        assert got.get(mask, {}) == {x: low[x] for p in edges_of for x in p}


def test_order_loops_nulls_and_chains(spark):
    chain = [(i, i + 1) for i in range(300)] + [(900, 900), (900, 900), (5, None), (None, None), (7, 7), (-3, -9)]
    for seed in range(2):
        rnd = random.Random(seed)
        rows = [(a, b) if rnd.random() < 0.5 else (b, a) for a, b in chain]
        rnd.shuffle(rows)
        df = spark.createDataFrame(rows, "u bigint, v bigint").repartition(3)
        want = {x: 0 for x in range(301)} | {900: 900, -3: -9, -9: -9}
        assert {r.v: r.low for r in components(df).collect()} == want
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_tracks_are_accepted_whole(spark):
    rows = [(1, 10, "a"), (1, 11, "a"), (2, 10, "a"), (2, 10, "a"), (3, 10, "a"), (3, 11, "b"), (4, 10, "a")]
    df = spark.createDataFrame(rows, "track int, image int, meta string")
    assert {r.track: r.accepted for r in accepted_tracks(df, "track", "image", "meta").collect()} == {1: True, 2: False, 3: False, 4: False}
