import random

import numpy as np

from parallaxa.operators.geometry import verify_pairs
from parallaxa.operators.grid import greedy_association, near_points, quota_selection
from pyspark.sql import functions as F


def scene(rng, n, outliers):
    x = np.column_stack([rng.uniform(-1, 1, (n, 2)), rng.uniform(4, 8, n)])
    angle = 0.1
    r = np.array([[np.cos(angle), 0, np.sin(angle)], [0, 1, 0], [-np.sin(angle), 0, np.cos(angle)]])
    a = x[:, :2] / x[:, 2:] * 1000 + 500
    y = x @ r.T + np.array([-0.5, 0.02, 0.1])
    b = y[:, :2] / y[:, 2:] * 1000 + 500 + rng.normal(0, 0.2, (n, 2))
    bad = rng.choice(n, int(n * outliers), replace=False)
    b[bad] = rng.uniform(0, 1000, (len(bad), 2))
    return np.column_stack([a, b]), n - len(bad)


def test_two_view_support(spark):
    rng = np.random.default_rng(3)
    rows, good = scene(rng, 120, 0.4)
    noise = rng.uniform(0, 1000, (40, 4))
    data = [(1, *map(float, r)) for r in rows] + [(2, *map(float, r)) for r in noise] + [(3, 1.0, 2.0, 3.0, 4.0)] * 30
    df = spark.createDataFrame(data, "pair bigint, ax double, ay double, bx double, by double").repartition(3)
    got = {r.pair: r for r in verify_pairs(df, "pair").collect()}
    assert got[1].verified and abs(got[1].inliers - good) <= 8 and abs(np.linalg.norm(got[1].model) - 1) < 1e-9
    assert not got[3].verified and got[3].model is None and got[3].inliers == 0
    assert got[2].inliers < got[1].inliers / 2


def test_association_is_greedy_in_index_order(spark):
    rnd = random.Random(5)
    a = [(g, i, rnd.randrange(20), rnd.randrange(20)) for g in range(3) for i in range(25)]
    b = [(g, i, rnd.randrange(20), rnd.randrange(20)) for g in range(3) for i in range(25)]
    schema = "g bigint, index bigint, x double, y double"
    near = near_points(spark.createDataFrame([(g, i, float(x), float(y)) for g, i, x, y in a], schema), spark.createDataFrame([(g, i, float(x), float(y)) for g, i, x, y in b], schema), "g", 4.0)
    want = set()
    for g in range(3):
        used = set()
        for _, i, x, y in sorted(r for r in a if r[0] == g):
            free = [((x - u) ** 2 + (y - v) ** 2, j) for h, j, u, v in b if h == g and j not in used and (x - u) ** 2 + (y - v) ** 2 <= 16]
            if free:
                d, j = min(free)
                used.add(j)
                want.add((g, i, j))
    assert {(r.g, r.a_index, r.b_index) for r in greedy_association(near, "g").collect()} == want


def test_quota_per_cell_before_the_cap(spark):
    df = spark.createDataFrame([(1, c, i, 10 - i) for i in range(6) for c in range(3)], "img int, cell int, i int, response int")
    got = quota_selection(df, ["img"], ["cell"], [F.desc("response"), F.asc("i"), F.asc("cell")], 2, 5).collect()
    assert sorted((r.cell, r.i) for r in got) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0)]
