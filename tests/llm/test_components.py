import random

import pytest

from parallaxa.llm.components import connected_groups


def expected(pairs):
    up = {}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, i, b, j in pairs:
        if None in (a, i, b, j):
            continue
        for x in ((a, i), (b, j)):
            up.setdefault(x, x)
        p, q = sorted((root((a, i)), root((b, j))))
        up[q] = p
    return {(*x, *root(x)) for x in up}


def run(spark, pairs, **kw):
    df = spark.createDataFrame(pairs, "major_a bigint, minor_a bigint, major_b bigint, minor_b bigint")
    rows = connected_groups(df.selectExpr("*", "1 as u", "2 as code"), **kw).collect()
    got = {tuple(r) for r in rows}
    assert len(got) == len(rows)
    assert got == expected(pairs)


def test_hub_chain_loops_nulls_and_repeats(spark):
    rnd = random.Random(1)
    hub = [(9, 0, 10 + i, i) for i in range(60)]
    chain = [(500, i, 500, i + 1) for i in range(90)]
    odd = [(1, 1, 1, 1), (1, 1, 1, 1), (None, 1, 2, 2), (3, None, 2, 2), (7, 7, 7, 8), (7, 8, 7, 7), (7, 8, 7, 8)]
    pairs = hub + chain + odd
    rnd.shuffle(pairs)
    run(spark, pairs)


@pytest.mark.parametrize("rounds", [0, 2])
def test_deep_giant_is_contracted(spark, rounds):
    pairs = [(5, i, 5, i + 1) for i in range(70)] + [(5, 35, 6, i) for i in range(9)] + [(1, 0, 5, 70), (8, 1, 8, 2)]
    run(spark, pairs, peel_rounds=rounds)


def test_wide_ids_and_empty(spark):
    run(spark, [(-5, 2**62, 2**62, 3), (2**62, 3, 4, -9), (1, 2, 3, 4)])
    run(spark, [])
    run(spark, [(4, 4, 4, 4)])
