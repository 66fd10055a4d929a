import random

import pytest

from parallaxa.llm.setsim import similar_sets


def expected(rows, t):
    sets = {}
    for s, i, e in rows:
        if i is not None and e is not None:
            sets.setdefault((s, i), set()).add(e)
    keys = sorted(sets, key=str)
    out = set()
    for x in keys:
        for y in keys:
            if x[0] == y[0] and x[1] < y[1]:
                both = len(sets[x] & sets[y])
                if both >= t * len(sets[x] | sets[y]):
                    out.add((x[0], x[1], y[1]))
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "s int, i bigint, e bigint").selectExpr("*", "1 as id", "2 as print")
    found = similar_sets(df, ["s"], "i", "e", 0.4, **kw)
    members = {}
    for r in found.members.collect():
        members.setdefault((r.s, r.class_id), []).append(r.id)
    got = set()
    for r in found.pairs.collect():
        assert r.a < r.b
        got |= {(r.s, *sorted((x, y))) for x in members[r.s, r.a] for y in members[r.s, r.b]}
    for (s, _), ids in members.items():
        got |= {(s, x, y) for x in ids for y in ids if x < y}
    assert got == expected(rows, 0.4)


@pytest.mark.parametrize("kw", [{"element_cap": 900}, {}, {"max_bucket": 3}])
def test_random_sets_with_copies(spark, kw):
    rnd = random.Random(4)
    rows = []
    for i in range(70):
        base = rnd.choice([list(range(20)), list(range(10, 40)), list(range(60, 75)), [7]])
        own = base if i % 4 == 0 else [e if rnd.random() < 0.8 else rnd.randrange(500) for e in base]
        rows += [(i % 2, i, e) for e in own]
    rows += [(None, 300 + i, e) for i in range(9) for e in (5, 6, 7 + i)]  # more than a small bucket holds, in the null space
    run(spark, rows + rows[:30] + [(None, 1, 5), (None, 2, 5), (0, None, 5), (0, 900, None), (1, -3, -8)], **kw)


def test_empty(spark):
    run(spark, [])
