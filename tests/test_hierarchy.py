import random

import pytest
from pyspark.sql import functions as F

from parallaxa.operators.hierarchy import build_hierarchy, descendants_of, hierarchy_paths
from parallaxa.operators.prefix import prefix_sum


def expected(rows):
    parent = {}
    for node, up in rows:
        for x in (node, up):
            if x is not None:
                parent.setdefault(x, None)
        if node is not None and up is not None:
            parent[node] = up if parent[node] is None else min(up, parent[node])
    out = {}
    for v in parent:
        path, x = [v], v
        while parent[x] is not None and parent[x] not in path:
            x = parent[x]
            path.append(x)
        if parent[x] is None:
            out[v] = ("tree", x, len(path) - 1, path[::-1])
        else:
            ring = path[path.index(parent[x]) :]
            if v in ring:
                out[v] = ("cycle", min(ring), 0, [v])
            else:
                at = next(i for i, y in enumerate(path) if y in ring)
                out[v] = ("below_cycle", min(ring), at, path[at::-1])
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "child bigint, base bigint").withColumn("id", F.lit("a clash"))
    tree = build_hierarchy(df, "child", "base")
    want = expected(rows)
    nodes = {r.id: r for r in tree.nodes.collect()}
    assert len(nodes) == tree.nodes.count() == len(want)
    paths = {r.id: r.path for r in hierarchy_paths(tree, rows_per_block=7).collect()}
    for v, (state, root, depth, path) in want.items():
        r = nodes[v]
        assert (r.state, r.root, r.depth) == (state, root, depth), v
        assert paths[v] == path
    below = {(a, v) for v, w in want.items() for a in w[3][:-1]}
    assert {v: r.descendants for v, r in nodes.items()} == {v: sum(a == v for a, _ in below) for v in want}
    got = descendants_of(tree, tree.nodes.select("id")).collect()
    assert len(got) == len(below) and {(r.ancestor_id, r.descendant_id) for r in got} == below
    assert sorted(r.start for r in nodes.values()) == list(range(len(want)))


def test_small_cases(spark):
    check(spark, [(5, None), (6, 5), (6, 5), (7, 6), (9, 8), (1, 1), (2, 1), (3, 4), (4, 3), (10, 3), (11, 10), (None, 12), (13, None)])


def test_empty(spark):
    tree = build_hierarchy(spark.createDataFrame([], "c bigint, p bigint"), "c", "p")
    assert tree.nodes.count() == 0 and hierarchy_paths(tree).count() == 0


def test_conflicting_parents_take_the_smallest(spark):
    check(spark, [(3, 1), (3, 2), (3, None)])


def test_random_forest_with_a_hot_parent_a_chain_and_cycles(spark):
    rnd = random.Random(3)
    rows = [(i, 100) for i in range(101, 170)] + [(i, i - 1) for i in range(201, 260)]
    rows += [(i, rnd.choice(range(300, 340))) for i in range(300, 330)]
    rnd.shuffle(rows)
    check(spark, rows + rows[:20])


@pytest.mark.parametrize("partitions", [1, 5])
def test_prefix_sum_across_blocks(spark, partitions):
    rows = [(None if i % 3 else 1, i, (i * 7) % 5 if i % 11 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, o int, v bigint")
    got, held = prefix_sum(df, ["g"], ["o"], "v", "before", partitions)
    for r in got.collect():
        assert r.before == sum(v or 0 for g, o, v in rows if g == r.g and o < r.o)
    held.drop()
