import math
import random

import parallaxa.llm.topn as topn


def expected(rows):
    groups = {}
    for g, score, item, n in rows:
        if score is None or math.isnan(score) or item is None or n is None:
            continue
        best = groups.setdefault(g, ({}, n))[0]
        best[item] = max(best.get(item, -math.inf), score)
    return {(g, i) for g, (best, n) in groups.items() for i, _ in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:n]}


def run(spark, rows):
    df = spark.createDataFrame(rows, "g bigint, score double, item bigint, n int").selectExpr("*", "'x' as __h").repartition(5)
    got = topn.top_n(df, ["g"], [("score", "descending")], ["item"], "n").select("g", "item").collect()
    assert len({tuple(r) for r in got}) == len(got)
    assert {tuple(r) for r in got} == expected(rows)


def test_edges(spark):
    nan = float("nan")
    run(spark, [(1, 0.5, 3, 2), (1, 0.5, 2, 2), (1, 0.5, 2, 2), (1, 0.5, 1, 2), (None, 1.0, 4, 1), (None, 2.0, 5, 1), (2, nan, 1, 3), (2, None, 1, 3), (2, 0.0, None, 3), (3, 1.0, 1, 0), (4, 1.0, 1, None)])
    run(spark, [])


def test_hot_group_with_small_buffers(spark, monkeypatch):
    # the closure of the tasks reads the module's own value, so the small buffer is exercised on the kernel directly
    import pyarrow as pa

    monkeypatch.setattr(topn, "BUFFER_ROWS", 16)
    rnd = random.Random(2)
    rows = [(1 if rnd.random() < 0.5 else rnd.randrange(40), rnd.randrange(9) / 4, rnd.randrange(50), 3) for _ in range(900)]

    def batches(rs, size):
        for i in range(0, len(rs), size):
            g, s, it, n = zip(*rs[i : i + size], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(s), pa.array(it), pa.array(n)], names=["g", "score", "item", "n"])

    order = [("score", "descending"), ("item", "ascending")]
    partial = [
        tuple(r.values())
        for part in (rows[:500], rows[500:])
        for b in topn._heaps(["g"], order, ["item"], "n", False)(batches(part, 7))
        for r in b.to_pylist()
    ]
    assert len(partial) < len(rows)
    out = [
        (r["g"], r["item"])
        for b in topn._heaps(["g"], order, ["item"], "n", True)(batches(sorted(partial), 5))
        for r in b.to_pylist()
    ]
    assert len(out) == len(set(out)) and set(out) == expected(rows)
