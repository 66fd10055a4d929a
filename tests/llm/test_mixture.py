import random

import numpy as np
import pytest

from parallaxa.llm.mixture import MixModel, fit_rates, mix, packed_masses

MODEL = MixModel(hashed_words=256)


def run(spark, docs, weights):
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string").selectExpr("*", "1 as tokens", "2 as rate", "3 as domain")
    w = spark.createDataFrame(weights, "source string, target_weight double, max_repeats int")
    found = mix(d, w, MODEL)
    return found.copies.collect(), {r.source: r for r in found.shares.collect()}


def test_shares_caps_and_unknown_sources(spark):
    rnd = random.Random(9)
    words = {"a": "red green blue cyan", "b": "cat dog cow hen", "c": "one two six ten", "z": "none of those"}
    docs, i = [], 0
    for s, n in (("a", 400), ("b", 150), ("c", 20), ("z", 50)):
        for _ in range(n):
            docs.append((i, s, " ".join(rnd.choice(words[s].split()) for _ in range(rnd.randrange(1, 40)))))
            i += 1
    docs += [(i + k, None, "cat cow dog hen cat") for k in range(30)] + [(i + 40, "a", None), (i + 41, "b", ""), (i + 42, None, None)]
    weights = [("a", 50.0, 1), ("b", 30.0, 2), ("c", 10.0, 4), ("none", 10.0, 3), (None, 5.0, 1)]
    copies, shares = run(spark, docs, weights)
    cap = {"a": 1, "b": 2, "c": 4}
    text_of = {d[0]: d[2] for d in docs}
    for r in copies:
        assert 0 <= r.copies <= cap.get(r.source, 4) and r.source != "z"
        assert text_of[r.doc_id] or r.copies == 0
    assert shares["none"].state == "no documents" and shares["none"].reached_share == 0
    for s, want in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
        assert shares[s].attainable_share == pytest.approx(want)
        assert shares[s].expected_share == pytest.approx(want, abs=0.01)
    assert shares["c"].most_copies == 4  # the scarcest source is repeated as often as it may
    unknown = [r for r in copies if r.source is None]
    assert sum(r.copies for r in unknown) > 0  # told apart by their words


def test_unknown_sources_take_part_when_nothing_repeats(spark):
    rnd = random.Random(10)
    words = {"a": "red green blue cyan", "b": "cat dog cow hen", "z": "none of those"}
    docs, i = [], 0
    for s, n in (("a", 200), ("b", 50), ("z", 50)):
        for _ in range(n):
            docs.append((i, s, " ".join(rnd.choice(words[s].split()) for _ in range(rnd.randrange(5, 20)))))
            i += 1
    docs += [(i + k, None, "cat cow dog hen cat hen cow") for k in range(40)]
    copies, shares = run(spark, docs, [("a", 50.0, 1), ("b", 50.0, 1)])
    unknown = [r.copies for r in copies if r.source is None]
    assert max(r.copies for r in copies) == 1 and sum(unknown) >= 36  # b is scarce, and these are b by their words
    assert all(r.source != "z" for r in copies if r.copies)
    assert shares["b"].expected_share == pytest.approx(0.5, abs=0.02)


def test_no_documents_one_source_and_no_weights(spark):
    assert run(spark, [], [("a", 1.0, 1)])[0] == []
    copies, shares = run(spark, [(1, "a", "x y"), (1, "a", "x y")], [("a", 1.0, 2), ("a", 1.0, 2)])
    assert [r.copies for r in copies] == [2, 2] and shares["a"].reached_share == 1.0
    copies, _ = run(spark, [(1, "a", "x y")], [])
    assert all(r.copies == 0 for r in copies)


def rows_of(spark, p, q, t, cap):
    data = [(i, int(t[i]), [float(x) for x in p[i]], [float(x) for x in q[i]], float(cap[i])) for i in range(len(t))]
    return packed_masses(spark.createDataFrame(data, "doc_id int, tokens bigint, membership array<double>, predicted array<double>, cap double").repartition(3))


def rates_of(rows, found):
    kept = found.applied(rows).select("doc_id", "rate")
    return np.array([r.rate for r in kept.orderBy("doc_id").collect()])


def test_rates_reach_the_targets_and_lean_to_the_predictions(spark):
    rng = np.random.default_rng(2)
    p = np.eye(3)[rng.integers(0, 3, 300)]
    q = 0.6 * p + 0.4 * rng.dirichlet([0.3] * 3, 300)
    t = rng.integers(1, 50, 300)
    rows = rows_of(spark, p, q, t, np.full(300, 2.0))
    target = np.array([900.0, 2000.0, 500.0])
    rates = rates_of(rows, fit_rates(rows, target, MixModel()))
    even = rates_of(rows, fit_rates(rows, target, MixModel(soft_weight=0.0)))
    assert rates.min() >= 0 and rates.max() <= 2
    assert np.abs((p * (t * rates)[:, None]).sum(0) - target).max() < 1e-3 * target.sum()
    miss = lambda r: np.abs((q * (t * r)[:, None]).sum(0) - target).sum()
    assert miss(rates) < 0.9 * miss(even)


def test_error_falls_with_every_step_where_caps_are_met(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.3] * 3, 200)
    t = rng.integers(1, 50, 200)
    cap = rng.integers(1, 3, 200)
    rows = rows_of(spark, p, p, t, cap)
    target = (p * (t * cap)[:, None]).sum(0) * [1.0, 0.6, 0.2]
    misses = []
    for steps in (1, 3, 6, 12):
        found = fit_rates(rows, target, MixModel(steps=steps))
        found.moves = [m for m in found.moves if m[0] == "add"]
        r = rates_of(rows, found)
        assert r.min() >= 0 and (r <= cap).all()
        misses.append((((p * (t * r)[:, None]).sum(0) - target) ** 2 / (p * t[:, None]).sum(0)).sum())
    assert misses == sorted(misses, reverse=True) and misses[-1] < 0.5 * misses[0]
