"""The ranking machine against one that forms every pair."""

import numpy as np
from pyspark.sql import functions as F

from loomtext.operators import ranksvm

COLUMNS = ("f1", "f2", "f3")


def made(seed, n=60, queries=3, levels=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(3)
    rel = np.clip((x @ [1.0, -2.0, 0.2] + rng.normal(size=n)).round().astype(int), 0, levels - 1)
    return [(f"q{i % queries}", int(i), int(r), *map(float, v)) for i, (r, v) in enumerate(zip(rel, x))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "qid string, doc_id long, rel int, f1 double, f2 double, f3 double")


def pairs(rows):
    return np.array([np.subtract(a[3:], b[3:]) for a in rows for b in rows if a[0] == b[0] and a[2] > b[2]])


def test_planes_are_those_of_all_pairs(spark):
    rows, rng = made(1), np.random.default_rng(2)
    rows += [(*rows[0][:1], 100 + i, *rows[0][2:]) for i in range(5)]
    d = pairs(rows)
    for w in (np.zeros(3), rng.normal(size=3), 3 * rng.normal(size=3)):
        n, sums = ranksvm.plane(frame(spark, rows), COLUMNS, w, [0, 1, 2])
        violated = d @ w < 1
        assert n == violated.sum() and np.allclose(sums, d[violated].sum(0))


def test_weights_are_those_of_the_pair_version(spark):
    rows, cost = made(3), 0.05
    d, n_queries = pairs(rows), 3
    got = ranksvm.train(frame(spark, rows), F.col("rel"), COLUMNS, cost, 1e-9)
    w, slack, b, g = np.zeros(3), 0.0, [], []
    for _ in range(300):
        hit = d @ w < 1
        offset, slope = hit.sum() / n_queries, d[hit].sum(0) / n_queries
        if offset - w @ slope - slack <= 1e-9 * max(1.0, slack):
            break
        b.append(offset)
        g.append(slope)
        w, slack = ranksvm.solved(b, g, cost)
    assert np.allclose(got.weights, w, atol=1e-6) and got.rounds == len(b) < 100
    value = lambda v: v @ v / 2 + cost / n_queries * np.maximum(0, 1 - d @ v).sum()
    rng = np.random.default_rng(4)
    assert all(value(w) <= value(w + e) + 1e-9 for e in rng.normal(size=(200, 3)) * rng.choice([1e-3, 0.1, 1], (200, 1)))
    assert w[1] < 0 < w[0]


def test_training_and_test_queries_are_apart(spark):
    model = ranksvm.train(frame(spark, made(5)), F.col("rel"), COLUMNS, 0.1)
    tests = frame(spark, [(f"t{q[1:]}", d, r, *x) for q, d, r, *x in made(6)]).withColumn("rank", F.col("doc_id") + 1)
    ranked = {(r["qid"], r["doc_id"]): (r["score"], r["new_rank"]) for r in model.rank(tests).collect()}
    rows = tests.collect()
    for q in ("t0", "t1", "t2"):
        own = sorted((-round(sum(w * r[c] for w, c in zip(model.weights, COLUMNS)), 6), r["rank"]) for r in rows if r["qid"] == q)
        assert [(-ranked[q, d - 1][0], d) for _, d in own] == [(s, d) for s, d in own] and [ranked[q, d - 1][1] for _, d in own] == list(range(1, len(own) + 1))


def test_no_pairs(spark):
    rows = frame(spark, [("q", 1, 1, 0.0, 1.0, 2.0), ("q", 2, 1, 1.0, 1.0, 2.0), ("p", 3, None, 1.0, 0.0, 0.0)])
    assert ranksvm.train(rows, F.col("rel"), COLUMNS).weights == (0.0, 0.0, 0.0)
    assert ranksvm.train(rows.filter("false"), F.col("rel"), COLUMNS).weights == (0.0, 0.0, 0.0)
