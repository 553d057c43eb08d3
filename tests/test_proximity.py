import random

from pyspark.sql import functions as F

from loomtext.operators import proximity


def near_walk(lists, n):
    out, skip = [], -1
    for start in lists[0]:
        if start <= skip:
            continue
        at, ok = start, True
        for other in lists[1:]:
            later = [x for x in other if x > at]
            if not later:
                return out
            if later[0] - at > n:
                ok = False
                break
            at = later[0]
        skip = at
        if ok:
            out.append(at)
    return out


def window_walk(lists, n):
    at, out = [0] * len(lists), []
    while all(i < len(x) for i, x in zip(at, lists)):
        heads = [x[i] for i, x in zip(at, lists)]
        if max(heads) - min(heads) < n:
            out.append(max(heads))
            at = [i + 1 for i in at]
        else:
            at = [i + (h == min(heads)) for i, h in zip(at, heads)]
    return out


def run(spark, fold, cases):
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a array<int>, b array<int>, c array<int>")
    got = {r["i"]: r["p"] for r in rows.select("i", fold([F.col("a"), F.col("b"), F.col("c")]).alias("p")).collect()}
    return [got[i] for i in range(len(cases))]


def test_hand_cases(spark):
    two = spark.createDataFrame([(1, [1, 2], [3]), (2, [1], [3]), (3, [5], [3])], "i int, a array<int>, b array<int>")
    args = [F.col("a"), F.col("b")]
    got = {r["i"]: r for r in two.select("i", proximity.near(args, 2).alias("n2"), proximity.near(args, 1).alias("n1"), proximity.within(args, 3).alias("w3"), proximity.within(args, 2).alias("w2"), proximity.synonyms(args).alias("s")).collect()}
    assert got[1]["n2"] == [3] and got[2]["n1"] == [] and got[3]["w3"] == [5] and got[3]["w2"] == []
    assert got[1]["s"] == [1, 2, 3]
    assert run(spark, lambda a: proximity.near(a, 9), [([1, 3], [2, 5], [4, 6])]) == [[4]]


def test_sweeps_equal_walks(spark):
    rng = random.Random(5)
    cases = [tuple(sorted(rng.sample(range(30), rng.randint(0, 8))) for _ in range(3)) for _ in range(300)]
    assert run(spark, lambda a: proximity.near(a, 4), cases) == [near_walk(c, 4) for c in cases]
    assert run(spark, lambda a: proximity.within(a, 6), cases) == [window_walk(c, 6) if all(c) else [] for c in cases]


def test_sweeps_are_linear(spark):
    """Four times the positions take about four times as long, with a match at every other place and with none."""
    import time

    def seconds(n, fold, step):
        lists = [[step * i + k for i in range(n)] for k in range(3)]
        rows = spark.createDataFrame([(i, *lists) for i in range(2)], "i int, a array<int>, b array<int>, c array<int>")
        best = 1e9
        for _ in range(3):
            start = time.perf_counter()
            found = rows.select(F.size(fold([F.col("a"), F.col("b"), F.col("c")])).alias("n")).collect()[0]["n"]
            best = min(best, time.perf_counter() - start)
        return best, found

    for fold in (lambda a: proximity.near(a, 3), lambda a: proximity.within(a, 4)):
        (few, n), (many, m) = seconds(4000, fold, 5), seconds(16000, fold, 5)
        assert (n, m) == (4000, 16000) and many < 8 * few + 0.5
