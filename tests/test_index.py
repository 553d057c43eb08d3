"""Segments, manifests and searches by bounds."""

import os
import random
import subprocess
import sys

import pytest

from loomtext.operators.corpus import Corpus
from loomtext.operators.index import Index, Indexes
from loomtext.plans.bounded import bounded_search
from loomtext.plans.compile import Model, search

SCHEMA = "doc_id long, title string, text string"


def batch(seed, low, high):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["the", "running", "dogs"]
    return [(i, " ".join(rng.choices(words, k=2)), " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=rng.randint(0, 60))) or None) for i in range(low, high)]


def corpus(docs, **options):
    return Corpus(docs, fields={"title": "title", "body": "text"}, **options)


def rows(df):
    return sorted(map(str, df.collect()))


def test_segments_answer_as_one_index(spark, tmp_path):
    """Base and appended batches, before and after merging, against one index of all."""
    parts = [batch(i, 100 * i - 150, 100 * i - 50) for i in range(5)]
    make = lambda some: spark.createDataFrame([r for p in some for r in p], SCHEMA)
    whole = Index.build(corpus(make(parts), stop=("the",), stemmer="porter"), f"file://{tmp_path}/whole")
    grown = Index.build(corpus(make(parts[:1]), stop=("the",), stemmer="porter"), f"file://{tmp_path}/grown")
    for i, p in enumerate(parts[1:]):
        grown = grown.append(make([p]), merge=i == 3)
        if i == 2:
            assert len(grown.segments) == 4 and grown.manifest["appended"] == 4
            before = grown
    opened = Index.open(spark, f"file://{tmp_path}/grown")
    assert len(opened.segments) == 1 or len(opened.segments) == 2
    assert opened.manifest == grown.manifest and (opened.stop, opened.stemmer) == (("the",), "porter")
    assert rows(opened.dictionary()) == rows(whole.dictionary()) and rows(opened.field_stats()) == rows(whole.field_stats())
    assert rows(opened.postings(["w1", "run"])) == rows(whole.postings(["w1", "run"])) and rows(opened.term_vectors([-150, 7])) == rows(whole.term_vectors([-150, 7]))
    queries = {"a": "w1 w7 running", "b": "#near/3(w0 w1) w2", "c": "w1.title w3", "d": "the"}
    for model in ("bm25", "indri"):
        assert rows(search(opened, queries, Model(model), 20)) == rows(search(whole, queries, Model(model), 20))
    assert before.table("documents").count() == 400  # an earlier version still reads
    assert len(grown.vacuum()) >= 4 and rows(search(opened, queries, Model("bm25"))) == rows(search(whole, queries, Model("bm25")))


def test_an_index_opens_as_it_was_built(spark, tmp_path):
    path = f"file://{tmp_path}/stemmed"
    Index.build(Corpus(spark.createDataFrame([(1, "running"), (2, "cats")], "doc_id long, text string"), stemmer="porter"), path)
    index = Index.open(spark, path)
    assert [r["doc_id"] for r in search(index, {"q": "running"}, Model("bm25")).collect()] == [1]
    indexes = Indexes(spark)
    indexes.open(path)
    assert [r["doc_id"] for r in indexes.scan("runs").collect()] == [1]


def test_another_application_opens_it(spark, tmp_path):
    path = f"file://{tmp_path}/shared"
    Index.build(Corpus(spark.createDataFrame([(i, f"running w{i}") for i in range(20)], "doc_id long, text string"), stemmer="porter"), path)
    code = f"""
from pyspark.sql import SparkSession
from loomtext.operators.index import Index
from loomtext.plans.bounded import bounded_search
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
index = Index.open(spark, {path!r})
print("FOUND", index.stemmer, sorted(r["doc_id"] for r in bounded_search(index, {{"q": "runs w3"}}, k=1).rows.collect()))
"""
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))} | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, env=env, cwd=tmp_path)
    assert "FOUND porter [3]" in out.stdout, out.stderr[-2000:]


def test_two_writers_and_known_ids(spark, tmp_path):
    index = Index.build(Corpus(spark.createDataFrame([(1, "a")], "doc_id long, text string")), f"file://{tmp_path}/w")
    other = Index.open(spark, index.path)
    index.append(spark.createDataFrame([(2, "b")], "doc_id long, text string"))
    with pytest.raises(RuntimeError, match="by another"):
        other.append(spark.createDataFrame([(3, "c")], "doc_id long, text string"))
    assert Index.open(spark, index.path).table("documents").count() == 2
    with pytest.raises(ValueError, match="document 2"):
        Index.open(spark, index.path).append(spark.createDataFrame([(2, "x"), (9, "y")], "doc_id long, text string"))
    with pytest.raises(ValueError, match="no index"):
        Index.open(spark, f"file://{tmp_path}/none")


@pytest.mark.parametrize("k", (1, 5, 1000))
def test_bounds_lose_nothing(spark, tmp_path, k):
    parts = [batch(9, -100, 900), batch(10, 900, 1100)]
    make = lambda p: spark.createDataFrame(p, SCHEMA)
    index = Index.build(corpus(make(parts[0])), f"file://{tmp_path}/b").append(make(parts[1]))
    queries = {"a": "w1 w7 w20", "b": "w0", "c": "w1.title w3 w3", "d": "w0 w1 the", "e": "nosuchword", "f": "w30.title w31.title"}
    found = bounded_search(index, queries, k=k, report=True)
    assert rows(found.rows) == rows(search(index, queries, Model("bm25"), k))
    assert 0 < found.opened <= found.blocks and set(found.floors) <= set(queries)
    ordered = bounded_search(index, {"q": "#near/2(w0 w1)"}, k=k).rows
    assert rows(ordered) == rows(search(index, {"q": "#near/2(w0 w1)"}, Model("bm25"), k))


def test_postings_are_not_shuffled(spark, tmp_path):
    """Only the best rows of a task move, and ranges below the floor stay closed."""
    docs = [(i, "t", "common " * 3 + ("rare " * 5 if i == 77 else "")) for i in range(3000)]
    index = Index.build(corpus(spark.createDataFrame(docs, SCHEMA)), f"file://{tmp_path}/p")
    found = bounded_search(index, {"q": "rare common"}, k=1, report=True)
    assert [r["doc_id"] for r in found.rows.collect()] == [77] and found.opened < 5 < found.blocks
    plan = found.rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(qid" in plan and "SortMergeJoin" not in plan


def test_ids_that_are_no_integers(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x y"), ("b", "x")], "doc_id string, text string")
    index = Index.build(Corpus(docs), f"file://{tmp_path}/s").append(spark.createDataFrame([("c", "y y")], "doc_id string, text string"))
    assert sorted(r["doc_id"] for r in bounded_search(index, {"q": "y"}, k=5).rows.collect()) == ["a", "c"]


def test_building_moves_about_the_texts(spark, tmp_path):
    """Neither tokens nor postings are shuffled or written over and over: what a build moves stays near the size of the texts."""
    from loomtext.plans.observed import measured, totals

    rng = random.Random(3)
    words = [f"word{i}" for i in range(3000)]
    docs = [(i, " ".join(rng.choices(words, k=400))) for i in range(1000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    took = totals(measured(spark, {"build": lambda: Index.build(Corpus(df), f"file://{tmp_path}/i").dictionary()})).first()
    size = sum(len(t) for _, t in docs)
    assert took["rows_out"] == 3000 and took["shuffle_bytes_written"] + took["spilled_bytes"] < 1.5 * size
    stored = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path / "i") for f in names)
    assert stored < 3 * size


def test_ranges_of_long_texts_and_stray_ids(spark, tmp_path):
    """A range that holds nearly all documents is kept in chunks, a stray id does not widen ranges, and places stay exact."""
    long = " ".join(f"x{i % 50} the" for i in range(150_000))
    docs = [(i, f"common w{i}") for i in range(300)] + [(300, long), (301, long), (1 << 40, "stray common"), (-5, None)]
    index = Index.build(Corpus(spark.createDataFrame(docs, "doc_id long, text string"), stop=("the",)), f"file://{tmp_path}/r")
    assert index.manifest["range_width"] < 100
    got = {r["doc_id"]: r for r in index.postings(["x7", "the"]).collect()}
    assert set(got) == {300, 301} and all(r["positions"] == [2 * i for i in range(7, 150_000, 50)] and r["tf"] == 3000 for r in got.values())
    assert {r["doc_id"]: r["tf"] for r in index.term_vectors([301]).filter("term = 'x0'").collect()} == {301: 3000}
    assert index.dictionary(terms=["common", "the"]).collect()[0].asDict() == {"term": "common", "df": 301, "ctf": 301}
    assert {r["doc_id"]: (r["dl_all"], r["dl_indexed"]) for r in index.lengths().filter("doc_id in (-5, 300)").collect()} == {-5: (0, 0), 300: (300_000, 150_000)}
    assert rows(bounded_search(index, {"q": "common x7 w9"}, k=20).rows) == rows(search(index, {"q": "common x7 w9"}, Model("bm25"), 20))


def test_a_task_sorts_the_blocks_of_one_bucket(spark, tmp_path, monkeypatch):
    """However small the files of the buckets are, no task takes several: what it sorts does not grow with the table."""
    from loomtext.operators import index as module
    from loomtext.plans.observed import measured

    monkeypatch.setattr(module, "BUCKET_BYTES", 1000)
    df = spark.createDataFrame([(i, f"w{i} common " * 10) for i in range(1300)], "doc_id long, text string")
    built = []
    stages = measured(spark, {"build": lambda: built.append(Index.build(Corpus(df), f"file://{tmp_path}/n")) or built[0].table("documents")}).collect()
    most = max(stages, key=lambda r: r["rows_written"])
    assert built[0].segments[0]["buckets"] > 100 and most["rows_written"] > 1300 and most["tasks"] == built[0].segments[0]["buckets"]


def test_ranges_of_ids_in_far_groups(spark, tmp_path):
    """Gaps between groups of ids do not widen ranges, so what one task sorts does not grow with a group."""
    ids = [g * 10**12 + i for g in (-1, 0, 3) for i in range(500)]
    df = spark.createDataFrame([(i, f"common w{i % 500} g{i // 10**12}") for i in ids], "doc_id long, text string")
    index = Index.build(Corpus(df), f"file://{tmp_path}/f")
    sizes = [r["count"] for r in index._documents_in(index.segments[0]).groupBy("range").count().collect()]
    assert sum(sizes) == 1500 and max(sizes) <= 128 and len(sizes) < 60
    assert {r["doc_id"]: r["term"] for r in index.term_vectors([3 * 10**12 + 7]).filter("term like 'w%'").collect()} == {3 * 10**12 + 7: "w7"}
    assert rows(bounded_search(index, {"q": "common w7 g3"}, k=20).rows) == rows(search(index, {"q": "common w7 g3"}, Model("bm25"), 20))


def test_width_of_ranges():
    from loomtext.operators.index import RANGE_DOCS, WIDTH_CELLS, width_of

    def of(ids):
        ids = sorted(ids)
        return width_of([ids[int((len(ids) - 1) * (0.05 + 0.9 * i / WIDTH_CELLS))] for i in range(WIDTH_CELLS + 1)], len(ids))

    assert width_of(None, 0) == 1 and of([5]) <= RANGE_DOCS * 2 and of([5] * 1000) == 1
    assert 55 <= of(range(100_000)) <= 75 and 550 <= of(range(0, 1_000_000, 10)) <= 750 and 550 <= of(range(-1_000_000, 0, 10)) <= 750
    for groups in (2, 60, 150):
        assert 50 <= of(g * 10**9 + i for g in range(groups) for i in range(120_000 // groups)) <= 8 * 80
    assert of([*range(40_000), *range(10**9, 10**9 + 60_000 * 10**6, 10**6)]) <= 8 * 80  # two fifths lie close


def test_width_where_groups_of_ids_are_many(spark):
    """Cells are smaller than a group of ids, however many groups there are: else every cell spans a gap and a range holds a whole group."""
    from pyspark.sql import functions as F

    from loomtext.operators.index import range_width

    ids = spark.range(150_000).select((F.floor(F.col("id") / 600) * 10**9 + F.col("id") % 600).alias("doc_id"))
    assert 50 <= range_width(ids, "doc_id") <= 80
    assert 55 <= range_width(spark.range(150_000), "id") <= 75 and range_width(ids.filter("false"), "doc_id") == 1


def test_blocks_and_vectors_hold_the_tokens(spark, tmp_path):
    """Against plain Python: stopwords, stems that meet other words, empty and null texts, letters beyond the first plane, several fields, chunks of a range."""
    import re
    from collections import defaultdict

    from loomtext.functions.porter import stem

    rng = random.Random(5)
    words = ["run", "running", "runs", "the", "é", "\U0001d400", "\uffee", "z9", "cats", "cat"]
    docs = [(i, rng.choice([None, "", "Run the cats"]), rng.choice([None, "", " ".join(rng.choices(words, k=rng.randint(1, 300)))])) for i in range(-70, 130)]
    index = Index.build(corpus(spark.createDataFrame(docs, SCHEMA), stop=("the",), stemmer="porter"), f"file://{tmp_path}/v")
    for at, field in ((1, "title"), (2, "body")):
        want, squares = defaultdict(list), {}
        for d in docs:
            found = re.findall(r"[^\W_]+", (d[at] or "").lower())
            squares[d[0]] = (len(found), sum(t != "the" for t in found), float(sum(found.count(t) ** 2 for t in set(found))))
            for p, t in enumerate(found):
                if t != "the":
                    want[d[0], stem(t)].append(p)
        assert {(r["doc_id"], r["term"]): r["positions"] for r in index.term_vectors(name=field).collect()} == want
        terms = sorted({t for _, t in want})
        got = index.postings(terms, field, ("term", "doc_id", "tf", "dl", "positions")).collect()
        assert {(r["doc_id"], r["term"]): r["positions"] for r in got} == want and all(r["tf"] == len(r["positions"]) and r["dl"] == squares[r["doc_id"]][0] for r in got)
        assert {r["doc_id"]: (r[f"dl_{field}"], r[f"il_{field}"], r[f"sq_{field}"]) for r in index.table("documents").collect()} == squares
        for r in index._blocks_in(index.segments[0]).filter(f"field = '{field}'").collect():
            assert r["docs"] == sorted(r["docs"]) and (r["n"], r["most_tf"], r["least_dl"], r["total"]) == (len(r["docs"]), max(r["tfs"]), min(r["dls"]), sum(r["tfs"]))
