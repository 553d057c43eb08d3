import pytest
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.functions.porter import stem
from loomtext.operators.corpus import Corpus
from loomtext.operators.feedback import expansion_query
from loomtext.operators.index import Index, Indexes
from loomtext.plans.compile import Model, search
from loomtext.sources import files


def rows_of(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "line_no long, line string")


def test_parameters():
    assert files.parameters("# c\n\na=1\nb=2=3\n c = x ", ("a",)) == {"a": "1", "c": "x"}
    with pytest.raises(ValueError):
        files.parameters("a=1", ("b",))


def test_query_files(spark):
    found = files.queries(rows_of(spark, "1:a b", "2: x:y", "")).orderBy("line_no").collect()
    assert [(r["qid"], r["query"]) for r in found] == [("1", "a b"), ("2", "x:y")]
    with pytest.raises(Exception, match="no colon"):
        files.queries(rows_of(spark, "bad")).collect()
    assert files.training_queries(rows_of(spark, "2: x:y")).first()["query"] == "x"
    asked = spark.createDataFrame([("15",)], "qid string")
    assert [r["intent"] for r in files.intents(rows_of(spark, "15.1:a", "157.1:b"), asked).collect()] == ["15.1"]


def test_qrels_runs_ranks(spark):
    ids = spark.createDataFrame([(0, "d0"), (1, "d1")], "doc_id long, external_id string")
    assert [tuple(r) for r in files.qrels(rows_of(spark, "1 0 d0 1", "1 0 d1 2", "1 0 d9 1"), ids).collect()] == [("1", 1, 2)]
    run = files.run(rows_of(spark, "1 Q0 d1 1 0.9 t", "1 Q0 d0 2 0.8 t", "2 Q0 d0 1 0.7 t"), 1)
    assert sorted((r["qid"], r["external_id"], r["rank"]) for r in run.collect()) == [("1", "d1", 1), ("2", "d0", 1)]
    assert {r["doc_id"]: r["page_rank"] for r in files.page_ranks(rows_of(spark, "d1\t0.5", "zz\t1"), ids).collect()} == {0: 0.0, 1: 0.5}
    csv = ",".join(map(str, range(20)))
    assert tuple(files.metric_row(rows_of(spark, "head", csv)).first()) == (13.0, 18.0, 19.0)


def test_sinks(spark, tmp_path):
    results = spark.createDataFrame([("1", "d1", 0.5, 1), ("1", "d2", 0.25, 2)], "qid string, external_id string, score double, rank long")
    files.write_lines(files.run_lines(results), f"file://{tmp_path}/run")
    assert sorted(r["line"] for r in files.lines(spark, f"file://{tmp_path}/run").collect())[0] == "1 Q0 d1 1 0.500000000000 run-1"
    expanded = spark.createDataFrame([("1", "b", 0.1234567, 2), ("1", "a", 0.5, 1)], "qid string, term string, weight double, rank long")
    assert files.expansion_lines(expansion_query(expanded)).first()["line"] == "1: #WAND( 0.5000 a 0.1235 b )"


def test_text_functions(spark):
    one = spark.range(1)
    got = one.select(T.tokens(F.lit("The Dog's café 3.14"), possessive=True).alias("t"), T.query_parameters(F.lit("?a=1&a=2&b=x%20y&c")).alias("q"), T.is_username(F.lit("a_b")).alias("u"), T.is_email(F.lit("a@b")).alias("e"), T.is_doc_id(F.lit("12x")).alias("d")).first()
    assert got["t"] == ["the", "dog", "café", "3", "14"]
    assert got["q"] == {"a": ["1", "2"], "b": ["x y"]}
    assert (got["u"], got["e"], got["d"]) == (True, False, False)
    t = "2024-01-02 03:04:05.123456"
    assert one.select(T.written_time(T.read_time(F.lit(t))).alias("t")).first()["t"] == t
    assert [stem(w) for w in ("caresses", "hopping", "relational", "generalizations", "sky", "Ünder")] == ["caress", "hop", "relat", "gener", "sky", "Ünder"]
    words = spark.createDataFrame([("running",), ("running",), ("cats",)], "term string")
    assert {r["word"]: r["stem"] for r in T.stems(words, "term", keep=("cats",)).collect()} == {"running": "run", "cats": "cats"}
    with pytest.raises(ValueError):
        T.stems(words, "term", "kstem")


def test_index_round_trip(spark, tmp_path):
    corpus = Corpus(spark.createDataFrame([(1, "the cat the"), (2, "cat"), (3, None)], "doc_id long, text string"), stop=("the",))
    path = f"file://{tmp_path}/index"
    made = Index.build(corpus, path)
    indexes = Indexes(spark)
    indexes.open(path)
    assert {r["doc_id"]: (r["tf"], r["positions"]) for r in indexes.scan("cat").collect()} == {1: (1, [1]), 2: (1, [0])}
    assert indexes.scan("the").count() == 0
    with pytest.raises(ValueError):
        indexes.switch("elsewhere")
    with pytest.raises(Exception):
        indexes.open(f"file://{tmp_path}/none")
    assert {r["doc_id"]: (r["dl_all"], r["dl_indexed"]) for r in made.lengths().collect()} == {1: (3, 1), 2: (1, 1), 3: (0, 0)}
    assert tuple(made.field_stats().select("num_docs", "doc_count", "sum_tf").first()) == (3, 2, 2)
    assert [tuple(r) for r in made.dictionary().collect()] == [("cat", 2, 2)]
    assert sorted((r["doc_id"], r["term"]) for r in made.term_vectors([2]).collect()) == [(2, "cat")]


def test_an_empty_corpus(spark, tmp_path):
    none = Corpus(spark.createDataFrame([], "doc_id long, text string"))
    assert search(Index.build(none, f"file://{tmp_path}/empty"), {"q": "a b"}, Model("bm25")).count() == 0


def test_stems_meet_on_both_sides(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Running dogs ran"), (2, "run, dog; run"), (3, "cats")], "doc_id long, text string")
    index = Index.build(Corpus(docs, stemmer="porter"), f"file://{tmp_path}/stems")
    assert sorted(r["doc_id"] for r in search(index, {"q": "runs"}, Model("ranked")).collect()) == [1, 2]
    assert {(r["doc_id"], r["tf"]) for r in index.postings(["run"]).collect()} == {(1, 1), (2, 2)}
    assert [r["positions"] for r in index.postings(["run"]).filter("doc_id = 2").collect()] == [[0, 2]]


def test_queries_read_their_terms_only(spark, tmp_path):
    """The term filter is pushed into the scan of the lists, and no text is analysed when a query runs."""
    docs = spark.createDataFrame([(i, f"a{i} common word") for i in range(50)], "doc_id long, text string")
    index = Index.build(Corpus(docs), f"file://{tmp_path}/plan")
    for text, columns in (("common a7", False), ("#near/2(common word)", True)):
        plan = search(index, {"q": text}, Model("bm25"))._jdf.queryExecution().executedPlan().toString()
        assert "In(term, [" in plan or "EqualTo(term," in plan
        assert "regexp" not in plan and ("positions" in plan) == columns and "text#" not in plan


def test_a_database_table(spark):
    """Through JDBC, in ranges of a key: Derby comes with Spark."""
    url = "jdbc:derby:memory:loomtext;create=true"
    rows = spark.createDataFrame([(i, f"u{i}") for i in range(40)], "id long, name string")
    rows.write.format("jdbc").option("url", url).option("dbtable", "people").option("driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver").mode("overwrite").save()
    from loomtext.sources import database

    read = database.table(spark, url, "people", "id", (0, 40), 4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert read.rdd.getNumPartitions() == 4 and sorted(r["NAME"] if "NAME" in read.columns else r["name"] for r in read.collect()) == sorted(f"u{i}" for i in range(40))
