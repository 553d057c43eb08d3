import pytest

from loomtext.plans.query import QuerySyntaxError, parse, wrap
from loomtext.plans.retrieval_queries import tree_text


def test_wraps_parses_and_prints():
    assert tree_text("aich that", "bm25") == "#sum(#score(aich.body) #score(that.body))"
    assert tree_text("#AND(a.title #near/2(b c))", "indri") == "#and(#score(a.title) #score(#near/2(b.body c.body)))"
    assert str(parse("#wand(0.7 a 0.3 #and(b c))")) == "#wand(0.7 #score(a.body) 0.3 #and(#score(b.body) #score(c.body)))"


def test_rewrites_prune_and_collapse():
    stop = ("of", "the")
    assert parse("#near/1(of the)", stop) is None
    assert str(parse("#sum(#syn(aich))")) == "#score(aich.body)"
    assert str(parse("#wand(0.5 the 0.2 a-b 0.1 c)", stop)) == "#wand(0.2 #score(a.body) 0.2 #score(b.body) 0.1 #score(c.body))"
    assert str(parse("x#near/3(a b)")) == "#score(#near/3(a.body b.body))"
    assert str(parse("#near/x(a b)")) == "#score(#near/0(a.body b.body))"


@pytest.mark.parametrize("text", ["a b", "#sum(a", "#sum(a))", "#foo(a)", "#and(a.nofield)", "#near/2(a.title b)", "#near/2(#and(a b) c)", "#wand(a b)", "#near(a b)", "#sum(a) b"])
def test_errors(text):
    with pytest.raises(QuerySyntaxError):
        parse(text)


def test_unsupported_models(spark, tmp_path):
    from loomtext.operators.corpus import Corpus
    from loomtext.operators.index import Index
    from loomtext.plans.compile import Model, UnsupportedOperator, search

    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    index = Index.build(Corpus(docs), f"file://{tmp_path}/all")
    for model, text in (("bm25", "#sum(#and(a b) a)"), ("indri", "#or(a b)"), ("bm25", "#wand(1 a 2 b)")):
        with pytest.raises(UnsupportedOperator):
            search(index, {"q": text}, Model(model)).collect()
    assert wrap("a", "ranked") == "#or(a)"
    assert search(index, {"q": "#or(a zzz)"}, Model("ranked")).collect()[0]["score"] == 1.0
    assert search(Index.build(Corpus(docs, stop=("a",)), f"file://{tmp_path}/stop"), {"q": "a"}, Model("bm25")).count() == 0


#: Queries by model, and the text of their trees.
TREES = [
    ("bm25", "the aich #near/1(of the) aien", "#sum(#score(aich.body) #score(aien.body))"), ("indri", "#wand(0.7 #and(x.title y.title) 0.3 #or(the))", "#and(#score(x.title) #score(y.title))"),
    ("indri", "x.title #syn(w z.url)", "error"), ("unranked", "#and(x y) #near/2(u v)", "#or(#and(#score(x.body) #score(y.body)) #score(#near/2(u.body v.body)))"), ("bm25", "#sum(#syn(x))", "#score(x.body)"),
    ("bm25", "the of", "nothing"), ("bm25", "#near/2(#and(x y) z)", "error"), ("bm25", "x) #sum(y", "error"),
]


def test_trees_of_the_hand_table():
    from loomtext.functions.text import STOPWORDS

    def tree(model, text):
        try:
            return str(parse(wrap(text, model), STOPWORDS) or "nothing")
        except ValueError:
            return "error"

    assert [tree(m, q) for m, q, _ in TREES] == [t for _, _, t in TREES]
