"""Word-break rules and dictionary stems by hand tables."""

import pytest
import regex
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators.corpus import Corpus
from loomtext.operators.feedback import expansion_terms
from loomtext.operators.index import Index
from loomtext.plans.compile import Model, search

#: Texts and their words by the word-break rules.
CASES = [
    ("can't won’t", ["can't", "won’t"]), ("3.14 1,000.5 1;2 3:4", ["3.14", "1,000.5", "1;2", "3", "4"]), ("U.S.A. e.g. end.", ["U.S.A", "e.g", "end"]), ("wi-fi a/b a..b", ["wi", "fi", "a", "b", "a", "b"]),
    ("foo_bar _x_ __ 9_9", ["foo_bar", "_x_", "9_9"]), ("a1b2 3a.b a.1", ["a1b2", "3a.b", "a", "1"]), ("漢字 かな", ["漢", "字", "か", "な"]), ("カタカナ ァー", ["カタカナ", "ァー"]), ("漢字abcカナ", ["漢", "字", "abc", "カナ"]),
    ("café ño", ["café", "ño"]), ("l'été d’or", ["l'été", "d’or"]), ("a:b x·y", ["a:b", "x·y"]), ("'quoted' .5 5.", ["quoted", "5", "5"]), ("한국어 ไทย עברית", ["한국어", "ไทย", "עברית"]), ("­soft a­b", ["soft", "a­b"]), ("…!? -- ", []), ("", []), ("Ⅷ x²", ["Ⅷ", "x"]),
]


def test_words_of_the_hand_table(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, text string")
    got = {r["i"]: r["t"] for r in rows.select("i", T.tokens(rows["text"], lowercase=False, rule="words").alias("t")).collect()}
    assert [got[i] for i in range(len(CASES))] == [w for _, w in CASES]
    assert [regex.compile(T.word_pattern("")).findall(t) for t, _ in CASES] == [w for _, w in CASES]


def test_very_long_words(spark):
    for text, n in (("a" * 300_000, 1), ("a.1" * 50_000, None), ("1." * 100_000, 1), ("漢" * 20_000, 20_000), ("_" * 50_000, 0), ("a'" * 100_000, 1)):
        found = spark.range(1).select(T.tokens(F.lit(text), rule="words").alias("t")).first()["t"]
        assert n is None or len(found) == n


def test_an_index_of_words(spark, tmp_path):
    docs = spark.createDataFrame([(1, "It can't be 3.14, can it"), (2, "can t be 3 14"), (3, "漢字")], "doc_id long, text string")
    path = f"file://{tmp_path}/words"
    Index.build(Corpus(docs, rule="words"), path).append(spark.createDataFrame([(4, "3.14!")], "doc_id long, text string"))
    index = Index.open(spark, path)
    found = lambda q: sorted(r["doc_id"] for r in search(index, {"q": q}, Model("ranked")).collect())
    assert found("3.14") == [1, 4] and found("can't") == [1] and found("can") == [1, 2] and found("字漢") == [3] and found("3.14.body") == [1, 4]
    best = spark.createDataFrame([("q", 1, 1.0), ("q", 4, 0.5)], "qid string, doc_id long, score double")
    assert {r["term"] for r in expansion_terms(index, best).collect()} == {"it", "can't", "be", "can"}  # terms with a point are left out


#: Words, and their forms where the lexicon is that of the test.
STEMS = {"cats": "cat", "ponies": "pony", "ties": "tie", "boxes": "box", "horses": "horse", "glass": "glass", "hoped": "hope", "hopped": "hop", "walked": "walk", "tried": "try", "making": "make", "running": "run", "being": "being", "thing": "thing", "bus": "bus", "news": "news", "as": "as", "sing": "sing", "unknowns": "unknowns"}
LEXICON = ["cat", "pony", "tie", "box", "horse", "glass", "hope", "hop", "walk", "try", "make", "run", "running", "thing", "bus"]


def test_dictionary_stems(spark):
    words = spark.createDataFrame([(w,) for w in [*STEMS, *STEMS, None]], "term string")
    got = {r["word"]: r["stem"] for r in T.dictionary_stems(words, "term", spark.createDataFrame([(w,) for w in LEXICON], "word string")).collect()}
    assert got == STEMS
    assert {w: next((x for x in T.inflected_from(w) if x in LEXICON), w) for w in STEMS} == STEMS


def test_dictionary_stems_meet_on_both_sides(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the run of cats"), (2, "running a cat"), (3, "dogs")], "doc_id long, text string")
    path = f"file://{tmp_path}/forms"
    Index.build(Corpus(docs, stemmer="dictionary"), path).append(spark.createDataFrame([(4, "runs with dogs"), (5, "dog")], "doc_id long, text string"))
    index = Index.open(spark, path)
    found = lambda q: sorted(r["doc_id"] for r in search(index, {"q": q}, Model("ranked")).collect())
    assert found("runs") == [1, 2, 4] and found("cats") == [1, 2] and found("dogs") == [3, 4] and found("dog") == [5]  # dog is no word of the first batch
    with pytest.raises(ValueError):
        T.stems(docs.select("text"), "text", "other")
