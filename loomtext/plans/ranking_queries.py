"""Registered queries of feedback, learning to rank, diversification and metrics.

Stand-ins, as the tables hold no such data: spam score and page rank are functions of page_id, relevance is
page_id % 3 or ``labels.quality``, intents are hand-written term sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators import diversity, feedback, ltor, ranksvm
from loomtext.operators.ranksvm import Ranker
from loomtext.plans.compile import Model, search
from loomtext.plans.observed import measured, totals
from loomtext.plans.retrieval_queries import BASE, BM25_TF, INDRI, PAGES, documents_index, pages_index, ranked_sql, terms_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_FED = f"""{BASE}, {terms_sql('aich', 'that')},
m1 AS (SELECT doc_id, exp(sum(ln(p)) / 2.0::DOUBLE) AS score FROM (
  SELECT d.doc_id, {INDRI} AS p FROM (SELECT DISTINCT doc_id FROM tf) m JOIN d USING (doc_id) CROSS JOIN df CROSS JOIN s
  LEFT JOIN tf ON tf.doc_id = d.doc_id AND tf.term = df.term) GROUP BY doc_id),
best AS (SELECT doc_id, score FROM (SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, doc_id) AS r FROM m1) WHERE r <= 10),
ct AS MATERIALIZED (SELECT term, count(*)::DOUBLE AS ctf FROM t GROUP BY term),
ft AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM t WHERE doc_id IN (SELECT doc_id FROM best) GROUP BY doc_id, term),
ex AS MATERIALIZED (SELECT term, weight, rank FROM (SELECT term, weight, row_number() OVER (ORDER BY weight DESC, term) AS rank FROM (
  SELECT term, round(sum(tf / len(l)::DOUBLE * score * ln(c / ctf)), 8) AS weight FROM ft JOIN best USING (doc_id) JOIN d USING (doc_id) JOIN ct USING (term), s GROUP BY term)) WHERE rank <= 20)"""


@query(f"WITH {_FED} SELECT 'q1' AS qid, term, round(weight, 6) AS weight, rank FROM ex")
def prf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents_index(spark, sf_dir)
    best = search(index, {"q1": "aich that"}, Model("indri"), 10)
    return feedback.expansion_terms(index, best).withColumn("weight", F.round("weight", 6))


@query(f"WITH {_FED} SELECT 'q1' AS qid, '#WAND( ' || string_agg(printf('%.4f %s', weight, term), ' ' ORDER BY rank) || ' )' AS query FROM ex")
def prf_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = documents_index(spark, sf_dir)
    return feedback.expansion_query(feedback.expansion_terms(index, search(index, {"q1": "aich that"}, Model("indri"), 10)))


@query(
    f"""WITH {_FED}, a AS (SELECT term, 0.3::DOUBLE AS w FROM (VALUES ('aich'), ('that')) v(term)
  UNION ALL SELECT term, 0.4::DOUBLE * round(weight, 4) / (SELECT sum(round(weight, 4)) FROM ex) FROM ex),
xt AS MATERIALIZED (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM t WHERE term IN (SELECT term FROM a) GROUP BY doc_id, term) """
    + ranked_sql(
        f"""SELECT doc_id, exp(sum(w * ln(p))) AS score FROM (
        SELECT d.doc_id, w, {INDRI} AS p FROM (SELECT DISTINCT doc_id FROM xt) m JOIN d USING (doc_id) CROSS JOIN (SELECT a.term, w, ctf FROM a JOIN ct USING (term)) q CROSS JOIN s
        LEFT JOIN xt ON xt.doc_id = d.doc_id AND xt.term = q.term) GROUP BY doc_id"""
    )
)
def prf_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.expanded_search(documents_index(spark, sf_dir), {"q1": "aich that"}, Model("indri"))


_TERMS = {"q1": ["of", "the", "the"], "q2": ["que", "de"]}
_FEATURES = [f"f{i}" for i in range(1, 19)]


def _features(spark: SparkSession, sf_dir: str, terms: dict[str, list[str]] = _TERMS) -> DataFrame:
    index = pages_index(spark, sf_dir)
    spam = F.col("doc_id") % 100
    page_rank = F.when(F.col("doc_id") % 5 != 0, (F.col("doc_id") * 37 % 101).cast("double") / 10)
    return ltor.raw_features(index, terms, spam, page_rank, F.col("raw_url"))


def _features_sql() -> str:
    rows = ", ".join(f"('{q}', '{t}', {i})" for q, ts in _TERMS.items() for i, t in enumerate(ts))
    cols = []
    for j, field in enumerate(("body", "title", "url", "inlink")):
        at = f"FILTER (WHERE field = '{field}')"
        cols.append(f"any_value(bm25) {at} AS f{5 + 3 * j}, any_value(indri) {at} AS f{6 + 3 * j}, any_value(overlap) {at} AS f{7 + 3 * j}")
    return f"""{PAGES}, q AS (SELECT * FROM (VALUES {rows}) q(qid, term, i)),
x AS (SELECT q.qid, f.doc_id, f.field, f.l, coalesce(ft.tf, 0) AS tf, coalesce(fd.df, 0) AS df, coalesce(fd.ctf, 0) AS ctf, n, c, dc
  FROM q CROSS JOIN f JOIN fs USING (field) LEFT JOIN ft ON ft.doc_id = f.doc_id AND ft.field = f.field AND ft.term = q.term LEFT JOIN fd ON fd.field = f.field AND fd.term = q.term
  WHERE len(f.l) > 0),
y AS (SELECT qid, doc_id, field, sum(CASE WHEN tf > 0 THEN {BM25_TF} ELSE 0 END) AS bm25,
  CASE WHEN max(tf) = 0 OR min({INDRI}) <= 0 THEN 0::DOUBLE ELSE exp(sum(ln(greatest({INDRI}, 5e-324::DOUBLE))) / count(*)) END AS indri,
  (count(*) FILTER (WHERE tf > 0))::DOUBLE / count(*) AS overlap, sum(tf) AS hits, count(*)::DOUBLE AS k FROM x GROUP BY qid, doc_id, field),
z AS (SELECT qid, doc_id, {', '.join(cols)}, any_value(hits) FILTER (WHERE field = 'body') AS hits, any_value(k) AS k FROM y GROUP BY qid, doc_id),
sq AS (SELECT doc_id, sqrt(sum(tf * tf)) AS norm FROM ft WHERE field = 'body' GROUP BY doc_id),
raw AS MATERIALIZED (SELECT * FROM (SELECT qid, doc_id, (doc_id % 100)::DOUBLE AS f1, (length(raw_url) - length(replace(raw_url, '/', '')))::DOUBLE AS f2,
  contains(raw_url, 'wikipedia.org')::INTEGER::DOUBLE AS f3, CASE WHEN doc_id % 5 <> 0 THEN (doc_id * 37 % 101)::DOUBLE / 10 ELSE 0::DOUBLE END AS f4,
  {', '.join(f'f{i}' for i in range(5, 17))}, hits / (sqrt(k) * norm) AS f17, f15 AS f18,
  row_number() OVER (PARTITION BY qid ORDER BY round(f5, 6) DESC, doc_id) AS rank FROM z JOIN g USING (doc_id) JOIN sq USING (doc_id) WHERE hits > 0) WHERE rank <= 100)"""


_SCALED = ", ".join(f"round(coalesce(CASE WHEN max({f}) OVER w > min({f}) OVER w THEN ({f} - min({f}) OVER w) / (max({f}) OVER w - min({f}) OVER w) END, 0), 6) AS {f}" for f in _FEATURES)


@query(f"WITH {_features_sql()} SELECT qid, doc_id, rank, {', '.join(f'round({f}, 6) AS {f}' for f in _FEATURES)} FROM raw")
def ltor_features_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select("qid", "doc_id", "rank", *(F.round(f, 6).alias(f) for f in _FEATURES))


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ltor.scaled(_features(spark, sf_dir)).select("qid", "doc_id", "rank", *(F.round(f, 6).alias(f) for f in _FEATURES))


@query(f"WITH {_features_sql()} SELECT qid, doc_id, rank, {_SCALED} FROM raw WINDOW w AS (PARTITION BY qid)")
def ltor_features_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scaled(spark, sf_dir)


@query(
    f"WITH {_features_sql()}, sc AS (SELECT qid, doc_id, rank, {_SCALED} FROM raw WINDOW w AS (PARTITION BY qid)) "
    f"SELECT qid, doc_id, (doc_id % 3)::VARCHAR || ' qid:' || qid || ' ' || concat_ws(' ', {', '.join(f'printf($${f[1:]}:%.12f$$, {f})' for f in _FEATURES)}) || ' # ' || doc_id::VARCHAR AS line FROM sc"
)
def svmlight_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ltor.svm_light(_scaled(spark, sf_dir), F.col("doc_id") % 3)


@query()
def ltor_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trained on two queries, the ranker orders two others."""
    tests = ltor.scaled(_features(spark, sf_dir, {"q3": ["la", "el"], "q4": ["and", "of"]})).select("qid", "doc_id", "rank", *(F.round(f, 6).alias(f) for f in _FEATURES))
    return ltor.rerank(_scaled(spark, sf_dir), F.col("doc_id") % 3, tests=tests)


_WEIGHTS = tuple((i * 7 % 11 - 5) / 4 for i in range(1, 19))
_WEIGHED = " + ".join(f"({w}::DOUBLE * {f})" for w, f in zip(_WEIGHTS, _FEATURES))


@query(
    f"WITH {_features_sql()}, sc AS (SELECT qid, doc_id, rank, {_SCALED} FROM raw WINDOW w AS (PARTITION BY qid)), r AS (SELECT qid, doc_id, rank, round({_WEIGHED}, 6) AS score FROM sc) "
    "SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank, doc_id) AS new_rank FROM r"
)
def ltor_ranked_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking step under a model that is given."""
    return Ranker(tuple(_FEATURES), _WEIGHTS).rank(_scaled(spark, sf_dir))


@query(
    f"WITH {_features_sql()}, sc AS (SELECT qid, doc_id, rank, {_SCALED} FROM raw WINDOW w AS (PARTITION BY qid)), r AS MATERIALIZED (SELECT qid, doc_id, doc_id % 3 AS rel, round({_WEIGHED}, 6) AS s FROM sc) "
    """SELECT a.qid, a.doc_id, count(*) FILTER (WHERE a.rel > b.rel AND b.s >= a.s - 1::DOUBLE) AS n_over, count(*) FILTER (WHERE a.rel < b.rel AND b.s <= a.s + 1::DOUBLE) AS n_under
FROM r a JOIN r b USING (qid) GROUP BY a.qid, a.doc_id"""
)
def ltor_violated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document stands in a pair that a model violates, counted without pairs."""
    rows = _scaled(spark, sf_dir)
    score = Ranker(tuple(_FEATURES), _WEIGHTS).rank(rows).select("qid", "doc_id", (F.col("doc_id") % 3).cast("int").alias("rel"), F.col("score").alias("s"))
    return ranksvm.pair_counts(score, [0, 1, 2]).select("qid", "doc_id", "n_over", "n_under")


_RUNS = {"q1": "aich that", "q1.1": "aich", "q1.2": "that of", "q2": "of in", "q2.1": "of", "q2.2": "in to"}


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents_index(spark, sf_dir), _RUNS, Model("bm25"))


def _runs_sql() -> str:
    words = sorted({w for ts in _RUNS.values() for w in ts.split()})
    rows = ", ".join(f"('{q}', '{t}')" for q, ts in _RUNS.items() for t in ts.split())
    return f"""{BASE}, {terms_sql(*words)}, q AS (SELECT * FROM (VALUES {rows}) q(qid, term)),
runs AS MATERIALIZED (SELECT qid, doc_id, score, rank FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT qid, doc_id, round(sum({BM25_TF}), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN d USING (doc_id), s GROUP BY qid, doc_id)) WHERE rank <= 100),
cand AS MATERIALIZED (SELECT o.qid, o.doc_id, o.rank, o.score AS original, coalesce(a.score, 0) AS intent1, coalesce(b.score, 0) AS intent2 FROM runs o
  LEFT JOIN runs a ON a.qid = o.qid || '.1' AND a.doc_id = o.doc_id LEFT JOIN runs b ON b.qid = o.qid || '.2' AND b.doc_id = o.doc_id WHERE NOT contains(o.qid, '.')),
most AS (SELECT qid, greatest(sum(original), sum(intent1), sum(intent2)) AS most FROM cand GROUP BY qid)"""


@query(f"WITH {_runs_sql()} SELECT qid, doc_id, rank, round(original / most, 6) + 0.0 AS original, round(intent1 / most, 6) + 0.0 AS intent1, round(intent2 / most, 6) + 0.0 AS intent2 FROM cand JOIN most USING (qid)")
def diversity_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diversity.normalised(diversity.candidates(_runs(spark, sf_dir)))
    return found.select("qid", "doc_id", "rank", (F.round("original", 6) + 0.0).alias("original"), (F.round(F.get("intents", F.lit(0)), 6) + 0.0).alias("intent1"), (F.round(F.get("intents", F.lit(1)), 6) + 0.0).alias("intent2"))


_NORM = """nc AS MATERIALIZED (SELECT qid, doc_id, rank, original / most AS o, intent1 / most AS a, intent2 / most AS b FROM cand JOIN most USING (qid))"""


def _greedy_sql(state: str, score: str, step: str) -> str:
    """A greedy choice per query: ``state`` are the start values of x and y, ``score`` values a candidate, ``step`` moves x and y."""
    return f"""WITH RECURSIVE {_runs_sql()}, {_NORM},
g AS (
  SELECT qid, 0 AS at_step, {state}, NULL::BIGINT AS doc_id, NULL::DOUBLE AS score, []::BIGINT[] AS chosen FROM (SELECT DISTINCT qid FROM nc)
  UNION ALL
  SELECT qid, at_step + 1, {step}, best.d, best.s, list_append(chosen, best.d) FROM (
    SELECT qid, at_step, x, y, chosen, max({{'s': {score}, 'r': -rank, 'd': nc.doc_id, 'a': a, 'b': b}}) AS best
    FROM g JOIN nc USING (qid) WHERE at_step < 100 AND NOT list_contains(chosen, nc.doc_id) GROUP BY qid, at_step, x, y, chosen))
SELECT qid, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, at_step) AS rank FROM g WHERE at_step > 0"""


_LEAD = "(100 / 2.0::DOUBLE / (2 * x + 1)) >= (100 / 2.0::DOUBLE / (2 * y + 1))"
_QA, _QB = "(a * (100 / 2.0::DOUBLE / (2 * x + 1)))", "(b * (100 / 2.0::DOUBLE / (2 * y + 1)))"


@query(_greedy_sql("1.0::DOUBLE AS x, 1.0::DOUBLE AS y", "0.5::DOUBLE * o + 0.5::DOUBLE * ((a * x + b * y) / 2)", "x * (1 - best.a), y * (1 - best.b)"))
def xquad_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diversity.xquad(diversity.normalised(diversity.candidates(_runs(spark, sf_dir))), 0.5).withColumn("score", F.round("score", 6))


@query(
    _greedy_sql(
        "0.0::DOUBLE AS x, 0.0::DOUBLE AS y", f"CASE WHEN {_LEAD} THEN 0.5::DOUBLE * {_QA} + 0.5::DOUBLE * ({_QA} + {_QB} - {_QA}) ELSE 0.5::DOUBLE * {_QB} + 0.5::DOUBLE * ({_QA} + {_QB} - {_QB}) END",
        "x + CASE WHEN best.a + best.b > 0 THEN best.a / (best.a + best.b) ELSE 0 END, y + CASE WHEN best.a + best.b > 0 THEN best.b / (best.a + best.b) ELSE 0 END",
    )
)
def pm2_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diversity.pm2(diversity.normalised(diversity.candidates(_runs(spark, sf_dir))), 0.5).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {_runs_sql()}, rel AS (SELECT qid, doc_id, quality AS rel FROM labels, (VALUES ('q1'), ('q2')) v(qid)),
dcg AS (SELECT qid, sum((pow(2.0::DOUBLE, coalesce(rel, 0)) - 1) / log2(rank + 1.0::DOUBLE)) AS dcg FROM runs LEFT JOIN rel USING (qid, doc_id) WHERE rank <= 10 AND NOT contains(qid, '.') GROUP BY qid),
ideal AS (SELECT qid, sum((pow(2.0::DOUBLE, rel) - 1) / log2(place + 1.0::DOUBLE)) AS best FROM (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS place FROM rel) WHERE place <= 10 GROUP BY qid)
SELECT qid, round(coalesce(CASE WHEN best > 0 THEN dcg / best END, 0), 6) AS ndcg FROM dcg LEFT JOIN ideal USING (qid)"""
)
def ndcg_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    qrels = labels.select(F.explode(F.array(F.lit("q1"), F.lit("q2"))).alias("qid"), "doc_id", F.col("quality").alias("rel"))
    return diversity.ndcg(_runs(spark, sf_dir).filter(F.instr("qid", ".") == 0), qrels, 10)


@query(
    f"""WITH {_runs_sql()}, rel AS (SELECT qid, qid || '.' || (1 + doc_id % 2)::VARCHAR AS intent, doc_id, quality AS rel FROM labels, (VALUES ('q1'), ('q2')) v(qid)),
hits AS (SELECT r.qid, intent, count(*) AS n FROM runs r JOIN rel ON rel.qid = r.qid AND rel.doc_id = r.doc_id WHERE rank <= 20 AND rel > 0 GROUP BY r.qid, intent)
SELECT qid, round(avg(coalesce(n, 0) / 20.0::DOUBLE), 6) AS ia_precision FROM (SELECT DISTINCT qid, intent FROM rel) LEFT JOIN hits USING (qid, intent) GROUP BY qid"""
)
def ia_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    qrels = labels.select(F.explode(F.array(F.lit("q1"), F.lit("q2"))).alias("qid"), "doc_id", F.col("quality").alias("rel"))
    qrels = qrels.withColumn("intent", F.concat("qid", F.lit("."), (F.col("doc_id") % 2 + 1).cast("string")))
    return diversity.intent_precision(_runs(spark, sf_dir).filter(F.instr("qid", ".") == 0), qrels, 20)


@query(
    f"""WITH {BASE}, {terms_sql('aich', 'that')} SELECT 'dictionary' AS query, count(DISTINCT term) AS rows_out, TRUE AS ran FROM t
  UNION ALL SELECT 'search', least(100, (SELECT count(DISTINCT doc_id) FROM tf)), TRUE UNION ALL SELECT 'lengths', (SELECT count(*) FROM d), TRUE"""
)
def observed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three queries measured: the rows that each gave, and whether a stage ran and read rows for it."""
    index = documents_index(spark, sf_dir)
    made = {"dictionary": index.dictionary, "search": lambda: search(index, {"q1": "aich that"}, Model("bm25")), "lengths": index.lengths}
    return totals(measured(spark, made)).select("query", "rows_out", ((F.col("stages") > 0) & (F.col("rows_read") > 0)).alias("ran"))
