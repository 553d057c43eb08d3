"""Registered queries of the corpus, Boolean, ranked, proximity and query-language operators, with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.functions.text import STOPWORDS
from loomtext.operators import proximity
from loomtext.operators.corpus import Corpus
from loomtext.operators.index import Index, index_of, kept_at, written_when
from loomtext.plans.bounded import bounded_search
from loomtext.plans.compile import Model, positional, search
from loomtext.plans.query import Node, parse, wrap

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Tokens, lengths and statistics of ``documents`` in SQL.
BASE = r"""
d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS l FROM documents),
t AS MATERIALIZED (SELECT doc_id, unnest(l) AS term, unnest(range(len(l)))::INTEGER AS pos FROM d),
s AS (SELECT count(*)::DOUBLE AS n, sum(len(l))::DOUBLE AS c, (count(*) FILTER (WHERE len(l) > 0))::DOUBLE AS dc FROM d)"""


def terms_sql(*terms: str) -> str:
    inside = ", ".join(f"'{t}'" for t in terms)
    return f"""
tf AS MATERIALIZED (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM t WHERE term IN ({inside}) GROUP BY doc_id, term),
df AS (SELECT term, count(*)::DOUBLE AS df, sum(tf)::DOUBLE AS ctf FROM tf GROUP BY term)"""


def ranked_sql(body: str, qid: str = "q1", k: int = 100) -> str:
    """body gives doc_id and score."""
    return f"""SELECT '{qid}' AS qid, doc_id, score, rank FROM (
  SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT doc_id, round(score, 6) AS score FROM ({body})))
WHERE rank <= {k}"""


BM25_TF = "ln((n - df + 0.5) / (df + 0.5)) * (tf / (tf + 1.2::DOUBLE * ((1.0::DOUBLE - 0.75::DOUBLE) + 0.75::DOUBLE * len(l)::DOUBLE / (c / dc))))"
INDRI = "((1.0::DOUBLE - 0.4::DOUBLE) * (coalesce(tf, 0) + 2500::DOUBLE * ctf / c) / (len(l)::DOUBLE + 2500::DOUBLE) + 0.4::DOUBLE * ctf / c)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def documents_index(spark: SparkSession, sf_dir: str, **options) -> Index:
    """The stored index of ``documents``."""
    return index_of(f"{sf_dir}/documents.parquet", Corpus.documents(spark, sf_dir, **options))


def listed(positions) -> F.Column:
    return F.array_join(F.transform(positions, lambda p: p.cast("string")), ",")


@query(f"WITH {BASE} SELECT doc_id, len(l)::BIGINT AS n_tokens, len(list_distinct(l))::BIGINT AS n_terms FROM d")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = Corpus.documents(spark, sf_dir).tokenised()
    return toks.select("doc_id", F.size("tok_body").cast("long").alias("n_tokens"), F.size(F.array_distinct("tok_body")).cast("long").alias("n_terms"))


@query(f"WITH {BASE} SELECT 'body' AS field, n::BIGINT AS num_docs, dc::BIGINT AS doc_count, c::BIGINT AS sum_tf, round(c / dc, 6) AS avg_len FROM s")
def field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_index(spark, sf_dir).field_stats().withColumn("avg_len", F.round("avg_len", 6))


@query(f"WITH {BASE} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS ctf FROM t GROUP BY term")
def term_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_index(spark, sf_dir).dictionary()


@query(f"WITH {BASE} SELECT term, doc_id, count(*) AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM t WHERE term IN ('aich', 'that', 'zzz') GROUP BY term, doc_id")
def postings_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_index(spark, sf_dir).postings(["aich", "that", "zzz"]).withColumn("positions", listed("positions"))


@query(f"WITH {BASE} SELECT doc_id, term, count(*) AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM t GROUP BY doc_id, term")
def term_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The term vectors of all documents."""
    return documents_index(spark, sf_dir).term_vectors().drop("dl").withColumn("positions", listed("positions"))


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


@query(f"WITH {BASE} SELECT doc_id, len(l)::BIGINT AS dl_all, len(list_filter(l, lambda x: x NOT IN ({_STOP})))::BIGINT AS dl_indexed FROM d")
def doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_index(spark, sf_dir, stop=STOPWORDS).lengths()


@query(f"WITH {BASE} SELECT term, df, ctf, rank FROM (SELECT term, df, ctf, row_number() OVER (ORDER BY df DESC, term) AS rank FROM (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS ctf FROM t WHERE term NOT IN ({_STOP}) GROUP BY term)) WHERE rank BETWEEN 11 AND 20")
def dictionary_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second page of ten of the dictionary by df, stopwords removed."""
    best = documents_index(spark, sf_dir, stop=STOPWORDS).dictionary().orderBy(F.desc("df"), "term").limit(20)
    from pyspark.sql.window import Window

    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("df"), "term")).cast("long")).filter("rank > 10")


@query("SELECT doc_id, doc_id::VARCHAR AS external_id FROM documents WHERE doc_id::VARCHAR IN ('3', '17', 'none')")
def external_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External to internal ids: an exact match; what is unknown has no row."""
    docs = Corpus.documents(spark, sf_dir).docs
    wanted = spark.createDataFrame([("3",), ("17",), ("none",)], "external_id string")
    return docs.select("doc_id", F.col("doc_id").cast("string").alias("external_id")).join(wanted, "external_id", "left_semi").select("doc_id", "external_id")


def _search(spark, sf_dir, model: str, text: str, **options) -> DataFrame:
    return search(documents_index(spark, sf_dir, **options), {"q1": text}, Model(model))


@query(f"WITH {BASE}, {terms_sql('aich', 'aien')} " + ranked_sql("SELECT doc_id, 1.0::DOUBLE AS score FROM tf GROUP BY doc_id HAVING count(*) = 2"))
def unranked_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "unranked", "#and(aich aien)")


@query(f"WITH {BASE}, {terms_sql('aich', 'aien')} " + ranked_sql("SELECT DISTINCT doc_id, 1.0::DOUBLE AS score FROM tf"))
def unranked_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "unranked", "aich aien")


@query(f"WITH {BASE}, {terms_sql('of', 'that', 'the')} " + ranked_sql("SELECT doc_id, min(tf) AS score FROM tf GROUP BY doc_id HAVING count(*) = 3"))
def ranked_and_min_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "ranked", "#and(of that the)")


@query(f"WITH {BASE}, {terms_sql('aich', 'that', 'aien')} " + ranked_sql("SELECT doc_id, max(tf) AS score FROM tf GROUP BY doc_id"))
def ranked_or_max_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "ranked", "#or(aich that aien)")


@query(f"WITH {BASE} SELECT doc_id, count(*) AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM t WHERE term IN ('aich', 'aien', 'ach') GROUP BY doc_id")
def syn_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _postings(spark, sf_dir, "syn", "aich", "aien", "ach")


def _postings(spark, sf_dir, op: str, *terms: str, distance: int = 0) -> DataFrame:
    node = Node(op, tuple(Node("term", term=t) for t in terms), distance=distance)
    return positional(documents_index(spark, sf_dir), node).withColumn("positions", listed("positions"))


@query(f"WITH {BASE}, {terms_sql('aich', 'aien', 'that')} " + ranked_sql(f"SELECT doc_id, sum({BM25_TF}) AS score FROM tf JOIN df USING (term) JOIN d USING (doc_id), s GROUP BY doc_id"))
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "bm25", "aich aien that")


def _indri_sql(weights: dict[str, float], how: str) -> str:
    total = sum(weights.values())
    rows = ", ".join(f"('{t}', {w}::DOUBLE)" for t, w in weights.items())
    score = f"exp(sum(w * ln(p)) / {total}::DOUBLE)" if how == "wand" else f"sum(w / {total}::DOUBLE * p)"
    return f"WITH {BASE}, {terms_sql(*weights)} " + ranked_sql(
        f"""SELECT doc_id, {score} AS score FROM (
        SELECT d.doc_id, w, {INDRI} AS p FROM (SELECT DISTINCT doc_id FROM tf) m JOIN d USING (doc_id)
        CROSS JOIN (SELECT * FROM (VALUES {rows}) q(term, w) JOIN df USING (term)) q CROSS JOIN s
        LEFT JOIN tf ON tf.doc_id = d.doc_id AND tf.term = q.term) GROUP BY doc_id"""
    )


@query(_indri_sql({"aich": 1.0, "aien": 1.0, "that": 1.0}, "wand"))
def indri_and_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "indri", "aich aien that")


@query(_indri_sql({"aich": 0.7, "aien": 0.2, "that": 0.1}, "wand"))
def indri_wand_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "indri", "#wand(0.7 aich 0.2 aien 0.1 that)")


@query(_indri_sql({"aich": 0.7, "aien": 0.2, "that": 0.1}, "wsum"))
def indri_wsum_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "indri", "#wsum(0.7 aich 0.2 aien 0.1 that)")


def pages_corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    """``pages`` with fields: the title element, the url, the text of paragraphs (body) and of anchors (inlink)."""
    html = F.col("html")
    joined = lambda pattern: F.array_join(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), " ")
    docs = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        F.col("page_id").alias("doc_id"), F.col("url").alias("raw_url"), F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"),
        joined("<p>([^<]*)").alias("body"), joined("<a [^>]*>([^<]*)</a>").alias("inlink"),
    )
    return Corpus(docs, fields={"title": "title", "url": "raw_url", "body": "body", "inlink": "inlink"})


def pages_index(spark: SparkSession, sf_dir: str) -> Index:
    """The stored index of ``pages``, which keeps the url as it is."""
    return index_of(f"{sf_dir}/pages.parquet", pages_corpus(spark, sf_dir), ("raw_url",))


PAGES = r"""
g AS MATERIALIZED (SELECT page_id AS doc_id, url AS raw_url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  array_to_string(regexp_extract_all(html, '<p>([^<]*)', 1), ' ') AS body, array_to_string(regexp_extract_all(html, '<a [^>]*>([^<]*)</a>', 1), ' ') AS inlink FROM pages),
f AS MATERIALIZED (
  SELECT doc_id, 'title' AS field, regexp_extract_all(lower(title), '[\p{L}\p{N}]+') AS l FROM g
  UNION ALL SELECT doc_id, 'url', regexp_extract_all(lower(raw_url), '[\p{L}\p{N}]+') FROM g
  UNION ALL SELECT doc_id, 'body', regexp_extract_all(lower(body), '[\p{L}\p{N}]+') FROM g
  UNION ALL SELECT doc_id, 'inlink', regexp_extract_all(lower(inlink), '[\p{L}\p{N}]+') FROM g),
fs AS (SELECT field, count(*)::DOUBLE AS n, sum(len(l))::DOUBLE AS c, (count(*) FILTER (WHERE len(l) > 0))::DOUBLE AS dc FROM f GROUP BY field),
ft AS MATERIALIZED (SELECT doc_id, field, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, field, unnest(l) AS term FROM f) GROUP BY ALL),
fd AS MATERIALIZED (SELECT field, term, count(*)::DOUBLE AS df, sum(tf)::DOUBLE AS ctf FROM ft GROUP BY field, term)"""


@query(f"WITH {PAGES}, q AS (SELECT * FROM (VALUES ('of', 'body'), ('the', 'title'), ('en', 'url')) q(term, field)) " + ranked_sql(f"SELECT ft.doc_id, sum({BM25_TF}) AS score FROM q JOIN ft USING (term, field) JOIN fd USING (term, field) JOIN fs USING (field) JOIN f ON f.doc_id = ft.doc_id AND f.field = q.field GROUP BY ft.doc_id"))
def multi_field_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(pages_index(spark, sf_dir), {"q1": "of the.title en.url"}, Model("bm25"))


_NEAR2 = """
o AS (SELECT doc_id, term, pos, lag(term) OVER w AS before, lag(pos) OVER w AS from_pos FROM t WHERE term IN ('of', 'the') WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
near AS MATERIALIZED (SELECT doc_id, pos FROM o WHERE term = 'the' AND before = 'of' AND pos - from_pos <= 2)"""


@query(f"WITH {BASE}, {_NEAR2} SELECT doc_id, count(*) AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM near GROUP BY doc_id")
def near2_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window form over the token table."""
    return proximity.near_two(documents_index(spark, sf_dir).tokens(["of", "the"]), "of", "the", 2).withColumn("positions", listed("positions"))


@query(f"WITH {BASE}, {_NEAR2}, tf AS (SELECT doc_id, count(*)::DOUBLE AS tf FROM near GROUP BY doc_id), df AS (SELECT count(*)::DOUBLE AS df FROM tf) " + ranked_sql(f"SELECT doc_id, {BM25_TF} AS score FROM tf JOIN d USING (doc_id), s, df"))
def near2_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold form, scored: its df is that of the pairs."""
    return _search(spark, sf_dir, "bm25", "#near/2(of the)")


def lists_sql(*terms: str) -> str:
    names = "abcdefg"
    cols = ", ".join(f"list_filter(range(len(l)), lambda i: l[i + 1] = '{t}')::INTEGER[] AS {n}" for t, n in zip(terms, names))
    return f"p AS MATERIALIZED (SELECT * FROM (SELECT doc_id, {cols} FROM d) WHERE {' AND '.join(f'len({n}) > 0' for n in names[: len(terms)])})"


@query(
    f"""WITH RECURSIVE {BASE}, {lists_sql("the", "of", "and")},
st AS (
  SELECT doc_id, 1 AS i, -1 AS skip, NULL::INTEGER AS hit FROM p
  UNION ALL
  SELECT doc_id, i + 1,
    CASE WHEN x <= skip THEN skip WHEN y IS NULL THEN 2147483647 WHEN y - x > 4 THEN x WHEN z IS NULL THEN 2147483647 WHEN z - y > 4 THEN y ELSE z END,
    CASE WHEN x > skip AND y - x <= 4 AND z - y <= 4 THEN z END
  FROM (SELECT *, list_min(list_filter(c, lambda v: v > y)) AS z FROM (
    SELECT st.doc_id, i, skip, a[i] AS x, c, list_min(list_filter(b, lambda v: v > a[i])) AS y FROM st JOIN p USING (doc_id) WHERE i <= len(a)))
)
SELECT doc_id, count(hit) AS tf, string_agg(hit::VARCHAR, ',' ORDER BY hit) AS positions FROM st WHERE hit IS NOT NULL GROUP BY doc_id"""
)
def near3_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _postings(spark, sf_dir, "near", "the", "of", "and", distance=4)


@query(
    f"""WITH RECURSIVE {BASE}, {lists_sql("of", "that", "the")},
st AS (
  SELECT doc_id, 1 AS i, 1 AS j, 1 AS k, NULL::INTEGER AS hit FROM p
  UNION ALL
  SELECT doc_id, i + (ok OR x = low)::INTEGER, j + (ok OR y = low)::INTEGER, k + (ok OR z = low)::INTEGER, CASE WHEN ok THEN high END
  FROM (SELECT *, high - low < 8 AS ok FROM (SELECT *, least(x, y, z) AS low, greatest(x, y, z) AS high FROM (
    SELECT st.doc_id, i, j, k, a[i] AS x, b[j] AS y, c[k] AS z FROM st JOIN p USING (doc_id) WHERE i <= len(a) AND j <= len(b) AND k <= len(c))))
)
SELECT doc_id, count(hit) AS tf, string_agg(hit::VARCHAR, ',' ORDER BY hit) AS positions FROM st WHERE hit IS NOT NULL GROUP BY doc_id"""
)
def window_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _postings(spark, sf_dir, "window", "of", "that", "the", distance=8)


@query(
    f"""WITH {BASE}, {_NEAR2}, x AS MATERIALIZED (
  SELECT doc_id, 1 AS arg, count(*)::DOUBLE AS tf FROM near GROUP BY doc_id
  UNION ALL SELECT doc_id, 2, count(*)::DOUBLE FROM t WHERE term IN ('aich', 'aien') GROUP BY doc_id
  UNION ALL SELECT doc_id, 3, count(*)::DOUBLE FROM t WHERE term = 'that' GROUP BY doc_id),
df AS (SELECT arg, count(*)::DOUBLE AS df, sum(tf)::DOUBLE AS ctf FROM x GROUP BY arg) """
    + ranked_sql(
        f"""SELECT doc_id, exp(sum(w * ln(p)) / 3.0::DOUBLE) AS score FROM (
        SELECT d.doc_id, 1.0::DOUBLE AS w, {INDRI} AS p FROM (SELECT DISTINCT doc_id FROM x) m JOIN d USING (doc_id) CROSS JOIN df CROSS JOIN s
        LEFT JOIN x ON x.doc_id = d.doc_id AND x.arg = df.arg) GROUP BY doc_id"""
    )
)
def structured_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "indri", "#and(#near/2(of the) #syn(aich aien) that)")


@query(f"WITH {BASE}, {terms_sql('aich')} " + ranked_sql(f"SELECT doc_id, {BM25_TF} AS score FROM tf JOIN df USING (term) JOIN d USING (doc_id), s"))
def single_term_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "bm25", "#sum(#syn(aich))")


@query(
    f"""WITH {BASE}, {terms_sql('aich', 'aien')}, s2 AS (SELECT n, sum(len(list_filter(l, lambda x: x NOT IN ({_STOP}))))::DOUBLE AS c,
  (count(*) FILTER (WHERE len(list_filter(l, lambda x: x NOT IN ({_STOP}))) > 0))::DOUBLE AS dc FROM d, s GROUP BY n) """
    + ranked_sql(f"SELECT doc_id, sum({BM25_TF}) AS score FROM tf JOIN df USING (term) JOIN d USING (doc_id), s2 GROUP BY doc_id")
)
def stopword_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stopwords leave the query and the collection length, but their positions count in a document's length."""
    return _search(spark, sf_dir, "bm25", "the aich #near/1(of the) aien", stop=STOPWORDS)


@query(
    f"WITH {BASE}, {terms_sql('aich', 'aien', 'that')} "
    + " UNION ALL ".join(
        ranked_sql(f"SELECT doc_id, sum({BM25_TF}) AS score FROM tf JOIN df USING (term) JOIN d USING (doc_id), s WHERE term IN ({ts}) GROUP BY doc_id", q, 10)
        for q, ts in (("q1", "'aich', 'that'"), ("q2", "'aien', 'that'"))
    )
)
def query_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two queries in one plan."""
    return search(documents_index(spark, sf_dir), {"q1": "aich that", "q2": "aien that"}, Model("bm25"), k=10)


def tree_text(text: str, model: str) -> str:
    return str(parse(wrap(text, model)))


@query(
    f"WITH {BASE}, {terms_sql('aich', 'aien', 'that')}, r AS (" + ranked_sql(f"SELECT doc_id, sum({BM25_TF}) AS score FROM tf JOIN df USING (term) JOIN d USING (doc_id), s GROUP BY doc_id")
    + ") SELECT qid, rank, printf('%s Q0 %s %d %.12f run-1', qid, doc_id::VARCHAR, rank, score) AS line FROM r UNION ALL SELECT 'q2', 1, 'q2 Q0 dummy 1 0 run-1'"
)
def trec_run_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of two queries, of which the second is all stopwords."""
    from loomtext.sources import files

    results = bm25_topk(spark, sf_dir).withColumn("external_id", F.col("doc_id").cast("string"))
    trees = {"q1": parse(wrap("aich aien that", "bm25")), "q2": parse(wrap("the of", "bm25"), STOPWORDS)}
    asked = spark.createDataFrame([(q, t is None) for q, t in trees.items()], "qid string, empty boolean")
    return files.run_lines(results, asked)


@query("SELECT doc_id, quality AS rel, 'q' || (doc_id % 3)::VARCHAR AS qid FROM labels WHERE doc_id > 0")
def qrel_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels`` written as qrel lines and read back."""
    from loomtext.sources import files

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    made = labels.select(F.lit(0).alias("line_no"), F.concat_ws(" ", F.concat(F.lit("q"), (F.col("doc_id") % 3).cast("string")), F.lit("0"), F.col("doc_id").cast("string"), F.col("quality").cast("string")).alias("line"))
    ids = Corpus.documents(spark, sf_dir).docs.select("doc_id", F.col("doc_id").cast("string").alias("external_id"))
    return files.qrels(made, ids).select("doc_id", "rel", "qid")


@query(f"WITH {PAGES} SELECT field, n::BIGINT AS num_docs, dc::BIGINT AS doc_count, c::BIGINT AS sum_tf, round(c / dc, 6) AS avg_len FROM fs")
def list_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields and their statistics."""
    return pages_index(spark, sf_dir).field_stats().withColumn("avg_len", F.round("avg_len", 6))


@query("SELECT page_id, url AS raw_url, page_id::VARCHAR AS external_id, (page_id % 100)::BIGINT AS spam_score FROM pages")
def stored_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored attributes of all internal ids; the spam score is a stand-in."""
    stored = pages_index(spark, sf_dir).table("documents")
    return stored.select(F.col("doc_id").alias("page_id"), "raw_url", F.col("doc_id").cast("string").alias("external_id"), (F.col("doc_id") % 100).alias("spam_score"))


@query(
    f"""WITH {BASE}, {terms_sql('aich', 'aien', 'that', 'of')}, r AS (
  SELECT 'q1' AS qid, doc_id, round(sum({BM25_TF}), 6) AS score FROM tf JOIN df USING (term) JOIN d USING (doc_id), s WHERE term IN ('aich', 'that') GROUP BY doc_id)
SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank BETWEEN 21 AND 30"""
)
def paged_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of ten results."""
    return search(documents_index(spark, sf_dir), {"q1": "aich that"}, Model("bm25"), k=30).filter("rank > 20")


_BATCHES = 5


def segmented_index(spark: SparkSession, sf_dir: str) -> Index:
    """An index of ``documents`` that has grown by batches: a base, then one batch after another, small segments merged. Opened by its path alone."""
    docs, source = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{sf_dir}/documents.parquet"
    path = kept_at(spark, "segments", source, written_when(spark, source))
    batch = lambda i: docs.filter(F.pmod("doc_id", F.lit(_BATCHES)) == i)  # noqa: E731  all together are the table
    try:
        index = Index.open(spark, path)
    except ValueError:
        index = Index.build(Corpus(batch(0)), path)
    for i in range(index.manifest["appended"], _BATCHES):
        index = index.append(batch(i))
    return Index.open(spark, path)


@query(f"WITH {BASE}, {terms_sql('aich', 'aien', 'that')} " + ranked_sql(f"SELECT doc_id, sum({BM25_TF}) AS score FROM tf JOIN df USING (term) JOIN d USING (doc_id), s GROUP BY doc_id"))
def segments_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(segmented_index(spark, sf_dir), {"q1": "aich aien that"}, Model("bm25"))


@query(f"WITH {BASE} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS ctf FROM t GROUP BY term")
def segments_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary summed over segments."""
    return segmented_index(spark, sf_dir).dictionary()


@query(f"WITH {BASE} SELECT 'body' AS field, n::BIGINT AS num_docs, dc::BIGINT AS doc_count, c::BIGINT AS sum_tf, round(c / dc, 6) AS avg_len FROM s")
def segments_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics summed over segments, from the manifest."""
    return segmented_index(spark, sf_dir).field_stats().withColumn("avg_len", F.round("avg_len", 6))


@query(f"WITH {BASE}, {terms_sql('aich', 'aien', 'that')} " + ranked_sql(f"SELECT doc_id, sum({BM25_TF}) AS score FROM tf JOIN df USING (term) JOIN d USING (doc_id), s GROUP BY doc_id", k=10))
def bounded_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best by document ranges and their bounds, over the segments."""
    return bounded_search(segmented_index(spark, sf_dir), {"q1": "aich aien that"}, k=10).rows


@query(
    f"WITH {BASE}, {terms_sql('aich', 'aien', 'that', 'the')} "
    + " UNION ALL ".join(
        ranked_sql(f"SELECT doc_id, sum({BM25_TF} * CASE WHEN term = 'aien' THEN {n} ELSE 1 END) AS score FROM tf JOIN df USING (term) JOIN d USING (doc_id), s WHERE term IN ({ts}) GROUP BY doc_id", q, 10)
        for q, ts, n in (("q1", "'aich', 'that'", 1), ("q2", "'aien', 'that', 'the'", 2))
    )
)
def bounded_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two queries, one with a term twice and one that lowers scores, by ranges that both share."""
    return bounded_search(documents_index(spark, sf_dir), {"q1": "aich that", "q2": "aien aien that the"}, k=10).rows


_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '" + T.word_pattern("", "").replace("'", "''") + "')"


@query(f"WITH w AS MATERIALIZED (SELECT doc_id, {_WORDS} AS l FROM documents) SELECT doc_id, len(l)::BIGINT AS n_tokens, len(list_distinct(l))::BIGINT AS n_terms, md5(array_to_string(l, ' ')) AS digest FROM w")
def word_break_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by the word-break rules."""
    toks = Corpus.documents(spark, sf_dir, rule="words").tokenised()
    return toks.select("doc_id", F.size("tok_body").cast("long").alias("n_tokens"), F.size(F.array_distinct("tok_body")).cast("long").alias("n_terms"), F.md5(F.array_join("tok_body", " ")).alias("digest"))


_MARKED = r"""CASE doc_id % 4 WHEN 0 THEN replace(text, ' the ', ' the''s 3.14 ') WHEN 1 THEN replace(text, ' of ', ' 1,000.5_of 漢字かな ') WHEN 2 THEN replace(text, ' and ', ' wi-fi U.S.A. カタカナ ') ELSE text END"""


@query(f"WITH m AS (SELECT doc_id, {_MARKED} AS text FROM documents), w AS MATERIALIZED (SELECT doc_id, {_WORDS} AS l FROM m) SELECT doc_id, len(l)::BIGINT AS n_tokens, md5(array_to_string(l, ' ')) AS digest FROM w")
def word_break_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over texts with apostrophes, numbers, ideographs and katakana put in, as the documents have few."""
    docs = Corpus.documents(spark, sf_dir).docs
    toks = Corpus(docs.select("doc_id", F.expr(_MARKED.replace("''s", "\\'s")).alias("text")), rule="words").tokenised()
    return toks.select("doc_id", F.size("tok_body").cast("long").alias("n_tokens"), F.md5(F.array_join("tok_body", " ")).alias("digest"))


def _forms_sql() -> str:
    """Forms of a word w in SQL, in order, as the stemmer tries them."""
    cases = []
    for ending, put in T.INFLECTIONS:
        base = f"left(w, len(w) - {len(ending)})"
        ends = f"ends_with(w, '{ending}')" + (" AND NOT ends_with(w, 'ss')" if ending == "s" else "")
        for p in put:
            cases.append(f"CASE WHEN {ends} AND len({base}) > 1 AND right({base}, 1) = substr({base}, len({base}) - 1, 1) THEN left({base}, len({base}) - 1) END" if p == "=" else f"CASE WHEN {ends} THEN {base} || '{p}' END")
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL AND len(x) >= {T.LEAST_STEM})"


_FORMS = f"""v AS MATERIALIZED (SELECT DISTINCT term AS w FROM t), f AS (SELECT w, unnest(forms) AS form, generate_subscripts(forms, 1) AS i FROM (SELECT w, {_forms_sql()} AS forms FROM v)),
k AS (SELECT w, min_by(form, i) AS form FROM f WHERE form IN (SELECT w FROM v) GROUP BY w), st AS MATERIALIZED (SELECT v.w AS word, coalesce(form, v.w) AS stem FROM v LEFT JOIN k USING (w))"""


@query(f"WITH {BASE}, {_FORMS} SELECT word, stem FROM st")
def dictionary_stem_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form of every word of ``documents``, the documents' own words being the lexicon."""
    words = documents_index(spark, sf_dir).dictionary().select(F.col("term").alias("word"))
    return T.dictionary_stems(words, "word", words)


@query(
    f"WITH {BASE}, {_FORMS}, tf AS MATERIALIZED (SELECT doc_id, stem AS term, count(*)::DOUBLE AS tf FROM t JOIN st ON word = term WHERE stem IN (SELECT coalesce((SELECT stem FROM st WHERE word = q), q) FROM (VALUES ('ends'), ('that')) v(q)) GROUP BY ALL), "
    f"df AS (SELECT term, count(*)::DOUBLE AS df, sum(tf)::DOUBLE AS ctf FROM tf GROUP BY term) " + ranked_sql(f"SELECT doc_id, sum({BM25_TF}) AS score FROM tf JOIN df USING (term) JOIN d USING (doc_id), s GROUP BY doc_id", k=20)
)
def dictionary_stem_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search whose texts and query are stemmed by the index's own words."""
    return search(documents_index(spark, sf_dir, stemmer="dictionary"), {"q1": "ends that"}, Model("bm25"), k=20)


@query(f"WITH {BASE}, {_FORMS} SELECT word, CASE WHEN word IN ('ends', 'thes', 'reed') THEN word ELSE stem END AS stem FROM st")
def dictionary_stems_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with words that are left as they are."""
    words = documents_index(spark, sf_dir).dictionary().select(F.col("term").alias("word"))
    return T.dictionary_stems(words, "word", words, ("ends", "thes", "reed"))


def _trees(queries: DataFrame, model: str, stop: tuple[str, ...]) -> DataFrame:
    """qid, tree: the rewritten tree of every query (qid, text), ``nothing`` where nothing is left, ``error`` where the parser refuses."""
    @F.pandas_udf("string")
    def tree(texts: pd.Series) -> pd.Series:
        def one(text):
            try:
                return str(parse(wrap(text, model), stop) or "nothing")
            except ValueError:
                return "error"

        return texts.map(one)

    return queries.select("qid", tree("text").alias("tree"))


@query(
    f"""WITH w AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: len(x) > 1) AS l FROM benchmark),
k AS (SELECT item_id, l, list_filter(l[1:1], lambda x: x NOT IN ({_STOP})) AS a, list_filter(l[2:3], lambda x: x NOT IN ({_STOP})) AS b, list_filter(l[4:6], lambda x: x NOT IN ({_STOP})) AS c FROM w),
p AS (SELECT item_id, l, list_transform(a, lambda x: '#score(' || x || '.body)')
  || CASE len(b) WHEN 0 THEN [] WHEN 1 THEN ['#score(' || b[1] || '.body)'] ELSE ['#score(#near/2(' || b[1] || '.body ' || b[2] || '.body))'] END
  || CASE len(c) WHEN 0 THEN [] WHEN 1 THEN ['#score(' || c[1] || '.title)'] ELSE ['#and(' || array_to_string(list_transform(c, lambda x: '#score(' || x || '.title)'), ' ') || ')'] END AS parts FROM k)
SELECT item_id AS qid, CASE WHEN item_id % 5 = 4 THEN 'error' WHEN len(parts) = 0 THEN 'nothing' WHEN len(parts) = 1 THEN parts[1] ELSE '#sum(' || array_to_string(parts, ' ') || ')' END AS tree FROM p WHERE len(l) >= 6"""
)
def query_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first words of every benchmark text as a structured query, parsed, pruned of stopwords and of operators that lose their arguments; one in five has a positional operator over a scored one."""
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda x: F.length(x) > 1)
    at = lambda i: F.get("w", F.lit(i))
    near = F.concat(F.lit(" #near/2("), at(1), F.lit(" "), at(2), F.lit(")"))
    fields = F.concat(F.lit(" #and("), at(3), F.lit(".title "), at(4), F.lit(".title "), at(5), F.lit(".title)"))
    refused = F.concat(F.lit(" #window/8("), at(1), F.lit("zz #and("), at(2), F.lit("zz x))"))  # no stopwords, so both operators stay
    rows = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("qid"), words.alias("w")).filter(F.size("w") >= 6)
    text = F.concat(at(0), F.when(F.col("qid") % 5 == 4, refused).otherwise(F.concat(near, fields)))
    return _trees(rows.select("qid", text.alias("text")), "bm25", STOPWORDS)
