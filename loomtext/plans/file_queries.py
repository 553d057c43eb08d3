"""Registered queries of file readers and sinks, analysis switches, the query language's texts and index handling.

Lines are made of the tables and read by the same functions that read files; the sinks' lines are read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import collab, ltor, proximity
from loomtext.operators.index import Indexes
from loomtext.plans.ranking_queries import _features, _features_sql
from loomtext.plans.retrieval_queries import BASE, documents_index, listed
from loomtext.sources import database, files
from loomtext.storage import new_path

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _lines(spark: SparkSession, sf_dir: str, table: str, key: str, line: Column) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).alias("line_no"), line.alias("line"))


def _ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("external_id"))


@query("SELECT item_id::VARCHAR AS qid, trim(text, ' ') AS query FROM benchmark WHERE text IS NOT NULL")
def query_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as ``qid: query`` lines."""
    made = _lines(spark, sf_dir, "benchmark", "item_id", F.concat(F.col("item_id").cast("string"), F.lit(": "), F.col("text")))
    return files.queries(made.filter("line is not null")).select("qid", "query")


@query("SELECT item_id::VARCHAR AS qid, 'b' || (item_id % 7)::VARCHAR AS query FROM benchmark")
def training_query_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a third piece, which does not count."""
    i = F.col("item_id")
    return files.training_queries(_lines(spark, sf_dir, "benchmark", "item_id", F.concat(i.cast("string"), F.lit(": b"), (i % 7).cast("string"), F.lit(":rest")))).select("qid", "query")


@query("SELECT (item_id // 3)::VARCHAR AS qid, (item_id // 3)::VARCHAR || '.' || (item_id % 3 + 1)::VARCHAR AS intent, 'q' || item_id::VARCHAR AS query FROM benchmark WHERE (item_id // 3) % 2 = 0")
def intents_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three intents of each query; every other query is asked."""
    i = F.col("item_id")
    of = F.floor(i / 3).cast("long")
    made = _lines(spark, sf_dir, "benchmark", "item_id", F.concat(of.cast("string"), F.lit("."), (i % 3 + 1).cast("string"), F.lit(":q"), i.cast("string")))
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(of.alias("qid")).filter("qid % 2 = 0").select(F.col("qid").cast("string").alias("qid"))
    return files.intents(made, asked).select("qid", "intent", "query")


@query(
    """SELECT qid, external_id, score, rank FROM (SELECT 'q' || (doc_id % 5)::VARCHAR AS qid, 'd' || doc_id::VARCHAR AS external_id, (1000000 - doc_id)::DOUBLE / 8 AS score, row_number() OVER (PARTITION BY doc_id % 5 ORDER BY doc_id) AS rank FROM documents)
WHERE rank <= 20"""
)
def run_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty lines of each query of a run."""
    i = F.col("doc_id")
    line = F.concat_ws(" ", F.concat(F.lit("q"), (i % 5).cast("string")), F.lit("Q0"), F.concat(F.lit("d"), i.cast("string")), F.lit("1"), ((F.lit(1000000) - i) / 8).cast("string"), F.lit("run-1"))
    return files.run(_lines(spark, sf_dir, "documents", "doc_id", line), 20)


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN doc_id::DOUBLE / 16 ELSE 0::DOUBLE END AS page_rank FROM documents")
def page_rank_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    made = _lines(spark, sf_dir, "documents", "doc_id", F.concat(F.when(i % 4 == 1, "d").otherwise("unknown"), i.cast("string"), F.lit("\t"), (i / 16).cast("string")))
    return files.page_ranks(made, _ids(spark, sf_dir))


@query("SELECT max(item_id)::DOUBLE + 13 AS c13, max(item_id)::DOUBLE + 18 AS c18, max(item_id)::DOUBLE + 19 AS c19 FROM benchmark")
def metric_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty columns a row, of which the last row counts."""
    return files.metric_row(_lines(spark, sf_dir, "benchmark", "item_id", F.concat_ws(",", *((F.col("item_id") + c).cast("string") for c in range(20)))))


@query("SELECT 'p' || item_id::VARCHAR AS name, 'v=' || item_id::VARCHAR AS bad, item_id AS value FROM benchmark WHERE item_id % 3 = 0")
def parameter_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``key=value`` lines among comments, blanks and lines of three pieces."""
    i = F.col("item_id").cast("string")
    line = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit(" p"), i, F.lit(" = "), i, F.lit(" "))).when(F.col("item_id") % 3 == 1, F.concat(F.lit("# p"), i, F.lit("="), i)).otherwise(F.concat(F.lit("p"), i, F.lit("=v="), i))
    found = files.parameter_rows(_lines(spark, sf_dir, "benchmark", "item_id", line))
    return found.select("name", F.concat(F.lit("v="), F.col("value")).alias("bad"), F.col("value").cast("long").alias("value"))


@query("SELECT 'q' || (item_id % 2)::VARCHAR || ': ' || 'w' || item_id::VARCHAR AS line FROM benchmark")
def expansion_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    expanded = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.concat(F.lit("q"), (i % 2).cast("string")).alias("qid"), F.concat(F.lit("w"), i.cast("string")).alias("query"))
    return files.expansion_lines(expanded).select("line")


@query(f"WITH {_features_sql()} SELECT qid, doc_id, rank, (doc_id * 7 % 13)::DOUBLE AS score FROM raw")
def score_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores beside the feature rows that they belong to."""
    features = _features(spark, sf_dir)
    return files.scores_beside(features, features.select("qid", "doc_id", (F.col("doc_id") * 7 % 13).cast("double").alias("score"))).select("qid", "doc_id", "rank", "score")


@query("SELECT 'q' || (doc_id % 3)::VARCHAR AS qid, doc_id, 1 + (doc_id // 3) AS rank, 'q' || (doc_id % 3)::VARCHAR || ' Q0 d' || doc_id::VARCHAR || ' ' || (1 + doc_id // 3)::VARCHAR || ' 0.500000000000 run-1' AS line FROM documents")
def run_lines_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run lines of every document written as text, and read back from the files."""
    i = F.col("doc_id")
    results = _ids(spark, sf_dir).select(F.concat(F.lit("q"), (i % 3).cast("string")).alias("qid"), "external_id", F.lit(0.5).alias("score"), (F.floor(i / 3) + 1).cast("long").alias("rank"))
    path = new_path(spark, "run-lines")
    files.write_lines(files.run_lines(results), path)
    read = files.lines(spark, path)
    back = files.run(read).select("qid", F.substring("external_id", 2, 20).cast("long").alias("doc_id"))
    line = read.select("line", F.regexp_extract("line", " d([0-9]+) ", 1).cast("long").alias("doc_id"))
    return back.join(line, "doc_id").select("qid", "doc_id", (F.floor(i / 3) + 1).cast("long").alias("rank"), "line")


@query(
    f"WITH {_features_sql()}, w AS (SELECT qid, doc_id, rank, f1, f5, f18 FROM raw) SELECT qid, doc_id, rank, "
    + ", ".join(f"round(coalesce(CASE WHEN max({f}) OVER w2 > min({f}) OVER w2 THEN ({f} - min({f}) OVER w2) / (max({f}) OVER w2 - min({f}) OVER w2) END, 0), 6) AS {f}" for f in ("f1", "f5", "f18"))
    + " FROM w WINDOW w2 AS (PARTITION BY qid)"
)
def ltor_disabled_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but three features are disabled."""
    left = ltor.scaled(_features(spark, sf_dir), disabled=tuple(i for i in range(1, 19) if i not in (1, 5, 18)))
    return left.select("qid", "doc_id", "rank", *(F.round(f, 6).alias(f) for f in ("f1", "f5", "f18")))


@query(r"""SELECT doc_id, len(regexp_extract_all(regexp_replace(coalesce(text, '') || ' Ann''s dogs’S', '[''’][sS]\b', '', 'g'), '[\p{L}\p{N}]+'))::BIGINT AS n_tokens, len(list_distinct(regexp_extract_all(regexp_replace(coalesce(text, '') || ' Ann''s dogs’S', '[''’][sS]\b', '', 'g'), '[\p{L}\p{N}]+')))::BIGINT AS n_terms FROM documents""")
def possessives_and_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Possessives stripped and letters' case kept."""
    toks = T.tokens(F.concat(F.coalesce("text", F.lit("")), F.lit(" Ann's dogs’S")), lowercase=False, possessive=True)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", toks.alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_terms"))


@query(f"WITH {BASE} SELECT term, doc_id, count(*) AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM t WHERE term = 'aich' GROUP BY term, doc_id")
def index_opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index opened by its path, switched to, and one list scanned."""
    indexes = Indexes(spark)
    indexes.open(documents_index(spark, sf_dir, stop=T.STOPWORDS).path)
    path = documents_index(spark, sf_dir).path
    indexes.open(path)
    indexes.switch(path)
    return indexes.scan("aich").select(F.lit("aich").alias("term"), "doc_id", "tf", listed("positions").alias("positions"))


@query(f"WITH {BASE}, p AS (SELECT doc_id, list(pos ORDER BY pos) AS l FROM t WHERE term = 'the' GROUP BY doc_id) SELECT doc_id, list_min(list_filter(l, lambda x: x >= 50)) AS at_or_past, list_min(list_filter(l, lambda x: x > 100)) AS past, len(list_filter(l, lambda x: x > 100))::BIGINT AS to_come FROM p")
def location_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a list's cursor stands once it has been moved to a place, past a place, and how many are to come."""
    lists = documents_index(spark, sf_dir).postings(["the"])
    at = F.col("positions")
    return lists.select("doc_id", proximity.at_or_past(at, F.lit(50)).alias("at_or_past"), proximity.past(at, F.lit(100)).alias("past"), F.size(proximity.to_come(at, F.lit(100))).cast("long").alias("to_come"))


@query(f"WITH {BASE} SELECT doc_id, string_agg(pos::VARCHAR, ',' ORDER BY pos) || ',1000000' AS positions FROM t WHERE term = 'that' GROUP BY doc_id")
def posting_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place appended to every list of a term; one out of order raises."""
    lists = documents_index(spark, sf_dir).postings(["that"])
    return lists.select("doc_id", listed(proximity.appended(F.col("positions"), F.lit(1_000_000))).alias("positions"))


@query("SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey = 7 THEN 'new' ELSE o_orderpriority END AS title, o_custkey AS creator FROM orders UNION ALL SELECT -1, 'made', 3")
def created_and_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is made, and the creator of another gives it a new title."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    docs = orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("title"), F.col("o_custkey").alias("creator"))
    owner = docs.filter("doc_id = 7").first()
    shares = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("doc_id"), F.col("l_suppkey").alias("user_id"))
    renamed, _ = collab.rename(docs, shares, 7, owner["creator"] if owner else -1, "new")
    return collab.create(renamed, -1, 3, "made", "text").select("doc_id", "title", "creator")


@query("SELECT n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def tables_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The database source over files: tables by name, joined."""
    found = database.tables(spark, sf_dir, ("nation", "region"))
    return found["nation"].join(found["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
