"""Files of the retrieval engine: parameters, queries, qrels, runs, intents, page ranks, scores, and their sinks.

All but parameters are read as DataFrames of lines, so a file of any size is read in parallel; where order within a
file matters, ``line_no`` is taken from the position of each line in its file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, line of a text file, in order: the offset of a line is its partition and place there."""
    text = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    return text.select("line_no", F.col("value").alias("line"))


def parameters(text: str, required: tuple[str, ...] = ()) -> dict[str, str]:
    """``key=value`` lines; comments, blanks and lines that are not exactly two parts are skipped."""
    pairs = [line.split("=") for line in text.splitlines() if line.strip() and not line.lstrip().startswith("#")]
    found = {p[0].strip(): p[1].strip() for p in pairs if len(p) == 2}
    missing = [k for k in required if k not in found]
    if missing:
        raise ValueError(f"missing parameters: {', '.join(missing)}")
    return found


def parameter_rows(rows: DataFrame) -> DataFrame:
    """name, value of ``key=value`` lines (line_no, line), read as ``parameters`` does; of a name that comes again the last counts."""
    parts = F.split("line", "=", -1)
    good = (F.trim("line") != "") & ~F.ltrim("line").startswith("#") & (F.size(parts) == 2)
    pairs = rows.filter(good).select("line_no", F.trim(F.get(parts, F.lit(0))).alias("name"), F.trim(F.get(parts, F.lit(1))).alias("value"))
    return pairs.groupBy("name").agg(F.max_by("value", "line_no").alias("value"))


def queries(rows: DataFrame) -> DataFrame:
    """qid, query: split at the first colon; a line without one raises when it is read."""
    at = F.instr("line", ":")
    checked = F.when(at > 0, F.trim(F.substring("line", at + 1, F.length("line")))).otherwise(F.raise_error(F.concat(F.lit("no colon in query line: "), F.col("line"))))
    return rows.filter(F.trim("line") != "").select("line_no", F.trim(F.substring_index("line", ":", 1)).alias("qid"), checked.alias("query"))


def training_queries(rows: DataFrame) -> DataFrame:
    """qid, query: split at every colon, of which the second piece counts."""
    parts = F.split("line", ":")
    return rows.filter(F.size(parts) > 1).select("line_no", F.trim(parts[0]).alias("qid"), F.trim(parts[1]).alias("query"))


def qrels(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """qid, doc_id, rel: known documents with an internal id above 0. ids: doc_id, external_id."""
    p = F.split(F.trim("line"), r"\s+")
    parsed = rows.filter(F.size(p) >= 4).select(p[0].alias("qid"), p[2].alias("external_id"), p[3].cast("int").alias("rel"))
    return parsed.join(ids, "external_id").filter(F.col("doc_id") > 0).select("qid", "doc_id", "rel")


def run(rows: DataFrame, depth: int | None = None) -> DataFrame:
    """qid, external_id, score, rank of a run file, the first ``depth`` lines of each query in file order."""
    p = F.split(F.trim("line"), r"\s+")
    parsed = rows.filter(F.size(p) >= 5).select("line_no", p[0].alias("qid"), p[2].alias("external_id"), p[4].cast("double").alias("score"))
    ranked = parsed.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("line_no")).cast("long")).drop("line_no")
    return ranked.filter(F.col("rank") <= depth) if depth is not None else ranked


def intents(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """qid, intent, query of ``qid.k:query`` lines for the queries asked (qid), by exact id."""
    read = queries(rows).withColumnRenamed("qid", "intent")
    return read.withColumn("qid", F.split_part("intent", F.lit("."), F.lit(1))).join(asked.select("qid").distinct(), "qid", "left_semi").select("qid", "intent", "query")


def page_ranks(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, page_rank for every document; unknown ids are skipped, unlisted documents have 0."""
    p = F.split("line", "\t")
    listed = rows.filter(F.size(p) == 2).select(p[0].alias("external_id"), p[1].cast("double").alias("page_rank"))
    return ids.join(listed, "external_id", "left").select("doc_id", F.coalesce("page_rank", F.lit(0.0)).alias("page_rank"))


def metric_row(rows: DataFrame, columns: tuple[int, ...] = (13, 18, 19)) -> DataFrame:
    """Columns of the last row of a comma-separated file (0-based; NDCG and intent-aware precision at 10 and 20)."""
    parts = F.split(F.max_by("line", "line_no"), ",")
    return rows.filter(F.trim("line") != "").agg(*(F.get(parts, F.lit(c)).cast("double").alias(f"c{c}") for c in columns))


def run_lines(results: DataFrame, asked: DataFrame | None = None, tag: str = "run-1") -> DataFrame:
    """``qid Q0 id rank score tag`` lines; a query asked for (qid, empty) whose tree is empty gives one dummy line."""
    made = results.select("qid", "rank", F.format_string(f"%s Q0 %s %d %.12f {tag}", "qid", F.col("external_id"), F.col("rank"), F.col("score")).alias("line"))
    if asked is None:
        return made
    dummies = asked.filter("empty").select("qid", F.lit(1).cast("long").alias("rank"), F.concat("qid", F.lit(f" Q0 dummy 1 0 {tag}")).alias("line"))
    return made.unionByName(dummies)


def write_lines(made: DataFrame, path: str) -> None:
    """Lines in order of query and rank: a range partitioning keeps the sort parallel."""
    made.repartitionByRange("qid", "rank").sortWithinPartitions("qid", "rank").select("line").write.mode("overwrite").text(path)


def expansion_lines(expanded: DataFrame) -> DataFrame:
    """``qid:query`` lines of expansion queries (qid, query)."""
    return expanded.select("qid", F.concat("qid", F.lit(": "), "query").alias("line"))


def scores_beside(features: DataFrame, scores: DataFrame) -> DataFrame:
    """Scores joined to the rows they belong to by id, where files would zip them by place."""
    return features.join(scores, ["qid", "doc_id"])
