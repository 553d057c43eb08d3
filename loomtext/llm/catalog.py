"""The registered queries of the training-data operators, and SQL for those that SQL can state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtext.llm import blockmax, chat, decontaminate, embeddings, importance, langid, minhash, mixing, pages, repeats, secrets, sql, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.cluster(_table(spark, sf_dir, "embeddings"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(_table(spark, sf_dir, "documents"))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.cluster(_table(spark, sf_dir, "documents"), size=3, percent=85)


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.report(_table(spark, sf_dir, "documents"))


def op6_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(_table(spark, sf_dir, "pages"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted_conversations(_table(spark, sf_dir, "conversations"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blockmax.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(_table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_secret_scan, op3_language_id, op4_minhash_dedup, op5_repeated_passages, op6_page_text, op7_chat_format, op8_decontaminate, op9_source_mix, op10_toxicity, op11_importance_resample, op12_ranked_search, op13_warc_archive)}
ORACLE_SQL = sql.ORACLE_SQL | {
    "op9_source_mix": mixing.REPORT_SQL, "op11_importance_resample": importance.REPORT_SQL, "op12_ranked_search": blockmax.REPORT_SQL, "op13_warc_archive": warc.REPORT_SQL,
}
