"""Registered queries that run as streams; each equals its batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.plans.editor_queries import EDIT_FOLD_SQL, edits_of
from loomtext.sources.channel import Channel
from loomtext.storage import new_path
from loomtext.streaming import edits


def edit_fold_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = edits.turns_stream(spark, f"{sf_dir}/conversations.parquet*")
    return edits.latest(edits.drained(edits.fold_stream(edits_of(turns)), "edit-fold"), "doc_id")


def chat_room_counts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = edits.turns_stream(spark, f"{sf_dir}/conversations.parquet*")
    return edits.latest(edits.drained(edits.room_counts_stream(turns), "room-counts"), "room")


def document_pieces_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same edits by documents that keep pieces as their state."""
    turns = edits.turns_stream(spark, f"{sf_dir}/conversations.parquet*")
    based = edits_of(turns).withColumn("base", F.lit(None).cast("long"))
    return edits.latest(edits.drained(edits.document_stream(based), "documents", conf=edits.ROCKS), "doc_id")


def channel_room_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns streamed into an event channel, and the rooms counted by a stream out of it."""
    spark.dataSource.register(Channel)
    path, marks = new_path(spark, "channel"), new_path(spark, "channel-marks")
    turns = edits.turns_stream(spark, f"{sf_dir}/conversations.parquet*")
    events = turns.select(F.col("conv_id").cast("string").alias("room"), F.col("role").alias("sender"), F.lit("chat").alias("kind"), F.col("text").alias("content"), F.lit(None).cast("timestamp").alias("sent"))
    events.writeStream.format("channel").option("path", path).option("writer", "turns").option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    read = spark.readStream.format("channel").option("path", path).load()
    return edits.latest(edits.drained(edits.room_counts_stream(read.select(F.col("room").cast("long").alias("conv_id"))), "channel-counts"), "room")


QUERIES = {f.__name__: f for f in (edit_fold_stream, chat_room_counts_stream, document_pieces_stream, channel_room_counts)}
_COUNTS = "SELECT conv_id AS room, count(*) AS messages FROM conversations GROUP BY conv_id"
ORACLE_SQL = {"edit_fold_stream": EDIT_FOLD_SQL, "document_pieces_stream": EDIT_FOLD_SQL, "chat_room_counts_stream": _COUNTS, "channel_room_counts": _COUNTS}
