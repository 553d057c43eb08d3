"""Edit and chat events as streams: state per document or room, in order of arrival."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomtext.operators.collab import rebased
from loomtext.operators.rope import Rope
from loomtext.storage import new_path

TURNS = "conv_id long, turn long, role string, text string"


def turns_stream(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(TURNS).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").parquet(path)


def fold_stream(edits: DataFrame) -> DataFrame:
    """doc_id, content, n_edits, updated for every document that a batch touches; the text is the state."""
    def fold(key, batches: Iterator[pd.DataFrame], state):
        text, n = state.get if state.exists else ("", 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        for action, start, end, content in zip(rows["action"], rows["start"], rows["end"], rows["content"]):
            low = min(max(start, 0), len(text))
            high = max(low, min(end, len(text)))
            text = text[:low] + (content if action in ("add", "update") else "") + text[low if action == "add" else high :]
            n += 1
        state.update((text, n))
        yield pd.DataFrame({"doc_id": [key[0]], "content": [text], "n_edits": [n]})

    return edits.groupBy("doc_id").applyInPandasWithState(fold, "doc_id long, content string, n_edits long", "content string, n_edits long", "update", "NoTimeout")


#: What keeps state of several kinds for a key; it is set while such a stream runs.
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Documents(StatefulProcessor):
    """A document's text as a list of pieces, how many edits made it, and what each of them did, by version."""

    def __init__(self, client: bool = False):
        self.client = client

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pieces = handle.getListState("pieces", "piece string")
        self.count = handle.getValueState("count", "n long")
        self.done = handle.getMapState("done", "version long", "low long, high long, put long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        edits = pd.concat(list(rows)).sort_values("seq")
        rope = Rope([p[0] for p in self.pieces.get()])
        n = self.count.get()[0] if self.count.exists() else 0
        whole = lambda x: None if pd.isna(x) else int(x)
        for action, start, end, content, base in zip(edits["action"], edits["start"], edits["end"], edits["content"], edits["base"]):
            since = [] if pd.isna(base) else [self.done.getValue((v,)) for v in range(int(base), n)]
            low, high = rebased(whole(start), whole(end), since)
            self.done.updateValue((n,), rope.edit(action, low, high, content, self.client))
            n += 1
        self.pieces.put([(p,) for p in rope.pieces()])
        self.count.update((n,))
        yield pd.DataFrame({"doc_id": [key[0]], "content": [rope.text()], "n_edits": [n]})

    def close(self) -> None:
        pass


def document_stream(edits: DataFrame, client: bool = False) -> DataFrame:
    """doc_id, content, n_edits of every document that a batch of edits (doc_id, seq, base, action, start, end, content) touches.

    An edit's ``base`` is the version it was made against, null for the present one: its places move with what has been done
    since, whatever batch that came in. Run it under ROCKS.
    """
    return edits.groupBy("doc_id").transformWithStateInPandas(Documents(client), "doc_id long, content string, n_edits long", "Update", "None")


def drained(stream: DataFrame, name: str, mode: str = "update", conf: dict[str, str] | None = None) -> DataFrame:
    """Runs a stream over all that is there and returns its batches with their number. conf: settings that hold while it starts."""
    spark = stream.sparkSession
    out, marks = new_path(spark, name), new_path(spark, f"{name}-marks")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/n={number}")

    before = {k: spark.conf.get(k, None) for k in conf or {}}
    try:
        for k, v in (conf or {}).items():
            spark.conf.set(k, v)
        running = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", marks).trigger(availableNow=True).start()
        running.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.option("basePath", out).parquet(f"{out}/n=*").drop("n")


def latest(batches: DataFrame, key: str) -> DataFrame:
    """The last state of each key over all batches."""
    cols = [c for c in batches.columns if c not in (key, "batch")]
    return batches.groupBy(key).agg(F.max_by(F.struct(*cols), "batch").alias("s")).select(key, "s.*")


def room_counts_stream(turns: DataFrame) -> DataFrame:
    """room, messages, updated with every batch."""
    return turns.groupBy(F.col("conv_id").alias("room")).agg(F.count("*").alias("messages"))
