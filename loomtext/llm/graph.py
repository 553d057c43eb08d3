"""Connected components of links, and blocks of pairs within buckets, without collecting either."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.storage import Scratch, discard, settle


#: Rows of a file of links, about.
ROWS_OF_A_FILE = 50_000


def components(edges: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """node, label (the smallest node reachable) of every node in ``edges``, by alternating large and small stars.

    Every round writes its edges to the shared folder, so lineage never grows. What is known of each node is written
    before it meets the edges: both sides of that equi-join are then plain shuffles, of which adaptive execution
    splits the one with a node of very many links. The tables have files by their rows, not one for every shuffle
    partition: few links in many partitions would spend each round on opening files. Rounds end with the first graph of
    stars, which the least neighbours tell. ``scratch`` drops the last round's edges with its other tables.
    """
    now = settle(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    cores, n = now.sparkSession.sparkContext.defaultParallelism, now.count()
    by_rows = lambda df: df.coalesce(max(cores, n // ROWS_OF_A_FILE + 1))
    while True:
        both = now.withColumn("up", F.lit(1)).unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(0).alias("up")))
        least = settle(by_rows(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.sum("up").alias("up"), F.count("*").alias("links"))), "least-neighbours")
        n, torn = least.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if(F.expr("up > 1 or up = 1 and links > 1"))).first()  # in a star, links stand at its least node and each other node has one
        if not torn:
            discard(least)
            if scratch is not None:
                scratch.held.append(now)
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        large = now.join(least.select(F.col("u").alias("v"), "m"), "v").select(F.col("u"), F.col("m").alias("v")).filter("u <> v")
        large = settle(by_rows(large), "large-star")
        discard(least)
        low = settle(by_rows(large.groupBy("u").agg(F.min("v").alias("m"))), "least-of-large")
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        new = settle(by_rows(small), "small-star")
        for done in (large, low, now):
            discard(done)
        now = new


def block_pairs(members: DataFrame, bucket: list[str], spread_by: str, block: int) -> DataFrame:
    """Deals the members of each bucket of two or more into blocks and each pair of blocks into a group of its own.

    Adds ``_i``, ``_j`` (the pair of blocks) and ``_side`` (0: of block i, 1: of block j). No group has more than
    about two blocks of rows, and all pairs of a bucket meet in exactly one group.
    """
    sizes = members.groupBy(*bucket).agg(F.count("*").alias("_n")).filter("_n > 1")
    dealt = members.join(sizes, bucket).withColumn("_blocks", F.ceil(F.col("_n") / block).cast("int"))
    dealt = dealt.withColumn("_own", F.pmod(F.xxhash64(spread_by), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.select(*members.columns, F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), (F.col("_own") > F.col("_other")).cast("int").alias("_side"))


def chunks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole runs of rows with equal keys from a sorted stream: a table and the bounds of its runs.

    Holds one batch and the run that its end cuts.
    """
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = (pa.concat_tables([rest, table]) if rest is not None else table).combine_chunks()
        cut = _bounds(table, keys)
        if len(cut) > 2:
            yield table.slice(0, int(cut[-2])), cut[:-1]
            table = table.slice(int(cut[-2]))
        rest = table
    if rest is not None:
        yield rest, _bounds(rest, keys)


def _bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, dtype=bool)
    for k in keys:
        x = table.column(k).to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return np.concatenate(([0], np.flatnonzero(change), [table.num_rows]))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, one at a time."""
    for table, cut in chunks(batches, keys):
        for at, to in zip(cut[:-1].tolist(), cut[1:].tolist()):
            yield table.slice(at, to - at)
