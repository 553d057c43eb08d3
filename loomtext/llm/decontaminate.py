"""Benchmark decontamination with an FM-index per training shard.

A shard is a block of documents as they come from the scan. Words that no benchmark item holds cannot stand in an
occurrence, so they part the shard's words into runs, and runs shorter than every window are left out; what remains
is indexed: suffix order by prefix doubling, Burrows-Wheeler transform in a wavelet matrix, sampled suffix
positions. All windows are searched backward at once, occurrences are located by walking to a sampled position, and
each document's occurrences merge into removal spans.

The benchmark reaches the executors in blocks of about BLOCK_WORDS words, one pass over the documents a block; between
passes they are written to the shared folder, so the driver and the tasks hold one block at a time, whatever the
size of the benchmark. No shuffle takes place; a lost executor costs its tasks only.

Nulls: a null text has no words, an item without words has no windows, a null item_id counts as the empty string.
Repeated rows are judged alike. Empty tables give empty or clean results. Further columns pass through.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.storage import aside, discard, map_batches, only, settle
from loomtext.llm.words import ALNUM, LOWER, blocks, prefix_hashes, span_hashes, spread

WINDOW = 10
BLOCK_WORDS = 400_000
SHARD_BYTES = 1 << 20
SAMPLE = 16


class WaveletMatrix:
    """Rank of any symbol at any position, level by level from the highest bit."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))))
            self.zeros.append(len(bit) - int(self.ones[-1][-1]))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol[i] stands before position at[i]."""
        low, high = np.zeros_like(at), at
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            l1, h1 = self.ones[k][low], self.ones[k][high]
            low = np.where(one, self.zeros[k] + l1, low - l1)
            high = np.where(one, self.zeros[k] + h1, high - h1)
        return high - low


class FMIndex:
    """Over a sequence of symbols 1..top in runs, a 0 before each run and at the end."""

    def __init__(self, sequence: np.ndarray, top: int, sample: int = SAMPLE):
        n = len(sequence)
        order = suffix_order(sequence)
        self.bwt = sequence[order - 1]
        self.before = np.concatenate(([0], np.cumsum(np.bincount(sequence, minlength=top + 1))))
        self.tree = WaveletMatrix(self.bwt, top)
        start = np.zeros(n, dtype=bool)
        start[np.flatnonzero(sequence == 0)[:-1] + 1] = True
        self.sampled = (order % sample == 0) | start[order]
        self.slot = np.cumsum(self.sampled) - 1
        self.position = order[self.sampled]

    def search(self, patterns: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of right-aligned patterns: which are found, and their intervals of rows."""
        live = np.arange(len(patterns))
        low, high = np.zeros(len(live), dtype=np.int64), np.full(len(live), len(self.bwt), dtype=np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for step in range(patterns.shape[1]):
            c = patterns[live, -1 - step]
            low, high = self.before[c] + self.tree.rank(c, low), self.before[c] + self.tree.rank(c, high)
            there = low < high
            ended = there & (length[live] == step + 1)
            done.append((live[ended], low[ended], high[ended]))
            go = there & ~ended
            live, low, high = live[go], low[go], high[go]
            if not len(live):
                break
        return tuple(np.concatenate(x) for x in zip(*done))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the sequence: step back by the transform until a sampled row is met."""
        out, walked = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        open_, row = np.arange(len(rows)), rows.copy()
        while len(open_):
            there = self.sampled[row]
            out[open_[there]] = self.position[self.slot[row[there]]] + walked[open_[there]]
            open_, row = open_[~there], row[~there]
            c = self.bwt[row]
            row = self.before[c] + self.tree.rank(c, row)
            walked[open_] += 1
        return out


def suffix_order(sequence: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. Zeros are told apart by position, so no comparison passes the end of a run."""
    n = len(sequence)
    zero = sequence == 0
    rank = np.where(zero, np.cumsum(zero) - 1, sequence + zero.sum() - 1).astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (int(rank.max()) + 2) + second
        order = np.argsort(key, kind="stable")
        key = key[order]
        place = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
        rank[order] = place
        if place[-1] == n - 1 or step >= n:
            return order
        step *= 2


class Patterns:
    """The windows of some benchmark items over a vocabulary of their own."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        self.items = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.items)}
        texts = pa.array([t for _, t in items], pa.large_string())
        each: list[np.ndarray] = []
        for block in blocks(texts):
            data = LOWER[block.data]
            start, end, owner = block.words(ALNUM)
            h = span_hashes(prefix_hashes(data), start, end)
            each += np.split(h, np.searchsorted(owner, np.arange(1, len(block))))
        self.vocabulary = np.unique(np.concatenate([*each, np.zeros(0, np.uint64)]))
        holders: dict[tuple, set[int]] = defaultdict(set)
        for (item, _), h in zip(items, each):
            ids = np.searchsorted(self.vocabulary, h) + 1
            for at in range(max(1, len(ids) - window + 1) if len(ids) else 0):
                holders[tuple(ids[at : at + window].tolist())].add(number[item])
        self.length = np.array([len(w) for w in holders], dtype=np.int64)
        self.symbols = np.zeros((len(holders), window), dtype=np.int64)
        for k, w in enumerate(holders):
            self.symbols[k, window - len(w) :] = w
        count = np.array([len(x) for x in holders.values()], dtype=np.int64)
        self.held = np.array([i for x in holders.values() for i in sorted(x)], dtype=np.int64)
        self.held_from, self.held_count = np.cumsum(count) - count, count

    def find(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences in a shard's words (0: in no item): the word each begins with, and the window."""
        none = np.zeros(0, dtype=np.int64)
        if not len(self.length) or not len(ids):
            return none, none
        inside = ids > 0
        first = inside & np.concatenate(([True], ~inside[:-1] | (owner[1:] != owner[:-1])))
        last = inside & np.concatenate((~inside[1:] | (owner[1:] != owner[:-1]), [True]))
        begin, size = np.flatnonzero(first), np.flatnonzero(last) - np.flatnonzero(first) + 1
        long = size >= self.length.min()
        begin, size = begin[long], size[long]
        if not len(begin):
            return none, none
        word = spread(begin - 1, size + 1)
        sequence = np.append(ids[word], 0)
        sequence[np.cumsum(size + 1) - (size + 1)] = 0
        index = FMIndex(sequence, len(self.vocabulary))
        which, low, high = index.search(self.symbols, self.length)
        at = index.locate(spread(low, high - low))
        return word[at], np.repeat(which, high - low)


def _search(patterns: Patterns):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, hits, held, parts = [], [], [], []
            for block in blocks(batch.column("text"), SHARD_BYTES):
                start, end, owner = block.words(ALNUM)
                h = span_hashes(prefix_hashes(LOWER[block.data]), start, end)
                ids = np.searchsorted(patterns.vocabulary, h)
                known = ids < len(patterns.vocabulary)
                known[known] = patterns.vocabulary[ids[known]] == h[known]
                ids = np.where(known, ids + 1, 0)
                at, which = patterns.find(ids, owner)
                cover = np.zeros(len(ids) + 1, dtype=np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + patterns.length[which], -1)
                hit = np.concatenate(([False], np.cumsum(cover[:-1]) > 0, [False]))
                edge = np.concatenate(([-1], owner, [-1]))
                opens = np.flatnonzero(hit[1:-1] & (~hit[:-2] | (edge[1:-1] != edge[:-2])))
                closes = np.flatnonzero(hit[1:-1] & (~hit[2:] | (edge[1:-1] != edge[2:])))
                of = owner[opens]
                first = np.searchsorted(owner, of)
                words.append(np.bincount(owner, minlength=len(block)))
                parts.append(np.bincount(of, minlength=len(block)))
                hits.append(np.stack([opens - first, closes + 1 - first, start[opens] - block.begin[of], end[closes] - block.begin[of]]))
                pair = np.unique(np.stack([np.repeat(owner[at], patterns.held_count[which]), patterns.held[spread(patterns.held_from[which], patterns.held_count[which])]]), axis=1)
                held.append((np.bincount(pair[0], minlength=len(block)), pair[1]))
            join = lambda xs, kind=np.int64: np.concatenate(xs) if xs else np.zeros(0, kind)
            bounds = lambda xs: pa.array(np.concatenate(([0], np.cumsum(join(xs)))).astype(np.int32))
            span = np.concatenate(hits, axis=1) if hits else np.zeros((4, 0), np.int64)
            spans = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in span], ["start", "end", "from_byte", "to_byte"])
            items = pa.array(patterns.items, pa.string()).take(pa.array(join([x for _, x in held])))
            old = {n: batch.column(n) for n in batch.schema.names if n not in ("_n_words", "_spans", "_items")}
            new_spans, new_items = pa.ListArray.from_arrays(bounds(parts), spans), pa.ListArray.from_arrays(bounds([x for x, _ in held]), items)
            yield pa.RecordBatch.from_arrays([*old.values(), pa.array(join(words), pa.int64()), _append(batch, "_spans", new_spans, _merged), _append(batch, "_items", new_items)], [*old, "_n_words", "_spans", "_items"])

    return run


def _append(batch: pa.RecordBatch, name: str, more: pa.ListArray, join=lambda a, b: a + b) -> pa.Array:
    """What an earlier block of the benchmark found, and this one."""
    if name not in batch.schema.names or not batch.num_rows:
        return more
    return pa.array([join(a or [], b or []) for a, b in zip(batch.column(name).to_pylist(), more.to_pylist())], more.type)


def _merged(one: list[dict], two: list[dict]) -> list[dict]:
    """Spans of two blocks as one block would find them: those that share words or follow on each other are one."""
    if not one or not two:
        return one or two
    out: list[dict] = []
    for s in sorted(one + two, key=lambda s: (s["start"], s["end"])):
        if out and s["start"] <= out[-1]["end"]:
            if s["end"] > out[-1]["end"]:
                out[-1] |= {"end": s["end"], "to_byte": s["to_byte"]}
        else:
            out.append(s)
    return out


def _benchmark_blocks(benchmark: DataFrame) -> Iterator[list[tuple[str, str | None]]]:
    block, size = [], 0
    for row in only(benchmark, "item_id", "text").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), "text").toLocalIterator():
        block.append((row[0], row[1]))
        size += len((row[1] or "").split()) + 1
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``_n_words``, ``_spans`` (words and bytes of each run of hit words) and ``_items`` (ids with occurring windows)."""
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    schema = ", ".join([*kinds, "_n_words long", "_spans array<struct<start:long,end:long,from_byte:long,to_byte:long>>", "_items array<string>"])
    parts = _benchmark_blocks(benchmark)
    found, before = map_batches(docs, _search(Patterns(next(parts, []), window)), schema), None
    for items in parts:
        now = settle(found, "benchmark-block")
        if before is not None:
            discard(before)
        found, before = map_batches(now, _search(Patterns(items, window)), schema), now
    return found


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: words, hit words, items with occurring windows and a digest of their ids."""
    found = search(only(docs, "doc_id", "text"), benchmark)
    merge = lambda s, x: F.struct(
        F.greatest(s["to"], x["end"]).alias("to"), (s["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(s["to"], x["start"]))).alias("n")
    )
    n_hit = F.aggregate(F.array_sort("_spans"), F.struct(F.lit(0).cast("long").alias("to"), F.lit(0).cast("long").alias("n")), merge, lambda s: s["n"])
    items = F.array_sort(F.array_distinct("_items"))
    out = found.select("doc_id", F.col("_n_words").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("_spans").to_pylist()):
            if spans:
                raw, at, kept = text.encode(), 0, []
                for s in sorted(spans, key=lambda s: s["from_byte"]):
                    kept.append(raw[at : max(at, s["from_byte"])])
                    at = max(at, s["to_byte"])
                text = b"".join([*kept, raw[at:]]).decode()
            texts.append(text)
        cols = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in batch.schema.names if n not in ("_spans", "_items", "_n_words")]
        yield pa.RecordBatch.from_arrays(cols, [n for n in batch.schema.names if n not in ("_spans", "_items", "_n_words")])


def remove(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without the merged removal spans; those of which no word is left go. n_chars follows the text."""
    docs, restored = aside(docs, "doc_id", "text", "n_chars")
    found = search(docs, benchmark)
    hit = F.size("_spans") > 0
    kept = found.filter(~hit | (F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]) < F.col("_n_words")))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", _was_hit boolean"
    cut = map_batches(kept.withColumn("_was_hit", hit), _cut, schema)
    return restored(cut.withColumn("n_chars", F.when(F.col("_was_hit"), F.length("text").cast("long")).otherwise(F.col("n_chars"))))
