"""Repeated passages by longest-previous-factor arrays.

A byte is removed if it lies in a string of LENGTH bytes that also starts elsewhere. Beside that, passages are found
in words: runs of WORDS words (A-Z in lower case) that another document holds too, as passages of some fifty words
may be shorter than LENGTH bytes. Both go the same way, over symbols that are bytes or words.

Two equal strings hold the same anchor: the leftmost least hash of a gram (GRAM bytes, WORD_GRAM words) within them.
Texts are cut at anchors into contexts, the symbols of all strings that share one anchor; only anchors that recur are
followed up, and equal contexts are one class with a count before anything is moved. The classes of an anchor meet in
shards: suffix order (by the hash of a first gram, then by prefix doubling), common prefixes of neighbours, previous
and next smaller positions in suffix order, and from them the longest previous factor of every start (cut off at
LENGTH) with the place of its earlier occurrence. An anchor with very many classes is salted over shards, and the
first occurrence of each string in each shard is counted over all of them by fingerprint: first of parts of
neighbouring strings, then of subparts and single strings where a part recurs.

``keep_first`` leaves the first occurrence (by doc_id and place) of what recurs, and otherwise every occurrence goes. Nulls: a null text is empty. Rows with equal texts give equal results, as copies of each other.
Strings are judged on the input; matches never cross texts. Rows of one doc_id, null ones too, are one document where
passages are asked for that another holds. Empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.graph import chunks
from loomtext.llm.storage import Scratch, map_batches, only, settle
from loomtext.llm.words import LOWER, NOT_SPACE, _BYTE_VALUE, Block, blocks, mixed, prefix_hashes, prefix_sums, span_hashes, spread

LENGTH, GRAM = 400, 64
#: The same in words: a passage has over fifty.
WORDS, WORD_GRAM = 51, 8
#: Classes of one anchor that meet in one shard.
PER_SHARD = 512
#: Bytes of contexts that are put into one suffix order, and of texts that are cut at anchors together: their arrays stay in a core's cache.
SHARD_BYTES, BLOCK_BYTES = 3 << 14, 1 << 15
#: Strings of an anchor are counted over shards in parts and subparts of so many neighbouring starts.
PART, SUBPART = 30, 6
#: Low bits of an anchor's key that hold its place, the same for all blocks, so that equal strings choose alike.
PLACE_BITS = 26
BYTE, WORD = 0, 1
_SIZES = {BYTE: (LENGTH, GRAM), WORD: (WORDS, WORD_GRAM)}
_WORD_SALT = np.uint64(0x8CB92BA72F3D8DD7)


def anchors(hashes: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every run of neighbouring starts with one anchor, the least of ``window`` hashes: its place, the first and the last start."""
    n = len(hashes)
    bits = max(PLACE_BITS, n.bit_length())
    rows = -(-n // window)
    wide = np.full(rows * window, np.iinfo(np.uint64).max, dtype=np.uint64)
    wide[:n] = (hashes >> np.uint64(bits) << np.uint64(bits)) | np.arange(n, dtype=np.uint64)
    wide = wide.reshape(rows, window)
    ahead = np.minimum.accumulate(wide, axis=1).reshape(-1)
    behind = np.minimum.accumulate(wide[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[starts], ahead[starts + window - 1])
    place = (least & np.uint64((1 << bits) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1))))
    return place[first], starts[first], starts[np.append(first[1:], len(starts)) - 1]


_ANCHORS = "text_key long, doc long, n_bytes long, unit int, low int, high int, anchor int, gram long, context long"


def _of_bytes(block: Block) -> tuple[np.ndarray, ...]:
    """Per anchor of strings of bytes: text, place, first and last start in the text, gram and context."""
    size = block.finish - block.begin
    long = np.flatnonzero(size >= LENGTH)
    starts = spread(block.begin[long], size[long] - LENGTH + 1)
    if not len(starts):
        return ()
    prefix = prefix_hashes(block.data)
    at = np.arange(len(block.data) - GRAM + 1)
    grams = span_hashes(prefix, at, at + GRAM)
    place, low, high = anchors(grams, starts, LENGTH - GRAM + 1)
    text = np.searchsorted(block.finish, low, side="right")
    context = mixed(span_hashes(prefix, low, high + LENGTH) + (place - low).astype(np.uint64))
    return text, place, low - block.begin[text], high - block.begin[text], grams[place], context, place - low


def word_values(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A value for each word, its start and end in the block, and its text."""
    start, end, owner = block.words(NOT_SPACE)
    return mixed(span_hashes(prefix_hashes(LOWER[block.data]), start, end) ^ _WORD_SALT), start, end, owner


def _of_words(block: Block) -> tuple[np.ndarray, ...]:
    """The same of strings of words, places being numbers of words."""
    value, _, _, owner = word_values(block)
    n = len(value)
    starts = np.flatnonzero(owner[: max(0, n - WORDS + 1)] == owner[WORDS - 1 :]) if n >= WORDS else np.zeros(0, np.int64)
    if not len(starts):
        return ()
    prefix = prefix_sums(value)
    at = np.arange(n - WORD_GRAM + 1)
    grams = span_hashes(prefix, at, at + WORD_GRAM)
    place, low, high = anchors(grams, starts, WORDS - WORD_GRAM + 1)
    text = owner[low]
    first = np.searchsorted(owner, text)
    context = mixed(span_hashes(prefix, low, high + WORDS) + (place - low).astype(np.uint64))
    return text, place, low - first, high - first, grams[place], context, place - low


def _find_anchors(words: bool):
    names = [x.split()[0] for x in _ANCHORS.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), *(pa.int32(),) * 4, pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, doc, size = (batch.column(c).to_numpy() for c in ("text_key", "doc", "n_bytes"))
            parts: list[tuple[np.ndarray, ...]] = []
            for block in blocks(batch.column("text"), BLOCK_BYTES):
                for unit, found in ((BYTE, _of_bytes(block)), (WORD, _of_words(block) if words else ())):
                    if found:
                        text, _, low, high, gram, context, anchor = found
                        row = text + block.first
                        parts.append((key[row], doc[row], size[row], np.full(len(row), unit), low, high, anchor, gram.view(np.int64), context.view(np.int64)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)).cast(k) for c, k in zip(zip(*parts), kinds)], names)

    return run


def suffix_ranks(prefix: np.ndarray, depth: int, first: int) -> list[tuple[int, np.ndarray]]:
    """Ranks of all suffixes by their first 1, 2, 4, ... times ``first`` symbols and at last by ``depth``: of ``first`` symbols by hash, of more by prefix doubling."""
    n = len(prefix) - 1
    at = np.arange(n)
    key = span_hashes(prefix, at, np.minimum(at + first, n))
    levels, have = [], first
    while True:
        order = np.argsort(key)
        ranked = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        levels.append((have, rank))
        if have >= depth:
            return levels
        step = min(have, depth - have)
        second = np.zeros(n, dtype=np.int64)
        second[: max(0, n - step)] = rank[step:] + 1
        key = rank.astype(np.uint64) * np.uint64(n + 1) + second.astype(np.uint64)
        have += step


def common_prefixes(order: np.ndarray, levels: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Length of the common prefix of each suffix in order with the one before, in whole grams of the first level, up to the last depth."""
    first, depth = levels[0][0], levels[-1][0]
    n, ranks = len(levels[0][1]), dict(levels)
    a, b, out = order[:-1].copy(), order[1:].copy(), np.zeros(max(0, len(order) - 1), dtype=np.int64)
    full = levels[-1][1][a] == levels[-1][1][b]
    for size in sorted((s for s, _ in levels if s % first == 0 and (s // first) & (s // first - 1) == 0), reverse=True):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), dtype=bool)
        same[inside] = ranks[size][a[inside]] == ranks[size][b[inside]]
        out[same] += size
        a, b = np.where(same, a + size, a), np.where(same, b + size, b)
    return np.concatenate(([0], np.where(full, depth, np.minimum(out, depth - 1))))


def smaller_positions(order: np.ndarray, prefixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By place in suffix order: the place of the nearest suffix before that begins earlier in the text (-1: none), and the common prefix with it."""
    previous, low = np.arange(len(order)) - 1, prefixes.copy()
    open_ = np.flatnonzero((previous >= 0) & (order[np.maximum(previous, 0)] > order))
    while len(open_):
        j = previous[open_]
        low[open_] = np.minimum(low[open_], low[j])
        previous[open_] = previous[j]
        open_ = open_[(previous[open_] >= 0) & (order[np.maximum(previous[open_], 0)] > order[open_])]
    low[previous < 0] = 0
    return previous, low


def longest_previous_factors(prefix: np.ndarray, depth: int, starts: np.ndarray | None = None, first: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each start (all positions by default): the length, up to ``depth``, of the longest match with an earlier start, and that start; and ranks by ``depth`` symbols.

    prefix: ``prefix_sums`` of the symbols. Lengths below ``depth`` are in whole multiples of ``first``.
    """
    n = len(prefix) - 1
    starts = np.arange(n) if starts is None else starts
    levels = suffix_ranks(prefix, depth, first)
    order = starts[np.argsort(levels[-1][1][starts] * np.int64(n + 1) + starts)]
    prefixes = common_prefixes(order, levels)
    before, p = smaller_positions(order, prefixes)
    after, q = smaller_positions(order[::-1], np.concatenate(([0], prefixes[:0:-1])))
    after, q = np.where(after >= 0, len(order) - 1 - after, -1)[::-1], q[::-1]
    length, source = np.zeros(n, np.int64), np.full(n, -1)
    length[order] = np.maximum(p, q)
    source[order] = np.where(np.maximum(p, q) > 0, order[np.where(p >= q, before, after)], -1)
    return length, source, levels[-1][1]


_OPEN = "array<struct<mark:long,subs:array<struct<mark:long,strings:array<struct<start:int,mark:long,doc_low:long,doc_high:long>>>>>>"
_SHARD = f"gram long, context long, unit int, spans array<struct<start:int,end:int>>, open {_OPEN}"
_SPANS_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_STRING_TYPE = pa.struct([("start", pa.int32()), ("mark", pa.int64()), ("doc_low", pa.int64()), ("doc_high", pa.int64())])
_OPEN_TYPE = pa.list_(pa.struct([("mark", pa.int64()), ("subs", pa.list_(pa.struct([("mark", pa.int64()), ("strings", pa.list_(_STRING_TYPE))])))]))


def _shards(keep_first: bool):
    """Covered spans of each context, and for salted anchors the first occurrence of each string in its shard."""

    def run(batches):
        for table, cut in chunks(batches, ["unit", "gram", "salt"]):
            at = 0
            length, unit = np.array([len(x) for x in table.column("bytes").to_pylist()]), table.column("unit").to_numpy()[cut[:-1]]
            total = np.add.reduceat(length, cut[:-1])
            total = np.where(unit == WORD, total // 4, total)  # words are fewer symbols
            while at < len(total):
                to, held = at + 1, int(total[at])
                while to < len(total) and unit[to] == unit[at] and held + total[to] <= SHARD_BYTES:
                    held += int(total[to])
                    to += 1
                yield _one_shard(table.slice(int(cut[at]), int(cut[to] - cut[at])), keep_first)
                at = to

    return run


def _symbols(texts: list[bytes], unit: int, size: np.ndarray) -> np.ndarray:
    """Prefix sums over the symbols of some contexts, a symbol of no text after each, so that no string passes from one to the next."""
    if unit == BYTE:
        return prefix_sums(_BYTE_VALUE[np.frombuffer(b"\xff".join(texts), np.uint8)])
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    value = word_values(Block(data, np.zeros(1, np.int64), np.array([len(data)]), 0))[0]
    out = np.zeros(int((size + 1).sum()), np.uint64)
    out[spread(np.cumsum(size + 1) - (size + 1), size)] = value
    return prefix_sums(out)


def _one_shard(table: pa.Table, keep_first: bool) -> pa.RecordBatch:
    if keep_first:  # a shard may hold several salts of an anchor
        table = table.sort_by([("doc", "ascending"), ("low", "ascending")])
    texts, times, salts, anchor = (table.column(c).to_pylist() for c in ("bytes", "times", "salts", "anchor"))
    unit = table.column("unit")[0].as_py()
    whole, first = _SIZES[unit]
    size = np.array([len(x) for x in texts]) if unit == BYTE else table.column("high").to_numpy() - table.column("low").to_numpy() + whole
    begin = np.cumsum(size + 1) - (size + 1)
    prefix, starts = _symbols(texts, unit, size), spread(begin, size - whole + 1)
    length, source, rank = longest_previous_factors(prefix, whole, starts, first)
    low = high = np.zeros(len(length), np.int64)
    if unit == BYTE:
        twice = length >= whole
        if not keep_first:
            twice[source[twice]] = True
            twice[starts] |= np.repeat(np.array(times) > 1, size - whole + 1)
    else:  # a string counts if documents that hold it differ
        low, high = np.full(len(length), np.iinfo(np.int64).max), np.full(len(length), np.iinfo(np.int64).min)
        for ends, column, least in ((low, "doc", np.minimum), (high, "doc_high", np.maximum)):
            least.at(ends, rank[starts], np.repeat(table.column(column).to_numpy(), size - whole + 1))
        low, high = low[rank], high[rank]
        twice = low < high
    spans, opens = [], []
    for b, n, salted, place in zip(begin.tolist(), size.tolist(), salts, anchor):
        left = np.flatnonzero(length[b : b + n - whole + 1] < whole)  # the first of each string, for those that other shards hold too
        opens.append(_nested(prefix, b, left, place, whole, low, high) if salted > 1 and len(left) else [])
        edge = np.diff(np.concatenate(([0], twice[b : b + n - whole + 1].astype(np.int8), [0])))
        spans.append([{"start": int(s), "end": int(e) - 1 + whole} for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))])
    cols = [table.column("gram").combine_chunks(), table.column("context").combine_chunks(), pa.array([unit] * len(texts), pa.int32()), pa.array(spans, _SPANS_TYPE), pa.array(opens, _OPEN_TYPE)]
    return pa.RecordBatch.from_arrays(cols, ["gram", "context", "unit", "spans", "open"])


def _nested(prefix: np.ndarray, begin: int, starts: np.ndarray, anchor: int, whole: int, low: np.ndarray, high: np.ndarray) -> list[dict]:
    """Fingerprints of strings by their distance before the anchor, in parts and subparts; that of a part is of the bytes all its strings share."""

    def mark(first: int, n: int) -> int:
        return int(span_hashes(prefix, np.array([begin + first]), np.array([begin + first + n])).view(np.int64)[0])

    out: list[dict] = []
    part = sub = None
    for start in starts[::-1].tolist():
        ahead = anchor - start
        if ahead // PART != part:
            part, sub = ahead // PART, None
            out.append({"mark": mark(anchor - part * PART, whole - PART + 1), "subs": []})
        if ahead // SUBPART != sub:
            sub = ahead // SUBPART
            out[-1]["subs"].append({"mark": mark(anchor - sub * SUBPART, whole - SUBPART + 1), "strings": []})
        out[-1]["subs"][-1]["strings"].append({"start": start, "mark": mark(start, whole), "doc_low": int(low[begin + start]), "doc_high": int(high[begin + start])})
    return out


_ASKED = ("gram", "context", "times", "salt", "salts", "unit", "anchor", "doc", "doc_high", "low", "high")


def _slices(batches):
    """Cuts the contexts asked for out of each text."""
    for batch in batches:
        out: dict[str, list] = {k: [] for k in (*_ASKED, "bytes")}
        for text, asked in zip(batch.column("text").to_pylist(), batch.column("asked").to_pylist()):
            raw, start, end = text.encode(), None, None
            for a in asked:
                for k in _ASKED:
                    out[k].append(a[k])
                if a["unit"] == BYTE:
                    out["bytes"].append(raw[a["low"] : a["high"] + LENGTH])
                else:
                    if start is None:
                        data = np.frombuffer(raw + b" ", np.uint8)
                        start, end, _ = Block(data, np.zeros(1, np.int64), np.array([len(data)]), 0).words(NOT_SPACE)
                    out["bytes"].append(raw[start[a["low"]] : end[a["high"] + WORDS - 1]])
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([*((k, pa.int64()) for k in _ASKED), ("bytes", pa.binary())]))


def _recurring(marked: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows whose (gram, mark) stands in more than one context, and for strings of words in more than one document."""
    marked = scratch.settle(marked, "marks")
    again = marked.groupBy("gram", "mark")
    if "doc_low" in marked.columns:
        again = again.agg(F.count("*").alias("n"), F.min("doc_low").alias("low"), F.max("doc_high").alias("high"), F.first("unit").alias("of")).filter((F.col("n") > 1) & ((F.col("of") == BYTE) | (F.col("low") < F.col("high"))))
        marked = marked.drop("doc_low", "doc_high")
    else:
        again = again.agg(F.count("*").alias("n")).filter("n > 1")
    return marked.join(scratch.settle(again.select("gram", "mark"), "recurring-marks"), ["gram", "mark"])


def spans_by_context(spans: DataFrame) -> DataFrame:
    """One row for each (gram, context), its spans united where they meet: a place of a context joins one row, however many of its strings recur. A context has no more starts than a window."""
    def united(done, s):
        last = F.element_at(done, -1)
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when(s["start"] <= last["end"], longer).otherwise(F.concat(done, F.array(s)))

    every = spans.groupBy("gram", "context").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))
    return every.withColumn("spans", F.aggregate(F.slice("spans", 2, F.size("spans")), F.slice("spans", 1, 1), united))


def repeated_spans(keyed: DataFrame, scratch: Scratch, keep_first: bool = False) -> DataFrame:
    """text_key, n_bytes, spans: the bytes of each text that lie in recurring strings; passages: the same of words that another document holds. Reads tables that ``scratch`` holds.

    keyed: text_key, n_bytes, text and doc, by which texts are ordered where the first occurrence stays; passages are not looked for then.
    """
    least = LENGTH if keep_first else min(LENGTH, 2 * WORDS - 1)
    found = scratch.settle(map_batches(keyed.filter(F.col("n_bytes") >= least).select("text_key", "doc", "n_bytes", "text"), _find_anchors(not keep_first), _ANCHORS), "anchors")
    again = scratch.settle(found.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "recurring-grams")
    places = scratch.settle(found.join(again, "gram"), "recurring-anchors")
    classes = places.groupBy("gram", "context").agg(F.count("*").alias("times"), F.max("doc").alias("doc_high"), F.min(F.struct("doc", "low", "text_key", "n_bytes", "high", "anchor", "unit")).alias("at"))
    classes = scratch.settle(classes.select("gram", "context", "times", "doc_high", "at.*"), "contexts")
    per = scratch.settle(classes.groupBy("gram").agg(F.count("*").alias("classes")).withColumn("salts", F.ceil(F.col("classes") / PER_SHARD)), "classes-per-gram")
    dealt = classes.join(per, "gram").withColumn("salt", F.pmod(F.xxhash64("context"), "salts"))
    alone = F.col("classes") == 1
    asked = dealt.filter(~alone).groupBy("text_key", "n_bytes").agg(F.collect_list(F.struct(*_ASKED)).alias("asked"))
    texts = keyed.groupBy("text_key", "n_bytes").agg(F.first("text").alias("text"))  # one of each text before any is moved
    sliced = map_batches(texts.join(asked, ["text_key", "n_bytes"]).select("text", "asked"), _slices, ", ".join(f"{k} long" for k in _ASKED) + ", bytes binary")
    order = ["unit", "gram", "salt"]
    sharded = scratch.settle(map_batches(sliced.repartition("gram", "salt").sortWithinPartitions(*order, "doc", "low"), _shards(keep_first), _SHARD), "shards")
    held = ["gram", "context", "unit"]
    parts = _recurring(sharded.select(*held, F.explode("open").alias("o")).select(*held, "o.*"), scratch)
    subs = _recurring(parts.select(*held, F.explode("subs").alias("o")).select(*held, "o.*"), scratch)
    common = _recurring(subs.select(*held, F.explode("strings").alias("o")).select(*held, "o.*"), scratch)
    if keep_first:
        common = scratch.settle(common.join(classes.select("gram", "context", "doc", "low"), ["gram", "context"]).withColumn("place", F.struct("doc", F.col("low") + F.col("start"))), "open-places")
        common = common.join(common.groupBy("gram", "mark").agg(F.min("place").alias("least")), ["gram", "mark"]).filter("place > least")
    whole = F.when(F.col("unit") == BYTE, LENGTH).otherwise(WORDS)
    late = common.select("gram", "context", F.array(F.struct("start", (F.col("start") + whole).cast("int").alias("end"))).alias("spans"))
    all_of = F.array(F.struct(F.lit(0).alias("start"), (F.col("high") - F.col("low") + whole).cast("int").alias("end")))
    spans = sharded.select("gram", "context", "spans").filter(F.size("spans") > 0).unionByName(late)
    if keep_first:
        first = classes.select("gram", "context", F.col("doc").alias("of_doc"), F.col("low").alias("of_low"))
        once = places.select("text_key", "doc", "n_bytes", "unit", "low", "high", "gram", "context").distinct()
        once = scratch.settle(once.join(first, ["gram", "context"]).withColumn("is_first", (F.col("doc") == F.col("of_doc")) & (F.col("low") == F.col("of_low"))), "places-in-order")
        copies = once.filter("not is_first").select("text_key", "n_bytes", "unit", "low", all_of.alias("spans"))
        once = once.filter("is_first")
    else:
        once = places.select("text_key", "n_bytes", "unit", "low", "gram", "context").distinct()
        recurs = (F.col("unit") == BYTE) | (F.col("doc") < F.col("doc_high"))
        spans = spans.unionByName(dealt.filter(alone & recurs).select("gram", "context", all_of.alias("spans")))
    placed = once.join(spans_by_context(spans), ["gram", "context"]).select("text_key", "n_bytes", "unit", "low", "spans")
    if keep_first:
        placed = placed.unionByName(copies)
    moved = F.transform("spans", lambda s: F.struct((s["start"] + F.col("low")).alias("start"), (s["end"] + F.col("low")).alias("end")))
    of = lambda unit: F.flatten(F.collect_list(F.when(F.col("unit") == unit, F.col("spans"))))
    return placed.withColumn("spans", moved).groupBy("text_key", "n_bytes").agg(of(BYTE).alias("spans"), of(WORD).alias("passages"))


def _remaining(batches):
    for batch in batches:
        counts: list[tuple[int, int, int, int]] = []
        digests, kept = [], []
        for text, spans, passages in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "passages"))):
            raw, at, removed, runs, pieces = text.encode(), 0, 0, 0, []
            to = -1
            for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
                if start > to:
                    pieces.append(raw[at:start])
                    runs += 1
                    removed += end - start
                    at = to = end
                elif end > to:
                    removed += end - to
                    at = to = end
            pieces.append(raw[at:])
            rest = b"".join(pieces)
            counts.append((removed, runs, *_covered(passages)))
            digests.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        cols = {n: batch.column(n) for n in batch.schema.names if n not in ("text", "spans", "passages")}
        counted = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays([*cols.values(), *counted, pa.array(digests, pa.string()), pa.array(kept, pa.binary())], [*cols, "n_removed", "n_spans", "n_shared_words", "n_passages", "kept_sha256", "rest"])


def _covered(spans: list[dict] | None) -> tuple[int, int]:
    """How much some spans cover, and in how many runs."""
    n = runs = 0
    to = -1
    for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
        runs += start > to
        n += max(0, end - max(start, to))
        to = max(to, end)
    return n, runs


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return only(docs, "doc_id", "text").select("doc_id", text.alias("text")).withColumn("text_key", F.xxhash64("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))


def strip(docs: DataFrame, keep_first: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, n_shared_words, n_passages, kept_sha256 and ``rest``, the bytes that are left of each text.

    n_shared_words counts the words in passages of WORDS words or more that another document holds, n_passages their
    runs; both are 0 with ``keep_first``.
    """
    keyed, scratch = _keyed(docs), Scratch()
    if keep_first:
        firsts = settle(keyed.groupBy("text_key", "n_bytes").agg(F.coalesce(F.min("doc_id"), F.lit(0)).alias("doc")), "first-documents")
        keyed = keyed.join(firsts, ["text_key", "n_bytes"])
    else:
        keyed = keyed.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))
    spans = settle(repeated_spans(keyed, scratch, keep_first), "spans")
    scratch.drop()
    joined = keyed.join(spans, ["text_key", "n_bytes"], "left")
    if keep_first:  # a later copy of a whole text goes with all that may recur
        all_ = F.array(F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end")))
        joined = joined.withColumn("spans", F.when((F.col("doc_id") != F.col("doc")) & (F.col("n_bytes") >= LENGTH), all_).otherwise(F.col("spans")))
    return map_batches(joined.select("doc_id", "n_bytes", "text", "spans", "passages"), _remaining, "doc_id long, n_bytes long, n_removed long, n_spans long, n_shared_words long, n_passages long, kept_sha256 string, rest binary")


def report(docs: DataFrame) -> DataFrame:
    return strip(docs).drop("rest")
