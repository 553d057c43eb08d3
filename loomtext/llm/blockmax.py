"""Ranked lexical search by Block-Max WAND over compressed posting blocks.

``build`` cuts the documents into shards of about SHARD_BYTES as they come from the scan and writes, without a shuffle,
a row for each block of BLOCK postings of a term: shard, term, block, its first and last document, the largest impact
in it, and its postings as differences and frequencies in variable-length bytes. One more row a shard, of the empty
term, holds its documents' ids and length norms. An impact is what a term of weight 1 adds to a document's score, so it
needs the number and the length of all documents, which one pass sums up first.

``search`` sends the blocks of the queries' terms, no others, to one task a shard. There the lists move by their blocks' bounds alone
(shallow moves): between two ends of blocks the same blocks may hold a document, and where the sum of their weighted
maxima is below the score that the k-th best has so far, all of it is skipped and nothing is decompressed. In what is left, the
pivots are the documents at which the maxima of the lists that stand there reach that score, and only pivots are scored.
Stretches go by descending bound, in batches that double, so that the k-th score is high early and the rest ends at the first
bound below it. Scores are integers, and bounds equal to the k-th score are kept, so ties fall by id.
A part of the shards is searched first; the k-th best scores there bound those of all others, as any k documents do.

Queries come in blocks of about QUERY_TERMS terms, one round over the index each, so the driver and the tasks hold
one block of them, whatever their number. A shard's matches are at most k a query, and tasks keep k before they
shuffle.

Nulls: a null text has no terms and is in no count. A null id ranks after all others of its score. Queries without terms,
or whose terms no document holds, have no rows; queries with a null id are one more query each. Repeated documents and
repeated queries rank as rows of their own. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm.storage import Scratch, map_batches, only, settle
from loomtext.llm.words import ALNUM, LOWER, blocks, spread

BLOCK = 64
SHARD_BYTES = 12 << 20
QUERY_TERMS = 200_000
#: Documents in the first batch of a search.
FIRST_DOCS = 128
#: One of so many shards is searched before the others.
FIRST_OF = 16
K = 10
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_ROWS = "shard long, term string, block int, n int, first int, last int, top long, bytes binary"


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers below 2**35 in seven bits a byte, the highest bit set while more follow: all bytes, and where each number starts."""
    sizes = np.ones(len(values), dtype=np.int64)
    for k in range(1, 5):
        sizes += values >= 1 << (7 * k)
    at = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros(at[-1], dtype=np.uint8)
    for k in range(5):
        has = sizes > k
        out[at[:-1][has] + k] = ((values[has] >> (7 * k)) & 127) | np.where(sizes[has] > k + 1, 128, 0)
    return out, at


def unpacked(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    if not len(ends):
        return np.zeros(0, dtype=np.int64)
    starts = np.concatenate(([0], ends[:-1] + 1))
    within = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * within), starts)


def postings(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms in order, then the term's number, document's number and frequency of each posting in order, and each document's terms counted.

    Terms are told apart by their bytes.
    """
    dictionary, numbers, owners, lengths, base = pa.array([], pa.large_string()), [], [], [], 0
    chunks = []
    for block in blocks(texts, SHARD_BYTES):
        data = LOWER[block.data]
        start, end, owner = block.words(ALNUM)
        inside = ALNUM[data]
        offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
        chunks.append(pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data[inside])))
        owners.append(owner + base)
        lengths.append(np.bincount(owner, minlength=len(block)))
        base += len(block)
    coded = pa.chunked_array(chunks, pa.large_string()).combine_chunks().dictionary_encode() if chunks else None
    if coded is None or not len(coded):
        return [], *(np.zeros(0, np.int64) for _ in range(3)), np.concatenate([*lengths, np.zeros(0, np.int64)]).astype(np.int64)
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    dictionary = coded.dictionary
    order = pa.compute.sort_indices(dictionary).to_numpy()
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    numbers = place[coded.indices.to_numpy()]
    n_docs, owner = max(1, base), np.concatenate(owners)
    key, tf = np.unique(numbers * n_docs + owner, return_counts=True)
    return dictionary.take(pa.array(order)), key // n_docs, key % n_docs, tf.astype(np.int64), np.concatenate(lengths).astype(np.int64)


def norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 25 + (75 * n * n_docs) // max(1, n_terms)


def shard_rows(shard: int, ids: pa.Array, texts: pa.Array, n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
    """The index rows of one shard."""
    names = ["shard", "term", "block", "n", "first", "last", "top", "bytes"]
    terms, term, doc, tf, length = postings(texts)
    longest = np.argsort(-length, kind="stable")  # documents of like length side by side, so that a block's largest impact is near the others
    place = np.empty(len(longest), dtype=np.int64)
    place[longest] = np.arange(len(longest))
    doc, length, ids = place[doc], length[longest], ids.take(pa.array(longest))
    order = np.argsort(term * max(1, len(length)) + doc, kind="stable")
    doc, tf = doc[order], tf[order]
    m = norm(length, n_docs, n_terms)
    known = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
    documents = m.astype(np.int64).tobytes() + known.tobytes() + null.tobytes()
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in ([shard], [""])] + [pa.array([v], t) for v, t in ((0, pa.int32()), (len(m), pa.int32()), (0, pa.int32()), (0, pa.int32()), (0, pa.int64()), (documents, pa.binary()))], names)
    if not len(term):
        return
    starts = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
    count = np.diff(np.append(starts, len(term)))
    within = np.arange(len(term)) - np.repeat(starts, count)
    at = np.flatnonzero(within % BLOCK == 0)  # first posting of each block
    n = np.diff(np.append(at, len(term)))
    gap = np.diff(doc, prepend=0)
    gap[at] = 0  # the first document is in the row
    impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
    raw, places = packed(np.column_stack((gap, tf)).ravel())
    offsets = np.append(places[2 * at], places[-1]).astype(np.int32)
    payload = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    columns = [
        pa.array(np.full(len(at), shard, dtype=np.int64)), terms.take(pa.array(term[at])).cast(pa.string()), pa.array((within[at] // BLOCK).astype(np.int32)), pa.array(n.astype(np.int32)),
        pa.array(doc[at].astype(np.int32)), pa.array(doc[at + n - 1].astype(np.int32)), pa.array(np.maximum.reduceat(impact, at)), payload,
    ]
    whole = pa.RecordBatch.from_arrays(columns, names)
    for i in range(0, len(at), 20_000):
        yield whole.slice(i, 20_000)


class Index:
    """The rows of an index, the number of documents with terms and of all their terms."""

    def __init__(self, rows: DataFrame, n_docs: int, n_terms: int):
        self.rows, self.n_docs, self.n_terms = rows, n_docs, n_terms


def build(docs: DataFrame) -> Index:
    """Indexes every row of ``docs`` (doc_id, text) into the shared folder."""
    docs = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n = F.regexp_count("text", F.lit(_TERM)).cast("long")
    n_docs, n_terms = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()

    def run(batches):
        part, seen = TaskContext.get().partitionId(), 0
        held, size = [], 0

        def whole():
            ids, texts = (pa.chunked_array([b.column(i) for b in held]).combine_chunks() for i in (0, 1))
            ids, texts = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (ids, texts))
            return shard_rows((part << 24) + seen, ids, texts.cast(pa.large_string()), n_docs, n_terms)

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= SHARD_BYTES:
                yield from whole()
                held, size, seen = [], 0, seen + 1
        if held:
            yield from whole()

    return Index(settle(map_batches(docs, run, _ROWS), "block-index"), int(n_docs), int(n_terms))


class Shard:
    """The blocks of some terms in a shard, by term and place. Postings are decompressed block by block as they are asked for, and kept."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        own = rows.filter(pa.compute.not_equal(rows["term"], "")).sort_by([("term", "ascending"), ("block", "ascending")]).combine_chunks()
        raw = rows.filter(pa.compute.equal(rows["term"], ""))["bytes"][0].as_py()
        n_docs = len(raw) // 17
        self.norm, self.ids = np.frombuffer(raw, np.int64, n_docs), np.frombuffer(raw, np.int64, n_docs, 8 * n_docs)
        self.null = np.frombuffer(raw, np.uint8, n_docs, 16 * n_docs)
        self.first, self.last, self.top, self.n = (own[c].to_numpy().astype(np.int64) for c in ("first", "last", "top", "n"))
        terms = own["term"].to_pylist()
        starts = [i for i, t in enumerate(terms) if not i or terms[i - 1] != t]
        self.lists = {terms[i]: (i, j) for i, j in zip(starts, [*starts[1:], len(terms)])}
        column = own["bytes"].chunk(0) if len(own) else pa.array([], pa.binary())
        self.raw = np.frombuffer(column.buffers()[2], np.uint8) if len(own) and column.buffers()[2] else np.zeros(0, np.uint8)
        self.byte = np.frombuffer(column.buffers()[1], np.int32, len(own) + 1, 4 * column.offset).astype(np.int64) if len(own) else np.zeros(1, np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.n)))
        self.doc, self.impact = np.zeros(self.at[-1], np.int64), np.zeros(self.at[-1], np.int64)
        self.open = np.zeros(len(own), dtype=bool)

    def postings(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the postings of some blocks, and which of the blocks each belongs to; decompresses those that are closed."""
        closed = wanted[~self.open[wanted]]
        if len(closed):
            both = unpacked(self.raw[spread(self.byte[closed], self.byte[closed + 1] - self.byte[closed])])
            n = self.n[closed]
            total = np.cumsum(both[0::2])
            start = np.cumsum(n) - n
            doc = total - np.repeat(total[start] - self.first[closed], n)  # a block's first difference is 0
            tf, where = both[1::2], spread(self.at[closed], n)
            self.doc[where] = doc
            self.impact[where] = (1_000_000_000 * tf) // (1000 * tf + 8 * self.norm[doc])
            self.open[closed] = True
        return spread(self.at[wanted], self.n[wanted]), np.repeat(np.arange(len(wanted)), self.n[wanted])


def best(shard: Shard, weighed: list[tuple[str, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents and scores of the k best of a shard that reach ``least``, by Block-Max WAND with the cursors of all lists as arrays."""
    lists = [(shard.lists[t], w) for t, w in weighed if t in shard.lists]
    none = np.zeros(0, np.int64)
    if not lists:
        return none, none
    block = np.concatenate([np.arange(i, j) for (i, j), _ in lists])
    w = np.repeat([w for _, w in lists], [j - i for (i, j), _ in lists]).astype(np.int64)
    most = w * shard.top[block]
    # shallow moves: between two ends of blocks the same blocks may hold a document, and their maxima bound its score
    cuts, place = np.unique(np.concatenate((shard.first[block], shard.last[block] + 1)), return_inverse=True)
    begins, ends = place[: len(block)], place[len(block) :]
    bound = np.zeros(len(cuts), dtype=np.int64)
    np.add.at(bound, begins, most)
    np.subtract.at(bound, ends, most)
    bound = np.cumsum(bound)
    width = np.diff(cuts, append=cuts[-1])
    order = np.argsort(-bound, kind="stable")
    reach = np.cumsum(width[order])
    docs, scores, done, batch = none, none, 0, FIRST_DOCS
    while done < len(order) and bound[order[done]] >= max(least, 1):
        upto = int(np.searchsorted(reach, (reach[done - 1] if done else 0) + batch)) + 1
        taken = order[done:upto]
        taken = taken[bound[taken] >= max(least, 1)]
        done, batch = upto, batch * 2
        live = np.zeros(len(cuts) + 1, dtype=np.int64)
        live[taken + 1] = 1
        before = np.cumsum(live)
        wanted = np.flatnonzero(before[ends] > before[begins])  # no other block is decompressed
        at, of = shard.postings(block[wanted])
        doc = shard.doc[at]
        inside = live[np.searchsorted(cuts, doc, side="right")] == 1
        at, of, doc = at[inside], wanted[of[inside]], doc[inside]
        # pivots: documents at which the maxima of the lists that stand there reach the least score
        held, doc = np.unique(doc, return_inverse=True)
        pivot = np.zeros(len(held), dtype=np.int64)
        np.add.at(pivot, doc, most[of])
        keep = pivot[doc] >= least
        score = np.zeros(len(held), dtype=np.int64)
        np.add.at(score, doc[keep], w[of[keep]] * shard.impact[at[keep]])
        good = score >= max(least, 1)
        docs, scores = np.concatenate((docs, held[good])), np.concatenate((scores, score[good]))
        if len(docs) >= k:
            first = np.lexsort((shard.ids[docs], shard.null[docs], -scores))[:k]
            docs, scores = docs[first], scores[first]
            least = max(least, int(scores[-1]))
    return docs, scores


def search_shard(rows: pa.Table, queries: list[tuple[int, list[tuple[str, int]], int]], k: int) -> pa.Table:
    """query, doc_id, score of the k best of each query in one shard. queries: number, [(term, weight)], least score."""
    shard = Shard(rows)
    each = [(number, *best(shard, weighed, k, least)) for number, weighed, least in queries]
    docs = np.concatenate([np.zeros(0, np.int64), *(d for _, d, _ in each)])
    return pa.table({
        "query": pa.array(np.repeat(np.array([q for q, _, _ in each], dtype=np.int64), [len(d) for _, d, _ in each])),
        "doc_id": pa.array(shard.ids[docs], mask=shard.null[docs] == 1), "score": pa.array(np.concatenate([np.zeros(0, np.int64), *(s for _, _, s in each)])),
    })


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000.0 * math.log((2.0 * n_docs + 2.0) / (2.0 * df + 1.0)))


def search(index: Index, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item (item_id, text)."""
    scratch = Scratch()
    lowered = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = only(items, "item_id", "text").withColumn("query", F.monotonically_increasing_id())
    asked = asked.select("query", "item_id", F.explode(F.regexp_extract_all(lowered, F.lit(_TERM), F.lit(0))).alias("term"))
    asked = scratch.settle(asked.groupBy("query", "item_id", "term").agg(F.count("*").alias("times")), "query-terms")
    heads = index.rows.filter("term <> ''").select("shard", "term", "n")
    df = heads.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    asked = scratch.settle(asked.join(df, "term"), "query-weights")
    parts = max(1, math.ceil(asked.count() / QUERY_TERMS))
    found = []
    for part in range(parts):
        own = asked.filter(F.pmod(F.xxhash64("query"), F.lit(parts)) == part)
        found.append(scratch.settle(_round(index, own, k, scratch), "found"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    names = asked.select("query", "item_id").distinct()
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    ranked = every.withColumn("rank", rank).filter(F.col("rank") <= k).join(names, "query")
    out = settle(ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked")
    scratch.drop()
    return out


def _round(index: Index, asked: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """query, doc_id, score of one block of queries over all shards: some shards first, the others with the scores that these have reached."""
    queries = defaultdict(list)
    for query, term, times, df in asked.select("query", "term", "times", "df").collect():  # about QUERY_TERMS rows
        if (w := weight(index.n_docs, df)) > 0:
            queries[query].append((term, times * w))
    names = {t for ts in queries.values() for t, _ in ts} | {""}
    terms = asked.sparkSession.createDataFrame([(t,) for t in sorted(names)], "term string")
    rows = index.rows.join(F.broadcast(terms), "term", "left_semi").select("shard", "term", "block", "n", "first", "last", "top", "bytes")

    def over(part: DataFrame, least: dict[int, int]) -> DataFrame:
        plan = [(q, ts, least.get(q, 1)) for q, ts in sorted(queries.items())]

        def run(table: pa.Table) -> pa.Table:
            return search_shard(table, plan, k)

        return part.groupBy("shard").applyInArrow(run, "query long, doc_id long, score long")

    early = F.pmod(F.xxhash64("shard"), F.lit(FIRST_OF)) == 0
    first = scratch.settle(over(rows.filter(early), {}), "found-first")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    reached = dict(first.withColumn("place", place).filter(F.col("place") == k).select("query", "score").collect())  # a row a query
    return first.unionByName(over(rows.filter(~early), reached))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Each item's ten best documents: item_id, rank, doc_id, score."""
    index = build(docs)
    return search(index, items)


REPORT_SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
q AS MATERIALIZED (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
g AS (SELECT (count(*) FILTER (WHERE len(w) > 0))::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d),
p AS MATERIALIZED (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000.0::DOUBLE * ln((2.0::DOUBLE * g.n + 2.0::DOUBLE) / (2.0::DOUBLE * count(*) + 1.0::DOUBLE)))::BIGINT AS w FROM p, g GROUP BY term, g.n),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * p.n * g.n) // g.l))))::BIGINT AS score FROM q JOIN w USING (term) JOIN p USING (term), g GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""
