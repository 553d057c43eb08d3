"""Importance resampling towards a target: documents drawn by how much likelier their n-grams are in ``benchmark``.

Features are runs of one to three words; a feature's bucket is the CRC-32 of its words joined by spaces, modulo BUCKETS.
Each word's checksum is computed once; those of longer runs are composed by length-shift matrices (``llm.crc``), so
no run is ever written out. One pass counts buckets, BUCKETS numbers a task; the gains of buckets are BUCKETS numbers,
the only thing that passes through the driver; a second pass sums them over each document. Weights gain noise that a hash of
the id seeds, so a rerun draws alike. The best of the long enough documents are drawn: all scores are sorted by
ranges, and a range's first rank is the number of rows in the ranges before it, so no task holds them all.

Nulls: a null text has no words, so weight 0; a null id is seeded as the empty string and comes after all others of its
score. Rows with equal id and text have equal scores and ranks of their own, in the order in which the scores were
written. An empty table gives no rows; an empty target has T = 0. Texts are read whole, whatever their length.
Further columns pass through ``resample`` and are not read by ``report``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm import crc
from loomtext.llm.storage import Scratch, aside, map_batches, only
from loomtext.llm.words import ALNUM, LOWER, blocks, starts_by_text

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = "42:"


def features(texts: pa.Array, buckets: int = BUCKETS):
    """For each block of texts: the buckets of all features, the number of the text each stands in, and words by text."""
    for block in blocks(texts):
        data = LOWER[block.data]
        start, end, owner = block.words(ALNUM)
        length = end - start
        one = crc.of_spans(data, start, end)
        spaced = crc.joined(crc.of_spans(np.array([0x20], np.uint8), np.zeros(1, np.int64), np.ones(1, np.int64)).repeat(len(one)), one, length)
        found, of = [one], [owner]
        run = one
        for n in range(2, LONGEST + 1):
            # the run of n words from i on: that of n - 1 words, a space and word i + n - 1; the matrix is that word's with the space before it
            run = crc.joined(run[: len(one) - n + 1], spaced[n - 1 :], length[n - 1 :] + 1) if len(one) >= n else one[:0]
            whole = owner[: len(run)] == owner[n - 1 :][: len(run)]
            found.append(run[whole])
            of.append(owner[: len(run)][whole])
        yield block, (np.concatenate(found) % np.uint32(buckets)).astype(np.int64), np.concatenate(of), np.diff(starts_by_text(owner, len(block)))


def counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket that has any."""

    def run(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, bucket, _, _ in features(batch.column(0), buckets):
                total += np.bincount(bucket, minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    return map_batches(docs.select("text"), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket: ``buckets`` numbers, which both tables settle as a whole."""
    s, t = counts(docs, buckets).withColumnRenamed("n", "s"), counts(target, buckets).withColumnRenamed("n", "t")
    both = s.join(t, "bucket", "full").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    out = np.zeros((buckets, 2), dtype=np.int64)
    for bucket, in_docs, in_target in both.collect():  # at most ``buckets`` rows
        out[bucket] = in_docs, in_target
    n_docs, n_target = map(float, out.sum(0))
    up, down = (out[:, 1] + 1.0) * (n_docs + buckets), (out[:, 0] + 1.0) * (n_target + buckets)
    return np.floor(1000.0 * np.log(up / down)).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of every document."""
    buckets = len(gain)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at = 0
            for block, bucket, of, words in features(batch.column(1), buckets):
                n = len(block)
                sums = np.zeros(n, dtype=np.int64)
                np.add.at(sums, of, gain[bucket])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(words), pa.array(np.bincount(of, minlength=n).astype(np.int64)), pa.array(sums)], ["doc_id", "n_words", "n_features", "weight"])
                at += n

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {id_type}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Thousandths of a Gumbel number that depends on the seed and the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def drawn(scores: DataFrame, scratch: Scratch, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """scores (doc_id, n_words, score and others) with rank: 1, 2, 3, ... of the drawn, null of the others."""
    keys = ((F.col("n_words") < least_words), F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    dealt = scores.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    dealt = scratch.settle(dealt.withColumn("part", F.shiftright("at", 33)).withColumn("at", F.col("at").bitwiseAND((1 << 33) - 1)), "importance-order")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    most = dealt.filter(F.col("n_words") >= least_words).count() * percent // 100
    rank = F.col("offset") + F.col("at") + 1  # the long enough come first
    return dealt.join(offsets, "part").withColumn("rank", F.when(rank <= most, rank)).drop("part", "at", "offset", "row")


def scored(docs: DataFrame, target: DataFrame, scratch: Scratch, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """Every document's doc_id, n_words, n_features, weight, score and the number of its row, settled."""
    all_of = weighed(docs, gains(docs, target, buckets)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return scratch.settle(all_of.withColumn("row", F.monotonically_increasing_id()), "importance-scores")


def _ranked(docs: DataFrame, target: DataFrame, seed: str = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    scratch = Scratch()
    out = drawn(scored(docs, target, scratch, seed=seed), Scratch(), least_words, percent)
    scratch.drop()  # the order is settled apart
    return out


def report(docs: DataFrame, target: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank, n_words."""
    return _ranked(only(docs, "doc_id", "text"), only(target, "text")).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """The drawn documents with all their columns; ids have to be unique."""
    docs, restored = aside(docs, "doc_id", "text")
    ranked = _ranked(docs.select("doc_id", "text"), only(target, "text"), seed, least_words, percent)
    return restored(docs.join(ranked.filter("rank is not null").select("doc_id"), "doc_id", "left_semi"))


#: CRC-32 is linear: a byte's share depends on its distance from the end alone, and shares meet by exclusive or.
REPORT_SQL = r"""
WITH RECURSIVE step(b, k, c) AS (
  SELECT b::BIGINT, 0, b::BIGINT FROM range(256) r(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8
), tab AS MATERIALIZED (SELECT b, c AS t FROM step WHERE k = 8),
doc AS (SELECT 0 AS side, doc_id AS id, lower_ascii AS x FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)
  UNION ALL SELECT 1, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS MATERIALIZED (SELECT side, id, regexp_extract_all(x, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM doc),
f AS MATERIALIZED (
  SELECT side, id, g, count(*) AS n FROM (
    SELECT side, id, unnest(w) AS g FROM w
    UNION ALL SELECT side, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
    UNION ALL SELECT side, id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w) GROUP BY ALL),
gram AS MATERIALIZED (SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM f)),
far(d, b, c) AS (
  SELECT 0, b, t FROM tab
  UNION ALL SELECT d + 1, far.b, xor(far.c >> 8, tab.t) FROM far JOIN tab ON tab.b = far.c & 255 WHERE d < (SELECT max(length(h)) // 2 + 1 FROM gram)
), start(d, c) AS (
  SELECT 0, 4294967295::BIGINT
  UNION ALL SELECT d + 1, xor(start.c >> 8, tab.t) FROM start JOIN tab ON tab.b = start.c & 255 WHERE d < (SELECT max(length(h)) // 2 + 1 FROM gram)
), sums AS (
  SELECT g, bit_xor(far.c) AS c FROM (SELECT g, h, unnest(range(length(h) // 2)) AS i FROM gram) x
  JOIN far ON far.d = length(h) // 2 - 1 - i AND far.b = ('0x' || substr(h, (2 * i + 1)::INTEGER, 2))::BIGINT GROUP BY g
), bucket AS MATERIALIZED (
  SELECT g, xor(xor(sums.c, start.c), 4294967295) % 10000 AS b FROM sums JOIN gram USING (g) JOIN start ON start.d = length(h) // 2
), counted AS (
  SELECT b, coalesce(sum(n) FILTER (WHERE side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0)::DOUBLE AS t FROM f JOIN bucket USING (g) GROUP BY b
), total AS (SELECT sum(s) AS ss, sum(t) AS tt FROM counted),
gain AS (SELECT b, floor(1000.0::DOUBLE * ln(((t + 1.0::DOUBLE) * (ss + 10000.0::DOUBLE)) / ((s + 1.0::DOUBLE) * (tt + 10000.0::DOUBLE))))::BIGINT AS gain FROM counted, total),
weighed AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM f JOIN bucket USING (g) JOIN gain USING (b) WHERE side = 0 GROUP BY id),
scored AS (
  SELECT d.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000.0::DOUBLE * ln(-ln((('0x' || substr(sha256('42:' || d.doc_id::VARCHAR), 1, 8))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM documents d JOIN w ON w.side = 0 AND w.id = d.doc_id LEFT JOIN weighed ON weighed.id = d.doc_id
), ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) FILTER (WHERE n_words >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 5 * n // 100 THEN r END AS rank, n_words FROM ranked
"""
