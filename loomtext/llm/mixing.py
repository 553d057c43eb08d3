"""Mixing sources to target weights.

Words are summed per source; each source's target follows from its weight, and target / size is the rate at which
its documents repeat. A document is emitted floor(rate) times, and once more if its draw, seeded by the hash of its
id and text, falls below a bound, so that a rerun takes the same copies. The bound is the fraction of the rate, held within
strata: documents of one source and about one size share a stratum. From the longest documents to the shortest, a
stratum's share of second copies is the fraction that the words still wanted are of the words still to come, rounded
by a hash-seeded number; in each stratum the documents with the least draws have them. Whatever the longer documents
took, the expected share of the next stratum stays the fraction of the rate (a ratio outside of [0, 1] aside), so over
seeds every document has its second copy with that probability, and a source misses its target by about one of its
shortest documents instead of by the chance of independent draws.

A stratum's bound is an order statistic of its draws: a histogram over HIST_BITS bits names the bin it lies in, and
only that bin's draws are ranked. Joins meet a table of strata, which is broadcast if it is small.

Nulls: a null text has size 0; null sources form one source, the last in order; a null doc_id draws as the empty
string, with its text. Rows that repeat both id and text share one draw and are taken alike. An empty table gives no rows.
Columns beyond those named pass through ``mix``; names that clash with the working columns are kept apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomtext.llm.storage import Scratch, aside, only, settle

#: Weights by the source's place in code point order, over and over.
WEIGHTS = (5, 2, 1)
#: No target exceeds so many times its source's size.
MOST_REPEATS = 3
#: Tables of at most so many strata are broadcast; larger ones are joined by shuffle.
BROADCAST_STRATA = 50_000
SEED = "mix-1:"
HIST_BITS = 8
_BITS = 48


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(key: Column, seed: str = SEED) -> Column:
    """A number of 48 bits that depends on the seed and the key alone."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key)), 1, 12), 16, 10).cast("long")


def row_key(doc_id: Column, text: Column) -> Column:
    """What a row is drawn by: its id and its text, so that rows without ids, or of one id, have draws of their own."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8")))


def size_class(size: Column) -> Column:
    """The number of bits of a size and the two after the first: sizes of a class differ by a fifth at most, from 8 on."""
    bits = F.bin(size)
    return (F.length(bits) * 4 + F.conv(F.rpad(F.substring(bits, 2, 2), 2, "0"), 2, 10).cast("int")).cast("int")


def source_key(source: Column) -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))


def ranked(per: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per source with ``place``, its number in code point order, null last. Ranges are numbered apart, so no task holds all sources."""
    dealt = per.repartitionByRange(F.col("source").isNull(), "source").withColumn("part", F.spark_partition_id())
    dealt = scratch.settle(dealt, "mix-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return dealt.join(offsets, "part").withColumn("place", F.col("offset") + within - 1).drop("part", "offset")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """One row per source: source, source_size, target, rate.

    The share of a unit of weight rises as sources reach their caps; each round takes one sum over the sources that
    the share so far leaves uncapped, and the last changes nothing. Comparisons are in integers.
    """
    scratch = Scratch()
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    per = settle(ranked(per, scratch).withColumn("weight", weight).withColumn("cap", F.col("source_size") * most).drop("place"), "mix-weights")
    scratch.drop()
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    total = per.agg(F.sum(wide("source_size")).alias("s"), F.sum("weight").alias("w")).first()
    free_size, free_weight = int(total["s"] or 0), int(total["w"] or 0)
    while True:
        capped = wide("weight") * F.lit(free_size).cast("decimal(18,0)") >= wide("cap") * F.lit(free_weight).cast("decimal(18,0)")
        held = per.filter(capped).agg(F.sum(wide("cap")).alias("s"), F.sum("weight").alias("w")).first()
        now = int(total["s"] or 0) - int(held["s"] or 0), int(total["w"] or 0) - int(held["w"] or 0)
        if now == (free_size, free_weight) or now[1] <= 0:
            break
        free_size, free_weight = now
    share = F.col("weight").cast("double") * F.lit(float(free_size)) / F.lit(float(max(1, free_weight)))
    target = F.when(capped, F.col("cap").cast("double")).otherwise(share)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size").cast("double")).otherwise(F.lit(0.0))
    return per.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")


def strata(slim: DataFrame, per: DataFrame, seed: str, scratch: Scratch) -> DataFrame:
    """One row per source and size class: source_key, size_class, source_size, target, whole and bound: a draw up to the bound has one copy more.

    slim: source_key, size_class, size, draw; per: what ``targets`` gives.
    """
    cells = slim.groupBy("source_key", "size_class").agg(F.count("*").alias("n"), F.sum("size").cast("double").alias("words"))
    start = draw(F.concat("source_key", F.lit(":"), F.col("size_class").cast("string")), seed).cast("double") / F.lit(float(1 << _BITS))
    one = F.struct((-F.col("size_class")).alias("order"), "size_class", F.col("n").cast("double").alias("n"), "words", start.alias("start"))
    sources = cells.groupBy("source_key").agg(F.sort_array(F.collect_list(one)).alias("cells"))  # a source has as many as sizes have classes
    sources = sources.join(per.withColumn("source_key", source_key(F.col("source"))).drop("source"), "source_key").withColumn("whole", F.floor("rate").cast("long"))

    def step(s, c):
        fraction = F.when(s["words"] > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), s["wanted"] / s["words"]))).otherwise(F.lit(0.0))
        more = F.floor(c["start"] + fraction * c["n"])
        taken = F.struct(c["size_class"].alias("size_class"), more.alias("more"))
        return F.struct((s["wanted"] - more.cast("double") * (c["words"] / c["n"])).alias("wanted"), (s["words"] - c["words"]).alias("words"), F.concat(s["out"], F.array(taken)).alias("out"))

    wanted = F.col("target") - F.col("whole").cast("double") * F.col("source_size").cast("double")
    first = F.struct(wanted.alias("wanted"), F.col("source_size").cast("double").alias("words"), F.array().cast("array<struct<size_class:int,more:bigint>>").alias("out"))
    shares = sources.withColumn("cell", F.explode(F.aggregate("cells", first, step, lambda s: s["out"])))
    cells = scratch.settle(shares.select("source_key", "cell.size_class", "source_size", "target", "whole", "cell.more"), "mix-strata")
    binned = slim.withColumn("bin", F.shiftright("draw", _BITS - HIST_BITS))
    bins = binned.groupBy("source_key", "size_class", "bin").agg(F.count("*").alias("n")).join(cells.filter("more > 0").select("source_key", "size_class", "more"), ["source_key", "size_class"])
    below = F.sum("n").over(Window.partitionBy("source_key", "size_class").orderBy("bin"))
    edge = bins.withColumn("upto", below).filter((F.col("upto") >= F.col("more")) & (F.col("upto") - F.col("n") < F.col("more")))
    edge = edge.select("source_key", "size_class", "bin", (F.col("more") - F.col("upto") + F.col("n")).alias("rank"))
    at = F.row_number().over(Window.partitionBy("source_key", "size_class", "bin").orderBy("draw"))
    found = binned.join(edge, ["source_key", "size_class", "bin"]).withColumn("at", at).filter("at = rank").select("source_key", "size_class", F.col("draw").alias("bound"))
    return cells.join(found, ["source_key", "size_class"], "left").withColumn("bound", F.coalesce("bound", F.lit(-1).cast("long"))).drop("more")


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """Every document as ``doc`` (all its columns) with its size, its source's size and target, and the copies taken."""
    sized = docs.select(F.struct("*").alias("doc"), "source", word_count(F.col("text")).alias("size"), draw(row_key(F.col("doc_id"), F.col("text")), seed).alias("draw"))
    sized = sized.withColumn("source_key", source_key(F.col("source"))).withColumn("size_class", size_class(F.col("size")))
    scratch = Scratch()
    slim = scratch.settle(sized.drop("doc"), "mix-sizes")
    per = scratch.settle(targets(slim.select("source", "size"), weights, most), "mix-targets")
    plan = settle(strata(slim.select("source_key", "size_class", "size", "draw"), per, seed, scratch), "mix-plan")
    scratch.drop()
    small = plan.limit(BROADCAST_STRATA + 1).count() <= BROADCAST_STRATA
    planned = sized.join(F.broadcast(plan) if small else plan, ["source_key", "size_class"], "left")
    copies = (F.col("whole") + (F.col("draw") <= F.col("bound")).cast("long")).cast("int")
    return planned.select("doc", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, each document as often as it is taken."""
    docs, restored = aside(docs, "doc_id", "source", "text")
    planned = plan_mix(docs, **options)
    return restored(planned.withColumn("doc", F.explode(F.array_repeat("doc", F.col("copies")))).select("doc.*"))


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies."""
    return plan_mix(only(docs, "doc_id", "source", "text")).select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.col("copies").cast("long").alias("copies"))


REPORT_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, 3 * source_size AS cap,
         (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::BIGINT AS weight
  FROM per
), ordered AS (
  SELECT *, cap::DOUBLE / weight::DOUBLE AS ratio, (sum(source_size) OVER ())::BIGINT AS all_size,
         (sum(weight) OVER ())::BIGINT AS all_weight FROM weighed
), stepped AS (
  SELECT *,
    all_size - coalesce(sum(cap) OVER w, 0) AS left_size,
    all_weight - coalesce(sum(weight) OVER w, 0) AS left_weight
  FROM ordered WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), judged AS (
  SELECT *, left_size * weight >= cap * left_weight AS capped FROM stepped
), shared AS (
  SELECT *, (all_size - coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0))::BIGINT AS free_size,
         (sum(weight) FILTER (WHERE NOT capped) OVER ())::BIGINT AS free_weight FROM judged
), aimed AS (
  SELECT source, source_size,
    CASE WHEN capped THEN cap::DOUBLE ELSE weight::DOUBLE * free_size::DOUBLE / free_weight::DOUBLE END AS target FROM shared
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0 END AS rate FROM aimed
), drawn AS (
  SELECT d.doc_id, d.size, coalesce('s' || d.source, 'null') AS source, r.source_size, r.target, floor(rate)::BIGINT AS whole, rate - floor(rate) AS fraction,
    length(bin(d.size)) * 4 + CASE rpad(substr(bin(d.size), 2, 2), 2, '0') WHEN '11' THEN 3 WHEN '10' THEN 2 WHEN '01' THEN 1 ELSE 0 END AS class,
    ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, '') || ':' || d.digest), 1, 12))::BIGINT AS u
  FROM sized d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source
), cells AS MATERIALIZED (
  SELECT source, class, count(*)::DOUBLE AS n, sum(size)::DOUBLE AS words, row_number() OVER (PARTITION BY source ORDER BY class DESC) AS i,
    any_value(target) - any_value(whole)::DOUBLE * any_value(source_size)::DOUBLE AS wanted, any_value(source_size)::DOUBLE AS all_words,
    ('0x' || substr(md5('mix-1:' || source || ':' || class::VARCHAR), 1, 12))::BIGINT::DOUBLE / 281474976710656.0::DOUBLE AS start FROM drawn GROUP BY source, class
), steps AS (
  SELECT DISTINCT source, 0::BIGINT AS i, wanted, all_words AS words, NULL::INTEGER AS class, NULL::DOUBLE AS more FROM cells
  UNION ALL
  SELECT source, i, wanted - more * (cell_words / n), words - cell_words, class, more FROM (
    SELECT c.source, c.i, s.wanted, s.words, c.words AS cell_words, c.n, c.class::INTEGER AS class,
      floor(c.start + CASE WHEN s.words > 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, s.wanted / s.words)) ELSE 0.0::DOUBLE END * c.n) AS more
    FROM steps s JOIN cells c ON c.source = s.source AND c.i = s.i + 1)
), shares AS (
  SELECT source, class, more FROM steps WHERE i > 0
), bounds AS (
  SELECT source, class, max(u) FILTER (WHERE place <= more) AS bound FROM (SELECT source, class, u, row_number() OVER (PARTITION BY source, class ORDER BY u) AS place FROM drawn)
  JOIN shares USING (source, class) GROUP BY source, class
), taken AS (
  SELECT *, whole + coalesce(u <= bound, false)::BIGINT AS copies FROM drawn JOIN bounds USING (source, class)
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, copies FROM taken
"""
