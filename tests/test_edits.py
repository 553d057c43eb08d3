"""Edits through ropes, in batches and in streams, against plain strings."""

import random
import time

from pyspark.sql import functions as F

from loomtext.operators import collab
from loomtext.operators.rope import Rope, moved
from loomtext.streaming import edits as streams

SCHEMA = "doc_id long, seq long, base long, action string, start int, end int, content string"


def plain(text, action, start, end, content, client=False):
    low = min(max(start or 0, 0), len(text))
    high = max(low, min(end or 0, len(text)))
    after = high if action != "add" or client else low
    put = content or "" if action in ("add", "update") else ""
    return text[:low] + put + text[after:], (low, after, len(put))


def made(seed, n, longest=3000):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        start = rng.choice([None, -3, rng.randint(0, 9000), rng.randint(0, 9000)])
        out.append((rng.choice(["add", "add", "update", "delete", None]), start, rng.choice([None, (start or 0) + rng.randint(0, 2500)]), rng.choice([None, "", "xé漢", "".join(rng.choices("abc", k=rng.randint(1, longest)))])))
    return out


def test_ropes_equal_strings():
    for seed in range(6):
        for client in (False, True):
            text = "start" * (seed * 2000)
            rope = Rope(text)
            for e in made(seed, 400):
                text, done = plain(text, *e, client)
                assert rope.edit(*e, client) == done
                assert rope.length == len(text)
            assert rope.text() == text and Rope(rope.pieces()).text() == text
            assert rope.sizes == [sum(map(len, g)) for g in rope.groups] and all(rope.groups)


def folded(rows, initial, client=False):
    """rows: (seq, base, action, start, end, content) of one document."""
    text, done = initial, []
    for _, base, action, start, end, content in sorted(rows, key=lambda r: r[0]):
        start, end = start or 0, end or 0
        for d in done[base:] if base is not None else ():
            start, end = moved(start, *d), moved(end, *d)
        text, d = plain(text, action, start, end, content, client)
        done.append(d)
    return text


def concurrent(seed, docs=5, n=40):
    rng, rows = random.Random(seed), []
    for d in range(docs):
        rows += [(d, i, None if rng.random() < 0.3 else rng.randint(max(0, i - 6), i), *e) for i, e in enumerate(made(100 * seed + d, n, 40))]
    rng.shuffle(rows)
    return rows


def test_concurrent_edits_are_rebased(spark):
    """Two writers at one version: both edits stand, wherever they were made."""
    rows = [(1, 1, 0, "add", 0, 0, "hello world"), (1, 2, 1, "add", 5, 5, ","), (1, 3, 1, "update", 6, 11, "there"), (1, 4, 1, "delete", 0, 1, None), (1, 5, 1, "add", 0, 0, "H")]
    assert collab.fold_edits(spark.createDataFrame(rows, SCHEMA)).first()["content"] == "Hello, there"
    rows = concurrent(1)
    initial = spark.createDataFrame([(0, "base text"), (3, None), (99, "no edits")], "doc_id long, text string")
    got = {r["doc_id"]: (r["content"], r["n_edits"]) for r in collab.fold_edits(spark.createDataFrame(rows, SCHEMA), initial).collect()}
    assert got == {d: (folded([r[1:] for r in rows if r[0] == d], "base text" if d == 0 else ""), 40) for d in range(5)}
    assert collab.fold_edits(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_stream_of_documents(spark, tmp_path):
    """Edits over several batches, bases in earlier ones."""
    rows = concurrent(2)
    for part in range(4):
        own = [r for r in rows if r[1] // 10 == part]
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.parquet(f"file://{tmp_path}/in/part={part}")
        time.sleep(1.1)  # files are taken in the order of their times
    read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
    out = streams.drained(streams.document_stream(read), "documents", conf=streams.ROCKS)
    assert out.select("batch").distinct().count() == 4
    got = {r["doc_id"]: (r["content"], r["n_edits"]) for r in streams.latest(out, "doc_id").collect()}
    assert got == {d: (folded([r[1:] for r in rows if r[0] == d], ""), 40) for d in range(5)}


def test_a_hundred_thousand_edits_of_one_document(spark):
    """Twice the edits take about twice as long."""
    def seconds(n):
        e = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), F.col("id").alias("seq"), F.when(F.col("id") % 5 == 4, "delete").otherwise("add").alias("action"), (F.col("id") * 7919 % (F.col("id") * 3 + 1)).cast("int").alias("start"), F.lit("abcd").alias("content"))
        start = time.perf_counter()
        row = collab.fold_edits(e.withColumn("end", F.col("start") + 2)).first()
        assert row["n_edits"] == n and n < len(row["content"]) < 4 * n
        return time.perf_counter() - start

    seconds(1000)
    few, many = seconds(50_000), seconds(100_000)
    assert many < 3 * few + 1
