"""Importance resampling, ranked search and WARC archives against plain versions."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyarrow import fs
from pyspark.sql import functions as F

from loomtext.llm import blockmax, catalog, crc, importance, langid, warc
from tests.llm import brute
from tests.llm.test_operators import odd_documents
from tests.oracle import same

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def words(text):
    return [brute.lower(w) for w in WORD.findall(text or "")]


@pytest.mark.parametrize("name", ("op11_importance_resample", "op12_ranked_search", "op13_warc_archive"))
def test_equals_sql(spark, sf_dir, name):
    same(catalog.QUERIES[name](spark, sf_dir), catalog.ORACLE_SQL[name], sf_dir)


# --- importance resampling ------------------------------------------------------------------------------------


def test_checksums_of_spans_and_joins():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 9000).astype(np.uint8)
    start = rng.integers(0, 4000, 300)
    end = start + np.concatenate((rng.integers(0, 60, 290), rng.integers(60, 5000, 10)))
    got = crc.of_spans(data, start, end)
    assert [int(x) for x in got] == [zlib.crc32(data[s:e].tobytes()) for s, e in zip(start, end)]
    both = crc.joined(got[:-1], got[1:], (end - start)[1:])
    assert [int(x) for x in both] == [zlib.crc32(data[a:b].tobytes() + data[c:d].tobytes()) for a, b, c, d in zip(start, end, start[1:], end[1:])]
    assert not len(crc.of_spans(data, start[:0], end[:0]))


def plain_resampling(rows, items, buckets=10_000):
    """[(n_features, weight, score, long enough)] in order of rows, and the number drawn."""

    def grams(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    each = [grams(t) for _, t in rows]
    s, t = Counter(b for g in each for b in g), Counter(b for _, x in items for b in grams(x))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000.0 * math.log((t[b] + 1.0) * (n_s + buckets) / ((s[b] + 1.0) * (n_t + buckets)))) for b in range(buckets)]
    out = []
    for (doc_id, text), g in zip(rows, each):
        weight = sum(gain[b] for b in g)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(g), weight, weight + math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= 20))
    return out


def test_resampling_equals_the_plain_version(spark, sf_dir):
    odd = odd_documents(spark).select("doc_id", "text")
    items = spark.createDataFrame([(1, "one two A three aA"), (2, None), (3, ""), (3, "abc one two")], ITEMS)
    docs = odd.unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    rows = [tuple(r) for r in docs.collect()]
    want = plain_resampling(rows, [tuple(r) for r in items.collect()])
    got = importance.report(docs.withColumn("row", F.lit(1)).withColumn("score", F.lit("x")), items).collect()
    assert sorted((str(r["doc_id"]), r["n_features"], r["weight"], r["score"]) for r in got) == sorted((str(d), n, w, s) for d, n, w, s, _ in want)
    fit = sorted((-s, d is None, d or 0) for d, _, _, s, long in want if long)
    drawn = sorted((r["rank"], -r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in got if r["rank"] is not None)
    assert [r[0] for r in drawn] == list(range(1, len(fit) * 5 // 100 + 1)) and [r[1:] for r in drawn] == fit[: len(drawn)]
    again = importance.report(docs.repartition(7), items).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_resampled_documents_keep_their_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("rank", F.lit("mine"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = importance.resample(docs, items)
    assert out.columns == docs.columns
    ranked = importance.report(docs, items).filter("rank is not null")
    assert sorted(r[0] for r in out.select("doc_id").collect()) == sorted(r[0] for r in ranked.select("doc_id").collect())
    assert importance.report(docs.filter("false"), items).count() == 0
    assert importance.report(docs, items.filter("false")).filter("rank is not null").count() == ranked.count()


def test_a_score_that_many_rows_share(spark):
    """Equal rows, a third of all, spread over the ranges and have ranks of their own."""
    rows = [(7, "a b c " * 10)] * 300 + [(i, f"w{i} " * 25) for i in range(600)]
    got = importance.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), spark.createDataFrame([(1, "a b c a b c")], ITEMS)).collect()
    assert len(got) == 900 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 46))


# --- ranked search --------------------------------------------------------------------------------------------


def plain_search(rows, items, k=10):
    docs = [(d, words(t)) for d, t in rows]
    n_docs, n_terms = sum(bool(w) for _, w in docs), sum(len(w) for _, w in docs)
    df = Counter(t for _, w in docs for t in set(w))
    out = []
    for item, text in items:
        scores = []
        for d, w in docs:
            m, tf = 25 + (75 * len(w) * n_docs) // max(1, n_terms), Counter(w)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in words(text) if tf[t])
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(scores)[:k])]
    return out


def test_bytes_of_numbers():
    x = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**34])
    raw, at = blockmax.packed(x)
    assert (blockmax.unpacked(raw) == x).all() and at[-1] == len(raw)
    assert not len(blockmax.unpacked(blockmax.packed(x[:0])[0]))


@pytest.mark.parametrize(("block", "shard", "first_of", "terms"), ((64, 12 << 20, 16, 200_000), (3, 4000, 2, 200_000), (2, 20_000, 1, 40)))
def test_search_equals_the_plain_version(spark, sf_dir, monkeypatch, block, shard, first_of, terms):
    for name, value in (("BLOCK", block), ("SHARD_BYTES", shard), ("FIRST_OF", first_of), ("QUERY_TERMS", terms), ("FIRST_DOCS", 5)):
        monkeypatch.setattr(blockmax, name, value)
    docs = odd_documents(spark).select("doc_id", "text").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    docs = docs.unionByName(spark.createDataFrame([(-i, "tied words tied") for i in range(30)], "doc_id long, text string"))
    bench = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    items = [*bench[:12], (500, None), (501, " !"), (502, "tied"), (503, "TIED tied words zzzzz"), (None, "one words"), (504, "nosuchterm"), (505, "null id here")]
    got = blockmax.report(docs.withColumn("term", F.lit("x")), spark.createDataFrame(items, ITEMS).withColumn("query", F.lit(1))).collect()
    want = plain_search([tuple(r) for r in docs.collect()], items)
    assert sorted(map(str, ((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in got))) == sorted(map(str, want))


def test_search_of_empty_tables(spark, sf_dir):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert blockmax.report(docs.filter("false"), items).count() == 0
    assert blockmax.report(docs, items.filter("false")).count() == 0


def test_blocks_below_the_least_score_stay_closed():
    """A term that stands apart decides, and blocks of the common term that cannot reach its score are not decompressed."""
    texts = pa.array(["common " * 3 + f"x{i}" for i in range(4000)] + ["rare rare common"] * 10, pa.large_string())
    rows = pa.Table.from_batches(list(blockmax.shard_rows(0, pa.array(range(4010)), texts, 4010, 16_000)))
    shard = blockmax.Shard(rows.filter(pa.compute.is_in(rows["term"], pa.array(["common", "rare", ""]))))
    docs, _ = blockmax.best(shard, [("rare", 8000), ("common", 1)], 10, 1)
    assert sorted(shard.ids[docs]) == list(range(4000, 4010)) and shard.open.sum() < 5 < len(shard.open)


# --- archives -------------------------------------------------------------------------------------------------


def page_rows():
    rows = [(i, f"http://h/{i}", f"<p>page {i} é</p>" * (i % 7)) for i in range(60)]
    rows += [(100 + i, f"http://c/{i}", "<p>copied</p>") for i in range(20)] + [(200, None, None), (201, "http://e/ü\r\nX: y", ""), (None, "http://n/", "<p>copied</p>"), (None, None, "alone"), (202, "", "x" * 300_000)]
    return rows + [(119, "http://c/19", "<p>copied</p>")]


def test_archives_round_trip(spark):
    rows = page_rows()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("last", F.lit(1)).repartition(5)
    manifest = warc.write(df, archive_bytes=20_000)
    assert manifest.agg(F.sum("n_records")).first()[0] == len(rows)
    got = warc.read(manifest).collect()
    last = defaultdict(lambda: None)
    for i, _, h in rows:
        if i is not None and (last[h or ""] is None or i > last[h or ""]):
            last[h or ""] = i
    want = []
    for i, _, h in rows:
        raw, to = (h or "").encode(), last[h or ""]
        again = to is not None and i != to
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", to if again else None, None if again else raw))
    assert sorted(map(str, want)) == sorted(str((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"]))) for r in got)
    assert {r["url"] for r in got if r["page_id"] == 201} == {"http://e/%C3%BC%0D%0AX:%20y"}
    assert warc.read(warc.write(df.filter("false"))).count() == 0


def test_an_archive_reads_alone(spark, sf_dir):
    """The dictionary stands in the leading frame, each record in a frame of its own, which plain tools read with it."""
    manifest = warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    first = manifest.first()
    files, path = fs.FileSystem.from_uri(first["archive"])
    raw = files.open_input_stream(path, compression=None).read()
    size = int.from_bytes(raw[4:8], "little")
    assert raw[:4] == b"\x5d\x2a\x4d\x18" and raw[8:12] == warc.DICTIONARY_MAGIC and len(raw) == first["n_bytes"]
    rest, n, plain, without = raw[8 + size :], 0, 0, 0
    while rest:
        one = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size])).decompressobj()
        record = one.decompress(rest)
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        rest, n, plain, without = one.unused_data, n + 1, plain + len(record), without + len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(record))
    assert n == first["n_records"] and len(raw) - size < without < plain


def test_records_that_are_damaged_raise(spark, tmp_path):
    archive = warc.Archive(f"file://{tmp_path}/a/x.warc.zst", b"")
    payload = b"<p>x</p>"
    archive.add(warc.record(1, "http://h/", payload, warc.digest_of(b"other"), len(payload), None, False))
    uri, _, size = archive.close()
    manifest = spark.createDataFrame([(uri, 1, size)], "archive string, n_records long, n_bytes long")
    with pytest.raises(Exception, match="is not what its headers state"):
        warc.read(manifest).count()
    rng = random.Random(2)
    (tmp_path / "a/y.warc.zst").write_bytes((tmp_path / "a/x.warc.zst").read_bytes()[: -rng.randint(1, 9)])
    with pytest.raises(ValueError, match="ends within"):
        list(warc.records_in(f"file://{tmp_path}/a/y.warc.zst"))


# --- kept models ----------------------------------------------------------------------------------------------


def test_models_are_trained_once(spark, sf_dir, monkeypatch):
    """The same rows find the model that was kept, other rows train one of their own."""
    calls, fit = [], langid.fit
    monkeypatch.setattr(langid, "fit", lambda sample: calls.append(len(sample)) or fit(sample))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id % 3 = 0")
    first, again = (langid.report(docs).collect() for _ in range(2))
    assert sorted(map(str, first)) == sorted(map(str, again)) and len(calls) == 1
    langid.report(docs.filter("doc_id > 30"))
    assert len(calls) == 2
