"""A stored inverted index of segments: tables that queries read by term or by document instead of the texts.

vectors       range, doc_id, stored columns; dl_, il_, sq_, terms_, starts_, places_ of each field     bucketed by document range
blocks        range, field, term, n, most_tf, least_dl, total, docs, tfs, dls, positions     bucketed by document range, sorted by term
dictionary    field, term, df, ctf                       by field, sorted by term
documents     doc_id, stored columns, dl_, il_, sq_ of each field, sorted by doc_id

Texts are shuffled once, by document range, and analysed there a batch of documents at a time. The vectors are written by the
buckets of the blocks, so the documents of a range, or of a chunk of it where texts are long, meet without another shuffle. Tokens and
postings are never shuffled, so what moves is about the size of the texts; and a task sorts the blocks of one bucket, however many there
are, so what is sorted at once does not grow with the table. Ranges are as wide as ids lie close, gaps between groups of them left out.

Every batch of documents is a segment with tables of its own; a manifest names the segments, the analysis they share (fields,
stopwords, possessives, stemmer) and each segment's statistics, so that a path is all that opening an index takes. A version
of the manifest is a file that is created once or not at all: of two writers at a time one commits and the other raises, and
what a lost job has written is in no manifest. Segments of about one size are merged from their tables, not from the texts;
``vacuum`` deletes what no longer stands in the manifest.

A term's filter reaches the scan, where sorted files skip row groups and pages by their bounds, so a query reads the
postings of its own terms only. ``dl`` counts all positions of a field, ``il`` those without stopwords, ``sq`` is the
sum of squared frequencies. Stopwords and stems are settled here, when the index is written, for both sides: queries
are analysed by what the index holds.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators.corpus import Corpus
from loomtext.storage import commit_manifest, hadoop_path, latest_manifest, shared_folder

_DICTIONARY = "term string, df long, ctf long, field string"
_BLOCKS = "`range` long, field string, term string, n int, most_tf long, least_dl long, total long, docs array<{id}>, tfs array<long>, dls array<long>, positions array<array<int>>"
#: Columns of the vectors for each field.
_ANALYSED = {"dl": "bigint", "il": "bigint", "sq": "double", "terms": "array<string>", "starts": "array<int>", "places": "array<int>"}
#: Enters the key of kept indexes: those of another layout are not opened.
LAYOUT = 3
#: Bytes of a row group, so that the bounds of sorted terms are narrow.
ROW_GROUP_BYTES = 8 << 20
#: Documents that are read by their ids; more are met by a join.
BY_ID = 10_000
#: Documents of a range, on average.
RANGE_DOCS = 64
#: Cells of equally many documents, whose spans tell how close ids lie: so many, and more in a large table, each of CELL_DOCS, so that a cell is smaller
#: than a group of ids; and how much closer than usual they may lie.
WIDTH_CELLS, MOST_CELLS, CELL_DOCS, CLOSER = 180, 2000, 256, 8
#: Bytes of text of a bucket, about, and the fewest buckets; tokens of a chunk of a range.
BUCKET_BYTES, LEAST_BUCKETS, CHUNK_PLACES = 8 << 20, 8, 1 << 18
#: So many segments of one size are merged; sizes are told apart by powers of it.
MERGE_AT = 4


#: Bytes of rows that reach a Python worker at a time.
ARROW_BYTES = 8 << 20


def _list(offsets: np.ndarray, values: pa.Array | np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def _starts(counts: np.ndarray) -> np.ndarray:
    """Where runs of some lengths start, and where the last ends."""
    return np.concatenate(([0], np.cumsum(counts)))


def _flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The lengths and the values of a column of lists."""
    return pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()


def _ranked(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For each value its place among the distinct ones in order, and these."""
    coded = values.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), dtype=np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return rank[coded.indices.to_numpy()], coded.dictionary.take(order)


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where each value of sorted keys begins."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)


def inverted(tokens: pa.Array, stop: tuple[str, ...] = (), stems: pa.Array | None = None) -> list[pa.Array]:
    """dl, il, sq, terms, starts, places of each document's tokens: the distinct terms in order, and for each where its places start in ``places``."""
    n = len(tokens)
    length, flat = _flat(tokens)
    form = None
    if stems is None:
        code, words = _ranked(flat)
    else:
        code, words = _ranked(pa.concat_arrays([flat, stems.keys, stems.items]))
        word, stem = np.split(code[len(flat) :], 2)
        code, form = code[: len(flat)], np.arange(len(words))
        form[word] = stem
    owner, place = np.repeat(np.arange(n), length), np.arange(len(flat)) - np.repeat(_starts(length)[:-1], length)
    key = owner * len(words) + code
    order = np.argsort(key, kind="stable")
    head = _runs(key[order])
    times = np.diff(np.append(head, len(order)))
    sq = np.bincount(owner[order[head]], weights=times.astype(np.float64) ** 2, minlength=n)
    if stop or form is not None:
        kept = ~pc.is_in(words, pa.array(stop, words.type)).to_numpy(zero_copy_only=False)[code]
        owner, place, code = owner[kept], place[kept], code[kept]
        key = owner * len(words) + (code if form is None else form[code])
        order = np.argsort(key, kind="stable")
        head = _runs(key[order])
    held, terms = np.bincount(owner, minlength=n), np.bincount(owner[order[head]], minlength=n)
    begin = _starts(held)
    return [
        pa.array(length), pa.array(held), pa.array(sq), _list(_starts(terms), words.take(pa.array(key[order[head]] % max(1, len(words))))),
        _list(_starts(terms), (head - begin[owner[order[head]]]).astype(np.int32)), _list(begin, place[order].astype(np.int32)),
    ]


def _blocks_of(docs: pa.Table, field: str) -> pa.RecordBatch:
    """The blocks of a field of some documents of a range, in the order of ids."""
    docs = docs.take(pc.sort_indices(docs, [("doc_id", "ascending")])).combine_chunks()
    column = lambda c: docs.column(c).combine_chunks() if docs.column(c).num_chunks != 1 else docs.column(c).chunk(0)
    n_terms, terms = _flat(column(f"terms_{field}"))
    n_places, places = _flat(column(f"places_{field}"))
    owner = np.repeat(np.arange(len(docs)), n_terms)
    begin = _starts(n_places)
    start = column(f"starts_{field}").flatten().to_numpy().astype(np.int64) + begin[owner]
    tf = np.diff(np.append(start, begin[-1]))  # lists stand one behind the other
    rank, words = _ranked(terms)
    order = np.argsort(rank, kind="stable")
    head = _runs(rank[order])
    owner, start, tf = owner[order], start[order], tf[order]
    dl, lists = column(f"dl_{field}").to_numpy()[owner], np.append(head, len(order))
    moved = places.to_numpy()[np.repeat(start - _starts(tf)[:-1], tf) + np.arange(tf.sum())]
    over = lambda f, x: f.reduceat(x, head) if len(head) else x
    same = lambda x: pa.array([x], pa.string()).take(pa.array(np.zeros(len(head), dtype=np.int64)))
    made = {
        "range": column("range").take(pa.array(np.zeros(len(head), dtype=np.int64))), "field": same(field), "term": words, "n": pa.array(np.diff(lists).astype(np.int32)),
        "most_tf": pa.array(over(np.maximum, tf)), "least_dl": pa.array(over(np.minimum, dl)), "total": pa.array(over(np.add, tf)),
        "docs": _list(lists, column("doc_id").take(pa.array(owner))), "tfs": _list(lists, tf), "dls": _list(lists, dl), "positions": _list(lists, _list(_starts(tf), moved)),
    }
    return pa.RecordBatch.from_arrays(list(made.values()), list(made))


def _chunks(batches: Iterator[pa.RecordBatch], fields: tuple[str, ...]) -> Iterator[pa.Table]:
    """The documents of a range in chunks of about CHUNK_PLACES."""
    held, n = [], 0
    for batch in batches:
        size = sum(pc.list_value_length(batch.column(f"places_{f}")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields)
        at = 0
        for i, more in enumerate(size.tolist()):
            if n and n + more > CHUNK_PLACES:
                yield pa.Table.from_batches([*held, batch.slice(at, i - at)])
                held, n, at = [], 0, i
            n += more
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def width_of(ids: list[int] | None, n: int) -> int:
    """The width of ranges of about RANGE_DOCS of n documents, whose ids are given at the ends of cells, equal steps over nine tenths of them. It goes
    by the usual span of a cell, and where ids lie in far groups by the closest ones, or a range would hold a whole group."""
    if not n:
        return 1
    cells = len(ids) - 1
    step = min(cells, -(-cells * RANGE_DOCS * 2 // n))  # a cell holds more documents than a range
    spans = sorted(b - a + 1 for a, b in zip(ids, ids[step:]))
    span = min(spans[len(spans) // 2], CLOSER * spans[len(spans) // 20])
    return max(1, math.ceil(span * RANGE_DOCS * cells / (0.9 * n * step)))


def range_width(docs: DataFrame, key: str) -> int:
    """The width of ranges for the ids of some documents."""
    cells = min(MOST_CELLS, max(WIDTH_CELLS, docs.count() // CELL_DOCS))
    at = [0.05 + 0.9 * i / cells for i in range(cells + 1)]  # without the ends: a stray id does not widen ranges
    return width_of(*docs.agg(F.percentile_approx(key, at, 10 * MOST_CELLS), F.count(key)).first())


def _postings_of(doc: Column, field: str) -> Column:
    """term, doc_id, tf, dl, positions of the terms of a document's field."""
    def posting(term, j):
        start = F.get(doc[f"starts_{field}"], j)
        n = F.coalesce(F.get(doc[f"starts_{field}"], j + 1), F.size(doc[f"places_{field}"])) - start
        return F.struct(term.alias("term"), doc["doc_id"].alias("doc_id"), n.cast("long").alias("tf"), doc[f"dl_{field}"].alias("dl"), F.slice(doc[f"places_{field}"], start + 1, n).alias("positions"))

    return F.transform(doc[f"terms_{field}"], posting)


class Index:
    """An index under a path, as one version of its manifest has it."""

    def __init__(self, spark: SparkSession, path: str, manifest: dict):
        self.spark, self.path, self.manifest = spark, path, manifest
        self.stop, self.stemmer, self.fields = tuple(manifest["stop"]), manifest["stemmer"], tuple(manifest["fields"])
        self._forms: dict[str, str] = {}

    @staticmethod
    def open(spark: SparkSession, path: str) -> Index:
        """The latest version of an index. Raises ValueError where there is none."""
        manifest = latest_manifest(spark, path)
        if manifest is None:
            raise ValueError(f"no index at {path}")
        return Index(spark, path, manifest)

    def _commit(self, **changes) -> Index:
        """The next version."""
        return Index(self.spark, self.path, commit_manifest(self.spark, self.path, self.manifest | changes))

    @property
    def segments(self) -> list[dict]:
        return self.manifest["segments"]

    def _where(self, segment: dict) -> str:
        return f"{self.path}/segments/{segment['name']}"

    def table(self, name: str) -> DataFrame:
        """A table of all segments; those by field are read by schema, as an empty corpus leaves them without files. ``fields`` sums the segments' statistics."""
        if name == "fields":
            rows = [(f, *(sum(s["stats"][f][i] for s in self.segments) for i in range(3))) for f in self.fields]
            return self.spark.createDataFrame(rows, "field string, num_docs long, doc_count long, sum_tf long")
        reader = self.spark.read
        if name == "dictionary":
            reader = reader.schema(_DICTIONARY)
        return reduce(DataFrame.unionByName, (reader.parquet(f"{self._where(s)}/{name}") for s in self.segments))

    def _documents_in(self, segment: dict, ids: list | None = None) -> DataFrame:
        """The analysed documents of a segment, or of the ranges that hold some ids."""
        rows = self.spark.read.schema(self.manifest["vectors"]).parquet(f"{self._where(segment)}/vectors")
        width = self.manifest["range_width"]
        if ids is not None and width:  # as doubles, which the engine divides too
            rows = rows.filter(F.col("range").isin(*{math.floor(float(i) / float(width)) for i in ids}))
        return rows

    def blocks(self, segment: dict) -> DataFrame:
        """A segment's blocks, bucketed by document range: rows of one range are in one task, so lists meet without a shuffle."""
        where = f"{self._where(segment)}/blocks"
        name = "loomtext_blocks_" + hashlib.md5(where.encode()).hexdigest()[:16]
        if not self.spark.catalog.tableExists(name):
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({_BLOCKS.format(id=self.manifest['id_type'])}) USING parquet CLUSTERED BY (`range`) SORTED BY (field, term, `range`) INTO {segment['buckets']} BUCKETS LOCATION '{where}'")
        return self.spark.table(name)

    @property
    def stem(self):
        """What query words go through, as the terms did."""
        from loomtext.functions.porter import stem

        return {"none": None, "porter": stem, "dictionary": self._form_of}[self.stemmer]

    def _form_of(self, word: str) -> str:
        """The form that the lexicon has for a query's word."""
        if word not in self._forms:
            tried = T.inflected_from(word)
            known = {r[0] for r in self.spark.read.parquet(f"{self.path}/lexicon").filter(F.col("word").isin(*tried)).collect()} if tried else set()
            self._forms[word] = next((w for w in tried if w in known), word)
        return self._forms[word]

    @property
    def find(self):
        """What cuts query words into tokens, as the texts were; None for runs of letters and digits."""
        if self.manifest["rule"] == "runs":
            return None
        return regex.compile(T.word_pattern("")).findall

    def _corpus(self, docs: DataFrame) -> Corpus:
        m = self.manifest
        return Corpus(docs, m["id"], dict(m["fields"]), tuple(m["stop"]), m["possessive"], m["stemmer"], m["rule"])

    @staticmethod
    def build(corpus: Corpus, path: str, stored: tuple[str, ...] = ()) -> Index:
        """Writes a corpus as the first segment of an index."""
        id_type = corpus.docs.schema[corpus.id].dataType.simpleString()
        manifest = {
            "version": 0, "id": corpus.id, "id_type": id_type, "fields": dict(corpus.fields), "stop": list(corpus.stop), "possessive": corpus.possessive, "stemmer": corpus.stemmer, "rule": corpus.rule,
            "stored": [c for c in stored if c != corpus.id], "range_width": None, "ranges": 1, "appended": 0, "segments": [],
        }
        columns = [("range", "bigint"), ("doc_id", id_type), *((c, corpus.docs.schema[c].dataType.simpleString()) for c in manifest["stored"])]
        columns += [(f"{c}_{f}", kind) for f in corpus.fields for c, kind in _ANALYSED.items()]
        manifest["vectors"] = ", ".join(f"`{c}` {kind}" for c, kind in columns)
        index = Index(corpus.docs.sparkSession, path, manifest)
        if id_type in ("bigint", "int", "smallint", "tinyint"):
            manifest["range_width"] = range_width(corpus.docs, corpus.id)
        else:
            manifest["ranges"] = corpus.docs.count() // RANGE_DOCS + 1
        if corpus.stemmer == "dictionary":  # the first batch's words decide, for later batches too
            words = reduce(DataFrame.unionByName, (corpus.docs.select(F.explode(corpus.tokens_of(f)).alias("word")) for f in corpus.fields))
            words.distinct().repartitionByRange("word").sortWithinPartitions("word").write.mode("overwrite").parquet(f"{path}/lexicon")
        return index._commit(segments=[index._analysed(corpus)], appended=1)

    def append(self, docs: DataFrame, merge: bool = True) -> Index:
        """The index with a batch of documents as a segment of its own, analysed as the others are; ids must be new. Small segments are merged. The manifest counts batches in ``appended``."""
        key = self.manifest["id"]
        known = docs.select(F.col(key).alias("doc_id")).join(self.table("documents").select("doc_id"), "doc_id", "left_semi").first()
        if known is not None:
            raise ValueError(f"document {known[0]} is in the index")
        grown = self._commit(segments=[*self.segments, self._analysed(self._corpus(docs))], appended=self.manifest["appended"] + 1)
        return grown.merged() if merge else grown

    def merged(self) -> Index:
        """The index after merging: while MERGE_AT segments are of one size, by powers of MERGE_AT, they become one."""
        index = self
        while True:
            sizes: dict[int, list[dict]] = {}
            for s in index.segments:
                sizes.setdefault(max(1, s["docs"]).bit_length() // (MERGE_AT.bit_length() - 1), []).append(s)
            many = next((own for _, own in sorted(sizes.items()) if len(own) >= MERGE_AT), None)
            if many is None:
                return index
            part = Index(index.spark, index.path, index.manifest | {"segments": many})
            size = sum(s["bytes"] for s in many)
            one = index._written(index._placed(reduce(DataFrame.unionByName, (part._documents_in(s) for s in many)), size), size)
            index = index._commit(segments=[*(s for s in index.segments if s not in many), one])

    def vacuum(self) -> list[str]:
        """Deletes the segments that this version does not name, and returns their names. Readers of earlier versions lose them."""
        fs, where = hadoop_path(self.spark, f"{self.path}/segments")
        gone = sorted({x.getPath().getName() for x in fs.listStatus(where)} - {s["name"] for s in self.segments})
        for name in gone:
            fs.delete(hadoop_path(self.spark, f"{self.path}/segments/{name}")[1], True)
        return gone

    def _analysed(self, corpus: Corpus) -> dict:
        """Writes a corpus as a segment."""
        stored, fields, texts = self.manifest["stored"], self.fields, list(dict.fromkeys(corpus.fields.values()))
        octets = reduce(lambda a, b: a + b, (F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c in texts))
        size = corpus.docs.agg(F.coalesce(F.sum(octets), F.lit(0))).first()[0]
        docs = corpus.docs.select(F.col(corpus.id).alias("doc_id"), *(F.col(c).alias(f"of_{c}") for c in stored), *(F.col(c).alias(f"text_{c}") for c in texts))
        stemmed = corpus.stemmer != "none"
        if stemmed:
            docs = docs.join(self._stems(corpus), "doc_id", "left").withColumn("stems", F.coalesce("stems", F.create_map().cast("map<string,string>")))
        placed = self._placed(docs.withColumn("range", self._range(F.col("doc_id"))), size)
        tokens = (T.tokens(F.col(f"text_{corpus.fields[f]}"), possessive=corpus.possessive, rule=corpus.rule).alias(f"tokens_{i}") for i, f in enumerate(fields))
        cut = placed.select("range", "doc_id", *(f"of_{c}" for c in stored), *tokens, *(["stems"] if stemmed else []))
        before, stop, n_fields = 2 + len(stored), tuple(corpus.stop), len(fields)
        names = ["range", "doc_id", *stored, *(f"{c}_{f}" for f in fields for c in _ANALYSED)]

        def analysed(batches):
            for batch in batches:
                if batch.num_rows:
                    stems = batch.column("stems") if stemmed else None
                    parts = (p for i in range(n_fields) for p in inverted(batch.column(f"tokens_{i}"), stop, stems))
                    yield pa.RecordBatch.from_arrays([*batch.columns[:before], *parts], names)

        self.spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
        return self._written(cut.mapInArrow(analysed, self.manifest["vectors"]), size)

    def _stems(self, corpus: Corpus) -> DataFrame:
        """doc_id, stems: the words of each document that their stem differs from, with it."""
        words = F.array_distinct(F.concat(*(corpus.tokens_of(f) for f in corpus.fields)))
        long = corpus.docs.select(F.col(corpus.id).alias("doc_id"), F.explode(words).alias("term"))
        stems = T.dictionary_stems(long, "term", self.spark.read.parquet(f"{self.path}/lexicon")) if corpus.stemmer == "dictionary" else T.stems(long, "term", corpus.stemmer)
        changed = long.join(stems.filter("stem != word"), F.col("term") == F.col("word"))
        return changed.groupBy("doc_id").agg(F.map_from_entries(F.collect_set(F.struct("word", "stem"))).alias("stems"))

    def _range(self, doc_id: Column) -> Column:
        width = self.manifest["range_width"]
        return F.floor(doc_id / F.lit(width)).cast("long") if width else F.pmod(F.xxhash64(doc_id), F.lit(self.manifest["ranges"]))

    @staticmethod
    def _buckets(size: int) -> int:
        return max(LEAST_BUCKETS, -(-size // BUCKET_BYTES))

    def _placed(self, rows: DataFrame, size: int) -> DataFrame:
        """Rows of documents by range, as the buckets of a segment of ``size`` bytes of text have them."""
        return rows.repartition(self._buckets(size), "range")

    def _written(self, docs: DataFrame, size: int) -> dict:
        """Writes the tables of a segment from analysed documents that are placed, and returns its entry in the manifest."""
        segment = {"name": f"s-{uuid.uuid4().hex}", "bytes": size, "buckets": self._buckets(size)}
        where = self._where(segment)
        write = lambda df: df.write.mode("append").option("parquet.block.size", ROW_GROUP_BYTES).option("compression", "zstd")
        self._write_blocks(self._bucketed(docs, segment, "vectors", "range", "doc_id"), segment)
        counts = self._blocks_in(segment).groupBy("field", "term").agg(F.sum("n").alias("df"), F.sum("total").alias("ctf"))
        write(counts.sortWithinPartitions("field", "term")).partitionBy("field").parquet(f"{where}/dictionary")
        lengths = [f"{c}_{f}" for f in self.fields for c in ("dl", "il", "sq")]
        docs = self._documents_in(segment).select("doc_id", *self.manifest["stored"], *lengths)
        write(docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id")).parquet(f"{where}/documents")
        some = [x for f in self.fields for x in (F.count_if(F.col(f"il_{f}") > 0), F.coalesce(F.sum(f"il_{f}"), F.lit(0)))]
        n, *counted = self.spark.read.parquet(f"{where}/documents").agg(F.count("*"), *some).first()
        return segment | {"docs": n, "stats": {f: [n, counted[2 * i], counted[2 * i + 1]] for i, f in enumerate(self.fields)}}

    def _blocks_in(self, segment: dict) -> DataFrame:
        """A segment's blocks as plain files."""
        return self.spark.read.schema(_BLOCKS.format(id=self.manifest["id_type"])).parquet(f"{self._where(segment)}/blocks")

    def _bucketed(self, rows: DataFrame, segment: dict, name: str, *order: str) -> DataFrame:
        """Writes a table of a segment by buckets, whose rows come from one task each, and returns it."""
        where = f"{self._where(segment)}/{name}"
        table = f"loomtext_{name}_" + hashlib.md5(where.encode()).hexdigest()[:16]
        out = rows.write.option("parquet.block.size", ROW_GROUP_BYTES).option("compression", "zstd").option("path", where)
        out.bucketBy(segment["buckets"], "range").sortBy(*order).saveAsTable(table)
        return self.spark.table(table)

    def _write_blocks(self, vectors: DataFrame, segment: dict) -> None:
        """The documents of a range meet in the task that reads its bucket, and its blocks stay there."""
        fields = self.fields

        def of_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for docs in _chunks(batches, fields):
                yield from (_blocks_of(docs, f) for f in fields)

        read = vectors.select("range", "doc_id", *(f"{c}_{f}" for f in fields for c in ("dl", "terms", "starts", "places")))
        made = read.groupBy("range").applyInArrow(of_range, _BLOCKS.format(id=self.manifest["id_type"]))
        self._bucketed(made, segment, "blocks", "field", "term", "range")

    def postings(self, terms: list[str], name: str = "body", columns: tuple[str, ...] = ("term", "doc_id", "tf", "positions")) -> DataFrame:
        """The lists of some terms of a field."""
        held = {"doc_id": "docs", "tf": "tfs", "dl": "dls", "positions": "positions"}
        own = [c for c in held if c in columns or c == "doc_id"]
        blocks = reduce(DataFrame.unionByName, (self._blocks_in(s).filter((F.col("field") == name) & F.col("term").isin(*terms)) for s in self.segments))
        each = blocks.select("term", F.explode(F.arrays_zip(*(held[c] for c in own))).alias("p"))
        return each.select("term", *(F.col("p")[held[c]].alias(c) for c in own)).select(*columns)

    def tokens(self, terms: list[str], name: str = "body") -> DataFrame:
        """doc_id, pos, term of some terms in long form."""
        return self.postings(terms, name, ("term", "doc_id", "positions")).select("doc_id", F.explode("positions").alias("pos"), "term")

    def dictionary(self, name: str = "body", terms: list[str] | None = None) -> DataFrame:
        """term, df, ctf: the whole dictionary of a field, or some terms of it."""
        own = self.table("dictionary").filter(F.col("field") == name)
        own = (own if terms is None else own.filter(F.col("term").isin(*terms))).select("term", "df", "ctf")
        return own if len(self.segments) == 1 else own.groupBy("term").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf"))

    def term_vectors(self, doc_ids: list[int] | None = None, name: str = "body") -> DataFrame:
        """doc_id, term, tf, positions, dl of all or some documents."""
        docs = reduce(DataFrame.unionByName, (self._documents_in(s, doc_ids).select("doc_id", *(f"{c}_{name}" for c in ("dl", "terms", "starts", "places"))) for s in self.segments))
        docs = docs if doc_ids is None else docs.filter(F.col("doc_id").isin(*doc_ids))
        each = docs.select(F.explode(_postings_of(F.struct(*docs.columns), name)).alias("p"))
        return each.select(*(F.col("p")[c].alias(c) for c in ("doc_id", "term", "tf", "positions", "dl")))

    @staticmethod
    def ids_of(rows: DataFrame) -> list | None:
        """The ids that rows (doc_id) name, if they are at most BY_ID."""
        ids = [r[0] for r in rows.select("doc_id").distinct().limit(BY_ID + 1).collect()]
        return sorted(i for i in ids if i is not None) if len(ids) <= BY_ID else None

    def of_documents(self, table: DataFrame, rows: DataFrame, ids: list | None) -> DataFrame:
        """The rows of a table for the documents that rows name: by their ids if they are few, so that the scan skips the others, else by a join."""
        if ids is None:
            return table.join(rows.select("doc_id").distinct(), "doc_id", "left_semi")
        return table.filter(F.col("doc_id").isin(*ids)) if ids else table.filter("false")

    def documents_of(self, rows: DataFrame, ids: list | None) -> DataFrame:
        """Lengths and stored columns of the documents that rows name."""
        return self.of_documents(self.table("documents"), rows, ids)

    def field_stats(self) -> DataFrame:
        """field, num_docs, doc_count, sum_tf, avg_len."""
        return self.table("fields").withColumn("avg_len", F.col("sum_tf") / F.col("doc_count"))

    def lengths(self, name: str = "body") -> DataFrame:
        """doc_id, dl_all (positions), dl_indexed (without stopwords)."""
        return self.table("documents").select("doc_id", F.col(f"dl_{name}").alias("dl_all"), F.col(f"il_{name}").alias("dl_indexed"))


def written_when(spark: SparkSession, path: str) -> tuple:
    """Time and size of a table's files, which tell whether an index of it still holds."""
    fs, where = hadoop_path(spark, path)
    return fs.getFileStatus(where).getModificationTime(), fs.getContentSummary(where).getLength()


def kept_at(spark: SparkSession, *key) -> str:
    """The path in the shared folder of what a key names, the same for every application."""
    return f"{shared_folder(spark)}/loomtext/indexes/{hashlib.sha256(repr((LAYOUT, *key)).encode()).hexdigest()[:32]}"


def index_of(source: str, corpus: Corpus, stored: tuple[str, ...] = ()) -> Index:
    """The index of a corpus read from ``source``: built in the shared folder by the first application that asks, and opened by all from then on."""
    spark = corpus.docs.sparkSession
    path = kept_at(spark, source, written_when(spark, source), tuple(corpus.fields.items()), corpus.stop, corpus.possessive, corpus.stemmer, corpus.rule, stored)
    try:
        return Index.open(spark, path)
    except ValueError:
        return Index.build(corpus, path, stored)


class Indexes:
    """Named indexes; the first opened is current."""

    def __init__(self, spark: SparkSession):
        self.spark, self.open_, self.current = spark, {}, None

    def open(self, path: str) -> Index:
        """Opens an index as it was built: its analysis comes from its manifest."""
        self.open_[path] = Index.open(self.spark, path)
        self.current = self.current or path
        return self.open_[path]

    def switch(self, path: str) -> Index:
        if path not in self.open_:
            raise ValueError(f"index {path} is not open")
        self.current = path
        return self.open_[path]

    def scan(self, term: str, field: str = "body") -> DataFrame:
        """Postings of one term of the current index, analysed as its texts were: doc_id, tf, positions."""
        index = self.open_[self.current]
        return index.postings([index.stem(term) if index.stem else term], field, ("doc_id", "tf", "positions"))
