"""WARC archives with one Zstandard dictionary each: records compressed one by one, the dictionary in a skippable frame before them.

A bounded sample of the records, as they will be archived, trains the dictionary (SAMPLE_PAGES pages by the hash of their id,
SAMPLE_CHARS of each); it stands in front of every archive, so that each can be read without the others. Tasks
write archives of about ARCHIVE_BYTES record by record, and hold one record at a time. A file is named after its task's
attempt, and its name reaches the manifest only if that attempt's rows are committed: what a lost or repeated
attempt has left is in no manifest and is never read. Files are written and read through pyarrow's file systems, by the
uri of the shared folder.

Of pages with equal payloads (by SHA-1 and length) the one with the largest id is written as a response, the others as
revisits that refer to it; digests are counted before they meet, so a payload that a third of all pages share
is one row of the table they are joined with, and the pages are shuffled by their ids.

Nulls and ties: a null html is an empty payload; a null url has no target header; a null id stands below all others, and
its record refers like any other. Rows that repeat the largest id of a payload are responses all. Bytes of a url
outside of printable ASCII are percent-encoded in the archive. An empty table gives no archives and no rows. Other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.storage import Scratch, map_batches, only, settle
from loomtext.storage import new_path

SAMPLE_PAGES = 400
SAMPLE_CHARS = 8 << 10
DICTIONARY_BYTES = 64 << 10
ARCHIVE_BYTES = 64 << 20
LEVEL = 6
READ_BYTES = 1 << 20
DATE = "1970-01-01T00:00:00Z"
#: The magic number of the skippable frame that holds a dictionary, that of a dictionary, and the profile of revisits.
DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"
_MANIFEST = "archive string, n_records long, n_bytes long"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record. A revisit has the headers of the whole payload and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda i: f"<{_ID}{'' if i is None else i}>"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(chr(b) if 0x20 < b < 0x7F else f"%{b:02X}" for b in url.encode()))
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """A record's page_id, url, type, refers_to, digest, payload (None of a revisit) and payload_bytes."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(b": ", 1) for line in http.split(b"\r\n")[1:])[b"Content-Length"])
    number = lambda text: int(text[len(_ID) + 1 : -1]) if text and len(text) > len(_ID) + 2 else None
    kind = fields["WARC-Type"]
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To")),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "payload": payload if kind == "response" else None, "payload_bytes": size,
    }


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def trained(samples: list[bytes], most: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from sample records. Too few of them cannot be trained on and give one of raw content, their own ends."""
    try:
        return zstandard.train_dictionary(most, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-most:]


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if raw.startswith(DICTIONARY_MAGIC) else zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """Writes one archive: the dictionary's frame, then a frame for each record."""

    def __init__(self, uri: str, dictionary: bytes):
        files, path = fs.FileSystem.from_uri(uri)
        files.create_dir(posixpath.dirname(path), recursive=True)
        self.uri, self.out = uri, files.open_output_stream(path, compression=None)
        self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)
        self.squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary) if dictionary else None)
        self.n_records, self.n_bytes = 0, 8 + len(dictionary)

    def add(self, raw: bytes) -> None:
        frame = self.squeeze.compress(raw)
        self.out.write(frame)
        self.n_records, self.n_bytes = self.n_records + 1, self.n_bytes + len(frame)

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.uri, self.n_records, self.n_bytes


def records_in(uri: str) -> Iterator[dict]:
    """The records of an archive, one in memory at a time."""
    files, path = fs.FileSystem.from_uri(uri)
    with files.open_input_stream(path, compression=None) as source:
        magic, size = struct.unpack("<II", source.read(8))
        if magic != DICTIONARY_FRAME:
            raise ValueError(f"{uri} has no dictionary before its records")
        raw = source.read(size)
        opened = zstandard.ZstdDecompressor(dict_data=_dictionary(raw) if raw else None)
        one, parts, rest = opened.decompressobj(), [], b""
        while rest := rest or source.read(READ_BYTES):
            parts.append(one.decompress(rest))
            rest = b""
            if one.eof:
                yield parsed(b"".join(parts))
                rest, one, parts = one.unused_data, opened.decompressobj(), []
        if parts:
            raise ValueError(f"{uri} ends within a record")


def planned(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """Pages with payload_bytes, hex (SHA-1) and the id that a revisit refers to, ``refers_to``, null for responses."""
    html = F.coalesce("html", F.lit(""))
    sized = pages.select("page_id", "url", "html", F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(F.encode(html, "UTF-8")).alias("hex"))
    slim = scratch.settle(sized.select("page_id", "hex", "payload_bytes"), "warc-digests")
    last = slim.groupBy("hex", "payload_bytes").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = slim.join(last, ["hex", "payload_bytes"]).filter("page_id is null or page_id < last")
    again = again.select(F.col("page_id").alias("again_id"), F.col("hex").alias("again_hex"), "last").distinct()
    met = sized.join(again, sized["page_id"].eqNullSafe(again["again_id"]) & (sized["hex"] == again["again_hex"]), "left")
    return met.select("page_id", "url", "html", "payload_bytes", "hex", F.col("last").alias("refers_to"))


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    for page_id, url, html, size, hex_, refers_to in zip(*(c for c in batch.columns)):
        payload = (html.as_py() or "").encode()
        yield page_id.as_py(), url.as_py(), payload, base64.b32encode(bytes.fromhex(hex_.as_py())).decode(), size.as_py(), refers_to.as_py(), refers_to.as_py() is not None


def sampled(pages: DataFrame) -> list[tuple]:
    """At most SAMPLE_PAGES pages with the beginnings of their html: those whose ids and urls have the least hashes, found before any html is read."""
    order = F.xxhash64("page_id", "url")
    bound = pages.select(order.alias("h")).orderBy("h").limit(SAMPLE_PAGES).agg(F.max("h")).first()[0]
    if bound is None:
        return []
    first = F.substring(F.coalesce("html", F.lit("")), 1, SAMPLE_CHARS)
    return pages.filter(order <= bound).select("page_id", "url", first).limit(SAMPLE_PAGES).collect()


def write(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives ``pages`` (page_id, url, html) under ``folder``, by default one in the shared folder. Returns the manifest: archive, n_records, n_bytes."""
    pages = only(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long"))
    folder = folder or new_path(pages.sparkSession, "warc")
    sample = sampled(pages)
    dictionary = trained([record(p, u, h.encode(), digest_of(h.encode()), len(h.encode()), None, False) for p, u, h in sample])

    def run(batches):
        context = TaskContext.get()
        done, archive, made = [], None, f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        for batch in batches:
            for row in _rows(batch):
                archive = archive or Archive(f"{made}-{len(done):05d}.warc.zst", dictionary)
                archive.add(record(*row))
                if archive.n_bytes >= archive_bytes:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["archive", "n_records", "n_bytes"])

    scratch = Scratch()
    manifest = settle(map_batches(planned(pages, scratch), run, _MANIFEST), "warc-manifest")
    scratch.drop()
    return manifest


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives: page_id, url, record_type, refers_to, payload_digest, payload_bytes and payload (null of revisits).

    A response's digest and length are those of the payload that was read, and must be the ones its headers state.
    """
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_digest": pa.string(), "payload_bytes": pa.int64()}
    kinds |= {"payload": pa.binary()} if payloads else {}
    schema = pa.schema(list(kinds.items()))

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                held, size = [], 0
                for r in records_in(uri):
                    if r["payload"] is not None and (digest_of(r["payload"]), len(r["payload"])) != (r["payload_digest"], r["payload_bytes"]):
                        raise ValueError(f"{uri}: the payload of page {r['page_id']} is not what its headers state")
                    held.append({k: r[k] for k in kinds})
                    size += 200 + (len(r["payload"] or b"") if payloads else 0)
                    if size >= READ_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)

    spark_types = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long" + (", payload binary" if payloads else "")
    each = max(1, manifest.count())  # archives, dealt out evenly
    return map_batches(manifest.select("archive").repartition(min(each, 10_000)), run, spark_types)


def report(pages: DataFrame) -> DataFrame:
    """Writes the archives and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    return read(write(pages), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


REPORT_SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
last AS (SELECT h, max(page_id) AS last FROM p GROUP BY h),
bits AS (SELECT page_id, url, h, list_reduce(list_transform(string_split(sha1(h), ''), lambda x: right(bin(16 + ('0x' || x)::INTEGER), 4)), lambda a, b: a || b) AS b FROM p)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_reduce(list_transform(range(5), lambda k: substr(b, (5 * i + k + 1)::INTEGER, 1)::INTEGER * (16 >> k::INTEGER)), lambda x, y: x + y), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to, url
FROM bits JOIN last USING (h)
"""
