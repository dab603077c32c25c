"""WARC archives in Zstandard with a dictionary: writer and reader.

An archive (.warc.zst) begins with a skippable frame (magic 0x184D2A5D) that holds
the dictionary, itself possibly a Zstandard frame; then comes one frame per record. The
reader loads the dictionary, decodes frame by frame and checks headers, lengths,
digests and block ends. Executors write archives through pyarrow's file systems
(file, hdfs, s3, gs) under temporary names that are renamed when whole, so a
repeated task leaves one archive; Spark's binaryFile source reads them back.
Records larger than a whole archive's share get an archive of their own.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, same, table, work_dir

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: Bytes of payloads after which a writer begins the next archive; bounds what a reader holds.
ARCHIVE_BYTES = 16 << 20
#: The dictionary is trained on at most so many bytes of an archive's first records.
DICTIONARY_SAMPLE, DICTIONARY_BYTES, LEVEL = 1 << 20, 32 << 10, 3
MIN_PAYLOAD = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


class BadArchive(ValueError):
    pass


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class Record:
    """page_id is None for a page without one. payload is None in a revisit that was read."""

    page_id: int | None
    url: str
    kind: str
    payload: bytes | None
    payload_bytes: int
    payload_digest: str
    refers_to: int | None = None


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(null|-?\d+)>", urn or "")
    if not m:
        raise BadArchive(f"record id {urn}")
    return None if m[1] == "null" else int(m[1])


def _line(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def encode(r: Record) -> bytes:
    """One record: a response with the HTTP head and the payload, or a revisit with the HTTP head alone, whose Content-Length keeps the payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r.payload_bytes}\r\n\r\n".encode()
    block = http + (r.payload or b"" if r.kind == "response" else b"")
    head = [
        "WARC/1.1", f"WARC-Type: {r.kind}", f"WARC-Record-ID: {_urn(r.page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_line(r.url)}",
        f"WARC-Payload-Digest: sha1:{r.payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if r.kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(r.refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode(raw: bytes) -> Record:
    """One record; raises BadArchive where header, length or digest is wrong."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    try:
        lines = head.decode("utf-8").split("\r\n")
    except UnicodeDecodeError as e:
        raise BadArchive("header bytes") from e
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise BadArchive(f"version line {lines[0][:40]!r}")
    fields = {}
    for x in lines[1:]:
        k, colon, v = x.partition(":")
        if not colon:
            raise BadArchive(f"header line {x[:80]!r}")
        fields[k.strip().lower()] = v.strip()
    for k in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if k not in fields:
            raise BadArchive(f"no {k}")
    n = fields["content-length"]
    if not (n.isascii() and n.isdigit()) or len(rest) != int(n) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadArchive(f"Content-Length {n}, {len(rest) - 4} bytes found")
    block = rest[:-4]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise BadArchive("block digest")
    http, sep, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", http)
    if not sep or not http.startswith(b"HTTP/") or not length:
        raise BadArchive("HTTP head")
    kind, said = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    page, url = _page(fields["warc-record-id"]), fields.get("warc-target-uri", "")
    if kind == "response":
        if len(payload) != int(length[1]) or digest(payload) != said:
            raise BadArchive("payload length or digest")
        return Record(page, url, kind, payload, len(payload), said)
    if kind != "revisit" or payload or fields.get("warc-profile") != PROFILE:
        raise BadArchive(f"record type {kind}")
    return Record(page, url, kind, None, int(length[1]), said, _page(fields.get("warc-refers-to")))


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; of a few or tiny samples, on which training fails, their plain content."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:] or b"WARC/1.1\r\n"


def pack(records: Iterable[bytes], dict_bytes: bytes) -> Iterator[bytes]:
    """The archive in pieces: the dictionary's frame, then a frame per record."""
    body = zstandard.ZstdCompressor(level=9).compress(dict_bytes)
    yield struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body
    coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dict_bytes), write_checksum=True, write_content_size=True)
    for r in records:
        yield coder.compress(r)


def unpack(archive: bytes) -> Iterator[bytes]:
    """The records' bytes, a frame each; raises BadArchive for a damaged or cut archive."""
    if len(archive) < 8:
        raise BadArchive("no dictionary frame")
    magic, n = struct.unpack_from("<II", archive)
    if magic != DICTIONARY_MAGIC or len(archive) < 8 + n:
        raise BadArchive("no dictionary frame")
    body = archive[8 : 8 + n]
    try:
        if body[:4] == struct.pack("<I", FRAME_MAGIC):
            body = zstandard.ZstdDecompressor().decompress(body)
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
        at = 8 + n
        view = memoryview(archive)
        while at < len(archive):
            one = reader.decompressobj()
            parts, used = [], at
            while not one.eof and used < len(archive):
                chunk = view[used : used + (1 << 20)]
                parts.append(one.decompress(chunk))
                used += len(chunk)
            if not one.eof:
                raise BadArchive("cut frame")
            at = used - len(one.unused_data)
            yield b"".join(parts)
    except zstandard.ZstdError as e:
        raise BadArchive(str(e)) from e


def read_archive(archive: bytes) -> Iterator[Record]:
    return map(decode, unpack(archive))


def roles(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """(digest, size, first): of each payload of at least min_payload bytes that several pages have, the smallest page_id. pages: (page_id, url, html)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    d = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size")).where(F.col("size") >= min_payload)
    return d.groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


def write(pages: DataFrame, directory: str, min_payload: int = MIN_PAYLOAD, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write archives of pages (page_id, url, html) to directory; what comes back lists (path, n_records, n_bytes) and runs when it is read.

    Equal payloads (by SHA-1 and length): rows with the smallest page_id are responses, others revisit it. Null
    html is the empty payload, a null url the empty string. A null page_id never is the smallest, unless
    all of its payload are null; then all are responses.
    """
    first = roles(pages, min_payload)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    small = pages.select("page_id", F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    again = hot_join(small, first, ["digest", "size"]).where(F.col("first").isNotNull() & ~same(F.col("page_id"), F.col("first"))).select("page_id", "digest", "size", "first").distinct()
    me = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size"))
    other = again.select(F.col("page_id").alias("p2"), F.col("digest").alias("d2"), F.col("size").alias("s2"), "first")
    me = me.join(other, same(F.col("page_id"), F.col("p2")) & (F.col("digest") == F.col("d2")) & (F.col("size") == F.col("s2")), "left").select("page_id", "url", "payload", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Record] = []
        size = 0

        def flush() -> pa.RecordBatch:
            raw = [encode(r) for r in held]
            samples, got = [], 0
            for x in raw:
                if got >= DICTIONARY_SAMPLE:
                    break
                samples.append(x[: 64 << 10])
                got += len(samples[-1])
            path = f"{directory}/{uuid.uuid4().hex}.warc.zst"
            n = put(path, pack(raw, dictionary(samples)))
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(raw)], pa.int64()), pa.array([n], pa.int64())], ["path", "n_records", "n_bytes"])

        for b in batches:
            for page, url, body, ref in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(Record(page, url or "", "response" if ref is None else "revisit", body, len(body), digest(body), ref))
                size += len(body) + 1000
                if size >= archive_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return me.mapInArrow(run, "path string, n_records long, n_bytes long")


def put(path: str, pieces: Iterator[bytes]) -> int:
    """Write through a temporary name; the path may be of any file system that pyarrow knows."""
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    where.create_dir(name.rpartition("/")[0], recursive=True)
    n = 0
    with where.open_output_stream(f"{name}.part") as out:
        for x in pieces:
            out.write(x)
            n += len(x)
    where.move(f"{name}.part", name)
    return n


def read(spark: SparkSession, paths: list[str] | str, content: bool = False, listed: DataFrame | None = None, bad: str = "raise") -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and the payload (null in revisits) if content is asked for.

    bad: "raise" ends the read at a damaged record or archive; "keep" gives a row of type bad instead (url:
    the archive and what is wrong) and goes on, behind a damaged frame with the next archive.
    """
    if bad not in ("raise", "keep"):
        raise ValueError(f"bad: {bad}")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(paths)
    if listed is not None:
        # archives of tasks that ran twice are left out: only what the writer listed counts
        name = F.element_at(F.split("path", "/"), -1)
        files = files.join(listed.select(name.alias("listed")), name == F.col("listed"), "left_semi")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * content

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, archive in zip(*b.columns, strict=True):
                rows: list[tuple] = []
                for r in records(name.as_py(), archive.as_py()):
                    rows.append((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.kind, r.refers_to, r.payload))
                    if len(rows) == 256:
                        yield _batch(rows, content)
                        rows = []
                if rows:
                    yield _batch(rows, content)

    def records(name: str, archive: bytes) -> Iterator[Record]:
        if bad == "raise":
            yield from read_archive(archive)
            return
        wrong = lambda e: Record(None, f"{name}: {e}", "bad", None, 0, "")
        try:
            for raw in unpack(archive):
                try:
                    yield decode(raw)
                except BadArchive as e:
                    yield wrong(e)
        except BadArchive as e:
            yield wrong(e)

    return files.select("path", "content").mapInArrow(run, schema)


def _batch(rows: list[tuple], content: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    k = 7 if content else 6
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(k)], names[:k])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    directory = f"{work_dir(spark)}/warc-{uuid.uuid4().hex}"
    listing = f"{directory}-list"
    write(pages, f"{directory}/archives").write.parquet(listing)
    listed = spark.read.parquet(listing)
    if listed.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read(spark, f"{directory}/archives", listed=listed).drop("url")


_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ORACLE = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, payload_bytes, h, list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform([15, 10, 5, 0],
        lambda s: substr('{_CHARS}', ((('0x' || substr(h, (i * 5 + 1)::INT, 5))::BIGINT >> s) & 31)::INT + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d
"""
