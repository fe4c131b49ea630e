"""Deterministic sharded WARC writer and its reader.

Pages are dealt to ranges of page_id of about equal payload bytes, whose bounds depend
on the data and the parameters alone; range i is sorted and written by task i in one
streaming pass. A file is rolled when its compressed size reaches the limit, and
begins with a warcinfo record. Headers and digests are made anew from the payload. A
page_id, or null, that holds more than a range is cut by digest. A task writes to a temporary name and moves the closed file to its final
name, so a repeated task replaces a file by the same bytes; a file counts only when
the manifest, committed last by Spark's writer, names it.

A payload that occurs again (``min_revisit`` bytes at least) is stored once: the row
with the smallest page_id is the response, others are revisit records without a
payload. The link to the first page travels as a narrow row beside the page, so the
payload is shuffled once.

Defined results: a null html is an empty payload; a null url is written as
``about:blank``; rows that repeat both page_id and payload are one response and
revisits to that page_id; a null page_id comes first and, where the payload has
other pages, is a revisit; an empty table gives an empty manifest.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import Workspace, bucket_of, long_array, range_edges, task_count

MANIFEST = "file string, bucket int, seq int, records long, compressed_bytes long, sha256 string"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, file string"
#: Bytes of headers that count for a record beside its payload.
OVERHEAD = 512
DATE = "2000-01-01T00:00:00Z"


def record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def info_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def info_bytes(name: str) -> bytes:
    """The warcinfo record that describes a file."""
    block = b"software: tidemark\r\nformat: WARC File Format 1.1\r\nconformsTo: http://iipc.github.io/warc-specifications/specifications/warc-format/warc-1.1/\r\n"
    head = [
        "WARC/1.1",
        "WARC-Type: warcinfo",
        f"WARC-Record-ID: {info_id(name)}",
        f"WARC-Date: {DATE}",
        f"WARC-Filename: {name}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/warc-fields",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def plain_url(url: str | None) -> str:
    return "".join(x for x in (url or "about:blank") if x >= " ")


def record_bytes(page_id, url: str, payload: bytes, digest: str, refers_to, refers_url: str | None, revisit: bool, info: str) -> bytes:
    """One WARC/1.1 record; the block of a revisit is the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {DATE}",
        f"WARC-Warcinfo-ID: {info}",
        f"WARC-Target-URI: {url}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head[2:2] = [f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {'' if refers_to is None else refers_to}", f"WARC-Refers-To-Target-URI: {refers_url}", f"WARC-Refers-To-Date: {DATE}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def open_fs(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


class _Roller:
    """Writes members to files of one range and moves closed files into place."""

    def __init__(self, root: str, roll_bytes: int):
        self.fs, self.base = open_fs(root)
        self.roll, self.out, self.rows = roll_bytes, None, []
        for d in ("tmp", "data"):
            self.fs.create_dir(f"{self.base}/{d}", recursive=True)

    def put(self, bucket: int, level: int, record) -> None:
        """Adds the record that ``record(id of the file's warcinfo)`` gives."""
        if self.out is not None and (bucket != self.bucket or self.size >= self.roll):
            seq = self.seq + 1 if bucket == self.bucket else 0
            self.close()
            self.seq = seq
        elif self.out is None:
            self.seq = 0
        if self.out is None:
            self.bucket, self.size, self.records, self.sha = bucket, 0, 0, hashlib.sha256()
            self.name = f"pages-{bucket:06d}-{self.seq:05d}.warc.gz"
            self.temp = f"{self.base}/tmp/{self.name}.{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(self.temp, compression=None)
            self._write(gzip_member(info_bytes(self.name), level))
        self._write(gzip_member(record(info_id(self.name)), level))
        self.records += 1

    def _write(self, member: bytes) -> None:
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.out = None
        final = f"{self.base}/data/{self.name}"
        try:
            self.fs.move(self.temp, final)
        except OSError:  # stores that do not replace: another attempt has put the same bytes there
            if self.fs.get_file_info(final).size != self.size:
                raise
            self.fs.delete_file(self.temp)
        self.rows.append((self.name, self.bucket, self.seq, self.records, self.size, self.sha.hexdigest()))

    def taken(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        cols = list(zip(*rows)) or [[]] * 6
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["file", "bucket", "seq", "records", "compressed_bytes", "sha256"])


def writer(root: str, roll_bytes: int, level: int, min_revisit: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, link, last = _Roller(root, roll_bytes), None, None
        for batch in batches:
            for bucket, page_id, digest, kind, first, url, html in zip(*(c.to_pylist() for c in batch.columns)):
                url = plain_url(url)
                if kind == 0:
                    link = (page_id, digest, first, url)
                    continue
                payload, refers, refers_url = (html or "").encode("utf-8", "surrogatepass"), None, None
                revisit = False
                if len(payload) >= min_revisit:
                    if link is not None and link[:2] == (page_id, digest):
                        revisit, refers, refers_url = True, link[2], link[3]
                    elif last is not None and last[:2] == (page_id, digest):
                        revisit, refers, refers_url = True, page_id, last[2]
                    else:
                        last = (page_id, digest, url)
                roller.put(bucket, level, lambda info: record_bytes(page_id, url, payload, digest, refers, refers_url, revisit, info))  # noqa: B023
            yield roller.taken()
        roller.close()
        yield roller.taken()

    return write


def write_warc(pages: DataFrame, root: str, roll_bytes: int = 64 << 20, range_bytes: int = 512 << 20, least_ranges: int = 1, max_ranges: int = 65_536, level: int = 6, min_revisit: int = 100) -> DataFrame:
    """Writes the archives under ``root`` and returns the committed manifest.

    A range holds ``range_bytes`` of payload, or more where there would be over
    ``max_ranges``; less, down to 1 MiB, until there are ``least_ranges``.
    """
    spark = pages.sparkSession
    space = Workspace(spark, "warc-links")
    html = F.coalesce(pages["html"].cast("string"), F.lit(""))
    digest = F.sha2(F.encode(html, "UTF-8"), 256)
    own = F.col("page_id").cast("long").alias("page_id")
    keys = space.save(pages.select(own, F.unhex(digest).alias("d"), F.octet_length(html).alias("b"), F.col("url").cast("string").alias("url")), "keys")
    size = F.col("b") + OVERHEAD
    total, null = keys.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.sum(F.when(F.col("page_id").isNull(), size)), F.lit(0))).first()
    target = max(-(-total // max_ranges), min(range_bytes, max(1 << 20, -(-total // least_ranges))), 1)
    ranges = range_edges(keys, "page_id", target, size)
    null_parts = max(1, -(-null // target))
    again = keys.where(F.col("b") >= min_revisit).groupBy("d").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    again = space.save(again.select("d", F.col("first.page_id").alias("id"), F.col("first.url").alias("first_url")), "again")
    links = keys.where(F.col("b") >= min_revisit).join(again, "d").where("page_id is null or page_id > id").select("page_id", "d", "id", "first_url").distinct()
    links = links.select(F.lit(0).alias("kind"), "page_id", F.lower(F.hex("d")).alias("digest"), F.col("id").alias("first"), F.col("first_url").alias("url"), F.lit(None).cast("string").alias("html"))
    full = pages.select(F.lit(1).alias("kind"), own, digest.alias("digest"), F.lit(None).cast("long").alias("first"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = links.unionByName(full)
    bases = [null_parts]
    for r in ranges:
        bases.append(bases[-1] + r.parts)
    key, i = F.col("page_id"), F.col("i").cast("int")
    rows = rows.withColumn("i", bucket_of(key, [r.upper for r in ranges]))
    parts = F.when(key.isNull(), F.lit(null_parts)).otherwise(F.get(long_array([r.parts for r in ranges] or [1]), i))
    base = F.when(key.isNull(), F.lit(0)).otherwise(F.get(long_array(bases), i))
    sub = F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * parts / 2**32)
    rows = rows.withColumn("bucket", (base + F.when(parts > 1, sub).otherwise(0)).cast("int"))
    rows = rows.select("bucket", "page_id", "digest", "kind", "first", "url", "html")
    rows = rows.repartitionById(bases[-1], F.col("bucket")).sortWithinPartitions("bucket", F.col("page_id").asc_nulls_first(), "digest", "kind", "url")
    manifest = rows.mapInArrow(writer(root, roll_bytes, level, min_revisit), MANIFEST)
    path = f"{root}/manifest"
    manifest.write.parquet(path)
    space.drop("keys", "again")
    return spark.read.schema(MANIFEST).parquet(path)


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, with one member in memory at a time."""
    held, parts, d = b"", [], zlib.decompressobj(31)
    while chunk := held or stream.read(1 << 20):
        held = b""
        parts.append(d.decompress(chunk))
        if d.eof:
            held = d.unused_data
            yield b"".join(parts)
            parts, d = [], zlib.decompressobj(31)
    if any(parts):
        raise ValueError("a gzip member is cut off")


def parse_record(data: bytes) -> tuple:
    """(page_id, url, type, payload bytes, payload digest, refers_to), None for a warcinfo; the digests are verified."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(h["Content-Length"])]
    if hashlib.sha256(block).hexdigest() != h["WARC-Block-Digest"].removeprefix("sha256:"):
        raise ValueError(f"block digest differs in {h['WARC-Record-ID']}")
    if h["WARC-Type"] == "warcinfo":
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    size, digest, kind = int(http.rsplit(b"Content-Length: ", 1)[1]), h["WARC-Payload-Digest"].removeprefix("sha256:"), h["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload digest differs in {h['WARC-Record-ID']}")
    number = lambda x: int(x) if x else None
    return number(h["WARC-Page-ID"]), h["WARC-Target-URI"], kind, size, digest, number(h.get("WARC-Refers-To-Page-ID"))


def reader(root: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(root)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "file"]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{base}/data/{name}", compression=None) as stream:
                    rows = []
                    for data in members(stream):
                        if (record := parse_record(data)) is None:
                            continue
                        rows.append((*record, name))
                        if len(rows) == 2000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return read


def read_warc(manifest: DataFrame, root: str) -> DataFrame:
    """The records of all files that the manifest names, without their payloads."""
    files = max(1, manifest.count())
    return manifest.select("file").repartition(files, "file").mapInArrow(reader(root), RECORD)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """Query: write all pages as archives and read them back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    root = Workspace(spark, "warc").path
    manifest = write_warc(pages, root, least_ranges=2 * task_count(spark))
    return read_warc(manifest, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
r AS (SELECT *, first_value(page_id) OVER w AS f, row_number() OVER w AS k FROM p WINDOW w AS (PARTITION BY d ORDER BY page_id))
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND k > 1 THEN f END AS refers_to
FROM r
"""
