"""WARC archives as a chunked record table.

Writing: one row a page becomes one gzip member of an archive in the shared folder; a payload is
encoded and compressed slice by slice from the Arrow buffer. Of records with equal payloads the
one with the largest page_id is the response, the others are revisits that refer to it and carry
no payload. Only archives named by a finished task are read, so a retried or lost task leaves no
half records behind.

Reading: an archive is a stream of blocks; each record becomes rows of (record, chunk number) with
at most `chunk` bytes and the SHA-1 of the payload up to and including that chunk. Neither side
ever holds a whole record besides the row that Spark hands over.

The page a payload belongs to is grouped by its digest: only digests are shuffled, and only pages
that revisit another travel as a table to join. A digest that a third of all pages share costs one
row per task before the shuffle, and its pages meet a broadcast row instead of one task (hot_join);
so do revisits of one response when they are read back.

Defined cases: null html is an empty payload; a null url becomes `about:blank` and characters that
a header can't hold are percent-encoded; rows with the same page_id and payload are all written,
and all are responses if that id is the largest; a null page_id counts as smaller than all others;
if only null ids have a payload, those are responses; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, claim, hot_join, qualified, shared_dir, table, written

CHUNK, ARCHIVE_BYTES = 1 << 20, 256 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
CHUNKS = "archive string, record_id string, record_type string, refers_to string, uri string, declared string, chunk_no int, size long, bytes_so_far long, digest_so_far string, last boolean"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    found = record[len("<urn:page:") : -1]
    return None if found == "null" else int(found)


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI in Hadoop's spelling: `file:/x` is local, `s3a://` is `s3://`."""
    scheme, found, rest = uri.partition(":")
    if not found or "/" in scheme:
        raise ValueError(f"{uri} has no scheme")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri({"s3a": "s3", "s3n": "s3"}.get(scheme, scheme) + ":" + rest)


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _slices(value: pa.StringScalar, step: int = CHUNK):
    data = memoryview(value.as_buffer()) if value.is_valid and len(value.as_buffer()) else memoryview(b"")
    return len(data), (data[i : i + step] for i in range(0, len(data), step))


def _write(folder: str):
    def run(batches):
        claim(__name__)
        where, root = filesystem(folder)
        where.create_dir(root, recursive=True)
        out, name, size, records = None, "", 0, 0
        for b in batches:
            page, url, html, sha, refers, revisit = b.columns
            for k in range(len(b)):
                if out is None:
                    name, size, records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = where.open_output_stream(f"{root}/{name}", compression=None)
                    info = b"software: warc writer\r\nformat: WARC File Format 1.1\r\n"
                    size += _record(out, [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], len(info), (info,))
                n, slices = _slices(html[k])
                uri = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url[k].as_py() or "about:blank")
                again = revisit[k].as_py()
                head = [
                    ("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", record_id(page[k].as_py())), ("WARC-Date", DATE), ("WARC-Target-URI", uri),
                    ("WARC-Payload-Digest", "sha1:" + base32(bytes.fromhex(sha[k].as_py()))), ("Content-Type", "application/http; msgtype=response"),
                ]
                if again:
                    head += [("WARC-Refers-To", record_id(refers[k].as_py())), ("WARC-Profile", PROFILE)]
                    size += _record(out, head, len(HTTP), (HTTP,))
                else:
                    size += _record(out, head, len(HTTP) + n, (HTTP, *slices))
                records += 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([records], pa.int64())], names=["archive", "records"])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([records], pa.int64())], names=["archive", "records"])

    return run


def _record(out, head, length: int, blocks) -> int:
    """Write one record as a gzip member of its own; returns its compressed size."""
    z, size = zlib.compressobj(5, zlib.DEFLATED, 31), 0
    lines = "".join(f"{k}: {v}\r\n" for k, v in (*head, ("Content-Length", length)))
    for data in (f"WARC/1.1\r\n{lines}\r\n".encode(), *blocks, b"\r\n\r\n"):
        packed = z.compress(data)
        out.write(packed)
        size += len(packed)
    packed = z.flush()
    out.write(packed)
    return size + len(packed)


def _plain(stream, block: int = 1 << 18):
    """The uncompressed bytes of a file of gzip members, in blocks."""
    z = zlib.decompressobj(31)
    while data := stream.read(block):
        while data:
            got = z.decompress(data, CHUNK)
            if got:
                yield got
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)
            else:
                data = z.unconsumed_tail


class _Reader:
    """Lines and bounded reads over blocks of bytes."""

    def __init__(self, blocks):
        self.blocks, self.held = blocks, b""

    def line(self) -> bytes | None:
        while b"\n" not in self.held:
            more = next(self.blocks, None)
            if more is None:
                return None
            self.held += more
        out, _, self.held = self.held.partition(b"\n")
        return out.rstrip(b"\r")

    def take(self, n: int):
        """The next n bytes, in pieces of at most CHUNK; EOFError if there are fewer."""
        while n:
            if not self.held:
                more = next(self.blocks, None)
                if more is None:
                    raise EOFError(f"{n} bytes of a record are missing")
                self.held = more
            out, self.held = self.held[:n], self.held[n:]
            n -= len(out)
            yield out


def records(stream, chunk: int = CHUNK):
    """(headers, chunk number, bytes, SHA-1 so far, bytes so far, last) for each chunk of each record's payload.

    The payload of a response or revisit is what follows the HTTP head of its block.
    """
    reader = _Reader(_plain(stream))
    while (line := reader.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        head = {}
        while line := reader.line():
            k, _, v = line.partition(b":")
            head[k.decode().lower()] = v.strip().decode()
        left = int(head["content-length"])
        if head["warc-type"] in ("response", "revisit"):
            while True:
                got = reader.line()
                left -= len(got) + 2
                if not got:
                    break
        sha, held, number, total = hashlib.sha1(), bytearray(), 0, 0
        for data in reader.take(left):
            at = 0
            while at < len(data):
                part = data[at : at + chunk - len(held)]
                at += len(part)
                held += part
                total += len(part)
                if len(held) == chunk and total < left:
                    sha.update(held)
                    yield head, number, bytes(held), sha.digest(), total, False
                    held.clear()
                    number += 1
        sha.update(held)
        yield head, number, bytes(held), sha.digest(), total, True


def _read(chunk: int, data: bool):
    names = [x.split()[0] for x in CHUNKS.split(", ")] + ["data"] * data

    def flush(rows):
        types = (pa.string(),) * 6 + (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_()) + (pa.binary(),) * data
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches):
        claim(__name__)
        for b in batches:
            for uri in b.column(0).to_pylist():
                where, path = filesystem(uri)
                rows, size = [], 0
                with where.open_input_stream(path, compression=None) as f:
                    for head, number, part, sha, total, last in records(f, chunk):
                        if head["warc-type"] not in ("response", "revisit"):
                            continue
                        declared = head.get("warc-payload-digest", "").removeprefix("sha1:")
                        rows.append((uri, head["warc-record-id"], head["warc-type"], head.get("warc-refers-to"), head.get("warc-target-uri"), declared, number, len(part), total, base32(sha), last) + (part,) * data)
                        size += len(part) * data + 300
                        if size > 8 << 20:
                            yield flush(rows)
                            rows, size = [], 0
                if rows:
                    yield flush(rows)

    return run


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, broadcast_rows: int = 200_000) -> DataFrame:
    """Write pages (page_id, url, html) as archives under folder, which all executors can write to; gives (archive, records)."""
    folder = qualified(pages.sparkSession, folder)
    arrow_rows(pages.sparkSession, 256)
    html = F.coalesce("html", F.lit(""))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(html).alias("sha"), F.octet_length(html).cast("long").alias("size"))
    ids = pages.where(F.col("size") >= least_bytes).select("page_id", "sha")
    ids = written(ids, "digests")
    top = ids.groupBy("sha").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1 and top is not null").select(F.col("sha").alias("s"), "top")
    again = hot_join(ids, "sha", written(top, "tops"), "s", "inner").where("page_id is null or page_id < top").select(F.col("page_id").alias("p"), "s", "top").distinct()
    again = written(again, "revisits")
    again = F.broadcast(again) if again.count() <= broadcast_rows else again
    match = pages["page_id"].eqNullSafe(again["p"]) & (pages["sha"] == again["s"]) & (pages["size"] >= least_bytes)
    rows = pages.join(again, match, "left").select("page_id", "url", "html", "sha", F.col("top").alias("refers"), F.col("s").isNotNull().alias("revisit"))
    return rows.mapInArrow(_write(folder), "archive string, records long")


def read_chunks(archives: DataFrame, chunk: int = CHUNK, data: bool = True) -> DataFrame:
    """The chunk table of archives (a column `archive` of URIs); data: with the bytes themselves."""
    spark = archives.sparkSession
    arrow_rows(spark, 256)
    archives = archives.select("archive").repartition(max(1, archives.count()))
    return archives.mapInArrow(_read(chunk, data), CHUNKS + (", data binary" if data else ""))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages, read the archives back; per record its page, payload size and digest as read, type and what it refers to."""
    spark = pages.sparkSession
    folder = f"{qualified(spark, shared_dir(spark))}/warc/{uuid.uuid4().hex}"
    archives = written(write_archives(pages, folder, least_bytes), "archives")
    got = read_chunks(archives, data=False).where("last").select("record_id", "record_type", "refers_to", "declared", "bytes_so_far", "digest_so_far")
    got = written(got, "records")
    number = lambda c: F.expr(f"try_cast(substring({c}, 11, length({c}) - 11) as long)")
    whole = got.where("record_type = 'response'")
    # a page_id can be there with several payloads, so a response is known by its id and digest
    paid = whole.groupBy(F.concat_ws(" ", "record_id", "digest_so_far").alias("r")).agg(F.max("bytes_so_far").alias("full"))
    again = got.where("record_type = 'revisit'").withColumn("of", F.concat_ws(" ", "refers_to", "declared"))
    again = hot_join(again, "of", written(paid, "responses"), "r")
    columns = lambda size, digest: [number("record_id").alias("page_id"), F.col(size).alias("payload_bytes"), F.col(digest).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to")]
    return whole.select(*columns("bytes_so_far", "digest_so_far")).unionByName(again.select(*columns("full", "declared")))


def op8_warc_round_trip(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))
