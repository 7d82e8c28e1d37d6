"""WARC archives of pages, compressed record by record with a Zstandard dictionary.

An archive file starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary;
each record follows as a frame of its own, so that a reader can start at any record. The
dictionary is built from the very records that the file archives, headers included: a task
gathers records up to ``file_bytes``, trains on all of them, and writes the file. Where they
are too few for the trainer, it gets their parts, and failing that, their first bytes are the dictionary.

A payload of at least ``least`` bytes that several pages share is archived once: the page
with the largest identifier has the response record, the others revisit it. A record's
identifier names its page, so a revisit's WARC-Refers-To names the page it refers to. Shorter
pages go past the search for equal ones.

A file is written under a name of the attempt and renamed at the end.

Defined results: a null html is an empty payload; a null url leaves out the target URI; null
identifiers are the smallest; rows that repeat an identifier get a record each, and rows that
repeat the response's identifier and payload, a tie, are responses too; a very long payload is
a record of its own like any other, in a file that ends after it; an empty table writes no
file and gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import posixpath
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.common import in_slices, made, shared_dir, stored
from arbora.llm.sstable import open_path

SKIPPABLE = 0x184D2A5D
RECORD = "urn:x-arbora:page:"


def decisions(pages: DataFrame, least: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"))
    p = p.withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    long, digest = F.col("payload_bytes") >= least, F.sha1("payload").alias("payload_digest")
    # equal payloads have one SHA-256; of a group of any size a task sends one row. Stored, so that the join's sides are plain and Spark can split a large group
    equal = F.sha2("payload", 256).alias("equal")
    groups = stored(p.where(long).groupBy(equal).agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1"))
    found = p.where(long).withColumn("equal", equal).join(groups, "equal", "left")
    revisit = F.col("copies").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    found = found.select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", digest,
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"),
    )
    short = p.where(~long).select("page_id", "url", "payload", "payload_bytes", digest, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return found.unionByName(short)


def dictionary_of(records: list[bytes], size: int, part: int = 512) -> bytes:
    """A dictionary from all of these records."""
    for samples in (records, [r[i : i + part] for r in records for i in range(0, len(r), part)]):
        try:
            return zstandard.train_dictionary(size, samples, k=1024, d=8).as_bytes()
        except zstandard.ZstdError:  # too few to learn from
            continue
    return b"".join(records)[:size]


def record(page_id, url, payload, n, digest, kind, refers_to) -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), f"WARC-Record-ID: <{RECORD}{'' if page_id is None else page_id}>".encode(), b"WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append(b"WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A").encode())
    head += [b"WARC-Payload-Digest: sha1:" + digest.encode(), b"Content-Type: application/http; msgtype=response"]
    if kind == "revisit":
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{RECORD}{refers_to}>".encode()]
    else:
        block += payload.encode()
    head.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, least: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", path: str | None = None, dictionary_bytes: int = 65536, file_bytes: int = 1 << 25, level: int = 3) -> DataFrame:
    """Writes the archives; a row for each file: path, records."""
    spark = pages.sparkSession
    folder = path or shared_dir(spark)
    if not path:
        made(spark, folder)

    def archive(held: list[bytes]) -> pa.RecordBatch:
        dictionary = dictionary_of(held, dictionary_bytes)
        zstd = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary))
        filesystem, root = open_path(folder)
        filesystem.create_dir(root, recursive=True)
        key = uuid.uuid4().hex
        temporary, name = (posixpath.join(root, f"{x}{key}.warc.zst") for x in (".writing-", "pages-"))
        with filesystem.open_output_stream(temporary, compression=None) as out:
            out.write(struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary)
            for r in held:
                out.write(zstd.compress(r))
        filesystem.move(temporary, name)
        return pa.RecordBatch.from_arrays([pa.array([posixpath.join(folder, posixpath.basename(name))]), pa.array([len(held)], pa.int64())], ["path", "records"])

    def scan(batches):
        held, n = [], 0
        for b in in_slices(batches):
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(record(*row))
                n += len(held[-1])
                if n >= file_bytes:
                    yield archive(held)
                    held, n = [], 0
        if held:
            yield archive(held)

    # the list of files is what counts: a file of an attempt that was lost is in no list
    return stored(decisions(pages, least, id_col, url_col, html_col).mapInArrow(scan, "path string, records long"))


def records(stream):
    """The records of one archive as (headers, HTTP headers, payload), one frame at a time."""
    magic, n = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    zstd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stream.read(n)))
    left = b""
    while True:
        frame, data = zstd.decompressobj(), bytearray()
        while not frame.eof:
            if not left and not (left := stream.read(1 << 20)):
                if data:
                    raise ValueError("a record is cut off")
                return
            data += frame.decompress(left)
            left = frame.unused_data
        head, _, rest = bytes(data).partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        block = rest[: int(fields[b"Content-Length"])]
        http, _, payload = block.partition(b"\r\n\r\n")
        yield fields, dict(line.split(b": ", 1) for line in http.split(b"\r\n")[1:]), payload


def read(spark: SparkSession, files: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of all records."""

    def page(uri: bytes) -> int | None:
        text = uri.decode()[len(RECORD) + 1 : -1]
        return int(text) if text else None

    def scan(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                filesystem, name = open_path(path)
                rows = []
                with filesystem.open_input_stream(name, compression=None) as f:
                    for head, http, payload in records(f):
                        kind, digest = head[b"WARC-Type"].decode(), head[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
                        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"payload of {head[b'WARC-Record-ID']!r} is damaged")
                        rows.append((
                            page(head[b"WARC-Record-ID"]), head[b"WARC-Target-URI"].decode() if b"WARC-Target-URI" in head else None, payload.decode() if kind == "response" else None,
                            int(http[b"Content-Length"]), digest, kind, page(head[b"WARC-Refers-To"]) if kind == "revisit" else None,
                        ))
                        if len(rows) == 256:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    def batch(rows):
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    n = max(1, files.count())
    return files.select("path").repartition(n, "path").mapInArrow(scan, "page_id long, url string, payload string, payload_bytes long, payload_digest string, record_type string, refers_to long")
