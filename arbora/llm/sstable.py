"""Sorted-string-table shards of token ids.

A shard is one file of documents in ascending order of their identifier:

    data block ...      prefix-compressed entries, Zstandard-compressed, CRC-32 each
    filter block        Bloom filter of the shard's keys
    index block         for each data block: last key, offset, length (sparse: one entry a block)
    footer, 64 bytes    offsets and lengths of filter and index, entries, tokens, bytes of an id, magic

A key is a flag and the identifier as 8 big-endian bytes with the sign bit flipped (byte order is
number order), then 8 bytes of the text's hash in the same form and 4 that number entries alike so
far. An entry is varint(shared bytes with the key before), varint(own bytes), varint(value bytes),
own key bytes, value; every 16th entry shares nothing. A value is the ids as little-endian numbers
of 16 bits if the vocabulary's largest id fits, else of 32. Lookup: footer, filter, binary search
in the index, one block.

Documents are range-partitioned by identifier, then hash of the text, then row, so shard order is
identifier order and one identifier of many rows spreads over shards. There are as many shards as
the texts have ``shard_bytes`` (Spark's own bound of a partition's input unless given). A task writes
under a name of its own attempt and renames it at the end: a repeated task leaves a whole file.

Defined results: a null text is empty, its document the end id alone; null identifiers come
first, as the smallest key of their own flag; rows that repeat an identifier get an entry
each, in order of a hash of their texts, ties in order of their rows; a very long text is one
entry in a block of its own; an empty table writes no file and gives no rows; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import bisect
import itertools
import posixpath
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.llm.common import in_slices, made, shared_dir, task_count
from arbora.llm.tokens import encoder

MAGIC = b"ARBSST02"
FOOTER = struct.Struct("<7Q8s")
RESTART = 16


def _ordered(n: int) -> bytes:
    """A signed number as bytes whose order is the numbers'."""
    return ((n + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def prefix_of(doc_id: int | None) -> bytes:
    return b"\x00" + bytes(8) if doc_id is None else b"\x01" + _ordered(doc_id)


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:9], "big") - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


class Bloom:
    """k bits a key by double hashing of one 64-bit digest."""

    def __init__(self, bits: bytearray, k: int = 7):
        self.bits, self.k = bits, k

    @classmethod
    def of(cls, digests: np.ndarray, per_key: int = 10) -> Bloom:
        out = cls(bytearray(max(8, len(digests) * per_key // 8 + 1)))
        m, view = np.uint64(len(out.bits) * 8), np.frombuffer(out.bits, np.uint8)
        a, b = digests & np.uint64(0xFFFFFFFF), digests >> np.uint64(32) | np.uint64(1)
        for i in range(out.k):
            at = (a + np.uint64(i) * b) % m
            np.bitwise_or.at(view, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        return out

    def admits(self, digests: np.ndarray) -> np.ndarray:
        m, view = np.uint64(len(self.bits) * 8), np.frombuffer(bytes(self.bits), np.uint8)
        a, b = digests & np.uint64(0xFFFFFFFF), digests >> np.uint64(32) | np.uint64(1)
        ok = np.ones(len(digests), bool)
        for i in range(self.k):
            at = (a + np.uint64(i) * b) % m
            ok &= (view[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return ok


def _digest(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key[:9])


class Writer:
    def __init__(self, out, width: int, block_bytes: int = 1 << 16):
        self.out, self.width, self.block_bytes, self.at = out, width, block_bytes, 0
        self.index, self.digests, self.block, self.in_block = [], [], bytearray(), 0
        self.last, self.entries, self.tokens = b"", 0, 0
        self.zstd = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, value: bytes, n_tokens: int) -> None:
        assert key > self.last, "keys must ascend"
        shared = 0
        if self.in_block % RESTART:
            shared = next((i for i, (x, y) in enumerate(zip(key, self.last, strict=False)) if x != y), len(key))
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.in_block, self.entries, self.tokens = key, self.in_block + 1, self.entries + 1, self.tokens + n_tokens
        self.digests.append(_digest(key))
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def _flush(self) -> None:
        if self.in_block:
            data = self.zstd.compress(bytes(self.block))
            at, n = self._put(data + struct.pack("<I", zlib.crc32(data)))
            self.index.append((self.last, at, n))
            self.block, self.in_block = bytearray(), 0

    def close(self) -> None:
        self._flush()
        f = self._put(bytes(Bloom.of(np.array(self.digests, np.uint64)).bits))
        i = self._put(b"".join(_varint(len(k)) + k + struct.pack("<QI", at, n) for k, at, n in self.index))
        self._put(FOOTER.pack(*f, *i, self.entries, self.tokens, self.width, MAGIC))


class Reader:
    def __init__(self, source: pa.NativeFile):
        self.source = source
        size = source.size()
        source.seek(size - FOOTER.size)
        self.f_at, self.f_n, i_at, i_n, self.entries, self.tokens, self.width, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        data, at, self.index = self._bytes(i_at, i_n), 0, []
        while at < len(data):
            n, at = _read_varint(data, at)
            self.index.append((data[at : at + n], *struct.unpack_from("<QI", data, at + n)))
            at += n + 12

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def _block(self, k: int):
        _, at, n = self.index[k]
        raw = self._bytes(at, n)
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError(f"block {k} is damaged")
        data, at, key = zstandard.ZstdDecompressor().decompress(raw[:-4]), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            yield key, data[at + own : at + own + n]
            at += own + n

    def __iter__(self):
        for k in range(len(self.index)):
            yield from self._block(k)

    def get(self, doc_id: int | None, nth: int = 0) -> np.ndarray | None:
        """The ids of the shard's nth document of that identifier."""
        prefix = prefix_of(doc_id)
        if not Bloom(self._bytes(self.f_at, self.f_n)).admits(np.array([_digest(prefix)], np.uint64))[0]:
            return None
        for k in range(bisect.bisect_left(self.index, prefix, key=lambda e: e[0]), len(self.index)):
            for key, value in self._block(k):
                if key[:9] > prefix:
                    return None
                if key[:9] == prefix:
                    if not nth:
                        return np.frombuffer(value, f"<u{self.width}")
                    nth -= 1
        return None


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def write(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, block_bytes: int = 1 << 16, shard_bytes: int = 0) -> DataFrame:
    """Writes the shards below ``path`` (else a fresh shared folder); a row for each: shard, path, entries, tokens."""
    spark = docs.sparkSession
    folder = path or shared_dir(spark)
    if not path:
        made(spark, folder)
    end = end_id.to_bytes(4, "little")

    def shard(batches):
        enc, out, writer, previous, nth, first = encoder(tokenizer_path), None, None, b"", 0, None
        width = 2 if max(enc.largest_id, end_id) < 1 << 16 else 4
        kind = f"<u{width}"
        for b in in_slices(batches):
            for doc, text, at, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if writer is None:
                    filesystem, root = open_path(folder)
                    filesystem.create_dir(root, recursive=True)
                    first, name = part, posixpath.join(root, f"shard-{part:06d}.sst")
                    temporary = f"{name}.{uuid.uuid4().hex}"
                    out = filesystem.open_output_stream(temporary, compression=None)
                    writer = Writer(out, width, block_bytes)
                key = prefix_of(doc) + _ordered(at)
                nth = nth + 1 if previous == key else 0
                previous = key
                ids = np.frombuffer(enc.ids(text) + end, "<u4")
                writer.add(key + nth.to_bytes(4, "big"), ids.astype(kind).tobytes(), len(ids))
        if writer is not None:
            writer.close()
            out.close()
            filesystem.move(temporary, name)
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([posixpath.join(folder, posixpath.basename(name))]), pa.array([writer.entries], pa.int64()), pa.array([writer.tokens], pa.int64())], ["shard", "path", "entries", "tokens"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    limit = shard_bytes or spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    shards = task_count(d.agg(F.sum(F.octet_length("text"))).first()[0] or 0, limit)
    order = (F.col("doc_id").asc_nulls_first(), "at", "rid")
    d = d.withColumn("at", F.xxhash64("text")).withColumn("rid", F.monotonically_increasing_id())
    d = d.repartitionByRange(shards, *order).sortWithinPartitions(*order)
    d = d.select("doc_id", "text", "at", F.spark_partition_id().cast("long").alias("part"))
    done = d.mapInArrow(shard, "shard long, path string, entries long, tokens long")
    return spark.createDataFrame(done.toArrow().to_pandas(), done.schema)  # one row for each file


def read(spark: SparkSession, shards: DataFrame, rows: int = 4096) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard from the files; start counts the ids of all shards before."""
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    based = shards.select("shard", "path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))

    def entries(shard: int, path: str, at: int):
        filesystem, name = open_path(path)
        with filesystem.open_input_file(name) as f:
            reader = Reader(f)
            kind = f"<u{reader.width}"
            for key, value in reader:
                ids = np.frombuffer(value, kind).astype("<u4")
                yield id_of(key), at, len(ids), zlib.crc32(ids.tobytes()), shard
                at += len(ids)

    def scan(batches):
        for b in batches:
            for file in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = entries(*file)
                while some := list(itertools.islice(found, rows)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*some, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    n = max(1, shards.count())
    return based.repartition(n, "shard").mapInArrow(scan, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")
