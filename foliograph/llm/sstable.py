"""Operator 1: token ids in sorted-string-table shards.

Documents are ranged by identifier over shards. A shard file holds, in this order,

* data blocks: entries (varint shared key bytes, varint other key bytes, varint value bytes, key suffix, value),
  each key prefix-compressed against the one before it in the block; the block is zstd-compressed and followed by
  its crc32;
* the index: for every block its first key, offset and size (sparse: one entry a block);
* the Bloom filter: ten bits a key, seven probes by double hashing;
* the footer: offsets, counts, id width and a magic number, of fixed size.

A key is the identifier as eight big-endian bytes with the sign bit flipped, so that byte order is numeric order;
a null identifier is the empty key, which sorts first. A value is the document's ids, two or four bytes each.

The number of shards follows the bytes of the texts, and rows of one identifier and text may go on in the next shard, so
neither a shard's file nor what its writer holds (sixteen bytes a key) grows with the table.

Defined results: null text has only the end id; rows with one identifier are kept side by side, ordered by a hash of
the text, and ``lookup`` returns all of them; an id too large for the width is an error; an empty table makes no shard;
other columns are ignored.

Shards are written under a name of the attempt's own and counted only through the manifest that Spark commits, so a
lost executor or a speculative copy leaves no trace in the result.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, prepare, scratch, texts_of, written
from .tokens import encoder

MAGIC = b"FGSST\x01\x00\x00"
FOOTER = struct.Struct("<QQQQQQI8s")  # index at, Bloom filter at, its bytes, blocks, documents, tokens, id width, magic
BITS_A_KEY, PROBES = 10, 7
BLOCK_BYTES = 64 << 10
#: Bytes of text of a shard, a row counting ROW_BYTES besides.
SHARD_BYTES, ROW_BYTES = 256 << 20, 32
MASK = (1 << 64) - 1


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & MASK)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _hashes(key: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(key)
    return h & MASK, h >> 64 | 1


def _probes(first: np.ndarray, step: np.ndarray, bits: int) -> np.ndarray:
    """The places of keys in a Bloom filter, by double hashing modulo 2^64."""
    return (first[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(bits)


class Writer:
    """Writes one shard; keys must come in ascending order."""

    def __init__(self, out, width: int, block_bytes: int = BLOCK_BYTES):
        self.out, self.width, self.block_bytes = out, width, block_bytes
        self.at = self.documents = self.tokens = 0
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes, self._before = array("Q"), None  # two for each distinct key
        self._zip = zstandard.ZstdCompressor(level=1)
        self._start()

    def _start(self) -> None:
        self._block, self._size, self._first, self._last = [], 0, None, b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if len(ids) and int(ids.max()) >> 8 * self.width:
            raise ValueError(f"an id of {ids.max()} does not fit {self.width} bytes")
        value = ids.astype(f"<u{self.width}").tobytes()
        if self._first is None:
            self._first = key
        shared = 0
        while shared < min(len(key), len(self._last)) and key[shared] == self._last[shared]:
            shared += 1
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self._block += [entry, value]
        self._size += len(entry) + len(value)
        self._last = key
        if key != self._before:
            self.hashes.extend(_hashes(key))
            self._before = key
        self.documents += 1
        self.tokens += len(ids)
        if self._size >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self._first is not None:
            data = self._zip.compress(b"".join(self._block))
            self.out.write(data + struct.pack("<I", zlib.crc32(data)))
            self.index.append((self._first, self.at, len(data) + 4))
            self.at += len(data) + 4
            self._start()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QI", at, n) for k, at, n in self.index)
        hashes = np.frombuffer(self.hashes, np.uint64).reshape(-1, 2)
        bits = max(64, BITS_A_KEY * len(hashes))
        field = np.zeros(-(-bits // 8), np.uint8)
        for part in range(0, len(hashes), 1 << 16):
            p = _probes(*hashes[part : part + (1 << 16)].T, bits)
            np.bitwise_or.at(field, (p >> np.uint64(3)).astype(np.int64), (128 >> (p & np.uint64(7))).astype(np.uint8))
        bloom = struct.pack("<Q", bits) + field.tobytes()
        self.out.write(index + bloom)
        self.out.write(FOOTER.pack(self.at, self.at + len(index), len(bloom), len(self.index), self.documents, self.tokens, self.width, MAGIC))


class Reader:
    """Reads one shard from a seekable file: everything in order, or one key by binary search."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - FOOTER.size)
        index_at, bloom_at, bloom_bytes, blocks, self.documents, self.tokens, self.width, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        file.seek(index_at)
        data = file.read(bloom_at - index_at + bloom_bytes)
        self.index, at = [], 0
        for _ in range(blocks):
            n, at = _read_varint(data, at)
            self.index.append((data[at : at + n], *struct.unpack_from("<QI", data, at + n)))
            at += n + 12
        self.bits = struct.unpack_from("<Q", data, at)[0]
        self.bloom = np.frombuffer(data, np.uint8, offset=at + 8)

    def _entries(self, block: tuple[bytes, int, int]) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, n = block
        self.file.seek(at)
        data = self.file.read(n)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a block's checksum is wrong")
        data, at, key = zstandard.ZstdDecompressor().decompress(data[:-4]), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            other, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + other]
            at += other
            yield key, np.frombuffer(data, f"<u{self.width}", size // self.width, at)
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for block in self.index:
            yield from self._entries(block)

    def may_hold(self, key: bytes) -> bool:
        p = _probes(*np.array(_hashes(key), np.uint64).reshape(2, 1), self.bits)[0].astype(np.int64)
        return bool(np.all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1))

    def lookup(self, key: bytes) -> list[np.ndarray]:
        """All values of a key: Bloom filter, then binary search over the index, then the blocks that may hold it."""
        if not self.index or not self.may_hold(key):
            return []
        at = max(0, bisect.bisect_left(self.index, (key,)) - 1)
        found = []
        for block in self.index[at:]:
            if block[0] > key:
                break
            found += [v for k, v in self._entries(block) if k == key]
        return found


@dataclass(frozen=True)
class Shard:
    uri: str
    start: int
    documents: int
    tokens: int
    first_key: bytes


def write(docs: DataFrame, tokenizer: str, end_id: int = 0, width: int = 2, shards: int | None = None) -> list[Shard]:
    """Encode ``docs`` (doc_id, text) and write them as shards in ascending order; the shards, in order.

    One range exchange, then one pass. What comes to the driver is one row a shard. ``width``: 2 for vocabularies of
    up to 65,536 ids, else 4. ``shards``: by default one for SHARD_BYTES, and as many as Spark's shuffles have at least.
    """
    spark = docs.sparkSession
    prepare(spark)
    folder = scratch(spark, "sst")
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)

    def encode(batches):
        context, out, writer, where, encode_all = TaskContext.get(), None, None, "", encoder(tokenizer).encode
        for batch in batches:
            texts = texts_of(batch.column(1))
            if writer is None and texts:
                fs, path = filesystem(folder)
                where = f"{context.partitionId():07d}-{context.taskAttemptId()}.sst"
                out = fs.open_output_stream(f"{path}/{where}")
                writer, first = Writer(out, width), key_of(batch.column(0)[0].as_py())
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode_all(texts)):
                writer.add(key_of(doc_id), np.append(np.frombuffer(ids, "<u4"), end_id))
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([context.partitionId()], pa.int32()), "file": [where], "documents": [writer.documents], "tokens": [writer.tokens], "first_key": [first]})

    size = docs.agg(F.sum(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + F.lit(ROW_BYTES).cast("long"))).first()[0] or 0
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    tie, place = F.xxhash64("text"), F.monotonically_increasing_id()
    ranged = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), place.alias("place")).repartitionByRange(n, "doc_id", tie, "place").sortWithinPartitions("doc_id", tie)
    manifest = written(ranged.mapInArrow(encode, "shard int, file string, documents long, tokens long, first_key binary"), "sst-manifest").orderBy("shard").collect()
    kept, start, out = {r.file for r in manifest}, 0, []
    from pyarrow.fs import FileSelector

    for info in fs.get_file_info(FileSelector(path)):
        if info.base_name.endswith(".sst") and info.base_name not in kept:
            fs.delete_file(info.path)
    for r in manifest:
        out.append(Shard(f"{folder}/{r.file}", start, r.documents, r.tokens, bytes(r.first_key)))
        start += r.tokens
    return out


def read(spark: SparkSession, shards: list[Shard]) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents, one task a shard."""
    prepare(spark)
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not shards:
        return spark.createDataFrame([], schema)
    listed = spark.createDataFrame([(k, s.uri, s.start) for k, s in enumerate(shards)], "shard int, uri string, start long").repartitionById(len(shards), "shard")

    def scan(batches):
        for batch in batches:
            for uri, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                fs, path = filesystem(uri)
                with fs.open_input_file(path) as file:
                    rows, held = [], 0
                    for key, ids in Reader(file):
                        rows.append((id_of(key), start, len(ids), ids.astype("<u4").tobytes()))
                        start += len(ids)
                        held += len(ids)
                        if held > 1 << 20:
                            yield _rows(rows)
                            rows, held = [], 0
                    if rows:
                        yield _rows(rows)

    return listed.mapInArrow(scan, schema)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    ids, starts, counts, values = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(values, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def lookup(shards: list[Shard], doc_id: int | None) -> list[np.ndarray]:
    """The ids of every row with an identifier, without Spark: binary search over shards, then within them."""
    key, found = key_of(doc_id), []
    at = max(0, bisect.bisect_left([s.first_key for s in shards], key) - 1)
    for s in shards[at:]:
        if s.first_key > key:
            break
        fs, path = filesystem(s.uri)
        with fs.open_input_file(path) as file:
            found += Reader(file).lookup(key)
    return found
