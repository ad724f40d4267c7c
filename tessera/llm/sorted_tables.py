"""Operator 6: token ids in sorted-string-table shards.

A shard holds documents by ascending doc_id: prefix-compressed entries in compressed
blocks, a sparse index with one entry for each block, a Bloom filter and a footer.

    block   zstd of: entries, restart offsets (u32 each), number of restarts (u32)
    entry   varint shared key bytes, varint further key bytes, varint value bytes, key rest, value
    key     doc_id + 2**63 as 8 big-endian bytes (their order is that of doc_id)
    value   one byte: width of an id (2 or 4); the ids, little-endian
    index   per block: last key (8), offset (u64), size (u32), crc32 (u32)
    footer  fixed size, at the end of the file (FOOTER)
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._session import Kept, documents, new_path, partitions, prepare
from tessera.llm._text import mix
from tessera.llm._text import pieces as runs
from tessera.llm._tokens import encoder, tokenizer_path

MAGIC = b"TSST0001"
INDEX = struct.Struct(">8sQII")
#: index offset, index bytes, filter offset, filter bytes, probes, entries, tokens, crc32 of index and filter, magic
FOOTER = struct.Struct("<QQQQIQQI8s")
BLOCK, RESTART, SHARD, BITS = 1 << 16, 16, 1 << 24, 10
SHARD_SCHEMA = "path string, first_id long, part int, n int, documents long, tokens long, bytes long"


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


def key_of(doc_id: int) -> bytes:
    return (doc_id + 2**63).to_bytes(8, "big")


def _bits(keys: np.ndarray, n_bits: int, probes: int) -> np.ndarray:
    """Positions in the Bloom filter, one row for each key (double hashing)."""
    h = mix(keys)
    a, b = h % np.uint64(n_bits), (mix(h) | np.uint64(1)) % np.uint64(n_bits)
    return (a[:, None] + b[:, None] * np.arange(probes, dtype=np.uint64)) % np.uint64(n_bits)


class Writer:
    """Collects entries in key order and writes one shard."""

    def __init__(self, out, block: int = BLOCK):
        import zstandard

        self.out, self.block, self.at = out, block, 0
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.body, self.restarts, self.last, self.in_block = bytearray(), [], b"", 0
        self.index, self.keys, self.tokens = bytearray(), [], 0
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit."""
        wide = np.frombuffer(ids, dtype="<u4")
        value = b"\x02" + wide.astype("<u2").tobytes() if not len(wide) or wide.max() < 1 << 16 else b"\x04" + ids
        key = key_of(doc_id)
        shared = 0
        if self.in_block % RESTART:
            while shared < 8 and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.restarts.append(len(self.body))
        self.body += _varint(shared) + _varint(8 - shared) + _varint(len(value)) + key[shared:] + value
        self.last, self.in_block = key, self.in_block + 1
        self.keys.append(doc_id)
        self.tokens += len(wide)
        if len(self.body) >= self.block:
            self._end_block()

    def _end_block(self) -> None:
        if not self.in_block:
            return
        data = self.pack(bytes(self.body) + struct.pack(f"<{len(self.restarts)}II", *self.restarts, len(self.restarts)))
        self.index += INDEX.pack(self.last, self.at, len(data), zlib.crc32(data))
        self._write(data)
        self.body, self.restarts, self.in_block = bytearray(), [], 0

    def close(self) -> None:
        self._end_block()
        n_bits = max(64, len(self.keys) * BITS + -len(self.keys) * BITS % 8)
        probes = 7
        bits = np.zeros(n_bits, dtype=np.uint8)
        bits[_bits(np.array(self.keys, dtype=np.int64).astype(np.uint64), n_bits, probes).ravel().astype(np.int64)] = 1
        bloom = np.packbits(bits).tobytes()
        at = self.at
        self._write(bytes(self.index))
        self._write(bloom)
        self._write(FOOTER.pack(at, len(self.index), at + len(self.index), len(bloom), probes, len(self.keys), self.tokens, zlib.crc32(bytes(self.index) + bloom), MAGIC))


class Table:
    """Reads a shard: lookups by binary search over the index, then inside one block."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor().decompress
        size = source.size()
        at, n, bloom_at, bloom_n, self.probes, self.documents, self.tokens, crc, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        index, bloom = self._read(at, n), self._read(bloom_at, bloom_n)
        if magic != MAGIC or zlib.crc32(index + bloom) != crc:
            raise ValueError("not a whole shard")
        self.index = list(INDEX.iter_unpack(index))
        self.bloom = np.unpackbits(np.frombuffer(bloom, dtype=np.uint8))

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return bytes(self.source.read(n))

    def _block(self, i: int) -> tuple[bytes, list[int], int]:
        _, at, n, crc = self.index[i]
        data = self._read(at, n)
        if zlib.crc32(data) != crc:
            raise ValueError("a block is damaged")
        data = self.unpack(data)
        (count,) = struct.unpack_from("<I", data, len(data) - 4)
        end = len(data) - 4 * (count + 1)
        return data, list(struct.unpack_from(f"<{count}I", data, end)), end

    @staticmethod
    def _entries(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + n]
            at += n

    @staticmethod
    def _ids(value: bytes) -> np.ndarray:
        return np.frombuffer(value, dtype="<u2" if value[0] == 2 else "<u4", offset=1).astype("<u4")

    def scan(self) -> Iterator[tuple[int, np.ndarray]]:
        """All (doc_id, ids) in order, a block at a time."""
        for i in range(len(self.index)):
            data, _, end = self._block(i)
            for key, value in self._entries(data, 0, end):
                yield int.from_bytes(key, "big") - 2**63, self._ids(value)

    def get(self, doc_id: int) -> list[np.ndarray]:
        """Ids of every document of that doc_id (none, one, or several repeated rows)."""
        if not self.bloom[_bits(np.array([doc_id], dtype=np.int64).astype(np.uint64), len(self.bloom), self.probes).astype(np.int64)].all():
            return []
        key, low, high = key_of(doc_id), 0, len(self.index)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.index[mid][0] < key else (low, mid)
        out = []
        for i in range(low, len(self.index)):
            data, restarts, end = self._block(i)
            a, b = 0, len(restarts)
            while a < b:  # first restart whose key isn't smaller; the entry can begin before it
                mid = (a + b) // 2
                a, b = (mid + 1, b) if next(self._entries(data, restarts[mid], end))[0] < key else (a, mid)
            for k, value in self._entries(data, restarts[max(0, a - 1)], end):
                if k == key:
                    out.append(self._ids(value))
                elif k > key:
                    return out
        return out


def _write(path: str, folder: str, end_id: int, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        store, root = FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, n, tail = TaskContext.get().partitionId(), 0, np.array([end_id], dtype="<u4").tobytes()
        writer = None

        def finish():
            writer.close()
            writer.out.close()
            store.move(temporary, f"{root}/{name}")  # all or nothing; a second attempt writes the same
            row = [[f"{folder}/{name}"], [writer.keys[0]], [part], [n], [len(writer.keys)], [writer.tokens], [writer.at]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.string(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 3))], ["path", "first_id", "part", "n", "documents", "tokens", "bytes"])

        for whole in batches:
            for batch in runs(whole):
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(path).encode(batch.column("text").to_pylist())):
                    if writer is None:
                        name = f"shard-{part:06d}-{n:04d}.sst"
                        temporary = f"{root}/.{name}.{uuid.uuid4().hex}"
                        writer = Writer(store.open_output_stream(temporary))
                    writer.add(doc_id, ids + tail)
                    if writer.at >= shard:
                        yield finish()
                        writer, n = None, n + 1
        if writer is not None:
            yield finish()

    return run


def write_tables(docs: DataFrame, folder: str, path: str, end_id: int = 0, shard: int = SHARD) -> DataFrame:
    """Writes shards of about ``shard`` bytes under ``folder``; a lazy frame with one row for each.

    Rows with null doc_id have no key and are left out. Null text counts as empty (the end id
    alone). Rows that share a doc_id are all kept, by text. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    ordered = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return ordered.mapInArrow(_write(path, folder, end_id, shard), SHARD_SCHEMA)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow.fs import FileSystem

    for batch in batches:
        for uri, before in zip(batch.column("path").to_pylist(), batch.column("before").to_pylist()):
            store, at = FileSystem.from_uri(uri)
            with store.open_input_file(at) as source:
                rows: tuple[list, ...] = ([], [], [], [])
                start, held = before, 0

                def flush(rows=rows, uri=uri):
                    out = pa.RecordBatch.from_arrays([pa.array([uri] * len(rows[0])), *(pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.binary())))], ["path", "doc_id", "start", "n_tokens", "ids"])
                    for c in rows:
                        c.clear()
                    return out

                for doc_id, ids in Table(source).scan():
                    for c, v in zip(rows, (doc_id, start, len(ids), ids.tobytes())):
                        c.append(v)
                    start, held = start + len(ids), held + len(ids)
                    if held > 1 << 20:
                        yield flush()
                        held = 0
                yield flush()


def read_tables(shards: DataFrame) -> DataFrame:
    """(path, doc_id, start, n_tokens, ids) of all documents in the shards; start counts the ids before, in all shards.

    ``shards`` are the rows of ``write_tables``, written to a table; a window puts them (one row for each shard) in order.
    """
    spark = shards.sparkSession
    before = Window.orderBy("part", "n").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before"))
    return placed.repartition(partitions(spark), "path").mapInArrow(_scan, "path string, doc_id long, start long, n_tokens long, ids binary")


def op6_sorted_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    shards = Kept(spark).table(write_tables(docs, new_path(spark, "sstables"), tokenizer_path()), "shards")
    return read_tables(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
