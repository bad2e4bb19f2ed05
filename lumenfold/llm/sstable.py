"""Token ids in sorted-string-table shards, for lookup of a document by binary search.

A shard holds documents by ascending identifier:

    blocks   zstd frames of about BLOCK_BYTES; entries are varint shared, varint unshared, varint value length,
             the rest of the key, the value.  A key is nine bytes that sort as the identifiers do
             (null first); ``shared`` counts the bytes it has in common with the key before it in the block.
    index    for each block: first key, file offset, stored bytes, entries, crc32
    filter   Bloom filter over the keys, BITS_PER_KEY bits a key, HASHES probes
    footer   struct FOOTER: where index and filter lie, entries, ids, bytes of an id, magic

Values are ids as little-endian integers of two bytes if the vocabulary allows, else four.
Shards are range partitions of the identifiers, or parts of one where it grows beyond SHARD_BYTES.  The manifest table names the shards of a finished
write; a shard written twice (a lost executor, a speculative task) is a second file that no manifest names.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm._spark import bound_batches, materialize, scratch_path
from lumenfold.llm._text import pieces
from lumenfold.llm._tokens import encoder

#: Stored bytes and keys from which a shard is closed and the next begun: what a task holds of its keys.
SHARD_BYTES, SHARD_KEYS = 256 << 20, 2_000_000
#: Input of a task that writes shards.
TASK_BYTES = 512 << 20
#: Tasks that read shards at most.
MAX_READERS = 10_000
BLOCK_BYTES, BITS_PER_KEY, HASHES = 64 << 10, 10, 7
FOOTER = struct.Struct("<QQQQQQB7s")
MAGIC = b"LFSST1\0"
_INDEX = struct.Struct("<9sQLLL")


def key_of(doc_id: int | None) -> bytes:
    """Nine bytes that sort as identifiers do, null first."""
    return b"\0" * 9 if doc_id is None else b"\1" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


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
        byte = data[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(HASHES)]


class Writer:
    """Writes one shard to an open binary file; ``add`` in ascending order of keys."""

    def __init__(self, file, width: int = 4) -> None:
        import zstandard

        self.file, self.width, self.at, self.ids = file, width, 0, 0
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.block, self.entries, self.first, self.last = bytearray(), 0, b"", b""
        self.index: list[bytes] = []
        self.keys: list[bytes] = []

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        if self.entries:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        value = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.entries, self.last, self.ids = self.entries + 1, key, self.ids + len(ids)
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.entries:
            stored = self.pack(bytes(self.block))
            self.file.write(stored)
            self.index.append(_INDEX.pack(self.first, self.at, len(stored), self.entries, zlib.crc32(stored)))
            self.at += len(stored)
            self.block, self.entries = bytearray(), 0

    def close(self) -> None:
        self._flush()
        bits = max(64, len(self.keys) * BITS_PER_KEY)
        bloom = np.zeros(bits, dtype=bool)
        for key in self.keys:
            bloom[_probes(key, bits)] = True
        index, packed = b"".join(self.index), np.packbits(bloom, bitorder="little").tobytes()
        self.file.write(index + packed + FOOTER.pack(self.at, len(index), self.at + len(index), bits, len(self.keys), self.ids, self.width, MAGIC))


class Reader:
    """Reads one shard from a seekable binary file."""

    def __init__(self, file) -> None:
        import zstandard

        self.file, self.unpack = file, zstandard.ZstdDecompressor().decompress
        file.seek(0, 2)
        file.seek(file.tell() - FOOTER.size)
        at, size, bloom_at, self.bits, self.documents, self.ids, self.width, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        file.seek(at)
        self.index = list(_INDEX.iter_unpack(file.read(size)))
        self.bloom = file.read((self.bits + 7) // 8)

    def _block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, size, entries, crc = self.index[k]
        self.file.seek(at)
        stored = self.file.read(size)
        if zlib.crc32(stored) != crc:
            raise ValueError(f"block {k} is damaged")
        data, at, key = self.unpack(stored), 0, b""
        kind = "<u2" if self.width == 2 else "<u4"
        for _ in range(entries):
            shared, at = _read_varint(data, at)
            more, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + more]
            at += more
            yield key, np.frombuffer(data, dtype=kind, count=size // self.width, offset=at).astype("<u4")
            at += size

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            for key, ids in self._block(k):
                yield id_of(key), ids

    def get(self, doc_id: int | None) -> np.ndarray | None:
        """The ids of the first document with this identifier, or None: filter, binary search, one block or few."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
            return None
        lo, hi = 0, len(self.index)
        while lo < hi:  # the first block that begins at or after the key
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.index[mid][0] < key else (lo, mid)
        for k in range(max(0, lo - 1), len(self.index)):
            if self.index[k][0] > key:
                return None
            for found, ids in self._block(k):
                if found == key:
                    return ids
        return None


def open_shard(path: str):
    """A shard's file for reading, on any file system that pyarrow knows."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def _write(folder: str, tokenizer: str, keep_space: bool, end_id: int, width: int):
    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        tool, end = encoder(tokenizer, keep_space), np.array([end_id], dtype="<u4")
        out = writer = None
        shards = 0

        def done():
            writer.close()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (first, writer.keys[-1], path, len(writer.keys), writer.ids)], names=["first_key", "last_key", "path", "documents", "ids"])

        for rows, data, offsets in pieces(batches, "text"):
            keys = [key_of(x) for x in rows.column(0).to_pylist()]
            ids, at = tool.encode_rows(data, offsets)
            for key, a, b in zip(keys, at[:-1].tolist(), at[1:].tolist(), strict=True):
                if writer is None:
                    path = f"{folder}/shard-{TaskContext.get().partitionId():06d}-{shards:06d}-{uuid.uuid4().hex}.sst"
                    system, name = fs.FileSystem.from_uri(path)
                    system.create_dir(name.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(name)
                    writer, first, shards = Writer(out, width), key, shards + 1
                writer.add(key, np.concatenate([ids[a:b], end]))
                if writer.at >= SHARD_BYTES or len(writer.keys) >= SHARD_KEYS:
                    yield done()
                    writer = None
        if writer is not None:
            yield done()

    return run


def write_shards(docs: DataFrame, folder: str, tokenizer: str, keep_space: bool = True, end_id: int = 0, vocabulary: int = 1 << 32) -> DataFrame:
    """Write the rows of ``docs`` (doc_id, text) below ``folder``; returns the manifest, a row per shard.

    Null and empty texts hold ``end_id`` alone; rows that repeat a doc_id are entries of their own, by a hash of their texts; a null
    doc_id sorts first.  A range of one doc_id may spread over several shards.  ``folder`` must be shared by all executors.  No rows give no shards.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    text = F.col("text").cast("string")
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    # as many tasks as the input's size asks for, by Spark's own estimate
    size = int(str(typed._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    order = [F.col("doc_id").asc_nulls_first(), F.col("th").asc()]
    parts = -(-size // TASK_BYTES)
    parted = typed.repartitionByRange(parts, *order) if int(spark.conf.get("spark.sql.shuffle.partitions")) < parts < MAX_READERS * 100 else typed.repartitionByRange(*order)
    rows = parted.sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(_write(folder, tokenizer, keep_space, end_id, 2 if vocabulary <= 1 << 16 else 4), "first_key binary, last_key binary, path string, documents long, ids long")
    return materialize(rows, "manifest")


def _scan(batches):
    for shards in batches:
        for path, base in zip(shards.column(0).to_pylist(), shards.column(1).to_pylist(), strict=True):
            out: list[tuple] = []
            with open_shard(path) as file:
                for doc, ids in Reader(file):
                    out.append((doc, base, len(ids), zlib.crc32(ids.tobytes())))
                    base += len(ids)
                    if len(out) == 10_000:
                        yield _rows(out)
                        out = []
            yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def scan_shards(manifest: DataFrame) -> DataFrame:
    """Every document of the shards: doc_id, start (ids before it in the whole), n_tokens, ids_crc32."""
    before = F.coalesce(F.sum("ids").over(Window.orderBy("first_key", "last_key", "path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = materialize(manifest.select("path", before.alias("base")), "bases")  # a row per shard
    # a number of its own, or rows so small would be read by one task
    return bases.repartition(max(1, min(bases.count(), MAX_READERS)), "path").mapInArrow(_scan, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, vocabulary: int, end_id: int = 0, keep_space: bool = True) -> DataFrame:
    """Write ``docs`` as shards in the shared folder and read them back; see :func:`scan_shards`."""
    folder = scratch_path(docs.sparkSession, "sstable")
    return scan_shards(write_shards(docs, folder, tokenizer, keep_space, end_id, vocabulary))
