"""Token-ID output as sorted-string-table shards, and the reader that looks documents up in them.

Documents are range-partitioned by key, so that each shard holds a run of
ascending keys and shards follow each other. A shard is written by one task as

    data blocks | block index | Bloom filter | footer

A data block (zstd, about ``BLOCK`` bytes before) holds entries ``shared,
suffix length, value length, suffix, value``: a key drops the bytes that it
shares with the key before it in its block, and each block begins with a whole
key. The sparse index has each block's first key, place and first ordinal. A
lookup asks the Bloom filter, bisects the index and scans one block.

A shard goes to a name of its own for each attempt, and counts only through the
manifest row that its task returned; the manifest is written as a table, so a
lost executor leaves at most a file that nothing names.

A task begins a new shard when one has ``SHARD`` bytes, so a shard's size, its
index and its filter are bounded. Rows are dealt by key and the text's hash, so
the rows of one very frequent key are dealt over several tasks too.

Texts are encoded as the library does by default: the strings of its special
tokens in a text stand for those tokens.

Defined cases: null text counts as empty and has only the end id. Repeated keys
keep all their rows, next to each other, in the order of their texts' hashes;
lookup returns the first. A null key sorts before all others. Columns other than
the key and the text are ignored. An empty input has no shards, and reading it
gives no rows.
"""

from __future__ import annotations

import bisect
import functools
import io
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.llm.common import bounded_batches, shared_dir, written
from weftgraph.llm.pretokens import Coder

BLOCK = 65_536
SHARD = 256 * 1024 * 1024
BLOOM_BITS, BLOOM_HASHES = 10, 7
FOOTER = struct.Struct("<QQQQQQB7s")
MAGIC = b"WEFTSST"
ROWS = 256


def key_bytes(key: int | str | None) -> bytes:
    """Bytes that sort as the keys do; null first."""
    if key is None:
        return b"\x00"
    return b"\x01" + (struct.pack(">Q", key + (1 << 63)) if isinstance(key, int) else key.encode())


def bytes_key(data: bytes, text: bool = False) -> int | str | None:
    if data == b"\x00":
        return None
    return data[1:].decode() if text else struct.unpack(">Q", data[1:])[0] - (1 << 63)


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


def _bloom_places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + j * b) % bits for j in range(BLOOM_HASHES)]


class ShardWriter:
    """Entries must come in ascending order of key bytes."""

    def __init__(self, out: io.RawIOBase, wide: bool):
        self.out, self.width = out, 4 if wide else 2
        self.at = self.entries = self.tokens = 0
        self.block, self.last, self.first, self.index, self.hashes = bytearray(), b"", b"", [], []
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if not self.block:
            self.first, self.last, self.first_ordinal = key, b"", self.entries
        shared = 0
        for x, y in zip(key, self.last, strict=False):
            if x != y:
                break
            shared += 1
        value = ids.astype("<u4" if self.width == 4 else "<u2").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.hashes.append(key)
        self.entries += 1
        self.tokens += len(ids)
        if len(self.block) >= BLOCK:
            self._flush()

    def _write(self, data: bytes) -> tuple[int, int]:
        place = self.at, len(data)
        self.out.write(data)
        self.at += len(data)
        return place

    def _flush(self) -> None:
        if self.block:
            place = self._write(self.pack.compress(bytes(self.block)))
            self.index.append((self.first, *place, self.first_ordinal))
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) + _varint(first) for k, at, n, first in self.index)
        index_at = self._write(index)
        bits = max(64, len(self.hashes) * BLOOM_BITS)
        bloom = np.zeros((bits + 7) // 8, dtype=np.uint8)
        for key in self.hashes:
            for place in _bloom_places(key, bits):
                bloom[place >> 3] |= 1 << (place & 7)
        bloom_at = self._write(bloom.tobytes())
        self._write(FOOTER.pack(*index_at, bloom_at[0], bits, self.entries, self.tokens, self.width, MAGIC))


class Shard:
    """A shard open for lookups (one block read each) and for whole scans."""

    def __init__(self, path: str, text_keys: bool = False):
        store, name = fs.FileSystem.from_uri(path)
        self.file, self.text_keys = store.open_input_file(name), text_keys
        self.file.seek(self.file.size() - FOOTER.size)
        index_at, index_size, bloom_at, self.bits, self.entries, self.tokens, self.width, magic = FOOTER.unpack(self.file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        self.bloom = self._read(bloom_at, (self.bits + 7) // 8)
        data, at, self.index = self._read(index_at, index_size), 0, []
        while at < len(data):
            n, at = _read_varint(data, at)
            key, at = data[at : at + n], at + n
            place, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            first, at = _read_varint(data, at)
            self.index.append((key, place, size, first))
        self.unpack = zstandard.ZstdDecompressor()

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def block(self, n: int) -> Iterator[tuple[bytes, np.ndarray]]:
        data, at, key = self.unpack.decompress(self._read(*self.index[n][1:3])), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, np.frombuffer(data, "<u4" if self.width == 4 else "<u2", size // self.width, at)
            at += size

    def scan(self) -> Iterator[tuple[int | str | None, np.ndarray]]:
        for n in range(len(self.index)):
            for key, ids in self.block(n):
                yield bytes_key(key, self.text_keys), ids

    def lookup(self, key: int | str | None) -> np.ndarray | None:
        wanted = key_bytes(key)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(wanted, self.bits)):
            return None
        at = bisect.bisect_left([k for k, *_ in self.index], wanted)
        for n in (at - 1, at):  # a key that begins a block may also end the one before
            if 0 <= n < len(self.index):
                for found, ids in self.block(n):
                    if found == wanted:
                        return ids
        return None


class Encoder:
    """The library's ids of texts: pre-token by pre-token through a cache; a text that holds a special token's string as a whole."""

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.wide = self.library.get_vocab_size() > 1 << 16
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.end = end
        self.coder = Coder(lambda words: [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)], (end,))

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, with the end id."""
        whole = [any(t in text for t in self.special) for text in texts]
        ids, counts = self.coder([text for text, w in zip(texts, whole, strict=True) if not w])
        ends = iter(np.cumsum(counts).tolist())
        begin = 0
        for text, w in zip(texts, whole, strict=True):
            if w:
                yield np.array([*self.library.encode(text, add_special_tokens=False).ids, self.end], "<u4")
            else:
                stop = next(ends)
                yield ids[begin:stop]
                begin = stop


@functools.lru_cache(maxsize=2)
def _encoder(path: str, end: int) -> Encoder:
    return Encoder(path, end)


def write_shards(docs: DataFrame, tokenizer: str, end: int, key: str = "doc_id", text: str = "text", folder: str | None = None, shard: int = SHARD) -> DataFrame:
    """Encodes and writes; the manifest (path, task, n, first, entries, tokens), one row for each shard: the n-th of its task, ``first`` being its first key's bytes."""
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = folder or f"{shared_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, number = _encoder(tokenizer, end), TaskContext.get().partitionId(), 0
        store, base = fs.FileSystem.from_uri(folder)
        out = writer = first = path = None

        def closed() -> pa.RecordBatch:
            writer.close()
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "task": pa.array([task], pa.int64()), "n": pa.array([number], pa.int64()), "first": pa.array([first], pa.binary()), "entries": [writer.entries], "tokens": [writer.tokens]})

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                for k, ids in zip(part.column("k").to_pylist(), encode([t or "" for t in part.column("text").to_pylist()]), strict=True):
                    if writer is None:
                        name = f"{uuid.uuid4().hex}.sst"
                        store.create_dir(base, recursive=True)
                        out, first, path = store.open_output_stream(f"{base}/{name}"), key_bytes(k), f"{folder}/{name}"
                        writer = ShardWriter(out, encode.wide)
                    writer.add(key_bytes(k), ids)
                    if writer.at >= shard:
                        yield closed()
                        writer, number = None, number + 1
        if writer is not None:
            yield closed()

    keyed = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("k", "h").sortWithinPartitions("k", "h").select("k", "text")
    return written(ordered.mapInArrow(write, "path string, task long, n long, first binary, entries long, tokens long"), "manifest")


def read_shards(manifest: DataFrame, key: str = "doc_id", text_keys: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids) of every document, read back from the files; start counts the ids of all documents before it."""
    base = F.coalesce(F.sum("tokens").over(Window.orderBy("task", "n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a shard
    shards = manifest.withColumn("base", base).select("path", "base")
    made = pa.schema([("key", pa.string() if text_keys else pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                rows = []
                for k, ids in Shard(path, text_keys).scan():
                    rows.append((k, start, len(ids), ids.astype("<u4").tobytes()))
                    start += len(ids)
                    if len(rows) == ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), made.types, strict=True)], schema=made)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), made.types, strict=True)], schema=made)

    dealt = shards.repartition(max(1, min(manifest.count(), 10_000)))
    return dealt.mapInArrow(read, f"key {'string' if text_keys else 'long'}, start long, n_tokens long, ids binary").withColumnRenamed("key", key)


def op9_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_shards(docs, public_tokenizers.path("byte_bpe_50k.json"), end=2)
    return read_shards(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
