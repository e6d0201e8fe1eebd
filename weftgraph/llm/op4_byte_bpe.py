"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into chunks of ``chunk`` characters that overlap by ``overlap``,
dealt over the cluster and pre-tokenised in parallel; a text of at most one
chunk is encoded where it stands. A match of the pre-token pattern depends only
on where it begins and on the text behind it (the pattern has no look-behind), so
two scans that share a boundary agree from there on: neighbouring chunks are cut
at the first boundary that both scans have. A boundary counts only if no white
space stands before it - a run of white space is divided by what follows the run,
which a piece that ends there would not show - and if it is ``LOOK`` characters
or more before the end of its chunk, since the pattern looks that far ahead. The
pieces between cuts are encoded in parallel and their ids joined in order. If two
scans share no boundary inside the overlap (one pre-token, or a run of white
space, is longer than it), that document is encoded whole.
Decoding concatenates the raw bytes of the ids.

Defined cases: null text counts as empty; an empty text has no ids. Each input
row gives one output row, repeated rows and null keys included. Columns other
than the key and the text are ignored, so their names cannot clash.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.llm.common import bounded_batches

CHUNK = 32_768
OVERLAP = 2_048
LOOK = 4
PIECES_PER_BATCH = 512


@functools.lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


@functools.lru_cache(maxsize=4)
def token_bytes(path: str) -> list[bytes]:
    known = ranks(path)
    table = [b""] * (max(known.values()) + 1)
    for token, rank in known.items():
        table[rank] = token
    return table


def encode_text(text: str | None, path: str, pattern: str) -> bytes:
    """The ids as little-endian unsigned 32-bit integers."""
    return np.asarray(encoding(path, pattern).encode_to_numpy(text or "", disallowed_special=()), dtype="<u4").tobytes()


def decode_ids(ids: bytes, path: str) -> bytes:
    return b"".join(map(token_bytes(path).__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, PIECES_PER_BATCH):
            yield batch.slice(at, PIECES_PER_BATCH)


def _encoder(path: str, pattern: str, decode: bool):
    def encode(batches):
        for batch in _small(batches):
            ids = [encode_text(t, path, pattern) for t in batch.column("text").to_pylist()]
            made = {"ids": pa.array(ids, pa.binary())} | ({"bytes": pa.array([decode_ids(x, path) for x in ids], pa.binary())} if decode else {})
            rest = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in rest), *made.values()], [*rest, *made])

    return encode


def boundaries(text: str, pattern: regex.Pattern) -> list[int]:
    """Ends of the pre-tokens at which the text may be cut; ends that more text behind it could move are left out."""
    return [end for m in pattern.finditer(text) if (end := m.end()) <= len(text) - LOOK and not text[end - 1].isspace()]


def _scanner(pattern: str, chunk: int, overlap: int):
    compiled = regex.compile(pattern)

    def scan(batches):
        for batch in _small(batches):
            heads, tails = [], []
            for text, start in zip(batch.column("text").to_pylist(), batch.column("start").to_pylist(), strict=True):
                ends = boundaries(text, compiled)
                heads.append([start + e for e in ends if e < overlap])
                tails.append([start + e for e in ends if e >= chunk])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], [*batch.schema.names, "head", "tail"])

    return scan


def bpe_encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, decode: bool = False) -> DataFrame:
    """(key, ids): the ids of each text as little-endian unsigned 32-bit integers; with ``decode`` also the bytes that they decode to, piece by piece where they were made."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    encode, made = _encoder(path, pattern, decode), ["ids", *["bytes"] * decode]
    kinds = ", ".join(f"{c} binary" for c in made)
    short = rows.where(F.length("text") <= chunk).mapInArrow(encode, f"k {kind}, {kinds}")

    long = rows.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id())
    number = F.ceil(F.length("text") / F.lit(chunk)).cast("int")
    chunks = (
        long.select("k", "row", "text", F.length("text").alias("size"), F.explode(F.sequence(F.lit(0), number - 1)).alias("n"))
        .withColumn("start", F.col("n").cast("long") * chunk)
        .select("k", "row", "size", "n", "start", F.substring(F.col("text"), F.col("start").cast("int") + 1, F.lit(chunk + overlap)).alias("text"))
        .repartition("row", "n")
    )
    scanned = chunks.mapInArrow(_scanner(pattern, chunk, overlap), f"k {kind}, row long, size int, n int, start long, text string, head array<bigint>, tail array<bigint>")
    order = Window.partitionBy("row").orderBy("n")
    met = F.array_min(F.array_intersect("tail", F.lead("head").over(order)))
    stitched = (
        scanned.withColumn("last", F.lead("n").over(order).isNull())
        .withColumn("end", F.when(F.col("last"), F.col("size").cast("long")).otherwise(met))
        .withColumn("begin", F.coalesce(F.lag("end").over(order), F.when(F.col("n") == 0, F.lit(0).cast("long"))))
        .withColumn("lost", F.max(F.col("end").isNull()).over(Window.partitionBy("row")))
    )
    # A scan that never meets its neighbour's: the document's own characters, chunk by chunk, are put together again.
    piece = F.when(F.col("lost"), F.substring(F.col("text"), F.lit(1), F.lit(chunk))).otherwise(F.expr("substring(text, cast(begin - start as int) + 1, cast(end - begin as int))"))
    pieces = stitched.select("k", "row", "n", "lost", piece.alias("text"))
    whole = (
        pieces.where("lost").groupBy("k", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "").alias("text"))
        .select("k", "text").mapInArrow(encode, f"k {kind}, {kinds}")
    )
    coded = pieces.where(~F.col("lost")).select("k", "row", "n", "text").mapInArrow(encode, f"k {kind}, row long, n int, {kinds}")
    ordered = coded.groupBy("k", "row").agg(F.array_sort(F.collect_list(F.struct("n", *made))).alias("x"))
    joined = ordered.select("k", *[F.unhex(F.array_join(F.transform("x", lambda x: F.hex(x[c])), "")).alias(c) for c in made])  # noqa: B023
    return short.unionByName(joined).unionByName(whole).withColumnRenamed("k", key)


def bpe_decode(coded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, ids, bytes): the raw bytes of the ids, in order."""

    def decode(batches):
        for batch in _small(batches):
            made = pa.array([decode_ids(ids or b"", path) for ids in batch.column("ids").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "bytes"])

    return coded.select(key, "ids").mapInArrow(decode, f"`{key}` {coded.schema[key].dataType.simpleString()}, ids binary, bytes binary")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    both = bpe_encode(docs, path, public_tokenizers.PATTERN, decode=True)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
