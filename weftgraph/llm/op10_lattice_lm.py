"""Language-model scores from a subword lattice, and a smoothed word unigram beside them.

The pieces of an existing tokenizer are the vocabulary. Its file stores merge
ranks, no probabilities, so each piece gets the add-one share of the pieces that
the tokenizer makes of the learning texts. A word's probability is the sum over
all its segmentations into pieces, by a forward recursion in log space; pieces
never cross white space, so a text's is the product over its words and its end.
A character that is no piece is written with byte pieces.

All distinct words of the corpus are counted by Spark (partial counts for each
batch, then one shuffle). The words frequent enough to number at most ``HEAD``
go to every task with their counts and lattice scores; all other words of a text
are joined to the full word table by a shuffle. Nothing is left out.

Base score: sum over tokens of log10((c + 1) / (N + V + 1)).

Defined cases: null text counts as empty and has its end only. Each input row
gives one output row, repeated rows and null keys included. With nothing to
learn from, N and V are 0 and all pieces are equally likely. Other columns are
ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import bounded_batches, crc32_mod, written

HEAD = 131_072
BYTES = 8_000_000
START = "▁"


def split_words(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, lower-cased in A-Z, and how many each text has."""
    raw = [(t or "").encode() for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]).lower(), dtype=np.uint8)
    blank = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    first = ~blank
    first[1:] &= blank[:-1]
    starts = np.flatnonzero(first)
    solid = np.concatenate([[0], np.cumsum(~blank)])
    offsets = np.append(solid[starts], solid[-1]).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~blank])])
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    return words, np.diff(np.searchsorted(starts, ends), prepend=0)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str | None]]]:
    """Rows from an offset, BYTES characters at a time or one longer text."""
    texts, begin, size = batch.column("text").to_pylist(), 0, 0
    for at, text in enumerate(texts):
        if at > begin and size + len(text or "") > BYTES:
            yield begin, texts[begin:at]
            begin, size = at, 0
        size += len(text or "")
    if begin < len(texts):
        yield begin, texts[begin:]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c, n) of docs (text, learn): c over the texts to learn from, n over all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            learn = batch.column("learn").to_numpy(zero_copy_only=False).astype(bool)
            for begin, texts in _parts(batch):
                words, per_text = split_words(texts)
                coded = words.dictionary_encode()
                which = coded.indices.to_numpy(zero_copy_only=False)
                size = len(coded.dictionary)
                mine = np.repeat(learn[begin : begin + len(texts)], per_text)
                yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.bincount(which[mine], minlength=size)), pa.array(np.bincount(which, minlength=size))], ["word", "c", "n"])

    return docs.select("text", "learn").mapInArrow(count, "word binary, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def piece_counts(words: DataFrame, path: str) -> dict[int, int]:
    """How often each piece comes up in the learning texts; at most as many entries as the vocabulary has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(path)
        total = np.zeros(model.vocab_size(), np.int64)
        for batch in batches:
            made = model.encode([w.decode() for w in batch.column("word").to_pylist()], num_threads=1)
            times = np.repeat(batch.column("c").to_numpy(), np.fromiter(map(len, made), np.int64, len(made)))
            total += np.bincount(np.fromiter((i for ids in made for i in ids), np.int64), weights=times, minlength=len(total)).astype(np.int64)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["piece", "n"])

    rows = words.where("c > 0").select("word", "c").mapInArrow(count, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    return {r["piece"]: r["n"] for r in rows}


class Lattice:
    """log10 probabilities of words, summed over all their segmentations."""

    def __init__(self, path: str, counts: dict[int, int], ends: int):
        model = tokenizer(path)
        size = model.vocab_size()
        whole = math.log10(sum(counts.values()) + ends + size + 1)
        share = [math.log10(counts.get(i, 0) + 1) - whole for i in range(size)]
        self.end = math.log10(ends + 1) - whole
        self.byte, self.piece = {}, {}
        for i in range(size):
            if model.is_byte(i):
                self.byte[int(model.id_to_piece(i)[3:5], 16)] = share[i]
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.piece[model.id_to_piece(i)] = share[i]
        self.longest = max(map(len, self.piece), default=1)
        self.floor = -whole

    def character(self, c: str) -> float:
        return sum(self.byte.get(b, self.floor) for b in c.encode())

    def word(self, word: str) -> float:
        text, piece, longest = START + word, self.piece, self.longest
        forward = [0.0]
        for end in range(1, len(text) + 1):
            terms = [forward[begin] + p for begin in range(max(0, end - longest), end) if (p := piece.get(text[begin:end])) is not None]
            if text[end - 1] not in piece:
                terms.append(forward[end - 1] + self.character(text[end - 1]))
            if len(terms) == 1:
                forward.append(terms[0])
            else:
                top = max(terms)
                forward.append(top + math.log10(sum(10.0 ** (t - top) for t in terms)))
        return forward[-1]


def _with_lattice(words: DataFrame, make) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = make()
        for batch in batches:
            made = pa.array([lattice.word(w.decode()) for w in batch.column("word").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), made], ["word", "c", "lp"])

    return words.select("word", "c").mapInArrow(work, "word binary, c long, lp double")


@functools.lru_cache(maxsize=2)
def _lattice(path: str, counts: tuple[tuple[int, int], ...], ends: int) -> Lattice:
    return Lattice(path, dict(counts), ends)


def lm_scores(docs: DataFrame, learn: Column, path: str, key: str = "doc_id", text: str = "text", head: int = HEAD) -> DataFrame:
    """(key, learnt, n_tokens, n_known, train_tokens, base_score, score) of every row; ``learn`` marks the rows to learn from."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"), learn.alias("learn"))
    words = written(word_counts(rows), "words")
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    ends = rows.where("learn").count()
    tokens, distinct = total["n"] + ends, total["v"] + (ends > 0)
    pieces = tuple(sorted(piece_counts(words, path).items()))
    make = functools.partial(_lattice, path, pieces, ends)

    # The lowest frequency, as a power of two, from which on the words fit the head.
    steps = {r["step"]: r["n"] for r in words.groupBy(F.floor(F.log2("n")).cast("int").alias("step")).agg(F.count("*").alias("n")).collect()}  # 64 rows at most
    held, least = 0, 1 << 62
    for step in sorted(steps, reverse=True):
        held += steps[step]
        if held > head:
            break
        least = 1 << step
    frequent = _with_lattice(words.where(F.col("n") >= least), make).collect()  # at most ``head`` rows
    shared = spark.sparkContext.broadcast({bytes(r["word"]): (r["c"], r["lp"]) for r in frequent})
    whole = math.log10(tokens + distinct + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lattice = shared.value, make()
        for batch in batches:
            keys, numbers, learnt = (batch.column(c) for c in ("k", "row", "learn"))
            for begin, texts in _parts(batch):
                n = len(texts)
                words, per_text = split_words(texts)
                coded = words.dictionary_encode()
                own = coded.dictionary.to_pylist()
                found = [known.get(w) for w in own]
                count = np.array([-1 if x is None else x[0] for x in found], np.int64)
                lp = np.array([0.0 if x is None else x[1] for x in found])
                which, of = coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(n), per_text)
                c = count[which]
                there = c >= 0
                sums = lambda x: np.bincount(of[there], weights=x[there], minlength=n)  # noqa: E731, B023
                row = numbers.slice(begin, n).to_numpy()
                none = np.zeros(n, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([b" %d" % r for r in row.tolist()], pa.binary()), pa.array(row), keys.slice(begin, n), learnt.slice(begin, n), pa.array(per_text + 1), pa.array(none + 1),
                        pa.array(sums(c > 0).astype(np.int64) + (ends > 0)), pa.array(sums(np.log10(np.maximum(c, 0) + 1.0)) + math.log10(ends + 1)), pa.array(sums(lp[which]) + lattice.end),
                    ],
                    schema,
                )
                # The others, once for each text and word.
                rest, times = np.unique(of[~there] * len(own) + which[~there], return_counts=True)
                at = rest // max(1, len(own))
                m = len(rest)
                zero = np.zeros(m)
                yield pa.RecordBatch.from_arrays(
                    [coded.dictionary.take(pa.array(rest % max(1, len(own)))), pa.array(row[at]), pa.nulls(m, keys.type), pa.nulls(m, pa.bool_()), pa.nulls(m, pa.int64()), pa.array(times), pa.array(zero.astype(np.int64)), pa.array(zero), pa.array(zero)],
                    schema,
                )

    schema = ["word", "row", "k", "learn", "n_tokens", "times", "known", "base", "lp"]
    # Of a text's words the frequent ones are summed where it stands; its own row has a key no word can have, as words hold no blank.
    found = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(score, f"word binary, row long, k {kind}, learn boolean, n_tokens long, times long, known long, base double, lp double")
    others = _with_lattice(words.where(F.col("n") < least), make).select("word", F.col("c").alias("c2"), F.col("lp").alias("lp2"))
    joined = found.join(others, "word", "left")
    summed = joined.groupBy("row").agg(
        F.max("k").alias(key), F.max("learn").alias("learnt"), F.max("n_tokens").alias("n_tokens"),
        F.sum(F.col("known") + F.coalesce(F.when(F.col("c2") > 0, F.col("times")), F.lit(0))).alias("n_known"),
        F.sum(F.col("base") + F.coalesce(F.col("times") * F.log10(F.col("c2") + 1), F.lit(0.0))).alias("base"),
        F.sum(F.col("lp") + F.coalesce(F.col("times") * F.col("lp2"), F.lit(0.0))).alias("score"),
    )
    return summed.select(key, "learnt", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * whole).alias("base_score"), "score")


def held_out(key: Column) -> Column:
    return crc32_mod(key, 7) == 2


def op10_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = lm_scores(docs, ~held_out(F.col("doc_id")), public_tokenizers.path("piece_bpe_32k.model"))
    return scored.select("doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
