"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A letter trigram is the product
(binding) of its letters' vectors, of which the first is permuted twice and the
second once; a text is the sum (bundle) of its trigrams, and a language's
prototype the bundle of all its learning texts. A text is given the language
whose prototype has the highest cosine with its own bundle.

Bundling is linear, so prototypes are made from trigram counts: those are
summed by Spark over all learning texts and are at most ``SYMBOLS ** 3`` numbers
a language, whatever the input's size.

Defined cases: a text that is null or has no letter gets ``und`` and score 0, as
does any text where nothing could be learned. Rows with a null text or language
teach nothing. Ties go to the language whose name sorts first. Each input row
gives one output row. Other columns pass through, but for those that are named as
a result, which give way to it. Letters outside a-z share ``SYMBOLS - 27`` vectors
by code point: neighbours in one alphabet have different ones, letters of
different scripts may have the same.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import bounded_batches, crc32_mod, without
from weftgraph.llm.pretokens import LETTER, classes

SYMBOLS = 64
DIMENSIONS = 1_024
SEED = 20_240_229
ROWS = 256
CHARS = 2_000_000
GRAMS = 8_192


@functools.lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """Code point to symbol: 0 for what is no letter (and the end mark), 1 to 26 for a to z, shared ones for other letters."""
    kind = classes()
    points = np.arange(len(kind))
    table = np.where(kind == LETTER, 27 + points % (SYMBOLS - 27), 0).astype(np.uint8)
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return table


@functools.lru_cache(maxsize=2)
def letter_vectors(dimensions: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs (first letter permuted twice, second once, bound) and of third letters."""
    own = np.random.Generator(np.random.PCG64(seed)).integers(0, 2, (SYMBOLS, dimensions), dtype=np.int8) * 2 - 1
    pairs = np.roll(own, 2, axis=1)[:, None, :] * np.roll(own, 1, axis=1)[None, :, :]
    return pairs.reshape(SYMBOLS * SYMBOLS, dimensions), own


def gram_vectors(grams: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    pairs, own = letter_vectors(dimensions, seed)
    return (pairs[grams // SYMBOLS] * own[grams % SYMBOLS]).astype(np.float32)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All trigrams that hold a letter, and the number of the text that each is from. Each text begins and ends with a non-letter, and runs of those are one."""
    lowered = [t.lower() for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 2
    ends = np.cumsum(sizes)
    code = np.full(int(sizes.sum()), 0x110000, dtype=np.uint32)
    inside = np.ones(len(code), dtype=bool)
    inside[ends - 1] = inside[ends - sizes] = False
    code[inside] = np.frombuffer("".join(lowered).encode("utf-32-le"), dtype="<u4")
    letters = symbols()[code]
    of = np.repeat(np.arange(len(texts)), sizes)
    keep = np.ones(len(letters), dtype=bool)
    keep[1:] = (letters[1:] != 0) | (letters[:-1] != 0) | (of[1:] != of[:-1])
    letters, of = letters[keep].astype(np.int32), of[keep]
    grams = (letters[:-2] * SYMBOLS + letters[1:-1]) * SYMBOLS + letters[2:]
    within = (of[:-2] == of[2:]) & (grams > 0)
    return grams[within], of[:-2][within]


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str]]]:
    """Rows from an offset, at most ROWS and, but for one long text, CHARS characters at a time."""
    texts = [t or "" for t in batch.column(column).to_pylist()]
    begin = size = 0
    for at, text in enumerate(texts):
        if at > begin and (at - begin >= ROWS or size + len(text) > CHARS):
            yield begin, texts[begin:at]
            begin, size = at, 0
        size += len(text)
    if begin < len(texts):
        yield begin, texts[begin:]


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED) -> tuple[list[str], np.ndarray]:
    """Languages in order of name, and their prototypes of length one."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for begin, texts in _parts(batch, "text"):
                grams, of = trigrams(texts)
                named = langs[begin : begin + len(texts)]
                for name in set(named):
                    mine = np.fromiter((x == name for x in named), bool, len(named))[of]
                    if name not in sums:
                        sums[name] = np.zeros(SYMBOLS**3, np.int64)
                    sums[name] += np.bincount(grams[mine], minlength=SYMBOLS**3)
        for name, total in sums.items():
            found = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(found), pa.string()), "gram": pa.array(found, pa.int64()), "n": pa.array(total[found], pa.int64())})

    bounded_batches(docs.sparkSession)
    known = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = known.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    names, profiles = [], []
    for name, own in counts.groupby("lang"):
        names.append(name)
        own, bundle = own.sort_values("gram"), np.zeros(dimensions)
        for at in range(0, len(own), GRAMS):
            part = own.iloc[at : at + GRAMS]
            bundle += part["n"].to_numpy(np.float64) @ gram_vectors(part["gram"].to_numpy(), dimensions, seed)
        profiles.append(bundle / max(np.linalg.norm(bundle), 1e-12))
    return names, np.array(profiles, dtype=np.float32).reshape(len(names), dimensions)


def cosines(texts: list[str], profiles: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each text has a letter, and its bundle's cosine with each prototype."""
    grams, of = trigrams(texts)
    found = np.flatnonzero(np.bincount(grams, minlength=1))
    column = np.zeros(SYMBOLS**3, np.int64)
    column[found] = np.arange(len(found))
    place, bundles = column[grams], np.zeros((len(texts), profiles.shape[1]), np.float32)
    for at in range(0, len(found), GRAMS):  # texts in many scripts have more different trigrams than fit at once
        part = found[at : at + GRAMS]
        own = (place >= at) & (place < at + GRAMS)
        counts = np.bincount(of[own] * len(part) + place[own] - at, minlength=len(texts) * len(part)).reshape(len(texts), len(part)).astype(np.float32)
        bundles += counts @ gram_vectors(part, profiles.shape[1], seed)
    lengths = np.linalg.norm(bundles, axis=1)
    return np.bincount(of, minlength=len(texts)) > 0, bundles @ profiles.T / np.maximum(lengths, 1e-12)[:, None]


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", seed: int = SEED, stated: str | None = None) -> DataFrame:
    """docs with lang_pred and score (the cosine, 0 at least) for every row; with ``stated``, a column of languages, also the cosine with that one's prototype as stated_score (null if it was not learned)."""
    names, profiles = model
    bounded_batches(docs.sparkSession)
    made = ["lang_pred", "score", *["stated_score"] * bool(stated)]
    docs = without(docs, made, (text,))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, texts in _parts(batch, text):
                if names:
                    letters, near = cosines(texts, profiles, seed)
                    best, score = near.argmax(axis=1), np.clip(near.max(axis=1), 0, 1)
                else:
                    letters, best, score = np.zeros(len(texts), bool), np.zeros(len(texts), int), np.zeros(len(texts))
                said = pa.array([names[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], pa.string())
                part = batch.slice(begin, len(texts))
                columns = [*part.columns, said, pa.array(np.where(letters, score, 0.0), pa.float64())]
                if stated:
                    columns.append(pa.array([float(near[at, names.index(x)]) if x in names else None for at, x in enumerate(part.column(stated).to_pylist())], pa.float64()))
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *made])

    return docs.mapInArrow(predict, f"{kinds}, lang_pred string, score double{', stated_score double' if stated else ''}")


def held_out(key: Column) -> Column:
    return crc32_mod(key, 4) == 2


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
