"""Toxicity by maximum-scoring segments of token log-odds.

Learning: tokens of labelled texts get log-odds with an informative Dirichlet
prior (a token's share of all learning tokens, times ``PRIOR``). Tokens are the
words and, for inflected and compound words that were never seen, their first
``STEMS`` letters; a word is scored by the longest that is known. Counts are of
distinct contexts - a token with the word before it, once for each class - so a
passage that many copies repeat counts once. Tokens that are more frequent in
toxic texts by a likelihood ratio of ``G`` or more carry their log-odds; every
other word carries the classes' common, negative, background score. The contexts
of a frequent word run out in the larger class before they do in the smaller one,
and a long text has many of its own: so texts with the token must be more
frequent among toxic ones as well, ``TIMES`` their share among clean ones and by a
ratio of ``G_TEXTS``, and ``MIN_TEXTS`` at least. Texts whose first place of the
token has the same two words on either side count once there.

Scoring: one linear scan finds all maximal scoring segments (Ruzzo and Tompa),
over the scored tokens with the background between them summed. A segment of
score S in a text of n tokens is expected K n exp(-S) times by chance (scores
are log-likelihood ratios, so the extreme-value scale is 1; K is fitted to the
clean learning texts). Segments with expectation under ``SIGNIFICANT`` are the
passages. Their S - ln(K n) are summed and a logistic curve, fitted to the
learning texts, turns the sum into the score; its intercept is at most
``NO_EVIDENCE``, so that no evidence is never toxic.

The learning texts are those of at most ``MAX_LABELS`` labelled rows, drawn by
the hash of doc_id, one text for each: that bounds the model and what the driver
gets. Labels, lang, source and doc_id are no inputs of a score.

Defined cases: null text counts as empty; a text without passages gets the
score of no evidence, under 0.5. Each input row gives one output row, repeated
rows and null keys included. A key with several labels counts as toxic if one of
them says so; of its several texts the one with the smallest hash teaches; null
labels teach nothing. Without learning rows of both classes every score is the
share of toxic ones (0 if none). Other columns pass through, but for those that
are named as a result, which give way to it.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import bounded_batches, bounded_broadcast, crc32_mod, without, written

MAX_LABELS = 20_000
PRIOR = 500.0
G = 22.0
G_TEXTS, TIMES, MIN_TEXTS = 3.84, 2.0, 2
MIN_CONTEXTS = 4
STEMS = (7, 6, 5)
SIGNIFICANT = 1.0
NO_EVIDENCE = -0.01
WORD = re.compile(r"\w+")
SPARK_WORD = r"(?U)\W+"
ROWS = 512
BROADCAST_ROWS = 1_000_000


@dataclass
class Model:
    """scores: of tokens; gap: of any other token; log_k: ln K; logit: intercept and slope."""

    scores: dict[str, float] = field(default_factory=dict)
    gap: float = -0.01
    log_k: float = 0.0
    logit: tuple[float, float] = (-10.0, 0.0)

    @functools.cached_property
    def heads(self) -> frozenset[str]:
        """The first letters of all tokens."""
        return frozenset(t[: STEMS[-1]] for t in self.scores)


def maximal_segments(places: list[int], gains: list[float], gap: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (first place, last place, score); between places each step scores ``gap``.

    Each candidate keeps the cumulative score before and behind it. A new one is
    joined with the last candidate that starts lower, unless that one ends at
    least as high; what it swallows is never looked at again.
    """
    kept: list[list[float]] = []
    total, before = 0.0, -1
    for place, gain in zip(places, gains, strict=True):
        total += gap * (place - before - 1)
        before = place
        left, total = total, total + gain
        new = [place, place, left, total]
        while True:
            at = len(kept) - 1
            while at >= 0 and kept[at][2] >= new[2]:
                at -= 1
            if at < 0 or kept[at][3] >= new[3]:
                kept.append(new)
                break
            new = [kept[at][0], new[1], kept[at][2], new[3]]
            del kept[at:]
    return [(int(a), int(b), r - l) for a, b, l, r in kept]


def word_score(word: str, scores: dict[str, float]) -> float | None:
    """The score of the longest known token: the word, else one of its stems."""
    found = scores.get(word)
    if found is None:
        for letters in STEMS:
            if len(word) > letters and (found := scores.get(word[:letters] + "*")) is not None:
                break
    return found


def hits(text: str | None, model: Model) -> tuple[int, list[int], list[float]]:
    """The number of words; places and scores of those that carry one."""
    words = WORD.findall((text or "").lower())
    heads, short = model.heads, STEMS[-1]
    places, gains = [], []
    for at in [i for i, w in enumerate(words) if w[:short] in heads]:
        if (gain := word_score(words[at], model.scores)) is not None:
            places.append(at)
            gains.append(gain)
    return len(words), places, gains


def passages(text: str | None, model: Model) -> tuple[list[tuple[int, int, float, float]], float]:
    """Significant segments as (first word, last word, score, expectation), and the evidence: their scores above chance, summed."""
    size, places, gains = hits(text, model)
    if not places:
        return [], 0.0
    chance = model.log_k + math.log(size)
    found = [(a, b, s, math.exp(min(50.0, chance - s))) for a, b, s in maximal_segments(places, gains, model.gap)]
    found = [x for x in found if x[3] < SIGNIFICANT]
    return found, sum(s - chance for _, _, s, _ in found)


def token_scores(docs: DataFrame) -> tuple[dict[str, float], float]:
    """(scores, gap) from (text, toxic)."""
    words = docs.select("toxic", F.xxhash64("text").alias("doc"), F.split(F.lower("text"), SPARK_WORD).alias("words"))
    placed = words.select("toxic", "doc", "words", F.posexplode("words").alias("pos", "word")).where(F.col("word") != "")
    bad = F.sum("toxic").cast("double")
    totals = placed.agg(bad.alias("n1"), (F.count("*") - bad).alias("n0")).first()
    n1, n0 = totals["n1"] or 0.0, totals["n0"] or 0.0
    if not n1 or not n0:
        return {}, -0.01
    of = words.groupBy("toxic").agg(F.count_distinct("doc").alias("n")).collect()  # two rows
    d1, d0 = (float(sum(r["n"] for r in of if r["toxic"] == k)) for k in (1, 0))
    stems = [F.when(F.length("word") > n, F.concat(F.substring("word", 1, n), F.lit("*"))) for n in STEMS]
    before = F.when(F.col("pos") > 0, F.get("words", F.col("pos") - 1)).alias("before")
    around = F.xxhash64(*[F.when(F.col("pos") + k >= 0, F.get("words", F.col("pos") + k)) for k in (-2, -1, 1, 2)], F.col("pos") > 0).alias("around")
    tokens = placed.select("toxic", "doc", "pos", before, around, F.explode(F.array("word", *stems)).alias("w")).where(F.col("w").isNotNull())
    # A token has at most as many contexts in toxic texts as it has places there: others cannot pass.
    plain = tokens.groupBy("w").agg(bad.alias("y1"))
    likely = plain.where(F.col("y1") >= MIN_CONTEXTS)
    able = tokens.join(bounded_broadcast(likely.select("w"), BROADCAST_ROWS), "w")
    texts = able.groupBy("toxic", "w", "doc").agg(F.min_by("around", "pos").alias("around")).select("toxic", "w", "around").distinct()
    side = lambda y, both, share: F.when(F.col(y) > 0, F.col(y) * F.log(F.col(y) / (both * share))).otherwise(0.0)
    ratio = lambda a, b, n, m: 2 * (side(a, F.col(a) + F.col(b), n / (n + m)) + side(b, F.col(a) + F.col(b), m / (n + m)))
    in_texts = texts.groupBy("w").agg(bad.alias("d1"), (F.count("*") - bad).cast("double").alias("d0"))
    spread = written(in_texts.where((F.col("d1") >= MIN_TEXTS) & (ratio("d1", "d0", d1, d0) >= G_TEXTS) & (F.col("d1") / d1 >= TIMES * F.col("d0") / d0)).select("w"), "spread")
    # Contexts are gathered of the few tokens that are left.
    contexts = tokens.select("toxic", "before", "w").join(bounded_broadcast(spread, BROADCAST_ROWS), "w").distinct()
    up, down = F.col("y1") + F.col("a"), F.col("y0") + F.col("a")
    scored = (
        contexts.groupBy("w").agg(bad.alias("y1"), (F.count("*") - bad).alias("y0"))
        .withColumn("a", PRIOR * (F.col("y1") + F.col("y0")) / (n1 + n0))
        .withColumn("odds", F.log(up / (n1 + PRIOR - up)) - F.log(down / (n0 + PRIOR - down)))
        .where((F.col("y1") >= MIN_CONTEXTS) & (ratio("y1", "y0", n1, n0) >= G) & (F.col("odds") > 0))
        .collect()  # of at most max_labels texts
    )
    whole = [r for r in scored if not r["w"].endswith("*")]
    share = sum(r["y1"] for r in whole) / n1, sum(r["y0"] for r in whole) / n0
    return {r["w"]: r["odds"] for r in scored}, min(-1e-4, math.log((1 - min(share[0], 0.99)) / (1 - min(share[1], 0.98))))


def _evidence(docs: DataFrame, model: Model) -> DataFrame:
    """(toxic, words, best, evidence) of labelled texts."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                size, places, gains = hits(text, model)
                best = max((s for _, _, s in maximal_segments(places, gains, model.gap)), default=0.0)
                rows.append((size, best, passages(text, model)[1]))
            n, best, evidence = (np.array(c) for c in zip(*rows, strict=True)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(n, pa.int64()), pa.array(best, pa.float64()), pa.array(evidence, pa.float64())], ["toxic", "words", "best", "evidence"])

    return docs.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(weigh, "toxic int, words long, best double, evidence double")


def _logit(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a ridge-penalised logistic curve, by Newton's steps."""
    design, beta, ridge = np.column_stack([np.ones(len(x)), x]), np.zeros(2), np.diag([1e-3, 1e-2])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + ridge, design.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return min(NO_EVIDENCE, float(beta[0])), max(0.0, float(beta[1]))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_labels: int = MAX_LABELS) -> Model:
    """The model from docs that labels name; the caller leaves out the rows it holds out."""
    bounded_batches(docs.sparkSession)
    drawn = labels.where(F.col("toxic").isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg((F.max("toxic") > 0).cast("int").alias("toxic")).orderBy(F.xxhash64("k"), "k").limit(max_labels)
    texts = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(bounded_broadcast(drawn, max_labels), "k")
    known = written(texts.groupBy("k").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic"), "known")
    scores, gap = token_scores(known)
    first = Model(scores, gap)
    seen = _evidence(known, first).toPandas()  # at most max_labels rows
    clean, toxic = seen[seen["toxic"] == 0], seen[seen["toxic"] == 1]
    if not scores or not len(clean) or not len(toxic):
        share = len(toxic) / max(1, len(seen))
        return Model(scores={}, logit=(math.log(max(share, 1e-4) / max(1 - share, 1e-4)), 0.0))
    levels = np.unique(np.quantile(list(scores.values()), np.linspace(0, 1, 11)))
    log_k = max(math.log(((clean["best"] >= s).sum() + 0.5) / max(1, clean["words"].sum())) + s for s in levels)
    fitted = Model(scores, gap, float(log_k))
    again = _evidence(known, fitted).toPandas()
    return Model(scores, gap, float(log_k), _logit(again["evidence"].to_numpy(), again["toxic"].to_numpy(float)))


def detect(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score, predicted and passages (first_word, last_word, score, expected) for every row."""
    bounded_batches(docs.sparkSession)
    docs = without(docs, ("score", "predicted", "passages"), (text,))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    passage = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                found = [passages(t, model) for t in batch.column(text).to_pylist()]
                scores = 1 / (1 + np.exp(-np.clip(model.logit[0] + model.logit[1] * np.array([e for _, e in found]), -30, 30)))
                listed = pa.array([[{"first_word": a, "last_word": b, "score": s, "expected": e} for a, b, s, e in p] for p, _ in found], passage)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32)), listed], [*batch.schema.names, "score", "predicted", "passages"])

    return docs.mapInArrow(score, f"{kinds}, score double, predicted int, passages array<struct<first_word: bigint, last_word: bigint, score: double, expected: double>>")


def held_out(key: Column) -> Column:
    return crc32_mod(key, 5) == 0


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn(docs.where(~held_out(F.col("doc_id"))), labels.where(~held_out(F.col("doc_id"))))
    found = detect(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("passages").cast("long").alias("n_passages"))
