"""Exact BM25 top-k: sharded inverted index, block-max WAND, exact merge.

Tasks turn their documents into index shards, kept as a table with one row a
shard, each a row group of its own, and searched in Arrow batches of one row:
whatever number of shards a task gets, it holds one at a time. Inside a shard documents are ordered by their most frequent word and
length, so that a block of ``BLOCK`` neighbours is alike and its maxima are
tight; lists hold (document, term frequency) in that order. Document frequencies
and the mean length are summed over all shards, so every shard scores with
global statistics and its top k merge exactly.

A search moves over a shard with ``BATCH`` queries at once. Words in one of
``COMMON`` documents or more (``MOST_COMMON`` words at most) stand in a matrix of
words and documents; the lists of all others are added up posting by posting. A
block's bound is the largest such sum in it and the maxima that the common words
have in it; the matrix is multiplied only over blocks whose bound reaches the
threshold of one of the queries. The product has single precision: all its terms
are positive, so its error is within a share of the score that is known, and every
document within that share of the threshold is scored exactly from its postings.
The threshold is the k-th score so far: of the query's best in this task, and at
first of its best over one in ``SAMPLE`` of the shards, which are searched first
(their results count; only the other shards are searched after that).

Queries are processed in blocks of about ``QUERY_TERMS`` terms or ``QUERIES``
queries, one after the other: a block is broadcast, its results are written, and
the broadcast is given up. Scores are sums rounded once (fsum), so equal texts
have equal scores; ties go to the smaller key.

Words: runs of letters, digits and non-ASCII characters, A-Z lower-cased. A
query is its text's words, repeats counting. score = sum over query words of
ln(1 + (N - df + 0.5) / (df + 0.5)) * tf (k1 + 1) / (tf + k1 (1 - b + b len / mean)).

Defined cases: null text counts as empty; an empty document is never found and an
empty query finds nothing. A document that shares no word is no result. Rows
that repeat a key are separate documents (their order in a tie is undefined) and
separate queries give the union of results, ranked together. Null keys are
documents, but no queries. Keys keep their type (numbers or strings). Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.llm.common import batches_of, bounded_batches, written

K1, B, TOP = 1.2, 0.75, 10
BLOCK = 64
SHARD_DOCS, SHARD_CHARS = 16_384, 16_000_000
CHARS = 2_000_000
QUERY_TERMS, QUERIES = 2_000_000, 20_000
SAMPLE = 8
BATCH, COMMON, MOST_COMMON = 64, 16, 1_024
MARGIN = 1e-9

_SPLITS = np.ones(256, dtype=bool)
_SPLITS[ord("0") : ord("9") + 1] = _SPLITS[ord("a") : ord("z") + 1] = _SPLITS[128:] = False


def split_words(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and how many each has."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]).lower(), dtype=np.uint8)
    gap = _SPLITS[data]
    first = ~gap
    first[1:] &= gap[:-1]
    starts = np.flatnonzero(first)
    solid = np.concatenate([[0], np.cumsum(~gap)])
    words = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(solid[starts], solid[-1]).astype(np.int32)), pa.py_buffer(data[~gap])])
    return words, np.diff(np.searchsorted(starts, np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)), prepend=0)


def counted(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, term, doc, tf, length): the distinct words, and each pair of word and text, ordered by word and text. Splits CHARS characters at a time, or one longer text."""
    known: dict[bytes, int] = {}
    pairs, times, lengths, begin, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, 0
    for at in range(len(texts) + 1):
        if at > begin and (at == len(texts) or size + len(texts[at]) > CHARS):
            words, length = split_words(texts[begin:at])
            coded = words.dictionary_encode()
            own = np.fromiter((known.setdefault(w, len(known)) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
            pair, tf = np.unique(own[coded.indices.to_numpy(zero_copy_only=False)] * len(texts) + np.repeat(np.arange(begin, at), length), return_counts=True)
            pairs.append(pair)
            times.append(tf)
            lengths.append(length)
            begin, size = at, 0
        if at < len(texts):
            size += len(texts[at])
    pair = np.concatenate(pairs)
    order = np.argsort(pair)
    pair = pair[order]
    return pa.array(list(known), pa.binary()), pair // max(1, len(texts)), pair % max(1, len(texts)), np.concatenate(times)[order], np.concatenate(lengths)


def ordered(n: int, term: np.ndarray, doc: np.ndarray, tf: np.ndarray, length: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Documents by their most frequent word (of equal ones the most widespread), then length."""
    by_doc = np.lexsort((df[term], tf, doc))
    last = np.flatnonzero(np.diff(doc[by_doc], append=n))
    chief = np.full(n, -1)
    chief[doc[by_doc][last]] = term[by_doc][last]
    return np.lexsort((length, chief))


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a shard: its number, terms with document frequencies, and the postings as arrays in binary columns."""
    kind = docs.schema[key].dataType.simpleString()

    def shard(number: int, keys: list, key_type: pa.DataType, texts: list[str]) -> pa.RecordBatch:
        terms, term, doc, tf, length = counted(texts)
        df = np.bincount(term, minlength=len(terms))
        order = ordered(len(texts), term, doc, tf, length, df)
        place = np.empty(len(texts), np.int64)
        place[order] = np.arange(len(texts))
        by_list = np.argsort(term * len(texts) + place[doc])
        whole = pa.array(keys, key_type).take(pa.array(order))
        return pa.RecordBatch.from_pydict(
            {
                "shard": pa.array([number], pa.int64()), "n": [len(texts)], "total": [int(length.sum())], "keys": pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), whole), "terms": pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms),
                "df": pa.ListArray.from_arrays(pa.array([0, len(df)], pa.int32()), pa.array(df, pa.int64())), "length": [length[order].astype("<i4").tobytes()], "doc": [place[doc][by_list].astype("<i4").tobytes()], "tf": [tf[by_list].astype("<i4").tobytes()],
            }
        )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, size, number = [], [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for k, t in zip(batch.column("k").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if texts and (len(texts) >= SHARD_DOCS or size + len(t) > SHARD_CHARS):
                    yield shard(number, keys, batch.column("k").type, texts)
                    keys, texts, size, number = [], [], 0, number + 1
                keys.append(k)
                texts.append(t)
                size += len(t)
        if texts:
            yield shard(number, keys, batch.column("k").type, texts)

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return written(rows.mapInArrow(build, f"shard long, n long, total long, keys array<{kind}>, terms array<binary>, df array<bigint>, length binary, doc binary, tf binary"), "index", **{"parquet.block.row.count.limit": 1})


class Shard:
    """A shard's index over the words of a block of queries."""

    def __init__(self, row: dict, vocabulary: pa.Array, mean: float):
        self.keys, self.n = row["keys"], row["n"]
        own = pc.index_in(row["terms"], value_set=vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        df = row["df"].to_numpy(zero_copy_only=False)
        length = np.frombuffer(row["length"], "<i4")
        keep = np.repeat(own >= 0, df)
        self.doc = np.frombuffer(row["doc"], "<i4")[keep].astype(np.int64)
        tf = np.frombuffer(row["tf"], "<i4")[keep]
        self.impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.doc] / mean))
        used, size = own[own >= 0], df[own >= 0]
        term = np.repeat(np.arange(len(used)), size)
        # The lists: the run of each word's postings.
        self.begin, self.size = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
        self.begin[used], self.size[used] = np.cumsum(size) - size, size
        # The common words as a matrix: word, document; and its maxima: word, block.
        common = np.argsort(-size, kind="stable")[:MOST_COMMON]
        common = common[size[common] * COMMON >= self.n]
        self.slot, row = np.full(len(vocabulary), -1), np.full(len(used), -1)
        self.slot[used[common]] = row[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), self.n), np.float32)
        at = row[term]
        self.matrix[at[at >= 0], self.doc[at >= 0]] = self.impact[at >= 0]
        self.starts = np.arange(0, self.n, BLOCK)
        self.most = np.maximum.reduceat(self.matrix, self.starts, axis=1)
        self.error = (len(common) + 8) * 2.0**-23  # of a sum of positive products in single precision, as a share; twice what is possible
        # The same by document.
        order = np.argsort(self.doc, kind="stable")
        self.by_doc_term, self.by_doc_impact = np.repeat(used, size)[order], self.impact[order]
        self.doc_ends = np.cumsum(np.bincount(self.doc, minlength=self.n))
        self.read = self.there = 0  # columns of the matrix multiplied, and those there

    def search(self, terms: np.ndarray, weights: np.ndarray, dense: np.ndarray, threshold: float, k: int) -> list[tuple[float, object]]:
        """``search_all`` for one query."""
        return next((found for _, found in self.search_all(terms, weights, np.array([len(terms)]), dense, np.array([threshold]), k)), [])

    def search_all(self, terms: np.ndarray, weights: np.ndarray, ends: np.ndarray, dense: np.ndarray, threshold: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[float, object]]]]:
        """(place, the best k (score, key) that reach its threshold) of the queries, whose terms end at ``ends``. dense: zeros, one for each word of the vocabulary."""
        count = len(ends)
        query = np.repeat(np.arange(count), np.diff(ends, prepend=0))
        slot = self.slot[terms]
        hot = slot >= 0
        asked = np.zeros((count, len(self.matrix)), np.float32)
        asked[query[hot], slot[hot]] = weights[hot]
        size = np.where(hot, 0, self.size[terms])
        at = spans(self.begin[terms], size)
        sums = np.bincount(np.repeat(query * self.n, size) + self.doc[at], np.repeat(weights, size) * self.impact[at], minlength=count * self.n).astype(np.float64, copy=False).reshape(count, self.n)
        # Blocks that can't reach the threshold of any of the queries are not multiplied.
        least = np.maximum(threshold - MARGIN, 1e-300) * (1 - 2 * self.error)
        bound = np.maximum.reduceat(sums, self.starts, axis=1) + asked @ self.most
        live = (bound >= least[:, None]).any(axis=0)
        if live.all():
            sums += asked @ self.matrix
            places = None
        else:
            places = np.flatnonzero(np.repeat(live, BLOCK)[: self.n])
            sums = sums[:, places] + asked @ self.matrix[:, places]
        self.read, self.there = self.read + count * sums.shape[1], self.there + count * self.n
        good = sums >= least[:, None]
        for q in np.flatnonzero(good.any(axis=1)).tolist():
            own = np.flatnonzero(good[q])
            if len(own) > k:  # what k others beat by more than the error can't be among the best
                reached = sums[q, own]
                own = own[reached >= (np.partition(reached, -k)[-k] - MARGIN) * (1 - 2 * self.error)]
            found = own if places is None else places[own]
            begin, end = ends[q - 1] if q else 0, ends[q]
            dense[terms[begin:end]] = weights[begin:end]
            stop = self.doc_ends[found]
            size = stop - np.where(found > 0, self.doc_ends[found - 1], 0)
            at = spans(stop - size, size)
            parts, stop = (dense[self.by_doc_term[at]] * self.by_doc_impact[at]).tolist(), np.cumsum(size).tolist()
            dense[terms[begin:end]] = 0.0
            keys = self.keys.take(pa.array(found)).to_pylist()
            yield q, best([(math.fsum(parts[b:e]), key) for b, e, key in zip([0, *stop], stop, keys, strict=False)], k)


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of several runs, one after the other."""
    total = np.cumsum(size)
    return np.repeat(begin - (total - size), size) + np.arange(total[-1] if len(total) else 0)


def best(scored: list[tuple[float, object]], k: int) -> list[tuple[float, object]]:
    """By falling score, then rising key; a null key comes last."""
    return sorted(scored, key=lambda x: (-x[0], x[1] is None, 0 if x[1] is None else x[1]))[:k]


def _shards(batch: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    """The rows of an index without a copy of what they hold."""
    for i in range(batch.num_rows):
        cell = {c: batch.column(c)[i] for c in batch.schema.names}
        yield {
            "n": cell["n"].as_py(), "keys": cell["keys"].values, "terms": cell["terms"].values, "df": cell["df"].values, **{c: cell[c].as_buffer() for c in ("length", "doc", "tf")},
        }


def _flat(lists: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The items of all lists, and where each list ends."""
    whole = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) and lists.num_chunks else lists
    if isinstance(whole, pa.ChunkedArray):
        return pa.array([], lists.type.value_type), np.zeros(0, np.int64)
    return whole.flatten(), np.cumsum(pc.list_value_length(whole).to_numpy(zero_copy_only=False))


def _queries(rows: pa.Table) -> dict:
    """A block of queries: its vocabulary, and each query's terms as places in that."""
    terms, ends = _flat(rows.column("terms"))
    coded = terms.dictionary_encode()
    return {
        "vocabulary": coded.dictionary, "ids": rows.column("query_id").combine_chunks(), "rows": rows.column("row").to_numpy(), "ends": ends, "terms": coded.indices.to_numpy(zero_copy_only=False).astype(np.int32),
        "weights": _flat(rows.column("weights"))[0].to_numpy(zero_copy_only=False),
    }


def query_weights(queries: DataFrame, index: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, float]:
    """(query_id, terms, weights) of queries that have a word in the index, and the mean length of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                terms, term, doc, tf, _ = counted(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("query_id").take(pa.array(doc)), part.column("row").take(pa.array(doc)), terms.take(pa.array(term)), pa.array(tf)], ["query_id", "row", "term", "q"])

    total = index.agg(F.sum("n").alias("n"), F.sum("total").alias("t")).first()
    n, mean = total["n"] or 0, (total["t"] or 0) / max(1, total["n"] or 0)
    rows = queries.where(F.col(key).isNotNull()).select(F.col(key).alias("query_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("row", F.monotonically_increasing_id())
    words = rows.select("query_id", "row", "text").mapInArrow(count, f"query_id {queries.schema[key].dataType.simpleString()}, row long, term binary, q long")
    df = index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.df").alias("df"))
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = words.join(df, "term").select("query_id", "row", F.struct("term", (F.col("q") * idf).alias("w")).alias("x"))
    grouped = weighed.groupBy("query_id", "row").agg(F.array_sort(F.collect_list("x")).alias("x"))  # as many as the query's own words
    return grouped.select("query_id", "row", F.col("x.term").alias("terms"), F.col("x.w").alias("weights")), mean


def top_k(docs: DataFrame, queries: DataFrame, k: int = TOP, key: str = "doc_id", text: str = "text", query_terms: int = QUERY_TERMS) -> DataFrame:
    """(query_id, rank, doc_id, score): the best k documents of each query."""
    spark = docs.sparkSession
    index = build_index(docs, key, text)
    weighed, mean = query_weights(queries, index, key, text)
    plan = written(weighed, "queries")
    size = plan.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("t")).first()
    blocks = max(1, -(-size["t"] // query_terms), -(-size["n"] // QUERIES))
    sampled = F.pmod(F.xxhash64("shard"), F.lit(SAMPLE)) == 0
    tasks = 4 * spark.sparkContext.defaultParallelism
    first, rest = (dealt(index.where(own), tasks) for own in (sampled, ~sampled))
    kinds = f"query_id {queries.schema[key].dataType.simpleString()}, row long, doc_id {docs.schema[key].dataType.simpleString()}, score double"
    parts = []
    for b in range(blocks):
        own = plan.where(F.pmod(F.xxhash64("query_id", "row"), F.lit(blocks)) == b).toArrow()  # about query_terms terms
        block = spark.sparkContext.broadcast(_queries(own))
        with batches_of(spark, 1):
            parts.append(written(first.mapInArrow(_searcher(block, None, mean, k), kinds), "found"))
        reached = parts[-1].groupBy("row").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).where(F.size("s") >= k).select("row", F.element_at("s", k).alias("least"))
        least = spark.sparkContext.broadcast({r["row"]: r["least"] for r in reached.collect()})  # one for each query of the block
        with batches_of(spark, 1):
            parts.append(written(rest.mapInArrow(_searcher(block, least, mean, k), kinds), "found"))
        for gone in (block, least):
            gone.destroy()
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def dealt(index: DataFrame, tasks: int) -> DataFrame:
    """Shards over tasks, at most as many as there are shards."""
    return index.repartition(max(1, min(index.count(), tasks)))


def _searcher(block, least, mean: float, k: int):
    """Searches all shards of a task for all queries of the block; a task returns k results a query at most."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, known = block.value, least.value if least else {}
        ends, dense = q["ends"], np.zeros(len(q["vocabulary"]))
        threshold = np.array([known.get(r, 0.0) for r in q["rows"].tolist()])
        top: list[list[tuple[float, object]]] = [[] for _ in ends]
        key_type = None
        for batch in batches:
            key_type = batch.column("keys").type.value_type
            for row in _shards(batch):
                shard = Shard(row, q["vocabulary"], mean)
                for at in range(0, len(ends) if shard.n else 0, BATCH):
                    begin, own = ends[at - 1] if at else 0, ends[at : at + BATCH]
                    for place, found in shard.search_all(q["terms"][begin : own[-1]], q["weights"][begin : own[-1]], own - begin, dense, threshold[at : at + BATCH], k):
                        top[at + place] = best(top[at + place] + found, k)
                        if len(top[at + place]) == k:
                            threshold[at + place] = max(threshold[at + place], top[at + place][-1][0])
        if key_type is None:
            return
        place = pa.array(np.repeat(np.arange(len(top)), np.fromiter(map(len, top), np.int64, len(top))))
        columns = [q["ids"].take(place), pa.array(q["rows"]).take(place), pa.array([d for x in top for _, d in x], key_type), pa.array([s for x in top for s, _ in x], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["query_id", "row", "doc_id", "score"])

    return search


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 100, as a query against all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return top_k(docs, docs.where(F.col("doc_id") % 100 == 0)).withColumn("score", F.round("score", 4))


ORACLES = {
    "op8_topk_search": rf"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d), p AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, unnest(w) AS term, len(w) AS dl FROM d) GROUP BY doc_id, term),
f AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, c GROUP BY term, n),
s AS (SELECT q.doc_id AS query_id, p.doc_id, sum(q.tf * idf * p.tf * {K1 + 1} / (p.tf + {K1} * ({1 - B} + {B} * p.dl / mean))) AS score FROM p q JOIN p ON p.term = q.term JOIN f ON f.term = q.term, c WHERE q.doc_id % 100 = 0 GROUP BY 1, 2)
SELECT query_id, rank::INTEGER AS rank, doc_id, round(score, 4)::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, doc_id) AS rank FROM s) WHERE rank <= {TOP}""",
}
