"""Retrieval: inverted index, BM25, vectors, rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.functions import text as T
from weftgraph.functions.scoring import cosine

STATUS_ORDER = ("active", "draft", "candidate")
KIND_ORDER = ("source", "module", "output")
# Vectors in a block, blocks at least, pairs compared at a time.
VECTORS, BLOCKS, PAIRS = 32_768, 8, 4_000_000


def build_index(pages: DataFrame, key: str = "doc_id", body: str = "text", title: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(postings(term, key, tf), lengths(key, dl)); title and body weigh alike."""
    whole = F.coalesce(F.col(body), F.lit("")) if title is None else F.concat_ws(" ", title, body)
    words = pages.select(key, T.tokens(whole).alias("w"))
    postings = words.select(key, F.explode("w").alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))
    return postings, words.select(key, F.size("w").alias("dl"))


def bm25(postings: DataFrame, lengths: DataFrame, terms: list[str], key: str = "doc_id", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of documents that have a term; more is better. Only the query's postings are read."""
    hits = postings.where(F.col("term").isin(*sorted(set(terms)))) if terms else postings.limit(0)
    corpus = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("mean"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # one row for each query term
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("mean")))
    return hits.join(F.broadcast(df), "term").join(lengths, key).crossJoin(corpus).groupBy(key).agg(F.sum(part).alias("score"))


def search(pages: DataFrame, question: str, limit: int = 5, key: str = "doc_id", body: str = "text", where: Column | None = None) -> DataFrame:
    """(key, score) of the best pages, status and kind before score where pages have them; an empty question finds nothing."""
    words = [w for w in pages.sparkSession.range(1).select(T.tokens(F.lit(question)).alias("w")).first()["w"]]
    postings, lengths = build_index(pages, key, body)
    found = bm25(postings, lengths, words, key)
    rank = lambda c, order: F.coalesce(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(c)), F.lit(0)) if c in pages.columns else None
    kept = pages if where is None else pages.where(where)
    extra = [c for c in ("status", "kind") if c in pages.columns]
    joined = found.join(kept.select(key, *extra), key)
    order = [F.when(r == 0, 99).otherwise(r) for r in (rank("status", STATUS_ORDER), rank("kind", KIND_ORDER)) if r is not None]
    return joined.orderBy(*order, F.desc(F.round("score", 9)), key).limit(limit).select(key, "score")


def snippet(body: Column, word: str, around: int = 60) -> Column:
    """The text around the first place of a word, which stands in brackets."""
    at = F.instr(F.lower(body), word.lower())
    start = F.greatest(F.lit(1), at - around)
    return F.when(at > 0, F.concat(F.substring(body, start, at - start), F.lit("["), F.substring(body, at, F.lit(len(word))), F.lit("]"), F.substring(body, at + len(word), F.lit(around))))


def semantic_search(vectors: DataFrame, query: list[float], least: float = 0.25, limit: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    score = cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    return vectors.select(key, score.alias("score")).where(F.col("score") >= least).orderBy(F.desc("score"), key).limit(limit)


def graph_matches(vectors: DataFrame, query: list[float], least: float = 18.0, limit: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, score): cosine times 100 with two digits, 18 or more."""
    score = F.greatest(F.lit(0.0), F.round(100 * cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])), 2))
    return vectors.select(key, score.alias("score")).where(F.col("score") >= least).orderBy(F.desc("score"), key).limit(limit)


def fuse(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """(key, score) of ranked lists (key, rank from 1): reciprocal ranks summed."""
    whole = lists[0].select(key, "rank")
    for x in lists[1:]:
        whole = whole.unionByName(x.select(key, "rank"))
    return whole.groupBy(key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def ranked(df: DataFrame, *order: Column | str) -> DataFrame:
    """df (a short list) with its rank from 1."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _edges_of_cells(least: float, per_node: int):
    """Rows (cell, same, is_left, key, v) sorted by cell, which is a pair of blocks; of each cell the best links of every vector."""

    def best(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort([b, -c, a])
        a, b, c = a[order], b[order], c[order]
        begin = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])[: len(a)])
        kept = np.arange(len(a)) - np.repeat(begin, np.diff(np.append(begin, len(a)))) < per_node
        return a[kept], b[kept], c[kept]

    def compare(cell: pa.Table) -> pa.RecordBatch:
        v = cell.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(cell.num_rows, -1)
        square = np.zeros(len(v))
        for d in range(v.shape[1]):  # element by element, as ``cosine`` sums
            square += v[:, d] * v[:, d]
        usable = np.flatnonzero(np.isfinite(square) & (square > 0))
        keys, is_left = cell.column("key").combine_chunks().take(pa.array(usable)), cell.column("is_left").combine_chunks().to_numpy(zero_copy_only=False)[usable]
        v, length = v[usable], np.sqrt(square[usable])
        names, rank = np.unique(keys.to_numpy(zero_copy_only=False), return_inverse=True)
        same = cell.column("same")[0].as_py()
        left, right = np.flatnonzero(is_left), np.arange(len(v)) if same else np.flatnonzero(~is_left)
        unit, columns = (v / length[:, None]).astype(np.float32), np.ascontiguousarray(v.T)
        nearly = np.float32(least - 1e-6 - 2.4e-7 * v.shape[1])  # float32 is off by less
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        step = max(1, PAIRS // max(1, len(right)))
        for at in range(0, len(left), step):
            i, j = np.nonzero(unit[left[at : at + step]] @ unit[right].T >= nearly)
            i, j = left[at + i], right[j]
            once = (rank[i] < rank[j]) if same else (rank[i] != rank[j])
            i, j = i[once], j[once]
            c = np.zeros(len(i))
            for x in columns:
                c += x[i] * x[j]
            c /= length[i] * length[j]
            close = np.flatnonzero(c >= least)
            a, b = np.minimum(rank[i[close]], rank[j[close]]), np.maximum(rank[i[close]], rank[j[close]])
            found = best(*(np.concatenate(x) for x in zip(found, (a, b, c[close]), strict=True)))
        a, b = (pa.array(names[x], keys.type) for x in found[:2])
        return pa.RecordBatch.from_arrays([a, b, pa.array(found[2])], ["a", "b", "c"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            cells = batch.column("cell").to_numpy(zero_copy_only=False)
            begin = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]])[: len(cells)])
            for at, end in zip(begin.tolist(), [*begin[1:].tolist(), len(cells)], strict=True):
                if held and cells[at] != now:
                    yield compare(pa.Table.from_batches(held))
                    held = []
                now = cells[at]
                held.append(batch.slice(at, end - at))
        if held:
            yield compare(pa.Table.from_batches(held))

    return link


def embedding_edges(vectors: DataFrame, least: float = 0.82, per_node: int = 3, key: str = "vec_id", vector: str = "embedding", block: int = VECTORS) -> DataFrame:
    """(a, b, confidence): for each vector its closest later ones, at every size.

    All pairs are compared, exactly: vectors are dealt in blocks, each pair of
    blocks is one task's matrix product, and what float32 finds near ``least`` is
    summed again as ``cosine`` does. Only the best of each vector leave a task.
    Vectors that are null, zero, of another length or hold a null or NaN have no links.
    """
    if least <= 0:
        raise ValueError("least must be over 0: vectors without a direction have cosine 0")
    own = vectors.select(F.col(key).alias("key"), F.col(vector).alias("v")).where(F.col("key").isNotNull() & (F.size("v") > 0))
    blocks = max(BLOCKS, -(-own.count() // block))
    placed = own.select("key", "v", F.size("v").alias("n"), F.pmod(F.xxhash64("key", "v"), F.lit(blocks)).cast("int").alias("own"))
    # Cell (i, j), i <= j: a block goes to every cell of its row and column.
    cells = placed.select("key", "v", "n", "own", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    number = (F.col("n").cast("long") * blocks + F.least("own", "other")) * blocks + F.greatest("own", "other")
    dealt = cells.select(number.alias("cell"), (F.col("own") == F.col("other")).alias("same"), (F.col("own") <= F.col("other")).alias("is_left"), "key", "v")
    kind = own.schema["key"].dataType.simpleString()
    near = dealt.repartition(blocks * (blocks + 1) // 2, "cell").sortWithinPartitions("cell").mapInArrow(_edges_of_cells(least, per_node), f"a {kind}, b {kind}, c double")
    top = near.withColumn("rn", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("c"), "b"))).where(F.col("rn") <= per_node)
    return top.select("a", "b", F.round("c", 3).alias("confidence"))


def cached_embeddings(items: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with their vector, misses) of items(kind, item_id, content_hash)."""
    keys = ["kind", "item_id", "content_hash"]
    return items.join(cache.select(*keys, "embedding"), keys), items.join(cache.select(*keys), keys, "left_anti")


def search_many(pages: DataFrame, questions: DataFrame, limit: int = 5, key: str = "doc_id", body: str = "text", where: Column | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, rank, key, score): the best pages for each of questions (query_id, text), by score and key.

    One join of the questions' terms with the postings; a term's frequency is
    counted where the postings are grouped by term already. Best rows are ranked
    in each task first. An empty question finds nothing.
    """
    asked = questions.select("query_id", F.explode(F.array_distinct(T.tokens(F.coalesce(F.col("text"), F.lit(""))))).alias("term"))
    postings, lengths = build_index(pages, key, body)
    corpus = lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("mean"))
    hits = postings.join(asked.select("term").distinct(), "term", "left_semi")
    weighed = hits.join(hits.groupBy("term").agg(F.count("*").alias("df")), "term").join(lengths, key).crossJoin(corpus)
    part = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("mean")))
    kept = weighed if where is None else weighed.join(pages.where(where).select(key), key, "left_semi")
    scored = asked.join(kept.select("term", key, part.alias("part")), "term").groupBy("query_id", key).agg(F.sum("part").alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), key)))
    return ranked.where(F.col("rank") <= limit).select("query_id", "rank", key, "score")


def _nearest(least: float, limit: int):
    """Two blocks of vectors of one length: the nearest of each question. PAIRS are multiplied at a time, in float32; what may be among the best is summed again as ``cosine`` does."""

    def matrix(t: pa.Table) -> np.ndarray:
        return t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)

    def compare(q: pa.Table, v: pa.Table) -> pa.Table:
        ids, keys = q.column("query_id").combine_chunks(), v.column("key").combine_chunks()
        found_i, found_j, found_c = [], [], []
        if q.num_rows and v.num_rows:
            a, b = matrix(q), matrix(v)
            na, nb = np.zeros(len(a)), np.zeros(len(b))
            for d in range(a.shape[1]):  # element by element, as ``cosine`` sums
                na, nb = na + a[:, d] * a[:, d], nb + b[:, d] * b[:, d]
            na, nb = np.sqrt(na), np.sqrt(nb)
            with np.errstate(invalid="ignore"):
                ua, ub = ((x / np.where(n > 0, n, 1.0)[:, None]).astype(np.float32) for x, n in ((a, na), (b, nb)))
            by_key, rank = pc.sort_indices(keys).to_numpy(), np.empty(len(b), np.int64)
            rank[by_key] = np.arange(len(b))
            slack = 1e-6 + 2.4e-7 * a.shape[1]  # float32 is off by less
            step = max(1, PAIRS // len(b))
            for at in range(0, len(a), step):
                with np.errstate(invalid="ignore"):
                    near = ua[at : at + step] @ ub.T
                near[np.isnan(near)] = -2.0
                enough = np.full(len(near), least) if len(b) <= limit else np.maximum(least, np.partition(near, len(b) - limit, axis=1)[:, len(b) - limit] - slack)
                i, j = np.nonzero(near >= (enough - slack)[:, None])
                i += at
                c = np.zeros(len(i))
                for d in range(a.shape[1]):
                    c += a[i, d] * b[j, d]
                size = na[i] * nb[j]
                c = np.divide(c, size, out=np.zeros_like(c), where=size > 0)
                close = np.flatnonzero(c >= least)
                i, j, c = i[close], j[close], c[close]
                order = np.lexsort([rank[j], -c, i])
                i, j, c = i[order], j[order], c[order]
                begin = np.flatnonzero(np.append(True, i[1:] != i[:-1])[: len(i)])
                kept = np.arange(len(i)) - np.repeat(begin, np.diff(np.append(begin, len(i)))) < limit
                found_i.append(i[kept])
                found_j.append(j[kept])
                found_c.append(c[kept])
        join = lambda parts, kind: pa.array(np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind))
        return pa.table([ids.take(join(found_i, np.int64)), keys.take(join(found_j, np.int64)), join(found_c, np.float64)], names=["query_id", "key", "score"])

    return compare


def semantic_many(vectors: DataFrame, questions: DataFrame, least: float = 0.25, limit: int = 5, key: str = "vec_id", vector: str = "embedding", block: int = 8_192) -> DataFrame:
    """(query_id, rank, key, score): the nearest vectors of each of questions (query_id, vector), by cosine and key.

    Vectors and questions are dealt in blocks by hash; each pair of blocks of one
    length is a task's product, of which only the best of each question leave.
    """
    v = vectors.where(F.size(vector) > 0).select(F.col(key).alias("key"), F.col(vector).alias("v"), F.size(vector).alias("n"))
    q = questions.where(F.size(vector) > 0).select("query_id", F.col(vector).alias("v"), F.size(vector).alias("n"))
    rows, columns = (max(1, -(-df.count() // block)) for df in (q, v))
    deal = lambda df, own, mine, all_: df.select(*own, "v", "n", F.pmod(F.xxhash64(own[0]), F.lit(mine)).alias("_own"), F.explode(F.sequence(F.lit(0), F.lit(all_ - 1))).alias("_other"))
    left = deal(q, ["query_id"], rows, columns).select("query_id", "v", "n", F.col("_own").cast("int").alias("i"), F.col("_other").cast("int").alias("j"))
    right = deal(v, ["key"], columns, rows).select("key", "v", "n", F.col("_other").cast("int").alias("i"), F.col("_own").cast("int").alias("j"))
    kinds = f"query_id {q.schema['query_id'].dataType.simpleString()}, key {v.schema['key'].dataType.simpleString()}, score double"
    near = left.groupBy("n", "i", "j").cogroup(right.groupBy("n", "i", "j")).applyInArrow(_nearest(least, limit), kinds)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))).where(F.col("rank") <= limit)
    return ranked.select("query_id", "rank", F.col("key").alias(key), "score")


def fuse_many(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """(query_id, key, score) of ranked lists (query_id, key, rank): reciprocal ranks summed for each question."""
    whole = lists[0].select("query_id", key, "rank")
    for x in lists[1:]:
        whole = whole.unionByName(x.select("query_id", key, "rank"))
    return whole.groupBy("query_id", key).agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def excerpts(found: DataFrame, pages: DataFrame, key: str = "doc_id", body: str = "text", page_chars: int = 1_200, raw_chars: int = 800) -> DataFrame:
    """found (query_id, rank, key) with the page's opening and that of its raw text, white space as single blanks."""
    said = T.normalize_whitespace(F.coalesce(F.col(body), F.lit("")))
    return found.join(pages.select(key, T.truncate(said, page_chars).alias("excerpt"), T.truncate(said, raw_chars).alias("raw_excerpt")), key)


def answers(quoted: DataFrame, question: DataFrame, key: str = "doc_id") -> DataFrame:
    """(query_id, related, answer): the pages that support an answer in order, and their excerpts as one text; a question without a hit says so."""
    parts = quoted.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col(key).alias("k"), "excerpt"))).alias("x"))  # a few pages each
    text = F.array_join(F.transform("x", lambda r: F.concat(F.lit("- "), r["excerpt"])), "\n")
    return question.select("query_id").join(parts, "query_id", "left").select("query_id", F.transform(F.coalesce("x", F.array().cast(parts.schema["x"].dataType)), lambda r: r["k"]).alias("related"), F.coalesce(text, F.lit("No matching page.")).alias("answer"))


def related_outputs(targets: DataFrame, outputs: DataFrame) -> DataFrame:
    """(target, output, rank): outputs (id, title, related_page_ids, related_node_ids, related_source_ids) that name the target page (3), share a node (2) or a source (1) with targets (id, node_ids, source_ids); the highest counts."""
    by = lambda target, output, rank: target.join(output, "k").select("target", "output", F.lit(rank).alias("rank"))
    one = lambda df, name, c: df.select(F.col("id").alias(name), F.explode(F.array_distinct(c)).alias("k"))  # rows of one id may repeat a key: the highest rank is the same
    met = by(targets.select(F.col("id").alias("target"), F.col("id").alias("k")), one(outputs, "output", "related_page_ids"), 3)
    met = met.unionByName(by(one(targets, "target", "node_ids"), one(outputs, "output", "related_node_ids"), 2)).unionByName(by(one(targets, "target", "source_ids"), one(outputs, "output", "related_source_ids"), 1))
    return met.groupBy("target", "output").agg(F.max("rank").alias("rank"))
