"""Operators that relate texts: decontamination, near-duplicates, licenses, search, language model; and the pipeline."""

from __future__ import annotations

import functools
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_rows_and_scores import odd_rows
from tests.oracle import actual, expected
from weftgraph.llm import op1_decontaminate, op3_language_id, op5_simhash, op7_license_scan, op8_topk_search, op10_lattice_lm, registry
from weftgraph.llm.common import joined_by

BIG = "/root/testdata/sf0.01"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_oracle(spark, sf_dir, name):
    assert actual(registry.QUERIES[name](spark, sf_dir)) == expected(sf_dir, registry.ORACLES[name])


def test_every_operator_is_registered():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14)) and "pipeline" in __spark_entry__.queries()


def test_every_planted_passage_is_found(spark):
    """Word by word, whatever case: documents that hold an item, and only those."""
    words = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = {r["item_id"]: words(r["text"]) for r in spark.read.parquet(f"{BIG}/benchmark.parquet").collect()}
    docs = {r["doc_id"]: words(r["text"]) for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()}
    want = {(d, i) for d, t in docs.items() for i, w in items.items() if w in t}
    got = {(r["doc_id"], r["item_id"]) for r in op1_decontaminate.op1_decontaminate(spark, BIG).collect()}
    assert want and got == want


ITEM = "Alice has 12 apples and gives 3 apples to her friend Bob who already has 12 pears, how many apples are left for the trip"
LEAKS = [
    (1, f"Intro. {ITEM} End.", "exact"),
    (2, "Say, Alice has 45 apples and gives 9 apples to her friend Tom who already has 45 pears, how many apples are left for the trip", "reparameterised"),
    (3, "Say, Alice has 45 apples and gives 9 apples to her friend Tom who already has 77 pears, how many apples are left for the trip", None),
    (4, "she has many pears and a friend, how many apples are left", None),
]


def test_slots_must_be_consistent(spark):
    bench = spark.createDataFrame([(1, ITEM, "clash"), (2, None, ""), (3, "", ""), (4, "short item", "")], "item_id long, text string, doc_id string")
    docs = spark.createDataFrame([r[:2] for r in LEAKS] + [(5, None), (6, ""), (None, "a very short item here"), (1, LEAKS[0][1])], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    for block in (200_000, 5):
        got = {(r["doc_id"], r["item_id"]): r["kind"] for r in op1_decontaminate.contaminations(docs, bench, block=block).collect()}
        assert got == {(1, 1): "exact", (2, 1): "reparameterised", (None, 4): "exact"}
    assert op1_decontaminate.contaminations(docs.limit(0), bench).count() == 0 and op1_decontaminate.contaminations(docs, bench.limit(0)).count() == 0


def slow_print(text: str | None) -> int:
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow_components(prints: np.ndarray, bits: int = 4) -> list[int]:
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= bits):
            a, b = root(i), root(i + 1 + int(j))
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


def test_simhash_matches_brute_force(spark):
    docs = sorted(spark.read.parquet(f"{BIG}/documents.parquet").collect())
    rows = {r["doc_id"]: r for r in op5_simhash.op5_simhash(spark, BIG).collect()}
    prints = np.array([slow_print(r["text"]) for r in docs], np.uint64)
    for r, p, c in zip(docs, prints.tolist(), slow_components(prints), strict=True):
        assert (rows[r["doc_id"]]["fingerprint"], rows[r["doc_id"]]["component_id"]) == (f"{p:016x}", docs[c]["doc_id"])


def test_four_positions_hold_a_triple():
    chosen = [set(t) for t in op5_simhash.triples()]
    assert len(chosen) == 20 and all(any(t <= set(q) for t in chosen) for q in itertools.combinations(range(8), 4))


@pytest.mark.parametrize("block", [64, 10_000])
def test_dense_groups_lose_no_link(spark, block):
    rng, found = np.random.default_rng(3), set()
    for base in rng.integers(0, 1 << 63, 3).tolist():
        for _ in range(400):
            x = base
            for b in rng.integers(0, 64, rng.integers(0, 8)).tolist():
                x ^= 1 << b
            found.add(x)
    prints = np.array(sorted(found), np.uint64)
    signed, of = prints.view(np.int64).tolist(), slow_components(prints)
    groups = defaultdict(list)
    for x, c in zip(signed, of, strict=True):
        groups[c].append(x)
    want = {x: min(g) for g in groups.values() for x in g if len(g) > 1}
    df = spark.createDataFrame([(x,) for x in signed], "print long")
    assert {r["node"]: r["root"] for r in op5_simhash.components(op5_simhash.links(df, 4, block)).collect()} == want


def test_near_duplicate_edges(spark):
    docs = odd_rows(spark)
    got = Counter((r["doc_id"], r["component_id"]) for r in op5_simhash.near_duplicates(docs).collect())
    assert got == {(1, 1): 1, (2, 1): 1, (None, None): 1, (3, 3): 1, (4, 4): 2, (5, 5): 1}
    assert op5_simhash.near_duplicates(docs.limit(0)).count() == 0


def test_license_labels(spark):
    texts = {
        1: "Released under the MIT License.", 2: "x Licensed under CC BY-NC 4.0. cc by nc", 3: "Licensed under the Apache License, Version 2.0.", 4: "This work is licensed under the GNU General Public License, version 3.",
        5: "This work is licensed under the GNU General Public License, version 2.", 6: "nothing", 7: "", 8: None, 9: "mit license under the", 10: "Permission is hereby granted, free of charge, to any person obtaining a new copy of this software and its associated documentation files (the Software), to deal in the Software without restriction",
    }
    docs = spark.createDataFrame([*texts.items(), (6, "nothing"), (None, "under the mit license")], "doc_id long, text string").withColumn("label", F.lit("clash"))
    rows = {r["doc_id"]: r for r in op7_license_scan.license_scan(docs).collect()}
    assert len(rows) == 11
    assert {k: r["labels"] for k, r in rows.items() if r["labels"]} == {1: "mit", 2: "cc-by-nc", 3: "apache-2", 4: "gpl-3", 5: "gpl-2", 10: "mit", None: "mit"}
    assert {k: r["base_labels"] for k, r in rows.items() if r["base_labels"]} == {1: "mit", 2: "cc-by-nc", 3: "apache-2", None: "mit"}
    assert (rows[2]["n_base"], rows[2]["first_word"], rows[2]["last_word"], rows[2]["n_words"]) == (2, 3, 8, 11)
    assert rows[8]["n_words"] == 0 and rows[6]["first_word"] is None and rows[6]["score"] == 0.0
    assert op7_license_scan.license_scan(docs.limit(0)).count() == 0


def test_search_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    words = {i: Counter(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for i, t in texts.items()}
    df, n, mean = Counter(t for w in words.values() for t in w), len(words), sum(sum(w.values()) for w in words.values()) / len(words)
    for limit in (2_000_000, 300):
        got = defaultdict(list)
        for r in sorted(op8_topk_search.top_k(docs, docs.where("doc_id % 20 = 0"), query_terms=limit).collect(), key=lambda r: r["rank"]):
            got[r["query_id"]].append((r["doc_id"], r["score"]))
        for q in (i for i in words if i % 20 == 0):
            scored = []
            for i, w in words.items():
                parts = [c * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * w[t] * 2.2 / (w[t] + 1.2 * (0.25 + 0.75 * sum(w.values()) / mean)) for t, c in words[q].items() if t in w]
                if parts:
                    scored.append((round(math.fsum(parts), 8), i))
            best = sorted(scored, key=lambda x: (-x[0], x[1]))[:10]
            assert [i for _, i in best] == [i for i, _ in got[q]] and [s for s, _ in best] == pytest.approx([s for _, s in got[q]])


def test_search_edges(spark):
    docs = odd_rows(spark)
    rows = op8_topk_search.top_k(docs, docs, k=2).collect()
    assert {r["query_id"] for r in rows} == {3, 4, 5} and all(r["rank"] <= 2 for r in rows)
    assert op8_topk_search.top_k(docs.limit(0), docs).count() == 0 and op8_topk_search.top_k(docs, docs.limit(0)).count() == 0
    named = docs.where("doc_id is not null").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc_id"), "text")
    assert {r["query_id"] for r in op8_topk_search.top_k(named, named, k=2).collect()} == {"d3", "d4", "d5"}


def test_search_holds_one_shard_at_a_time(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    monkeypatch.setattr(op8_topk_search, "SHARD_DOCS", 10)
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in op8_topk_search.build_index(docs).inputFiles()]
    assert sum(f.num_row_groups for f in files) == sum(f.num_rows for f in files) >= docs.count() // 10
    before, searcher, limit = op8_topk_search.top_k(docs, docs.where("doc_id % 20 = 0")).collect(), op8_topk_search._searcher, spark.conf.get(name)

    def checked(*args):
        search = searcher(*args)

        def single(batches):
            for batch in batches:
                if batch.num_rows > 1:
                    raise ValueError(f"{batch.num_rows} shards at once")
                yield batch

        return lambda batches: search(single(batches))

    monkeypatch.setattr(op8_topk_search, "_searcher", checked)
    monkeypatch.setattr(op8_topk_search, "dealt", lambda index, tasks: index.repartition(1))  # as where a task gets many shards
    after = op8_topk_search.top_k(docs, docs.where("doc_id % 20 = 0")).collect()
    assert sorted(after) == sorted(before) and before and spark.conf.get(name) == limit


def test_search_skips_blocks_and_keeps_the_best():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, rng.integers(1, 60)) if x < 400) for _ in range(1_500)]
    terms, term, doc, tf, length = op8_topk_search.counted(texts)
    df = np.bincount(term)
    order = op8_topk_search.ordered(len(texts), term, doc, tf, length, df)
    assert sorted(order.tolist()) == list(range(len(texts)))
    place = np.argsort(order)
    by_list = np.argsort(term * len(texts) + place[doc])
    row = {"n": len(texts), "keys": pa.array(order), "terms": terms, "df": pa.array(df), "length": length[order].astype("<i4").tobytes(), "doc": place[doc][by_list].astype("<i4").tobytes(), "tf": tf[by_list].astype("<i4").tobytes()}
    shard, dense = op8_topk_search.Shard(row, terms, length.mean()), np.zeros(len(terms))
    impact = tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length[doc] / length.mean()))
    for q in range(0, 1_500, 30):
        own = np.flatnonzero(doc == q)
        weights = np.log(len(texts) / df[term[own]]) * tf[own]
        sums = [math.fsum((w * impact[(term == t) & (doc == d)][0]) for t, w in zip(term[own], weights, strict=True) if ((term == t) & (doc == d)).any()) for d in np.unique(doc[np.isin(term, term[own])])] if q < 90 else None
        found = shard.search(term[own], weights, dense, 0.0, 5)
        assert not dense.any() and shard.search(term[own], weights, dense, found[-1][0] if found else 1.0, 5) == found
        if sums is not None:
            assert [s for s, _ in found] == pytest.approx(sorted((s for s in sums if s > 0), reverse=True)[:5])
    assert shard.read < shard.there


@pytest.mark.parametrize("common", [16, 10**9, 0])
def test_search_of_many_queries_is_that_of_each(common, monkeypatch):
    """Words in few documents, in many or in all of the matrix, copies whose scores tie, and queries without a word."""
    monkeypatch.setattr(op8_topk_search, "COMMON", common)
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, rng.integers(1, 60)) if x < 400) for _ in range(300)] * 2
    terms, term, doc, tf, length = op8_topk_search.counted(texts)
    df, order = np.bincount(term), np.arange(len(texts))
    by_list = np.argsort(term * len(texts) + doc)
    row = {"n": len(texts), "keys": pa.array(order), "terms": terms, "df": pa.array(df), "length": length.astype("<i4").tobytes(), "doc": doc[by_list].astype("<i4").tobytes(), "tf": tf[by_list].astype("<i4").tobytes()}
    shard, dense = op8_topk_search.Shard(row, terms, length.mean()), np.zeros(len(terms))
    assert len(shard.matrix) == {16: int((df * 16 >= 600).sum()), 10**9: len(terms), 0: 0}[common]
    impact = tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length[doc] / length.mean()))
    own = [np.flatnonzero(doc == q) if q != 7 else np.zeros(0, int) for q in range(40)]
    weights = [np.log(1 + len(texts) / df[term[x]]) * tf[x] for x in own]
    found = dict(shard.search_all(np.concatenate([term[x] for x in own]), np.concatenate(weights), np.cumsum([len(x) for x in own]), dense, np.zeros(40), 5))
    for q in range(40):
        asked = np.zeros(len(terms))
        asked[term[own[q]]] = weights[q]
        scores = [math.fsum((asked[term[doc == d]] * impact[doc == d]).tolist()) for d in range(600)]
        assert found.get(q, []) == sorted(((s, d) for d, s in enumerate(scores) if s > 0), key=lambda x: (-x[0], x[1]))[:5] == shard.search(term[own[q]], weights[q], dense, 0.0, 5)
    assert not dense.any()


def all_segmentations(text: str, lattice: op10_lattice_lm.Lattice) -> float:
    if not text:
        return 1.0
    total = 0.0
    for end in range(1, min(len(text), lattice.longest) + 1):
        p = lattice.piece.get(text[:end])
        if p is not None:
            total += 10**p * all_segmentations(text[end:], lattice)
    if text[0] not in lattice.piece:
        total += 10 ** lattice.character(text[0]) * all_segmentations(text[1:], lattice)
    return total


def test_lattice_sums_all_segmentations():
    lattice = op10_lattice_lm.Lattice(PIECES, {300: 5, 400: 7}, 3)
    for word in ("the", "unable", "a中b", "\x00z"):
        assert 10 ** lattice.word(word) == pytest.approx(all_segmentations(op10_lattice_lm.START + word, lattice))
    assert math.isfinite(lattice.word("x" * 5000))


@pytest.mark.parametrize("head", [131_072, 50])
def test_base_scores(spark, sf_dir, head):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r for r in op10_lattice_lm.lm_scores(docs, ~op10_lattice_lm.held_out(F.col("doc_id")), PIECES, head=head).collect()}
    tokens, counts = {}, Counter()
    for r in docs.collect():
        tokens[r["doc_id"]] = [*re.findall(rb"[^\x20\x09-\x0D]+", r["text"].encode().lower()), b" end"]
        if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
            counts.update(tokens[r["doc_id"]])
    n, v = sum(counts.values()), len(counts)
    assert len(rows) == len(tokens)
    for i, own in tokens.items():
        r = rows[i]
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[t] > 0 for t in own), n) and r["score"] < 0


def test_lm_edges(spark):
    docs = odd_rows(spark)
    rows = op10_lattice_lm.lm_scores(docs, F.lit(True), PIECES).collect()
    assert sorted(r["n_tokens"] for r in rows) == [1, 1, 3, 3, 3, 4, 40_001]
    none = op10_lattice_lm.lm_scores(docs, F.lit(False), PIECES).collect()
    assert all(r["train_tokens"] == 0 and r["base_score"] == 0 and r["n_known"] == 0 for r in none)
    assert op10_lattice_lm.lm_scores(docs.limit(0), F.lit(True), PIECES).count() == 0


def test_pipeline_matches_its_stages_by_hand(spark):
    """Each stage's decisions, taken again with plain Python from its operator's rules, on what the stage before kept."""
    docs, kept = spark.read.parquet(f"{BIG}/documents.parquet"), {}
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.written(stage(spark, before, BIG), name)
        assert after.columns == docs.columns
        kept[name] = (sorted(before.collect()), sorted(after.collect()))
        before = after
    was, now = kept["near_duplicates"]
    of = slow_groups([r["text"] for r in was])
    assert [r["doc_id"] for r in now] == [was[c]["doc_id"] for c in sorted(set(of))]
    was, now = kept["decontamination"]
    words = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = [words(r["text"]) for r in spark.read.parquet(f"{BIG}/benchmark.parquet").collect()]
    assert [r["doc_id"] for r in now] == [r["doc_id"] for r in was if not any(i in words(r["text"]) for i in items)]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    gone = {r["doc_id"] for r in kept["toxicity"][0]} - {r["doc_id"] for r in kept["toxicity"][1]}
    assert sum(labels.get(i) == 0 for i in gone) == 0 and sum(t and i in gone for i, t in labels.items()) >= 0.8 * sum(labels.values())
    was, now = kept["language"]
    names, profiles = op3_language_id.learn(spark.createDataFrame([r for r in was if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2], docs.schema))
    letters, near = op3_language_id.cosines([r["text"] for r in was], profiles, op3_language_id.SEED)
    sure = lambda r, c: r["lang"] in names and c[names.index(r["lang"])] < 0.3 * c.max() and c.max() >= 0.5
    assert [r["doc_id"] for r in now] == [r["doc_id"] for r, ok, c in zip(was, letters, near, strict=True) if ok and c.max() >= 0.01 and not sure(r, c)] and len(was) - 10 <= len(now)
    now = kept["decontamination"][1]
    final = {r["doc_id"]: r for r in corpus_pipeline.run(spark, BIG).collect()}
    assert sorted(final) == [r["doc_id"] for r in now] and all(final[r["doc_id"]]["n_bytes"] == len(r["text"].encode()) for r in now)


def slow_groups(texts: list[str]) -> list[int]:
    """Groups by fingerprints within 4 bits or exact five-word similarity of 0.8 or more, counted over shared shingles."""
    of = slow_components(np.array([slow_print(t) for t in texts], np.uint64))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (re.sub("[A-Z]", lambda m: m[0].lower(), t).split() for t in texts)]
    holders, shared = defaultdict(list), Counter()
    for n, own in enumerate(sets):
        for x in own:
            for m in holders[x]:
                shared[m, n] += 1
            holders[x].append(n)
    near = [(a, b) for (a, b), both in shared.items() if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both)]
    while True:
        before = list(of)
        for a, b in near:
            low, high = sorted((of[a], of[b]))
            of = [low if x == high else x for x in of] if low != high else of
        if of == before:
            return of


def test_language_stage_drops_only_what_is_surely_mislabelled(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    english = docs.where("lang = 'en' and n_chars > 2000").limit(1).select(F.lit(-1).cast("long").alias("doc_id"), "text", F.lit("de").alias("lang"), "source", "n_chars")
    odd = spark.createDataFrame([(-2, "12 34 !!", "en"), (-3, None, "en"), (-4, "xq", None)], "doc_id long, text string, lang string").select("*", F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs.unionByName(english).unionByName(odd), BIG).select("doc_id").collect()}
    assert not kept & {-1, -2, -3} and len(kept) >= docs.count() - 5


def test_hot_keys_are_joined_whole(spark):
    left = spark.createDataFrame([("hot", i) for i in range(900)] + [(f"k{i}", i) for i in range(300)] + [(None, 1)], "k string, v int")
    names = left.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("low"))
    for share in (1, 3, 1_000):
        got = joined_by(left, names, "k", "n", share)
        assert got.columns == ["k", "v", "low"] and Counter((r["k"], r["low"]) for r in got.collect()) == Counter({("hot", 0): 900} | {(f"k{i}", i): 1 for i in range(300)})


def test_pipeline_stages_take_odd_rows(spark):
    docs = odd_rows(spark).select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"), F.lit("x").alias("row_number"), F.lit("y").alias("key"))
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.limit(0)):
            out = stage(spark, corpus_pipeline.written(rows, "odd"), BIG)
            assert out.count() <= 7 and (name == "token_ids" or out.columns == docs.columns)


def test_near_duplicates_stage_catches_similar_texts(spark):
    """Every pair of five-word similarity 0.8 or more, most of them beyond 4 bits, and no other beside those within 4 bits."""
    rng, texts = random.Random(11), []
    for n in range(150):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(150, 500) if n else 3)]
        texts.append(" ".join(words))
        for _ in range(2):
            texts.append(" ".join(f"x{rng.randrange(5000)}" if rng.random() < 0.02 * rng.random() else w for w in words).upper())
    texts += ["", None]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").lower().split() for t in texts)]
    prints, parent = np.array([slow_print(t) for t in texts], np.uint64), list(range(len(texts)))
    missed = 0

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        close, both = int(np.bitwise_count(prints[i] ^ prints[j])) <= 4, len(sets[i] & sets[j])
        similar = both >= 0.8 * (len(sets[i]) + len(sets[j]) - both)
        missed += similar and not close
        if close or similar:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert missed and sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, BIG).collect()) == sorted({root(i) for i in range(len(texts))})
    own = op5_simhash.written(op5_simhash.sketches(docs), "test")
    want = {tuple(sorted((int(a), int(b)))) for i, j in itertools.combinations(range(len(texts)), 2) if (a := prints[i].astype(np.int64)) != (b := prints[j].astype(np.int64)) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    names = lambda df: {r["node"]: r["root"] for r in op5_simhash.components(df).collect()}
    whole = names(spark.createDataFrame(sorted(want), "a long, b long"))
    for block in (256, 1):
        assert names(op5_simhash.set_links(own, docs, block=block)) == whole


def test_numbers_in_words_and_people_are_slots(spark):
    item = "Maria bakes six cakes in two days. Then Peter eats three cakes and Maria sells one cake for 5 dollars. How many cakes do they still have"
    swap = lambda *pairs: functools.reduce(lambda t, p: t.replace(*p), pairs, item)
    docs = spark.createDataFrame([
        (1, swap(("Maria", "Anna"), ("Peter", "Oliver"), ("six", "Nine"), ("three", "seven"), ("5 dollars", "8 dollars"))),
        (2, swap(("six", "4"), ("three", "4"))),
        (3, swap(("Maria", "Anna"), ("Peter", "Anna"))),
        (4, "Maria bakes six cakes in two days and sleeps well after that"),
    ], "doc_id long, text string")
    got = {r["doc_id"]: r["kind"] for r in op1_decontaminate.contaminations(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: "reparameterised", 2: "reparameterised"}


def test_leaks_in_other_case_and_with_names_first(spark):
    start = "Tom buys 12 red apples at the market. Tom gives 3 apples to a friend. Tom eats 2 apples on the way. How many apples are left now"
    copy = start.replace("Tom", "Sam").replace("12", "45").replace("3", "9").replace("2 apples", "7 apples")
    bench = spark.createDataFrame([(1, ITEM), (2, start)], "item_id long, text string")
    docs = spark.createDataFrame([(1, ITEM.lower()), (2, ITEM.upper()), (3, copy), (5, "Tom buys 3 pears. Tom sleeps")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in op1_decontaminate.contaminations(docs, bench).collect()}
    assert got == {(1, 1): "exact", (2, 1): "exact", (3, 2): "reparameterised"}


def test_decontamination_of_a_text_full_of_passages(spark):
    """Each place of a passage was a row with the whole text and its words, all of them held at once: more than a heap of 8 GB here."""
    item = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
    docs = spark.createDataFrame([(1, " ".join([item] * 500)), (2, "nothing of it")], "doc_id long, text string")
    rows = op1_decontaminate.contaminations(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["coverage"], r["kind"], r["first_word"]) for r in rows] == [(1, 7, 1.0, "exact", 0)]


def test_decontamination_of_a_number_in_thousands_of_parts(spark):
    """One repeat of the pattern's group was one frame of the stack."""
    item = "Ann has 12 apples and gives 3,5 of them to Bob , who gives 4 back to Ann before they go home"
    docs = spark.createDataFrame([(1, "1,22.3:4/" * 30_000 + "5 " + item)], "doc_id long, text string")
    rows = op1_decontaminate.contaminations(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["coverage"], r["kind"]) for r in rows] == [(1, 7, 1.0, "exact")]


def test_decontamination_stage_on_texts_that_ended_executors(spark, tmp_path):
    item = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(1, " ".join([item] * 500)), (2, "nothing of it"), (3, "1,22.3:4/" * 30_000 + "5")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()) == [2, 3]
