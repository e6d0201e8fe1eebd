"""The stored index: whatever updates and merges it went through, it gives what an index made anew gives."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.operators import segments
from weftgraph.operators.segments import Conflict, SegmentIndex, split

PAGES = "doc_id long, text string"
WORDS = ["alpha", "beta", "gamma", "delta", "eps-ilon", "z9", "the", "the", "the"]


def text_of(draw):
    return draw.choice([None, "", "!?", " ".join(draw.choice(WORDS) for _ in range(draw.randint(1, 30))), " ".join(draw.choice(WORDS) for _ in range(draw.randint(1, 6)))])


def plain_search(pages, questions, limit, among=None):
    """BM25 over a dict of pages by its formula."""
    split = {k: re.findall(r"[a-z0-9][a-z0-9-]+", (t or "").lower()) for k, t in pages.items()}
    n, mean = len(split), sum(map(len, split.values())) / max(1, len(split))
    df = Counter(w for ws in split.values() for w in set(ws))
    out = []
    for q, asked in questions.items():
        scores = {}
        for k, ws in split.items():
            tf = Counter(ws)
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in sorted(set(re.findall(r"[a-z0-9][a-z0-9-]+", (asked or "").lower()))) if w in tf)
            if s > 0 and (among is None or k in among):
                scores[k] = s
        best = sorted(scores, key=lambda k: (-round(scores[k], 9), k))[:limit]
        out += [(q, at + 1, k, round(scores[k], 6)) for at, k in enumerate(best)]
    return sorted(out)


def found(index, questions, limit, among=None, **how):
    asked = index.spark.createDataFrame(sorted(questions.items()), "query_id string, text string")
    only = None if among is None else index.spark.createDataFrame([(k,) for k in among], "doc_id long")
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in index.search(asked, limit, only, **how).collect())


def frame(spark, pages):
    return spark.createDataFrame(sorted(pages.items()), PAGES)


ASKED = {"a": "Alpha the unknown", "b": "beta gamma the", "c": "", "d": None, "e": "nothing-of-this", "f": "z9 z9 eps-ilon"}


def test_updates_and_merges_equal_a_rebuild(spark, tmp_path):
    draw = random.Random(3)
    index, pages = SegmentIndex(spark, f"file://{tmp_path}/ix"), {}
    assert found(index, ASKED, 5) == [] and index.merge() == 0
    for step in range(6):
        before = dict(pages)
        if step % 2 == 0:
            for _ in range(25):
                pages[draw.randint(0, 60)] = text_of(draw)
            for k in draw.sample(sorted(pages), len(pages) // 5):
                del pages[k]
            counts = index.refresh(frame(spark, pages))
        else:
            put, gone = {draw.randint(0, 70): text_of(draw) for _ in range(8)}, draw.sample(sorted(pages), 4)
            pages = {k: t for k, t in pages.items() if k not in gone or k in put} | put
            counts = index.update(frame(spark, put), spark.createDataFrame([(k,) for k in gone], "doc_id long"))
        same = sum(k in before and (before[k] or "") == (pages[k] or "") for k in pages)
        assert counts == {"added": len(pages.keys() - before.keys()), "removed": len(before.keys() - pages.keys()), "kept": same, "changed": len(pages.keys() & before.keys()) - same}
        if step == 3:
            assert index.merge(most=2) >= 2 and len(index.manifest().segments) <= 2
        if step == 4:
            index.merge(most=1, dead_share=0.0)
            assert len(index.manifest().segments) == 1 and not index.manifest().dead
        assert found(index, ASKED, 7) == plain_search(pages, ASKED, 7)
    among = set(draw.sample(sorted(pages), len(pages) // 2))
    assert found(index, ASKED, 4, among, block=2) == plain_search(pages, ASKED, 4, among)
    assert index.vacuum() > 0 and found(index, ASKED, 7) == plain_search(pages, ASKED, 7)


def test_only_dirty_pages_are_split(spark, tmp_path):
    pages = {k: f"alpha w{k}" for k in range(200)}
    index = SegmentIndex(spark, f"file://{tmp_path}/ix")
    index.refresh(frame(spark, pages))
    version = index.manifest().version
    assert index.refresh(frame(spark, pages))["kept"] == 200 and index.manifest().version == version  # nothing to commit
    pages |= {3: "beta", 500: "gamma"}
    index.refresh(frame(spark, pages))
    new = index.manifest().segments[-1]
    assert spark.read.parquet(f"file://{tmp_path}/ix/segments/{new}/pages").count() == 2


def test_status_has_three_answers(spark, tmp_path):
    index = SegmentIndex(spark, f"file://{tmp_path}/ix")
    one, two = frame(spark, {1: "alpha"}), frame(spark, {1: "alpha", 2: None})
    assert tuple(index.status(one).first()) == ("missing", "rebuild")
    index.refresh(one)
    assert tuple(index.status(one).first()) == ("current", "none")
    assert tuple(index.status(two).first()) == ("stale", "refresh") and tuple(index.status(one.limit(0)).first()) == ("stale", "refresh")
    index.refresh(one.limit(0))
    assert tuple(index.status(one.limit(0)).first()) == ("current", "none") and found(index, ASKED, 3) == []


def test_a_writer_that_stops_or_comes_second_changes_nothing(spark, tmp_path, monkeypatch):
    index = SegmentIndex(spark, f"file://{tmp_path}/ix")
    index.refresh(frame(spark, {1: "alpha", 2: "beta"}))
    before, state = found(index, ASKED, 3), index.manifest()

    def stop(*_):
        raise OSError("stopped")

    monkeypatch.setattr(index, "_commit", stop)
    with pytest.raises(OSError):
        index.refresh(frame(spark, {1: "gamma"}))
    monkeypatch.undo()
    assert found(index, ASKED, 3) == before and index.manifest() == state
    other = SegmentIndex(spark, f"file://{tmp_path}/ix")
    other.refresh(frame(spark, {1: "alpha", 2: "gamma"}))
    with pytest.raises(Conflict):
        index._commit(state, state.segments, state.dead)
    assert found(index, ASKED, 3) == plain_search({1: "alpha", 2: "gamma"}, ASKED, 3)


def test_equal_pages_tie_by_key_across_segments(spark, tmp_path):
    index, pages = SegmentIndex(spark, f"file://{tmp_path}/ix"), {}
    for step in range(3):
        pages |= {k: "alpha beta the" for k in range(40 - step, 100, 3)}
        index.refresh(frame(spark, pages))
    assert found(index, {"a": "alpha"}, 10) == plain_search(pages, {"a": "alpha"}, 10)


def test_title_counts_and_other_columns_do_not_matter(spark, tmp_path):
    rows = spark.createDataFrame([("x", "alpha", None, 1), ("y", None, "beta beta", 2), ("z", None, None, 3)], "id string, name string, body string, slot int")
    index = SegmentIndex(spark, f"file://{tmp_path}/ix", key="id", body="body", title="name")
    index.refresh(rows)
    asked = spark.createDataFrame([(1, "alpha beta")], "query_id int, text string")
    assert {r["id"] for r in index.search(asked, 5).collect()} == {"x", "y"}
    assert index.pages().where(F.col("dl") == 0).count() == 1


def test_split_finds_the_tokens_of_the_pattern():
    draw = random.Random(5)
    texts = [None, "", "-", "a", "--ab", "x" * 9, *("".join(draw.choice("ab9- -.é\n") for _ in range(draw.randint(0, 40))) for _ in range(300))]
    for begin, end in ((0, len(texts)), (7, 90), (1, 3)):
        words, sizes = split(pa.array(texts).slice(begin, end - begin))
        each = [re.findall(r"[a-z0-9][a-z0-9-]+", t or "") for t in texts[begin:end]]
        assert sizes.tolist() == [len(w) for w in each] and [w.decode() for w in words.to_pylist()] == [w for ws in each for w in ws]


def test_a_shard_is_stored_and_moved_as_one_row(spark, tmp_path):
    index = SegmentIndex(spark, f"file://{tmp_path}/ix")
    pages = {k: f"alpha w{k} beta w{k // 2}" for k in range(300)}
    index.refresh(frame(spark, {k: pages[k] for k in range(200)}))
    index.refresh(frame(spark, pages))
    assert all(spark.read.parquet(f"file://{tmp_path}/ix/segments/{s}/postings").count() <= 16 for s in index.manifest().segments)
    assert index.merge(most=1) == 2
    (one,) = index.manifest().segments
    assert [r["n"] for r in spark.read.parquet(f"file://{tmp_path}/ix/segments/{one}/pages").groupBy("shard").agg(F.count("*").alias("n")).collect()] == [300]  # 32 small shards fit one
    asked = {str(k): pages[k] for k in range(0, 300, 7)}
    assert found(index, asked, 5) == plain_search(pages, asked, 5)


def test_common_and_rare_terms_copies_and_dead_pages_in_any_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "TOGETHER", 3)
    index, draw = SegmentIndex(spark, f"file://{tmp_path}/ix"), random.Random(8)
    pages = {k: " ".join(draw.choice(WORDS) if draw.random() < 0.5 else f"w{draw.randint(0, 400)}" for _ in range(25)) for k in range(400)} | {k: "alpha beta w7" for k in range(400, 460)}
    index.refresh(frame(spark, pages))
    index.refresh(frame(spark, {k: t for k, t in pages.items() if k % 9}))
    live, asked = {k: t for k, t in pages.items() if k % 9}, {str(k): pages[k] for k in range(0, 460, 20)}
    assert found(index, asked, 6) == found(index, asked, 6, block=4) == plain_search(live, asked, 6)
