"""Fill-in-middle, circulant MinHash and the conversation prefix trie, against plain versions of their definitions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import op11_fill_in_middle as fim
from weftgraph.llm import op12_minhash as minhash
from weftgraph.llm import op13_prefix_trie as trie
from weftgraph.llm.common import written

DOCS = "doc_id long, text string, lang string, k string, n long, output string, row string, sig string, bands string"


def docs_of(spark, rows):
    """With columns whose names clash with those the operators use."""
    return spark.createDataFrame([(*r, "x", "k", 7, "o", "r", "s", "b") for r in rows], DOCS)


# Fill in the middle


def plain_cut(doc_id, text):
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[at : at + 8], 16) for at in (0, 8, 16, 24))
    text, n = text or "", len(text or "")
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h4 % 100 < 20:
        return n, "spm", low, high - low, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", low, high - low, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fim_by_its_definition(spark):
    draw = random.Random(1)
    odd = [None, "", "a", "<P>", "a<M>b", "<S", "<P<S<M", "P><S>", "\U0001f600é\n\r\x00" * 3, "<" * 50, "x" * 400_000]
    rows = [(i, "".join(draw.choice("ab<SPM>é\n ") for _ in range(draw.randint(0, 12)))) for i in range(300)] + [(1_000 + i, t) for i in range(8) for t in odd] + [(None, "no id"), (5, "again"), (5, "again"), (-3, "below zero")]
    made = fim.fill_in_middle(docs_of(spark, rows)).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = sorted(((r["doc_id"], *r[1:6], r["back"]) for r in made.collect()), key=repr)
    assert got == sorted(((d, *plain_cut(d, t), t or "") for d, t in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_fim_over_words(spark):
    rows = [(i, f"  one two-{i} three\tfour ") for i in range(200)]
    made = fim.fill_in_middle(docs_of(spark, rows), unit=r"\S+").withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert all(r["back"] == t and r["n_units"] == 4 for r, (_, t) in zip(sorted(made, key=lambda r: r["doc_id"]), rows, strict=True))
    for r in made:
        if r["form"] != "plain":
            text = rows[r["doc_id"]][1]
            for cut in (r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]):
                assert cut in (0, len(text)) or (text[cut - 1].isspace() and not text[cut].isspace())


def test_fim_holds_no_units():
    """The matcher's peak memory does not grow with the number of units."""
    import tracemalloc

    pattern, peaks = re.compile(fim.UNIT), []
    for n in (10_000, 400_000):
        text = "é" * n
        tracemalloc.start()
        assert fim.count_units(pattern, text) == n and fim.places(pattern, text, n // 3, n // 2) == (n // 3, n // 2)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < peaks[0] + 10_000


def test_empty_tables(spark):
    none = docs_of(spark, [])
    assert fim.fill_in_middle(none).count() == 0 and minhash.near_duplicates(none).count() == 0
    talks = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.trie(written(trie.rebuilt(trie.turns(talks)), "none")).count() == 0


# MinHash


def shingle_set(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {b" ".join(words[at : at + 4]) for at in range(max(1, len(words) - 3))} if words else set()


def plain_components(rows):
    sets, label = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                label[root(i)] = root(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)].append(d)
    return sorted(((d, len(sets[i]), min(low[root(i)], default=None)) for i, (d, _) in enumerate(rows)), key=repr)


def families(draw, n, bases=3, words=60, edits=8):
    """Near copies of a few texts with up to so many changed words; chains of them link at a distance."""
    made = []
    base = [[f"w{draw.randint(0, 10**6)}" for _ in range(words)] for _ in range(bases)]
    for _ in range(n):
        text = list(draw.choice(base))
        at = draw.randrange(words - edits)
        for k in range(draw.randint(0, edits)):
            text[at + k] = f"z{draw.randint(0, 10**6)}"
        made.append(" ".join(text))
    return made


def got_components(spark, rows, **how):
    return sorted((tuple(r) for r in minhash.near_duplicates(docs_of(spark, rows), **how).select("doc_id", "n_shingles", "component_id").collect()), key=repr)


@pytest.mark.parametrize("block", [256, 6])
def test_minhash_components_by_brute_force(spark, block):
    """Blocks of 6 sets send every family through contraction, slices and cells."""
    draw = random.Random(4)
    odd = [None, "", " \t\n", "one", "ONE", "one two three", "One two Three", "one two three four", "é  x", "é  x", "same " * 30_000, "same " * 40]
    rows = list(enumerate(families(draw, 120))) + [(500 + i, t) for i, t in enumerate(odd)] + [(None, "no id at all here"), (None, "no id at all here"), (3, "other text of a repeated id"), (500, "one"), (7_000, "x y z " * 5), (7_001, "x y z " * 6)]
    draw.shuffle(rows)
    assert got_components(spark, rows, block=block) == plain_components(rows)


def test_minhash_threshold_is_exact(spark):
    """9 shingles of which 8 are shared: 8 of 10 is 0.8, 7 of 9 is not."""
    words = [f"a{i}" for i in range(12)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:11], "b"])), (3, " ".join(["c", *words[:11]])), (4, " ".join(["d", *words[1:11], "e"]))]
    assert got_components(spark, rows) == plain_components(rows)
    assert dict((d, c) for d, _, c in got_components(spark, rows))[2] == 1


def test_circulant_signatures_estimate_jaccard():
    draw = np.random.default_rng(7)
    for share in (0.2, 0.5, 0.8, 0.95):
        shared, other = draw.integers(0, 1 << 64, int(2_000 * share), np.uint64), int(2_000 * (1 - share) / 2)
        a, b = (np.concatenate([shared, draw.integers(0, 1 << 64, other, np.uint64)]) for _ in range(2))
        equal = np.mean(minhash.signature(a, 2_000) == minhash.signature(b, 2_000))
        assert abs(equal - len(shared) / (len(shared) + 2 * other)) < 0.04
    x = draw.integers(0, 1 << 64, 1_000, np.uint64)
    assert len(set(minhash._permuted(x, *minhash._DRAWN[:2]).tolist())) == len(set(x.tolist()))


# Prefix trie


def plain_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [t[2] for t in sorted(ts)] for c, ts in turns.items()}
    full = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        block = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        full[c] = tuple(own.get(block, [])[:h] + ts[h:])
    members = defaultdict(list)
    for c, ts in full.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    out = []
    for node, inside in members.items():
        under = [m for m in members if m[: len(node)] == node]
        children = [m for m in members if len(m) == len(node) + 1 and m[:-1] == node]
        leaves = sum(not any(len(k) == len(m) + 1 and k[:-1] == m for k in members) for m in under)
        saved = sum((len(members[m]) - 1) * len(m[-1][1]) for m in under if m)
        ends = ",".join(str(c) for c in sorted(c for c in inside if full[c] == node))
        out.append((min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def talks(draw, n):
    rows = []
    for _ in range(n):
        c = draw.choice([draw.randint(-150, 420), draw.randint(0, 5) * 100])
        for turn in range(draw.randint(0, 7)):
            rows.append((c, draw.choice([turn, turn, turn, None]), draw.choice(["user", "assistant", None, ""]), draw.choice(["a", "b", "", None, "long é " * 5])))
    return rows


def got_trie(spark, rows, bits=64):
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, depth string, pos string")
    return sorted((tuple(r) for r in trie.trie(written(trie.rebuilt(trie.turns(table)), "talks"), bits).collect()), key=repr)


@pytest.mark.parametrize("bits", [64, 3])
def test_trie_by_brute_force(spark, bits):
    """With fingerprints of three bits nearly all nodes collide and must be split."""
    rows = talks(random.Random(bits), 120) + [(None, 1, "user", "of no conversation"), (77, None, None, None)]
    assert got_trie(spark, rows, bits) == plain_trie(rows)


def test_trie_of_one_long_and_many_equal_conversations(spark):
    """A third of all turns in one conversation, over all ranges; a third of all conversations alike."""
    rows = [(100, t, "user", f"t{t % 7}") for t in range(2_000)] + [(c, t, "user", "same") for c in range(200, 800) for t in range(3)] + [(c, 0, "user", f"own {c}") for c in range(1_000, 1_200)]
    got, turns = got_trie(spark, rows), defaultdict(list)
    for c, _, role, text in rows:
        turns[c].append((role, text))
    full = {c: tuple(turns.get(c - c % 100, [])[: zlib.crc32(str(c).encode()) % 6]) + tuple(ts[zlib.crc32(str(c).encode()) % 6 :]) for c, ts in turns.items()}
    nodes = {ts[:d] for ts in set(full.values()) for d in range(len(ts) + 1)}
    assert len(got) == len(nodes) and max(r[1] for r in got) == 2_000
    root = next(r for r in got if r[1] == 0)
    assert root[3] == len(full) and root[5] == len({n for n in nodes} - {n[:-1] for n in nodes if n})
    by = defaultdict(int)
    for ts in full.values():
        for d in range(1, len(ts) + 1):
            by[ts[:d]] += 1
    assert root[6] == sum((k - 1) * len(n[-1][1]) for n, k in by.items())


def test_rolled_fingerprints_do_not_depend_on_ranges(spark):
    rows = [(c, t, "user", f"{c % 3}-{t}") for c in range(30) for t in range(40)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    prints = []
    for n in ("1", "7"):
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        scan = trie.scanned(trie.turns(table), [F.col("turn")], sums=["length"], digest=True)
        prints.append(sorted((r["conv"], r["turn"], r["pos"], r["length_run"], r["rolled"], r["rolled_up"]) for r in scan.collect()))
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert prints[0] == prints[1] and all(p[2] == p[1] + 1 for p in prints[0])
    first = {(p[0], p[2]): p[4] for p in prints[0]}
    assert all(p[5] == first.get((p[0], p[2] - 1), 0) for p in prints[0])
