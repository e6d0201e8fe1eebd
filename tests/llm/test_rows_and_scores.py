"""Operators that judge each text: toxicity, language, tokens, pages."""

from __future__ import annotations

import base64
import hashlib
import html as html_module
import math
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.llm import op2_toxicity, op3_language_id, op4_byte_bpe, op6_html_text, op9_sstable, pretokens

BIG = "/root/testdata/sf0.01"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = "doc_id long, text string, score string, predicted string, row string"


def odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names clash."""
    rows = [(1, None, "s", "p", "r"), (2, "", "s", "p", "r"), (None, "a word", "s", None, "r"), (3, "x " * 40_000, "s", "p", "r"), (4, "the same", "s", "p", "r"), (4, "the same", "s", "p", "r"), (5, "12 34 !!", None, "p", "r")]
    return spark.createDataFrame(rows, ODD)


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_toxicity_on_held_out_labels(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    rows = op2_toxicity.op2_toxicity(spark, BIG).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert sum(a and b for a, b in held) >= 0.7 * sum(a for a, _ in held)


def brute_segments(scores: list[float]) -> list[tuple[int, int]]:
    """By definition: every proper part of a maximal segment scores less, and no longer segment that contains it has that property."""
    spans = [(i, j) for i in range(len(scores)) for j in range(i, len(scores))]
    score = {(i, j): sum(scores[i : j + 1]) for i, j in spans}
    inside = lambda x, y: x != y and y[0] <= x[0] and x[1] <= y[1]
    able = [y for y in spans if score[y] > 0 and all(score[x] < score[y] for x in spans if inside(x, y))]
    return [x for x in able if not any(inside(x, y) for y in able)]


@example([3.125, None, None, None, None, 1.25, 2.5])  # the whole and its end score alike
@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([None, None, None, 1.25, 2.5, 3.125]), max_size=14))
def test_segments_match_their_definition(gains):
    gap = -0.78125
    places = [i for i, g in enumerate(gains) if g is not None]
    got = op2_toxicity.maximal_segments(places, [gains[i] for i in places], gap)
    scores = [gap if g is None else g for g in gains]
    assert [(a, b) for a, b, _ in got] == brute_segments(scores)
    for a, b, s in got:
        assert s == pytest.approx(sum(scores[a : b + 1]))


def test_toxicity_edges(spark):
    docs = odd_rows(spark)
    model = op2_toxicity.Model({"idiot": 6.0, "moron": 6.0}, -0.01, -1.0, (-4.0, 1.0))
    rows = op2_toxicity.detect(docs.select("doc_id", "text"), model).collect()
    assert len(rows) == 7 and all(r["predicted"] == 0 and not r["passages"] for r in rows)
    bad = op2_toxicity.detect(spark.createDataFrame([(1, "an IDIOT and a moron")], "doc_id long, text string"), model).first()
    assert bad["predicted"] == 1 and (bad["passages"][0]["first_word"], bad["passages"][0]["last_word"]) == (1, 4)
    empty = op2_toxicity.learn(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert op2_toxicity.detect(docs.select("doc_id", "text"), empty).where("predicted = 1").count() == 0
    assert op2_toxicity.detect(docs.select("doc_id", "text").limit(0), model).count() == 0
    whole = op2_toxicity.detect(docs, model)
    assert whole.columns == ["doc_id", "text", "row", "score", "predicted", "passages"] and all(isinstance(r["score"], float) for r in whole.collect())


def test_toxicity_learns_by_its_definition(spark):
    """Counts of contexts, prior, odds, K and the curve, once more in plain Python; repeated keys and passages count once."""
    toxic = [f"you {w} zorkface {w}{i} gruntle {i}" for i, w in enumerate("ab cd ef gh ij kl mn op".split())]
    clean = [f"the {w} day {w}{i} was long and {i} fine for all of us" for i, w in enumerate("qr st uv wx yz ba dc fe hg ji lk nm".split())]
    texts = [*toxic, *clean, clean[0]]
    docs = spark.createDataFrame([*enumerate(texts), (0, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < len(toxic))) for i in range(len(texts))] + [(0, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    model = op2_toxicity.learn(docs.where("text <> ''"), labels)
    words = [re.findall(r"\w+", t.lower()) for t in texts]
    n1, n0 = sum(map(len, words[: len(toxic)])), sum(map(len, words[len(toxic) :]))
    seen = {(w, own[i - 1] if i else None, n < len(toxic)) for n, own in enumerate(words) for i, whole in enumerate(own) for w in (whole, *(whole[:k] + "*" for k in op2_toxicity.STEMS if len(whole) > k))}
    want = {}
    for w in {w for w, _, _ in seen}:
        y1, y0 = (sum(x == w and bad == side for x, _, bad in seen) for side in (True, False))
        a, p = op2_toxicity.PRIOR * (y1 + y0) / (n1 + n0), n1 / (n1 + n0)
        odds = math.log((y1 + a) / (n1 + op2_toxicity.PRIOR - y1 - a)) - math.log((y0 + a) / (n0 + op2_toxicity.PRIOR - y0 - a))
        g = 2 * sum(y * math.log(y / ((y1 + y0) * share)) for y, share in ((y1, p), (y0, 1 - p)) if y)
        if y1 >= op2_toxicity.MIN_CONTEXTS and g >= op2_toxicity.G and odds > 0:
            want[w] = odds
    assert want and model.scores == pytest.approx(want)
    best = [max((s for _, _, s in op2_toxicity.maximal_segments(*op2_toxicity.hits(t, model)[1:], model.gap)), default=0.0) for t in clean + clean[:1]]
    levels = np.unique(np.quantile(list(want.values()), np.linspace(0, 1, 11)))
    assert model.log_k == pytest.approx(max(math.log((sum(b >= s for b in best) + 0.5) / n0) + s for s in levels))
    evidence = np.array([op2_toxicity.passages(t, model)[1] for t in texts])
    p = 1 / (1 + np.exp(-(model.logit[0] + model.logit[1] * evidence)))
    y = np.arange(len(texts)) < len(toxic)
    assert abs((y - p).sum() - 1e-3 * model.logit[0]) < 1e-3 and abs(((y - p) * evidence).sum() - 1e-2 * model.logit[1]) < 1e-3
    for r in op2_toxicity.detect(docs, model).collect():
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-(model.logit[0] + model.logit[1] * op2_toxicity.passages(r["text"], model)[1]))))


@pytest.mark.parametrize("copies", [1, 40])
def test_toxicity_counts_a_repeated_clean_passage_once(spark, copies):
    """A token in thirty contexts of toxic texts is learned, however often one clean passage with it is repeated."""
    toxic = [f"a{i} zork b{i} c{i} d{i}" for i in range(30)]
    clean = ["the zork passage repeats here " * copies + f"e{i} f{i} g{i} h{i}" for i in range(10)] + [f"i{i} j{i} k{i} l{i}" for i in range(60)]
    docs = spark.createDataFrame(enumerate([*toxic, *clean]), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(100)], "doc_id long, toxic int")
    model = op2_toxicity.learn(docs, labels)
    assert model.scores["zork"] > 0 and model.logit[0] < 0
    rows = {r["doc_id"]: r for r in op2_toxicity.detect(docs.unionByName(spark.createDataFrame([(200, "nothing known"), (201, None)], docs.schema)), model).collect()}
    assert rows[0]["score"] >= rows[200]["score"] == rows[201]["score"] < 0.5


def test_toxicity_does_not_learn_frequent_words(spark):
    """Contexts of a word in every text run out in the larger class first, and one long text has many of a word of its own: neither is learned."""
    words = [f"v{i}" for i in range(40)]
    draw = np.random.default_rng(3)
    plain = [" ".join(f"{w} of" for w in draw.choice(words, 12)) for _ in range(440)]
    toxic = [f"{t} {words[i]} zorkface {draw.choice(words)}" for i, t in enumerate(plain[:40])]
    toxic[0] += "".join(f" {w} odd" for w in words)
    docs = spark.createDataFrame(enumerate([*toxic, *plain[40:]]), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(440)], "doc_id long, toxic int")
    model = op2_toxicity.learn(docs, labels)
    assert "zorkface" in model.scores and not {"of", "odd"} & set(model.scores)
    caught = {r["doc_id"] for r in op2_toxicity.detect(docs, model).where("predicted = 1").collect()}
    assert caught == set(range(40))


def test_language_on_held_out_documents(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()}
    rows = op3_language_id.op3_language_id(spark, BIG).collect()
    held = [truth[r["doc_id"]] == r["lang_pred"] for r in rows if r["held_out"]]
    assert len(rows) == 1000 and sum(held) / len(held) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)


def slow_bundle(text: str, dimensions: int, seed: int) -> np.ndarray:
    own = np.random.Generator(np.random.PCG64(seed)).integers(0, 2, (op3_language_id.SYMBOLS, dimensions), dtype=np.int8).astype(int) * 2 - 1
    symbol = lambda c: ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % (op3_language_id.SYMBOLS - 27) if regex.match(r"\p{L}", c) else 0
    codes = [0]
    for c in text.lower():
        s = symbol(c)
        if s or codes[-1]:
            codes.append(s)
    if codes[-1]:
        codes.append(0)
    out = np.zeros(dimensions)
    for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
        out += np.roll(own[a], 2) * np.roll(own[b], 1) * own[c]
    return out


def test_bundles_match_the_definition():
    texts = ["Hello, World", "ñandú é  x", "", "12"]
    profiles = np.stack([slow_bundle("hello there", 64, 7), slow_bundle("otra cosa", 64, 7)])
    profiles /= np.linalg.norm(profiles, axis=1)[:, None]
    letters, near = op3_language_id.cosines(texts, profiles.astype(np.float32), 7)
    assert letters.tolist() == [True, True, False, False]
    for t, got in zip(texts[:2], near, strict=False):
        v = slow_bundle(t, 64, 7)
        assert got == pytest.approx(profiles @ v / np.linalg.norm(v), abs=1e-5)


def test_prototypes_bundle_all_learning_texts(spark):
    rows = [("one two", "en"), ("three", "en"), ("uno dos", "es"), (None, "en"), ("no language", None), ("", "es")]
    names, profiles = op3_language_id.learn(spark.createDataFrame(rows, "text string, lang string"), dimensions=64, seed=7)
    assert names == ["en", "es"]
    for name, own in zip(names, profiles, strict=True):
        v = sum(slow_bundle(t, 64, 7) for t, lang in rows if t and lang == name)
        assert own == pytest.approx(v / np.linalg.norm(v), abs=1e-5)


def test_language_edges(spark):
    docs = odd_rows(spark).withColumn("lang", F.when(F.col("doc_id") == 4, "en"))
    model = op3_language_id.learn(docs)
    rows = op3_language_id.identify(docs.select("doc_id", "text"), model).collect()
    assert sorted(r["lang_pred"] for r in rows) == ["en"] * 4 + ["und"] * 3
    whole = op3_language_id.identify(docs, model)
    assert whole.columns == ["doc_id", "text", "predicted", "row", "lang", "lang_pred", "score"] and all(isinstance(r["score"], float) for r in whole.collect())
    none = op3_language_id.learn(docs.limit(0))
    assert {r["lang_pred"] for r in op3_language_id.identify(docs.select("doc_id", "text"), none).collect()} == {"und"}


ALPHABET = ["a", "b", "s", "t", "re", "ve", "ll", "d", "'", " ", "  ", "\n", "\t", " ", "1", "²", "é", "中", "😀", "-", "_", "\x00", "’", "A", "́", "\x85", "​"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=25).map("".join), min_size=1, max_size=4))
def test_pretokens_match_the_pattern(texts):
    tokens, counts = pretokens.split(texts)
    tokens, at = tokens.to_pylist(), 0
    for t, n in zip(texts, counts, strict=True):
        assert tokens[at : at + n] == [*regex.findall(public_tokenizers.PATTERN, t), ""]
        at += n


def test_bpe_matches_tiktoken(spark, sf_dir):
    enc, texts = encoding(), {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op4_byte_bpe.op4_byte_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = enc.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


@pytest.mark.parametrize(("chunk", "overlap"), [(64, 16), (100, 30), (1000, 100)])
def test_bpe_chunks_stitch(spark, chunk, overlap):
    enc = encoding()
    texts = ["a" * 3000 + " bb  cc\n\n x" * 200, " " * 2000 + "z", "don't  stop\n" * 200 + "é " * 300, "", None]
    docs = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    rows = op4_byte_bpe.bpe_decode(op4_byte_bpe.bpe_encode(docs, RANKS, public_tokenizers.PATTERN, chunk=chunk, overlap=overlap), RANKS).collect()
    assert len(rows) == 6
    for r in rows:
        assert bytes(r["ids"]) == np.array(enc.encode_ordinary(texts[r["doc_id"]] or ""), "<u4").tobytes() and bytes(r["bytes"]) == (texts[r["doc_id"]] or "").encode()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 200), st.lists(st.sampled_from([" ", "\n", "\t", "\n\n", "\u3000", "a", "'", "re", "1", "-", "é"]), max_size=12).map("".join))
def test_cuts_keep_pretokens(shift, middle):
    """Any text around a chunk's start: pieces between shared boundaries have the pre-tokens of the whole."""
    chunk, overlap, pattern = 64, 32, regex.compile(public_tokenizers.PATTERN)
    text = ("word and " * 30)[:shift] + middle + "x y\n\nz " * 30
    starts = range(0, len(text), chunk)
    cuts = [0]
    for a in starts[1:]:
        tail = {a - chunk + e for e in op4_byte_bpe.boundaries(text[a - chunk : a + overlap], pattern) if e >= chunk}
        head = {a + e for e in op4_byte_bpe.boundaries(text[a : a + chunk + overlap], pattern) if e < overlap}
        if not tail & head:
            return
        cuts.append(min(tail & head))
    assert [t for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True) for t in pattern.findall(text[a:b])] == pattern.findall(text)


def test_bpe_white_space_at_every_offset(spark):
    enc = encoding()
    texts = ["ab " * n + gap + "cd ef'll gh\n\n" * 40 for n in range(15, 24) for gap in ("\n\nx", " \n y", "\t\t", "  ", "\n\n\n", "\u2003\u2003z")]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    for r in op4_byte_bpe.bpe_encode(docs, RANKS, public_tokenizers.PATTERN, chunk=64, overlap=32).collect():
        assert bytes(r["ids"]) == np.array(enc.encode_ordinary(texts[r["doc_id"]]), "<u4").tobytes()


def test_bpe_edges(spark):
    assert op4_byte_bpe.bpe_encode(odd_rows(spark), RANKS, public_tokenizers.PATTERN).count() == 7
    assert op4_byte_bpe.bpe_encode(odd_rows(spark).limit(0), RANKS, public_tokenizers.PATTERN).count() == 0


def test_articles_come_out_whole(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = op6_html_text.op6_html_text(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        h = pages[r["page_id"]]
        article = h[h.index("<article>") + 9 : h.rindex("</article>")]
        blocks = (" ".join(html_module.unescape(re.sub("</?b>", "", b)).split()) for b in re.split("</?(?:p|h1|br)>", article))
        assert r["text"] == " ".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("plain &amp; text", "plain & text"), ("<p>a<p>b", "a b"), ("<script>var x='</p>'</script><style>p{}</style>", ""),
        ("<main><h1>T</h1><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></main>", "T one two a b"),
        ("<article><p>Good text here</p><div class='comments'><p>I disagree</p></div><form><p>Mail</p></form><aside>x</aside></article><footer>f</footer>", "Good text here"),
        ("<body><div id=header><a href=/>Home</a></div><div class=content><h2>Title</h2><div><p>Some long text that goes on and on.</p></div></div><div class=cookie-notice>We use cookies</div></body>", "Title Some long text that goes on and on."),
        ("<article><p>a\n\t b<b>c</b></p><!-- no --><p>d<br>e</p></article>", "a bc d e"),
        ("<body><div class='content no-sidebar'><p>The text of this page, which is rather long.</p><p>And more of it.</p></div><div>x</div></body>", "The text of this page, which is rather long. And more of it."),
        ("<article><p>A paragraph of some length in the article.</p><p class='share'>Another one, as long as the first paragraph is.</p><p>The third is about as long as the two before.</p><p class='share'>Share!</p><div class='share'><a href=/>Post</a> <a href=/>Send</a></div></article>", "A paragraph of some length in the article. Another one, as long as the first paragraph is. The third is about as long as the two before."),
        ("<article><p>A paragraph of some length in the article.</p><p>And one more of such a length, to make a cluster.</p><ul><li><a href=/1>one</a></li><li><a href=/2>two</a></li><li><a href=/3>three</a></li></ul></article>", "A paragraph of some length in the article. And one more of such a length, to make a cluster."),
        ("<div id='share'><p>All that there is to read stands in an element with such a name.</p></div><p>x</p>", "All that there is to read stands in an element with such a name."),
        ("<div class=top-nav><a href=/>A</a><a href=/b>B</a></div><div><div><p>Text without any telling name around it, sentence after sentence.</p><p>So it goes on for a while.</p></div><div class='comment-list'><p>A reader says that this is wrong.</p></div></div>", "Text without any telling name around it, sentence after sentence. So it goes on for a while."),
    ],
)
def test_pages(html, text):
    assert op6_html_text.main_text(html) == text


@pytest.mark.parametrize("piece", ["<div>word ", "<b>word ", "<p><b>word ", "<div class=ad>word ", "<li>word ", "</i><span>word "])
def test_deep_pages_take_linear_time(piece):
    began = time.thread_time()
    small = op6_html_text.main_text(piece * 5_000)
    middle = time.thread_time()
    large = op6_html_text.main_text(piece * 50_000)
    assert len(large) >= len(small) and time.thread_time() - middle < 40 * (middle - began) + 2


def test_page_rows(spark):
    rows = spark.createDataFrame([(1, None, None, "x"), (1, None, None, "x"), (None, "u", "<p>a</p>" * 5000, "x")], "page_id long, url string, html string, text string")
    got = op6_html_text.extract(rows).collect()
    assert sorted(len(r["text"]) for r in got) == [0, 0, 9999] and op6_html_text.extract(rows.limit(0)).count() == 0


def test_shards_hold_what_the_library_encodes(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer, start = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0
    rows = sorted(op9_sstable.op9_sstable(spark, sf_dir).collect())
    for r, doc in zip(rows, sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect()), strict=True):
        ids = [*tokenizer.encode(doc["text"], add_special_tokens=False).ids, 2]
        assert tuple(r) == (doc["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_shards_read_special_tokens_and_odd_rows(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "plain", "<|endoftext|><|endoftext|>x", "<|endoftext", "word " * 60_000, "", None]
    docs = spark.createDataFrame([(i % 3, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, path string, tokens int")
    for bytes_of_shard in (op9_sstable.SHARD, 64):
        rows = op9_sstable.read_shards(op9_sstable.write_shards(docs, path, 2, shard=bytes_of_shard)).collect()
        want = sorted((i % 3, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in enumerate(texts))
        assert sorted((r["doc_id"], bytes(r["ids"])) for r in rows) == want
        at = 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["n_tokens"]
        assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])] == sorted(r["doc_id"] for r in rows)


def test_shard_lookups(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i * 3 - 50, f"text {i} " * (i % 40)) for i in range(600)] + [(None, "x"), (7, None), (7, "again")], "doc_id long, text string")
    manifest = op9_sstable.write_shards(docs, path, 2)
    assert op9_sstable.read_shards(manifest).count() == 603
    shards = [op9_sstable.Shard(r["path"]) for r in manifest.collect()]
    find = lambda k: [x for x in (s.lookup(k) for s in shards) if x is not None]
    assert len(find(-50)) == 1 and len(find(None)) == 1 and len(find(7)) == 1 and not find(8) and not find(10**9)
    assert op9_sstable.read_shards(op9_sstable.write_shards(docs.limit(0), path, 2)).count() == 0
