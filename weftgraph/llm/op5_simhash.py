"""SimHash near-duplicates through an inverted index over byte positions, with count filtering.

The eight bytes of a fingerprint are its positional features. Fingerprints that
differ in at most ``bits`` bits share at least ``8 - bits`` of them (the
guaranteed minimum; 4 for 4 bits). Instead of posting lists of single bytes,
which grow with the square of the input, the index holds triples of positions
with their three bytes: by the design in ``triples`` any four positions contain
one of the twenty triples, so every linked pair meets in at least one posting
list of a 24-bit key. Within a list the shared positional bytes of each pair are
tallied, pairs that reach the minimum are kept, and their bits are compared.

Equal fingerprints are one entry. A posting list emits, of the links found, only
a forest that connects the same fingerprints, never all pairs. A list longer than ``BLOCK`` is dealt in
pairs of blocks, so no task holds it whole and no link is lost. Components come
from repeated star contraction of the links, with a written table for each round.
Names are joined back without a shuffle for fingerprints and components that hold
more than a thousandth of the rows (at most a thousand of them are broadcast).

Fingerprint: lower-case A-Z, words between ASCII white space, ``width``-word
shingles with repeats (fewer words: the whole sequence), XXH64 with seed 42; a
bit is set if it is in over half of the hashes. No words: fingerprint zero,
which links like any other.

With ``similarity``, texts whose sets of five-word shingles have that Jaccard
similarity link too, whatever their fingerprints' distance. Their sets meet in an
index of ``BANDS`` bands of ``ROWS`` minimum hashes; all sets in reach of each
other there are compared by their whole sets, in pairs of blocks. A pair of
similarity 0.8 misses every band once in 8 million; more similar ones less often.

Defined cases: null text counts as empty. Each input row gives one output row;
rows that repeat a key keep the same component only if their fingerprints link.
A null key is never a component's name unless the component has no other.
Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import bounded_batches, bounded_broadcast, joined_by, written

WIDTH, BITS, SEED = 4, 4, 42
BLOCK = 2_048
PAIRS = 2_000_000
GATHER = 65_536
# Of the index of shingle sets; the least similarity that it is made for; sets in a block.
SHINGLE, BANDS, ROWS, LEAST, SETS = 5, 40, 5, 0.8, 256
BROADCAST_ROWS = 1_000_000
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS + ROWS), np.uint64)
_XOR, _TIMES = _DRAWN[0], _DRAWN[1] | np.uint64(1)


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) <= width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - width + 1
    digest = xxhash.xxh64_intdigest
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[at : min(n, at + 65_536)].tolist(), ends[at + width - 1 :].tolist(), strict=False)), np.uint64)
        set_bits += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(set_bits * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, print): the fingerprint as a signed long."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(t, width) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(made.view(np.int64))], ["k", "print"])

    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("text")).mapInArrow(make, f"k {kind}, print long").withColumnRenamed("k", key)


def triples() -> list[tuple[int, int, int]]:
    """Twenty triples of the eight positions, of which every four positions contain one.

    Turan's construction: three groups in a ring; triples inside a group, and those with two positions in one group and one in the next.
    """
    groups = [(0, 1, 2), (3, 4, 5), (6, 7)]
    made = [t for g in groups for t in itertools.combinations(g, 3)]
    for at, group in enumerate(groups):
        made += [tuple(sorted((*two, one))) for two in itertools.combinations(group, 2) for one in groups[(at + 1) % 3]]
    return sorted(made)


def _spanning(prints: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Each linked fingerprint with the first of those it reaches through these index pairs."""
    if not pairs.size:
        return np.zeros((0, 2), np.int64)
    nodes, place = np.unique(pairs, return_inverse=True)
    place = place.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, place[0], before[place[1]])
        np.minimum.at(label, place[1], before[place[0]])
        label = label[label]
        if (label == before).all():
            break
    far = np.flatnonzero(label != np.arange(len(nodes)))
    return np.stack([prints[nodes[label[far]]], prints[nodes[far]]], axis=1).view(np.int64)


def _forest(prints: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int, least: int) -> np.ndarray:
    """Each linked fingerprint with the first of those it reaches through the links among these candidate index pairs."""
    ends = []
    for at in range(0, len(a), PAIRS):
        x, y = a[at : at + PAIRS], b[at : at + PAIRS]
        differ = prints[x] ^ prints[y]
        shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1, dtype=np.uint8)  # the tally of positional bytes
        near = np.flatnonzero(shared >= least)
        near = near[np.bitwise_count(differ[near]) <= bits]
        ends.append(np.stack([x[near], y[near]]))
    return _spanning(prints, np.concatenate(ends, axis=1) if ends else np.zeros((2, 0), np.int64))


def _run_pairs(size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows of these sizes: (runs, first index, second index) of all pairs inside each, PAIRS or one run at a time; indices count from the run's start."""
    for n in np.unique(size[size > 1]).tolist():
        i, j = np.triu_indices(n, 1)
        own = np.flatnonzero(size == n)
        step = max(1, PAIRS // len(i))
        for at in range(0, len(own), step):
            yield own[at : at + step], i, j


def _links_of_lists(bits: int, least: int):
    """Rows (list, print) sorted by list; links of each list."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held_key = np.concatenate([held_key, batch.column("list").to_numpy(zero_copy_only=False)])
                held = np.concatenate([held, batch.column("print").to_numpy(zero_copy_only=False).view(np.uint64)])
                if len(held_key) < GATHER:
                    continue
                whole = int(np.searchsorted(held_key, held_key[-1]))  # the last list may go on
            else:
                whole = len(held_key)
            keys, prints = held_key[:whole], held[:whole]
            held_key, held = held_key[whole:], held[whole:]
            if not whole:
                continue
            begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            size = np.diff(np.append(begin, whole))
            for runs, i, j in _run_pairs(size):
                found = _forest(prints, (begin[runs][:, None] + i).ravel(), (begin[runs][:, None] + j).ravel(), bits, least)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return link


def _links_of_cells(bits: int, least: int):
    """One pair of blocks of a long list: (left, right, same) as arrays of fingerprints."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                left, right = np.array(row["left"], np.int64).view(np.uint64), np.array(row["right"] or [], np.int64).view(np.uint64)
                both = np.concatenate([left, right])
                step = max(1, PAIRS // max(1, len(both)))
                for at in range(0, len(left), step):
                    rows = np.arange(at, min(len(left), at + step))
                    others = np.arange(len(left), len(both)) if row["right"] is not None else np.arange(len(left))
                    a, b = np.repeat(rows, len(others)), np.tile(others, len(rows))
                    if row["right"] is None:
                        a, b = a[a < b], b[a < b]
                    found = _forest(both, a, b, bits, least)
                    if len(found):
                        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return link


def links(prints: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: pairs of connected fingerprints (from column ``print``, without repeats) that span every component."""
    least = 8 - bits
    if least < 4:
        raise ValueError("the index guarantees four shared bytes: bits must be 4 or less")
    byte = [F.shiftrightunsigned("print", 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]
    lists = [F.lit(n).cast("long") * (1 << 24) + byte[x] * 65_536 + byte[y] * 256 + byte[z] for n, (x, y, z) in enumerate(triples())]
    posted = prints.select("print", F.explode(F.array(*lists)).alias("list"))
    sizes = posted.groupBy("list").agg(F.count("*").alias("size")).where(F.col("size") > block)  # at most 20 rows for each ``block`` fingerprints
    long = written(sizes, "long-lists")
    usual = (posted.join(long, "list", "left_anti") if long.limit(1).count() else posted).repartition("list").sortWithinPartitions("list")
    made = usual.mapInArrow(_links_of_lists(bits, least), "a long, b long")
    if long.limit(1).count():
        parts = posted.join(long, "list").withColumn("parts", F.ceil(F.col("size") / block).cast("int")).withColumn("part", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int"))
        # Cell (i, j), i <= j: a block goes to every cell of its row and column.
        cells = parts.select("list", "print", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select(
            "list", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), (F.col("part") <= F.col("other")).alias("is_left"), "print"
        )
        dealt = cells.groupBy("list", "i", "j").agg(
            F.collect_list(F.when(F.col("is_left"), F.col("print"))).alias("left"), F.when(F.col("i") < F.col("j"), F.collect_list(F.when(~F.col("is_left"), F.col("print")))).alias("right")
        )
        made = made.unionByName(dealt.select("left", "right").mapInArrow(_links_of_cells(bits, least), "a long, b long"))
    return made.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The set of the text's shingles as sorted hashes; fewer words than ``width`` are one shingle."""
    words = (text or "").encode().lower().split()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[at : at + width]), SEED) for at in range(max(1, len(words) - width + 1) if words else 0)), np.uint64))


def bands(own: np.ndarray) -> np.ndarray:
    """The set's place in each band."""
    if not len(own):
        return np.zeros(0, np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 4_096):
        low = np.minimum(low, ((own[at : at + 4_096, None] ^ _XOR[:-ROWS]) * _TIMES[:-ROWS]).min(axis=0))
    mixed = (low.reshape(BANDS, ROWS) * _TIMES[-ROWS:]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    return ((mixed ^ (mixed >> np.uint64(32))) * _TIMES[0]).view(np.int64)


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, print, sig, bands): the fingerprint, a hash of the shingle set, its bands."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            prints = np.fromiter((fingerprint(t, width) for t in texts), np.uint64, len(texts)).view(np.int64)
            sets = [shingles(t) for t in texts]
            sigs = np.fromiter((xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets), np.uint64, len(sets)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("k"), pa.array(prints), pa.array(sigs), pa.array([bands(x) for x in sets], pa.list_(pa.int64()))], ["k", "print", "sig", "bands"]
            )

    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("k"), F.col(text).alias("text")).mapInArrow(make, f"k {kind}, print long, sig long, bands array<long>").withColumnRenamed("k", key)


def _with_sets(chosen: DataFrame) -> DataFrame:
    """chosen (sig, print, root, parts, text) with the text's set made again; rows of a repeated key whose text is another one go."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t).tobytes() for t in batch.column("text").to_pylist()]
            signs = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in sets), np.uint64, len(sets)).view(np.int64)
            own = pa.array(signs == batch.column("sig").to_numpy(zero_copy_only=False))
            columns = ["sig", "print", "root", "parts"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sets, pa.binary())], [*columns, "shingles"]).filter(own)

    return chosen.mapInArrow(make, "sig long, print long, root long, parts int, shingles binary")


def _links_of_sets(similarity: float):
    """Rows (cell, same, is_left, print, shingles) sorted by cell, which is a pair of blocks; links of each cell."""

    def compare(rows: list[dict]) -> np.ndarray:
        rows = sorted(rows, key=lambda r: len(r["shingles"]))
        sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
        prints = np.array([r["print"] for r in rows], np.int64).view(np.uint64)
        same = rows[0]["same"]
        right = [n for n, r in enumerate(rows) if same or not r["is_left"]]
        names, flat = np.unique(np.concatenate(sets), return_inverse=True)
        parts = np.split(flat, np.cumsum([len(x) for x in sets])[:-1])
        size = np.array([len(sets[n]) for n in right])
        ends = np.concatenate([[0], np.cumsum(size)])
        others = np.concatenate([parts[n] for n in right]) if right else flat[:0]
        mark, right, pairs = np.zeros(len(names), np.int32), np.array(right, np.int64), []
        for n, row in enumerate(rows):
            own = len(sets[n])
            low, high = np.searchsorted(size, [own * similarity - 1e-9, own / similarity + 1e-9])
            if not row["is_left"] or low == high:
                continue
            mark[parts[n]] = 1
            both = np.add.reduceat(mark[others[ends[low] : ends[high]]], ends[low:high] - ends[low])
            mark[parts[n]] = 0
            near = right[low + np.flatnonzero(both >= similarity * (own + size[low:high] - both) - 1e-9)]
            near = near[prints[near] != prints[n]]
            pairs.append(np.stack([np.full(len(near), n), near]))
        return _spanning(prints, np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        for _, cell in itertools.groupby(rows, key=lambda r: r["cell"]):
            found = compare(list(cell))
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return link


def set_links(own: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = LEAST, block: int = SETS) -> DataFrame:
    """(a, b), a < b: fingerprints of texts (own: ``sketches`` of docs, written) whose shingle sets are that similar; they span every group of these. Sets are made again, for one text each, where they meet another one."""
    if similarity < LEAST:
        raise ValueError(f"the bands are made for a similarity of {LEAST} or more")
    posted = own.select("sig", "bands").dropDuplicates(["sig"]).select("sig", F.explode("bands").alias("list"))
    lows = posted.groupBy("list").agg(F.min("sig").alias("low"), F.max("sig").alias("high")).where("low < high").select("list", "low")
    reach = written(components(posted.join(lows, "list").where("low < sig").select(F.col("low").alias("a"), F.col("sig").alias("b")).distinct()).select(F.col("node").alias("sig"), "root").distinct(), "reach")
    counted = reach.groupBy("root").agg(F.count("*").alias("size")).withColumn("parts", F.ceil(F.col("size") / block).cast("int"))
    named = written(reach.join(counted, "root").select("sig", "root", "parts"), "reach")
    first = written(own.groupBy("sig", "print").agg(F.min(key).alias("_k")).join(named, "sig").select("_k", "sig", "print", "root", "parts"), "chosen")
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("text"))
    sets = _with_sets(texts.join(bounded_broadcast(first, BROADCAST_ROWS), F.col("_key").eqNullSafe(F.col("_k"))).select("sig", "print", "root", "parts", "text"))
    parts = sets.withColumn("part", F.pmod(F.xxhash64("sig"), F.col("parts")).cast("int"))
    # Cell (i, j), i <= j: a block goes to every cell of its row and column.
    cells = parts.select("root", "part", "print", "shingles", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select(
        F.xxhash64("root", F.least("part", "other"), F.greatest("part", "other")).alias("cell"), (F.col("part") == F.col("other")).alias("same"), (F.col("part") <= F.col("other")).alias("is_left"), "print", "shingles"
    )
    made = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(_links_of_sets(similarity), "a long, b long")
    return made.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each linked node (columns a < b) reaches, by alternating large and small stars."""
    now = written(edges, "links")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()  # a > b
        down = large.groupBy("a").agg(F.min("b").alias("low"))
        star = large.join(down, "a")
        small = star.where(F.col("b") != F.col("low")).select(F.col("b").alias("a"), "low").unionByName(down.select("a", "low"))
        after = written(small.select(F.col("low").alias("a"), F.col("a").alias("b")).where("a < b").distinct(), "links")
        if not after.join(now, ["a", "b"], "left_anti").limit(1).count() and after.count() == now.count():
            return after.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(after.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        now = after


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, bits: int = BITS, similarity: float | None = None) -> DataFrame:
    """(key, print, component_id): component_id is the smallest key in reach; with ``similarity`` through similar shingle sets too."""
    own = written(fingerprints(docs, key, text, width) if similarity is None else sketches(docs, key, text, width), "prints")
    distinct = written(own.groupBy("print").agg(F.min(key).alias("low"), F.count("*").alias("n")), "distinct")
    found = links(distinct.select("print"), bits)
    if similarity is not None:
        found = found.unionByName(set_links(own, docs, key, text, similarity)).distinct()
    reach = components(found).withColumnRenamed("node", "print")
    rooted = written(distinct.join(reach, "print", "left").withColumn("root", F.coalesce("root", "print")), "rooted")
    names = written(rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("of_root")), "names")
    named = written(joined_by(rooted, names, "root", "of_root").select("print", "component_id", "n"), "named")
    return joined_by(own.select(key, "print"), named, "print", "n").select(key, "print", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
