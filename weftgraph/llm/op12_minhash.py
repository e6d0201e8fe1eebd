"""Circulant MinHash: near-duplicates by Jaccard similarity of word shingles.

Two permutations of the 64-bit numbers make the whole signature. SIGMA scatters
a shingle's hash once; PI is shifted circularly by k for coordinate k, which is
the least PI(SIGMA(x) - k) over the set's shingles x. Both are products with odd
numbers and xor-shifts, so they are one to one. The 200 coordinates form 40 bands
of 5; sets that share a band are candidates, and every link is confirmed on the
full sets of shingles. Two sets at a similarity of 0.8 share no band once in 8
million pairs, more similar ones less often; no other step can lose a link.

Sets, not documents, are compared: documents with one set (its 128-bit XXH3) are
one node. Work inside a band's group of n sets does not make n * n pairs:

1. Each set is tied to the least one of each of its groups (its pivots). What
   hangs together by these ties, verified or not, is a neighbourhood.
2. Neighbourhoods of more than a block of sets are contracted first: each set is
   compared with its pivots, which cuts the neighbourhood into verified parts.
3. Its sets go to blocks: those of a neighbourhood's largest part to blocks of their
   own, all others sorted by part. Pairs of blocks whose sets share a band are
   cells; pairs of blocks of the largest part are none, as their sets are linked
   already. In a cell, sets that share a band, are of fitting size and are not yet
   linked are compared exactly; a cell returns a forest of its links. What is left
   of the square is (sets outside the largest part) times (blocks that share a
   band with them): sets that meet in many bands and yet stay under the threshold.

Components come from repeated star contraction of the links (``components``).

Words: lower-case A-Z, runs without ASCII white space; 4-word shingles, a text of
fewer words is one shingle. A shingle stands for its XXH64: two different
shingles of a pair of documents with one hash would count as one.

Defined cases: null texts and texts without words have the empty set, which links
with nothing, not even with itself. Each row gives one row. A null doc_id is
never a component's name unless the component has no other; ``kept`` is then
false. Rows that repeat a doc_id are judged by their own texts. Other columns
are ignored. No rows give no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import bounded_batches, bounded_broadcast, joined_by, table, written
from weftgraph.llm.op5_simhash import components, shingles

WIDTH, PERCENT = 4, 80
BANDS, ROWS = 40, 5
SETS, BLOCK_SHINGLES = 1_024, 1_000_000
BROADCAST_ROWS = 500_000
_SLICE = 256
# Odd factors of the two permutations and of the bands' keys: any odd numbers will do.
_DRAWN = np.random.default_rng(12).integers(0, 1 << 64, 4 + ROWS, np.uint64) | np.uint64(1)


def _permuted(x: np.ndarray, first: np.uint64, second: np.uint64) -> np.ndarray:
    """A permutation of the 64-bit numbers: each step can be undone."""
    x = x * first
    x ^= x >> np.uint64(31)
    x *= second
    x ^= x >> np.uint64(29)
    return x


def signature(own: np.ndarray, coordinates: int = BANDS * ROWS) -> np.ndarray:
    """The circulant signature of a set of hashes that is not empty."""
    shift = np.arange(1, coordinates + 1, dtype=np.uint64)
    least = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), _SLICE):
        scattered = _permuted(own[at : at + _SLICE], *_DRAWN[:2])
        least = np.minimum(least, _permuted(scattered[:, None] - shift, *_DRAWN[2:4]).min(axis=0))
    return least


def bands(own: np.ndarray) -> np.ndarray:
    """One key for each band; none for the empty set."""
    if not len(own):
        return np.zeros(0, np.int64)
    mixed = (signature(own).reshape(BANDS, ROWS) * _DRAWN[4:]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    return (mixed ^ (mixed >> np.uint64(32))).view(np.int64)


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, n_shingles, sig, bands, shingles): the set's size, identity, bands and sorted hashes; written, with ``row`` to tell rows apart."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, width) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("k"), pa.array([len(x) for x in sets], pa.int64()), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary()),
                    pa.array([bands(x) for x in sets], pa.list_(pa.int64())), pa.array([x.tobytes() for x in sets], pa.binary()),
                ],
                ["k", "n_shingles", "sig", "bands", "shingles"],
            )

    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    made = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).mapInArrow(make, f"k {kind}, n_shingles long, sig binary, bands array<long>, shingles binary")
    return written(made.withColumnRenamed("k", key).withColumn("row", F.monotonically_increasing_id()), "sketches")


def _links_of_cells(percent: int):
    """Rows (cell, node, part, left, right, bands, shingles) sorted by cell: links between its left and its right sets."""

    def compare(rows: list[dict]) -> list[tuple[int, int]]:
        rows = sorted({r["node"]: r for r in sorted(rows, key=lambda r: r["left"])}.values(), key=lambda r: len(r["shingles"]))
        sets = [np.frombuffer(r["shingles"], np.uint64) for r in rows]
        places = np.split(np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum([len(x) for x in sets])[:-1])
        size = np.array([len(x) for x in sets])
        keys = np.array([r["bands"] for r in rows], np.int64)
        part, linked = np.array([r["part"] for r in rows], np.int64), []
        is_left, is_right = (np.array([r[c] for r in rows]) for c in ("left", "right"))
        mark = np.zeros(max(int(p.max()) for p in places) + 1, np.int64)
        for n in np.flatnonzero(is_left).tolist():
            low, high = np.searchsorted(size * 100, size[n] * percent), np.searchsorted(size * percent, size[n] * 100, side="right")
            met = low + np.flatnonzero(is_right[low:high] & (part[low:high] != part[n]) & (keys[low:high] == keys[n]).any(axis=1))
            if not len(met):
                continue
            mark[places[n]] = 1
            both = np.add.reduceat(mark[np.concatenate([places[m] for m in met])], np.cumsum(size[met]) - size[met])
            mark[places[n]] = 0
            for m in met[100 * both >= percent * (size[n] + size[met] - both)].tolist():
                if part[m] != part[n]:
                    linked.append((rows[n]["node"], rows[m]["node"]))
                    part[part == part[m]] = part[n]
        return linked

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        for _, cell in itertools.groupby(rows, key=lambda r: r["cell"]):
            found = compare(list(cell))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], ["a", "b"])

    return link


def _linked(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: links found in cells (cell, node, part, left, right)."""
    spark = cells.sparkSession
    # Cells are narrow, sets are not: up to the bound the sets are not shuffled for this join.
    bounded = sets.join(bounded_broadcast(written(cells, "cells"), BROADCAST_ROWS), "node").select("cell", "node", "part", "left", "right", "bands", "shingles")
    limit = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    bounded_batches(spark)
    found = written(bounded.repartition("cell").sortWithinPartitions("cell").mapInArrow(_links_of_cells(percent), "a long, b long").distinct(), "links")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", limit)
    return found


def set_links(own: DataFrame, sets: DataFrame, percent: int = PERCENT, block: int = SETS) -> DataFrame:
    """(a, b), a < b: links that span every group of similar sets; own: (node, n_shingles, bands), one row for each set that is not empty; sets: (node, bands, shingles) of these nodes, others are ignored."""
    posted = own.select("node", F.explode("bands").alias("band"))
    groups = written(posted.groupBy("band").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1"), "bands")
    met = written(joined_by(posted, groups, "band", "n"), "met")  # sets that share a band with another one
    ties = written(met.where("pivot < node").select("pivot", "node").distinct(), "ties")
    homes = written(components(ties.select(F.col("pivot").alias("a"), F.col("node").alias("b"))).select("node", F.col("root").alias("home")).distinct(), "homes")
    known = written(homes.join(own.select("node", "n_shingles"), "node"), "known")
    blocks_of = F.ceil(F.greatest(F.col("n") / block, F.col("total") / BLOCK_SHINGLES)).cast("int")
    sized = written(known.groupBy("home").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total")).withColumn("blocks", blocks_of), "homes")
    homed = written(joined_by(known, sized, "home", "n"), "homed")

    # Small neighbourhoods are one cell.
    whole = homed.where("blocks = 1").select(F.col("home").alias("cell"), "node", F.col("node").alias("part"), F.lit(True).alias("left"), F.lit(True).alias("right"))
    found = _linked(whole, sets, percent)
    large = homed.where("blocks > 1").select("node", "home", "blocks")
    if not large.limit(1).count():
        return found
    sets = written(sets.join(bounded_broadcast(large.select("node"), BROADCAST_ROWS), "node", "left_semi"), "large-sets")

    # Large ones: each set against its pivots, in blocks of a pivot's sets.
    pivots = ties.join(bounded_broadcast(large.select("node"), BROADCAST_ROWS), "node")
    tied = written(pivots.groupBy("pivot").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), "pivots")
    one = lambda b: F.xxhash64(F.lit("pivot"), "pivot", b).alias("cell")
    others = joined_by(pivots, tied, "pivot", "n").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))) if tied.limit(1).count() else None
    against = others.select(one(F.col("block")), "node", F.lit(False).alias("left"), F.lit(True).alias("right")).unionByName(
        tied.select("pivot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - F.lit(1).cast("long"))).alias("block")).select(one(F.col("block")), F.col("pivot").alias("node"), F.lit(True).alias("left"), F.lit(False).alias("right"))
    )
    tested = _linked(against.withColumn("part", F.col("node")), sets, percent)
    found = found.unionByName(tested)

    # What is verified by now, and the largest part of each neighbourhood.
    parts = written(large.join(components(tested).select("node", F.col("root").alias("part")).distinct(), "node", "left").withColumn("part", F.coalesce("part", "node")), "parts")
    main = parts.groupBy("home", "part").agg(F.count("*").alias("n")).groupBy("home").agg(F.max_by("part", F.struct("n", "part")).alias("main"))
    cut = parts.join(bounded_broadcast(written(main, "main"), BROADCAST_ROWS), "home")
    is_main = F.col("part") == F.col("main")
    # Sets of one part stay together unless the part is larger than a block.
    dealt = written(cut.select("node", "home", "part", is_main.alias("main"), F.when(is_main, F.pmod(F.xxhash64("node"), F.col("blocks"))).otherwise(F.col("blocks") + F.pmod(F.xxhash64("part"), F.col("blocks"))).alias("block")), "dealt")
    rest = dealt.where(~F.col("main"))
    fat = written(rest.groupBy("home", "block").agg(F.count("*").alias("in_block")).withColumn("slices", F.ceil(F.col("in_block") / block).cast("int")), "fat")
    sliced = rest.join(bounded_broadcast(fat, BROADCAST_ROWS), ["home", "block"]).withColumn("block", F.xxhash64("block", F.pmod(F.xxhash64("node", F.lit("slice")), F.col("slices"))))
    placed = written(dealt.where("main").unionByName(sliced.select(*dealt.columns)), "placed")
    # Cells: pairs of blocks that share a band whose sets are in several parts.
    seen = written(met.select("node", "band").join(bounded_broadcast(placed, BROADCAST_ROWS), "node"), "seen")
    mixed = seen.groupBy("band").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p < q").select("band")
    here = written(seen.join(bounded_broadcast(written(mixed, "mixed"), BROADCAST_ROWS), "band").select("band", "home", "block", "main").distinct(), "here")
    right = here.select("band", F.col("block").alias("other"), F.col("main").alias("other_main"))
    pairs = here.where(~F.col("main")).join(right, "band").where("other_main or block <= other").select("home", "block", "other").distinct()
    cells = written(pairs.withColumn("cell", F.xxhash64("home", "block", "other")), "pairs")
    lefts = cells.select("cell", "home", "block", F.lit(True).alias("left"), (F.col("block") == F.col("other")).alias("right"))
    rights = cells.where("block <> other").select("cell", "home", F.col("other").alias("block"), F.lit(False).alias("left"), F.lit(True).alias("right"))
    members = placed.select("node", "home", "part", "block").join(lefts.unionByName(rights), ["home", "block"]).select("cell", "node", "part", "left", "right")
    return found.unionByName(_linked(members, sets, percent))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, block: int = SETS) -> DataFrame:
    """(key, n_shingles, component_id): component_id is the smallest key in reach, the row's own included."""
    own = sketches(docs, key, text, width)
    full = own.where("n_shingles > 0")
    # Copies of one set are one node, named by the least of their rows.
    distinct = written(full.groupBy("sig").agg(F.min(F.struct("row", "n_shingles", "bands")).alias("least"), F.min(key).alias("low"), F.count("*").alias("n")).select("sig", "low", "n", F.col("least.row").alias("node"), "least.n_shingles", "least.bands"), "distinct")
    sets = full.select(F.col("row").alias("node"), "bands", "shingles")
    reach = components(set_links(distinct.select("node", "n_shingles", "bands"), sets, percent, block).distinct()).select("node", "root").distinct()
    rooted = written(distinct.select("sig", "low", "n", "node").join(reach, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    names = written(rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("of_root")), "names")
    named = written(joined_by(rooted, names, "root", "of_root").select("sig", "component_id", "n"), "named")
    linked = joined_by(full.select(key, "n_shingles", "sig"), named, "sig", "n").select(key, "n_shingles", "component_id")
    return linked.unionByName(own.where("n_shingles = 0").select(key, "n_shingles", F.col(key).alias("component_id")))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


ORACLES = {
    "op12_minhash": rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + {WIDTH - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - {WIDTH - 2}))) AS p FROM d WHERE len(w) > 0)),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM i JOIN z a ON a.doc_id = x JOIN z b ON b.doc_id = y WHERE 100 * common >= {PERCENT} * (a.n + b.n - common)),
l AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(doc_id, other) AS (SELECT x, y FROM l UNION SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.other)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id, d.doc_id <= coalesce(m.low, d.doc_id) AS kept
FROM d LEFT JOIN z USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS low FROM r GROUP BY doc_id) m USING (doc_id)""",
}
