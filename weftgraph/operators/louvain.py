"""Communities by modularity: local moving, contraction, splitting; each step a join over all graphs at once.

A *scope* is a graph of its own with its own total weight. Detection runs over all
scopes of a table together: the first pass has one scope, the pass that splits
large communities has one for each of them.

Local moving: each round scores every node's stay and its moves to neighbouring
communities in one pass, then lets half of the movers go (by a hash of name and
round, so neighbours do not swap). The same pass measures the modularity of the
state it started from; a state that is worse than the one before it is taken
back and fewer nodes move. Contraction: a community becomes one node, weights
between communities are summed, those inside become its loop. Levels end when
nothing merges any more. Names decide ties, so results do not depend on partitioning.

``communities`` works on the ranks of names. Where the nodes were counted to be at
most ``BROADCAST_NODES``, links lie in blocks of arrays, each with all links of its
nodes: a round sends two numbers of each node to all tasks, a task scores a block at
a time, and only the nodes that want to move and a sum come back; the driver holds a
few numbers of each node and no link. Beyond that bound the links lie in buckets of
their first end and each round is joins of tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.functions import text as T
from weftgraph.operators import metrics as M
from weftgraph.operators.graph import Graph, prune_dangling
from weftgraph.session import bounded_broadcast, shared_dir, written

# A community is split if it is larger than this share of all nodes (and than LEAST), or large and loose.
SHARE, LEAST, LOOSE, LOOSE_SIZE = 0.25, 10, 0.05, 50
ROUNDS, LEVELS, LESS = 10, 10, 3
SMALL = 1e-9
BROADCAST_NODES = 8_000_000
BLOCK_LINKS = 1_000_000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@dataclass
class Detected:
    """members: (scope, id, community), a community named by its least member; modularity: the sum over scopes after each level."""

    members: DataFrame
    modularity: list[float] = field(default_factory=list)


def simple_links(nodes: DataFrame, near: DataFrame, ranks: DataFrame | None = None) -> DataFrame:
    """(a, b, w): links between nodes that are no sources, each way, from (id, neighbor) and maybe a weight ``w``. ranks (id, rank) of all those nodes: the ends are ranks, looked up before links move."""
    w = F.sum("w") if "w" in near.columns else F.lit(1.0)
    if ranks is None:
        own = bounded_broadcast(nodes.where("type <> 'source'").select("id"), BROADCAST_NODES // 4)
        linked = near.where("id <> neighbor").join(own, "id", "left_semi").join(own.withColumnRenamed("id", "neighbor"), "neighbor", "left_semi").withColumnsRenamed({"id": "a", "neighbor": "b"})
    else:
        end = bounded_broadcast(ranks, BROADCAST_NODES // 4)
        end = lambda c, name, end=end: end.select(F.col("id").alias(c), F.col("rank").alias(name))
        linked = near.where("id <> neighbor").join(end("id", "a"), "id").join(end("neighbor", "b"), "neighbor")
    return linked.groupBy("a", "b").agg(w.cast("double").alias("w"))


def auto_resolution(nodes: int, edges: int) -> float:
    """Small and thin graphs get fewer, larger communities."""
    return 0.5 if nodes <= 20 else 0.8 if edges / max(1, nodes) < 2 else 1.0


def _ranked(ids: DataFrame) -> DataFrame:
    """(id, rank): the places of distinct ids in the order of names, from 0; written."""
    placed = written(ids.orderBy("id").withColumn("_at", F.monotonically_increasing_id()), "placed")  # the range of names, and the place within it
    part = F.shiftright("_at", 33).alias("_part")
    offsets = placed.groupBy(part).agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("_part")) - F.col("n"))  # one row a range
    return written(placed.select("id", "_at", part).join(F.broadcast(offsets), "_part").select("id", (F.col("before") + F.col("_at").bitwiseAND(2**33 - 1)).alias("rank")), "ranks")


def _bucketed(links: DataFrame) -> DataFrame:
    """links (a, b, w) as a table in buckets of a: what is grouped by a needs no shuffle."""
    spark, name = links.sparkSession, f"weft_links_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links.repartition(buckets, "a").write.bucketBy(buckets, "a").sortBy("a").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def _scored(state: DataFrame, links: DataFrame, resolution: float, few: bool) -> DataFrame:
    """state (scope, node, comm, k, loop, m2) with the best community ``to``, its advantage over staying, and the weight of links into the own one; written. With few nodes, theirs are sent to all tasks."""
    side = F.broadcast if few else (lambda df: df)
    total = side(state.groupBy("comm").agg(F.sum("k").alias("total")))
    ties = links.join(side(state.select(F.col("node").alias("b"), F.col("comm").alias("to"))), "b").groupBy(F.col("a").alias("node"), "to").agg(F.sum("w").alias("w"))
    cost = lambda others: F.when(F.col("m2") > 0, resolution * F.col("k") * others / F.col("m2")).otherwise(0.0)
    both = ties.join(state.select("node", "comm", "k", "m2"), "node").join(total.withColumnRenamed("comm", "to"), "to")
    here, gain = F.col("to") == F.col("comm"), F.col("w") - cost(F.col("total"))
    best = both.select("node", "w", here.alias("here"), F.when(~here, F.col("to")).alias("to"), F.when(~here, gain).alias("gain")).groupBy("node").agg(
        F.min_by("to", F.when(~F.col("here"), F.struct(-F.round("gain", 9), "to"))).alias("to"), F.max("gain").alias("gain"), F.max(F.when(F.col("here"), F.col("w"))).alias("inner")
    )
    inner = F.coalesce("inner", F.lit(0.0))
    moves = state.join(best, "node", "left").join(total, "comm").withColumn("more", F.col("gain") - (inner - cost(F.col("total") - F.col("k"))))
    return written(moves.select("scope", "node", "comm", "k", "loop", "m2", F.when(F.col("more") > SMALL, F.col("to")).alias("to"), "more", inner.alias("inner")), "moves")


def _measured(scored: DataFrame, resolution: float) -> tuple[float, int]:
    """(modularity over all scopes, how many nodes want to move)."""
    by = scored.groupBy("scope", "comm").agg(F.sum(F.col("inner") + F.col("loop")).alias("inner"), F.sum("k").alias("k"), F.first("m2").alias("m2"), F.count("to").alias("movers"))
    q = F.when(F.col("m2") > 0, F.col("inner") / F.col("m2") - resolution * (F.col("k") / F.col("m2")) ** 2).otherwise(0.0)
    row = by.agg(F.sum(q).alias("q"), F.sum("movers").alias("movers")).first()
    return row["q"] or 0.0, row["movers"] or 0


def _moved(scored: DataFrame, salt: int, less: int) -> DataFrame:
    """The state after one in 2 ** (less + 1) of the movers, by hash, went where they want."""
    goes = F.col("to").isNotNull() & (F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(2 << less)) == 0)
    return scored.select("scope", "node", F.when(goes, F.col("to")).otherwise(F.col("comm")).alias("comm"), "k", "loop", "m2")


@contextmanager
def _single_rows(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of one row for what runs meanwhile: a row is a block of links."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, "1")
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def _sums(key: np.ndarray, w: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the sum of w (None: of ones) of each."""
    if w is None:
        key = np.sort(key)
    else:
        order = np.argsort(key, kind="stable")
        key, w = key[order], w[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(first)
    return key[at], np.diff(at, append=len(key)).astype(np.float64) if w is None else np.add.reduceat(w, at) if len(at) else np.zeros(0)


def _blocks(links: DataFrame, k: np.ndarray, m2: np.ndarray) -> DataFrame:
    """links (a, b, w) of nodes 0, 1, ... as blocks of arrays, one row each; written. A block has all links of its nodes, their k and m2; w is null where all are one."""
    spark = links.sparkSession
    sent = spark.sparkContext.broadcast((k, m2))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[batch.column(c).to_numpy() for c in ("a", "b", "w")] for batch in batches if batch.num_rows]
        if not parts:
            return
        a, b, w = (np.concatenate(x) for x in zip(*parts, strict=True))
        key, weight = (a << 32) | b, None
        if (w == 1.0).all():
            key.sort()
        else:
            order = np.argsort(key)
            key, weight = key[order], w[order].tobytes()
        a = key >> 32
        begin = np.flatnonzero(np.diff(a, prepend=-1))
        node = a[begin]
        own = [node.astype(np.int32), sent.value[0][node], sent.value[1][node], np.diff(begin, append=len(a)).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32)]
        yield pa.RecordBatch.from_pydict({**{c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("node", "k", "m2", "size", "b"), own, strict=True)}, "w": pa.array([weight], pa.binary())})

    dealt = links.select("a", "b", "w").repartition(links.count() // BLOCK_LINKS + 1, "a")
    kept = written(dealt.mapInArrow(build, "node binary, k binary, m2 binary, size binary, b binary, w binary"), "blocks")
    sent.destroy()
    return kept


def _arrays(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray | None, ...]:
    """(node, k, m2, size, b, w) of a block."""
    kinds = {"node": np.int32, "k": np.float64, "m2": np.float64, "size": np.int32, "b": np.int32, "w": np.float64}
    cells = {c: batch.column(c)[row].as_buffer() for c in kinds}
    return tuple(None if cells[c] is None else np.frombuffer(cells[c], kind) for c, kind in kinds.items())


def _wishes(blocks: DataFrame, comm: np.ndarray, total: np.ndarray, resolution: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The sum over nodes of the share of links into the own community, the nodes that want to move, and where to."""
    spark = blocks.sparkSession
    sent = spark.sparkContext.broadcast((comm, total))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comm, total = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                node, k, m2, size, b, w = _arrays(batch, row)
                at = np.arange(len(node), dtype=np.int64)
                key, tied = _sums((np.repeat(at, size) << 32) | comm[b], w)
                own, to = key >> 32, key & 0xFFFFFFFF
                begin = np.flatnonzero(np.diff(own, prepend=-1))
                here = to == comm[node][own]
                inner = np.bincount(own[here], tied[here], minlength=len(node))
                gain = np.where(here, -np.inf, tied - resolution * k[own] * total[to] / m2[own])
                rounded = np.round(gain, 9)
                # Of the communities with the highest gain the one with the least name: keys are in order of names.
                found = np.flatnonzero(~here & (rounded == np.maximum.reduceat(rounded, begin)[own]))
                found = found[np.diff(own[found], prepend=-1) > 0]
                most = np.maximum.reduceat(gain, begin)[own[found]]
                mine = own[found]
                more = most - (inner[mine] - resolution * k[mine] * (total[comm[node[mine]]] - k[mine]) / m2[mine])
                goes = more > SMALL
                yield pa.RecordBatch.from_pydict({"share": [float((inner / m2).sum())], "node": [node[mine[goes]].tobytes()], "to": [to[found[goes]].astype(np.int32).tobytes()]})

    with _single_rows(spark):
        rows = blocks.mapInArrow(score, "share double, node binary, to binary").collect()
    sent.destroy()
    node, to = (np.frombuffer(b"".join(r[c] for r in rows), np.int32) for c in ("node", "to"))
    return sum(r["share"] for r in rows), node, to


def _contracted(blocks: DataFrame, comm: np.ndarray) -> DataFrame:
    """(a, b, w): the weights between communities, and inside them; written."""
    spark = blocks.sparkSession
    sent = spark.sparkContext.broadcast(comm)

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comm = sent.value.astype(np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                node, _, _, size, b, w = _arrays(batch, row)
                key, weight = _sums((np.repeat(comm[node], size) << 32) | comm[b], w)
                for at in range(0, len(key), 100_000):
                    part = key[at : at + 100_000]
                    yield pa.RecordBatch.from_pydict({"a": part >> 32, "b": part & 0xFFFFFFFF, "w": weight[at : at + 100_000]})

    with _single_rows(spark):
        kept = written(blocks.mapInArrow(contract, "a long, b long, w double").groupBy("a", "b").agg(F.sum("w").alias("w")), "contracted")
    sent.destroy()
    return kept


def _hashed(node: np.ndarray, salt: int) -> np.ndarray:
    """Spark's xxhash64(node, salt) of a long and an int."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))

    def mixed(h):
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))

    with np.errstate(over="ignore"):
        h = (np.full(len(node), 42, np.uint64) + p5 + np.uint64(8)) ^ (turned(node.astype(np.uint64) * p2, 31) * p1)
        h = mixed(turned(h, 27) * p1 + p4)
        h = (h + p5 + np.uint64(4)) ^ (np.uint64(salt) * p1)
        return mixed(turned(h, 23) * p2 + p3)


def _detect_packed(ids: DataFrame, links: DataFrame, n: int, resolution: float, rounds: int, levels: int) -> Detected:
    """``detect`` for ids 0, 1, ... under n: a node's numbers are arrays on the driver, links are blocks."""
    spark = ids.sparkSession
    own = ids.select("scope", "id").toArrow()
    here = own.column("id").to_numpy()
    scope = np.zeros(n, np.int32)
    scope[here] = pa.chunked_array(own.column("scope")).combine_chunks().dictionary_encode().indices.to_numpy()
    del own
    degree = links.groupBy("a").agg(F.sum("w").alias("k")).toArrow()
    k = np.zeros(n)
    k[degree.column("a").to_numpy()] = degree.column("k").to_numpy()
    del degree
    m2 = np.bincount(scope, k)[scope] if n else np.zeros(0)
    loop, place, history = np.zeros(n), np.arange(n, dtype=np.int32), []

    def measured(blocks: DataFrame, comm: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """(modularity over all scopes, the nodes that want to move, where to)."""
        total = np.bincount(comm, k, minlength=n)
        share, node, to = _wishes(blocks, comm, total, resolution)
        some = m2 > 0
        return share + float((loop[some] / m2[some]).sum()) - resolution * float(((total[some] / m2[some]) ** 2).sum()), node, to

    for level in range(levels):
        blocks, comm = _blocks(links, k, m2), np.arange(n, dtype=np.int32)
        q, node, to = measured(blocks, comm)
        if not history:
            history.append(q)
        less, began = 0, q
        for r in range(rounds):
            if not len(node):
                break
            goes = (_hashed(node, level * 1_000 + r) & np.uint64((2 << less) - 1)) == 0
            after = comm.copy()
            after[node[goes]] = to[goes]
            q_after, node_after, to_after = measured(blocks, after)
            if q_after < q - SMALL:  # too many moved at once
                less += 2
                if less > 2 * LESS:
                    break
                continue
            done = q_after - q < 1e-6 and r > rounds // 2
            comm, q, node, to = after, q_after, node_after, to_after
            if done:
                break
        place = comm[place]
        if q - began <= SMALL:
            break
        history.append(q)
        # Contraction: communities become nodes, links inside them loops.
        between = _contracted(blocks, comm)
        k, loop = np.bincount(comm, k, minlength=n), np.bincount(comm, loop, minlength=n)
        inside = between.where("a = b").select("a", "w").toArrow()
        loop[inside.column("a").to_numpy()] += inside.column("w").to_numpy()
        links = between.where("a <> b")
    least = np.full(n, n, np.int32)
    np.minimum.at(least, place[here], here.astype(np.int32))
    sent = spark.sparkContext.broadcast(least[place])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("community", pa.array(sent.value[batch.column("id").to_numpy()].astype(np.int64)))

    kind = ids.schema["scope"].dataType.simpleString()
    members = written(ids.select("scope", F.col("id").cast("long").alias("id")).mapInArrow(named, f"scope {kind}, id long, community long"), "communities")
    sent.destroy()
    return Detected(members, history)


def detect(ids: DataFrame, links: DataFrame, resolution: float = 1.0, rounds: int = ROUNDS, levels: int = LEVELS, ranked: int | None = None) -> Detected:
    """Communities of ids (scope, id) by links (a, b, w), each way and inside scopes, each pair once. Nodes without links stay alone. ranked: ids are whole numbers under this, from 0."""
    if (ids.count() if ranked is None else ranked) > BROADCAST_NODES:
        return _detect_joined(ids, links, resolution, rounds, levels)
    if ranked is not None:
        return _detect_packed(ids, links, ranked, resolution, rounds, levels)
    ranks = _ranked(ids.select("id").distinct())
    of = lambda c, name: ranks.select(F.col("id").alias(c), F.col("rank").alias(name))
    named = written(links.join(of("a", "_a"), "a").join(of("b", "_b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"), "w"), "links")
    found = _detect_packed(written(ids.join(of("id", "_id"), "id").select("scope", F.col("_id").alias("id")), "ids"), named, ranks.count(), resolution, rounds, levels)
    back = found.members.withColumnRenamed("id", "_id").join(of("id", "_id"), "_id").withColumnRenamed("community", "_c").join(of("community", "_c"), "_c")
    return Detected(written(back.select("scope", "id", "community"), "communities"), found.modularity)


def _detect_joined(ids: DataFrame, links: DataFrame, resolution: float, rounds: int, levels: int) -> Detected:
    """``detect`` by joins of tables, whatever the number of nodes."""
    degree = links.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))
    nodes = ids.select("scope", F.col("id").alias("node")).join(degree, "node", "left").withColumn("k", F.coalesce("k", F.lit(0.0)))
    m2 = nodes.groupBy("scope").agg(F.sum("k").alias("m2"))
    state = written(nodes.join(m2, "scope").select("scope", "node", F.col("node").alias("comm"), "k", F.lit(0.0).alias("loop"), "m2"), "state")
    members, links, history = ids.select("scope", "id", F.col("id").alias("at")), _bucketed(links), []
    few = ids.count() <= BROADCAST_NODES
    for level in range(levels):
        scored = _scored(state, links, resolution, few)
        q, movers = _measured(scored, resolution)
        if not history:
            history.append(q)
        less, began = 0, q
        for r in range(rounds):
            if not movers:
                break
            after = _scored(_moved(scored, level * 1_000 + r, less), links, resolution, few)
            q_after, movers_after = _measured(after, resolution)
            if q_after < q - SMALL:  # too many moved at once
                less += 2
                if less > 2 * LESS:
                    break
                continue
            done = q_after - q < 1e-6 and r > rounds // 2
            scored, q, movers = after, q_after, movers_after
            if done:
                break
        to = scored.select(F.col("node").alias("at"), "comm")
        members = written(members.join(to, "at").select("scope", "id", F.col("comm").alias("at")), "members")
        if q - began <= SMALL:
            break
        history.append(q)
        # Contraction: communities become nodes, links inside them loops.
        names = scored.select(F.col("node").alias("a"), F.col("comm").alias("ca"))
        between = written(links.join(names, "a").join(names.select(F.col("a").alias("b"), F.col("ca").alias("cb")), "b").groupBy("ca", "cb").agg(F.sum("w").alias("w")), "contracted")
        loops = between.where("ca = cb").select(F.col("ca").alias("node"), F.col("w").alias("added"))
        merged = scored.groupBy("scope", F.col("comm").alias("node")).agg(F.sum("k").alias("k"), F.sum("loop").alias("loop"), F.first("m2").alias("m2")).join(loops, "node", "left")
        state = written(merged.select("scope", "node", F.col("node").alias("comm"), "k", (F.col("loop") + F.coalesce("added", F.lit(0.0))).alias("loop"), "m2"), "state")
        links = _bucketed(between.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"), "w"))
    names = members.groupBy("scope", "at").agg(F.min("id").alias("community"))
    return Detected(written(members.join(names, ["scope", "at"]).select("scope", "id", "community"), "communities"), history)


def _split(members: DataFrame, links: DataFrame, chosen: DataFrame, resolution: float, ranked: int | None = None) -> tuple[DataFrame, bool]:
    """members (id, community) with the chosen communities (community) detected again, each as a graph of its own; whether one fell apart."""
    inside = written(members.join(F.broadcast(chosen), "community"), "inside")  # fewer than four of a quarter of all nodes, or of fifty nodes and more
    name = bounded_broadcast(inside.select(F.col("id").alias("a"), F.col("community").alias("scope")), BROADCAST_NODES // 4)
    own = links.join(name, "a").join(name.select(F.col("a").alias("b"), F.col("scope").alias("_other")), "b").where("scope = _other").select("a", "b", "w")
    again = detect(inside.select(F.col("community").alias("scope"), "id"), written(own, "own"), resolution, ranked=ranked).members
    apart = written(members.join(again.select("id", F.col("community").alias("_new")), "id", "left").select("id", F.coalesce("_new", "community").alias("community")), "split")
    return apart, again.select("community").distinct().count() > chosen.count()


def communities(nodes: DataFrame, near: DataFrame, resolution: float | None = None) -> Detected:
    """Communities of all nodes that are no sources: detected, then split while one is larger than max(10, a quarter of the nodes) and falls apart, then those of fifty and more with a cohesion under 0.05 once more."""
    ranks = _ranked(nodes.where("type <> 'source'").select("id").distinct())
    n = ranks.count()
    links = written(simple_links(nodes, near, ranks), "links")
    ids = ranks.select(F.col("rank").alias("id"))
    if resolution is None:
        resolution = auto_resolution(n, links.count() // 2)
    found = detect(ids.select(F.lit("").alias("scope"), "id"), links, resolution, ranked=n)
    members, most = found.members.select("id", "community"), max(LEAST, int(max(1, n) * SHARE))
    whole: list[int] = []
    while True:  # each turn splits at least one community, of which fewer than four are that large
        large = [r["community"] for r in members.groupBy("community").agg(F.count("*").alias("size")).where(F.col("size") > most).select("community").collect()]
        large = sorted(set(large) - set(whole))
        if not large:
            break
        before = members
        members, apart = _split(members, links, members.sparkSession.createDataFrame([(c,) for c in large], "community long"), resolution, n)
        still = members.where(F.col("community").isin(large)).groupBy("community").count()
        was = {r["community"]: r["count"] for r in before.where(F.col("community").isin(large)).groupBy("community").count().collect()}
        whole += [r["community"] for r in still.collect() if r["count"] == was[r["community"]]]
        if not apart:
            break
    near_links = links.select(F.col("a").alias("id"), F.col("b").alias("neighbor"))
    loose = M.cohesion(bounded_broadcast(members.select("id", F.col("community").alias("community_id")), BROADCAST_NODES // 4), near_links).where((F.col("size") >= LOOSE_SIZE) & (F.col("cohesion") < LOOSE)).select(F.col("community_id").alias("community"))
    loose = written(loose, "loose")
    if loose.limit(1).count():
        members, _ = _split(members, links, loose, resolution, n)
    community = ranks.select(F.col("rank").alias("community"), F.col("id").alias("_name"))
    back = members.join(ranks.withColumnRenamed("id", "_id").withColumnRenamed("rank", "id"), "id").join(community, "community")
    return Detected(written(back.select(F.col("_id").alias("id"), F.col("_name").alias("community")), "named"), found.modularity)


def with_sources(nodes: DataFrame, edges: DataFrame, members: DataFrame) -> DataFrame:
    """(id, community) of all nodes that get one: a node without its own takes that of its first neighbour by edge id that has one."""
    steps = edges.select(F.col("source").alias("id"), F.col("target").alias("to"), F.col("id").alias("_edge")).unionByName(edges.select(F.col("target").alias("id"), F.col("source").alias("to"), F.col("id").alias("_edge")))
    without = bounded_broadcast(nodes.select("id").distinct().join(members.select("id"), "id", "left_anti"), BROADCAST_NODES // 4)
    first = steps.join(without, "id", "left_semi").join(members.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.min_by("community", F.struct("_edge", "to")).alias("community"))
    return members.unionByName(first)


def refresh_clusters(g: Graph, resolution: float | None = None) -> Graph:
    """g with dangling edges pruned and all metrics made anew: nodes get community_id, degree, bridge_score, is_god, reason; communities are (id, label, size, community), the largest first; hyperedges stay if all their nodes are there."""
    edges = prune_dangling(g.nodes, g.edges)
    near = written(M.adjacency(g.nodes, edges), "near")
    found = communities(g.nodes, near, resolution).members
    label = g.nodes.select("id", "label")
    sized = found.groupBy("community").agg(F.count("*").alias("size")).join(label.withColumnRenamed("id", "community"), "community")
    numbered = written(sized.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("size"), "community"))), "communities")  # one row a community
    slug = F.when(T.slugify(F.col("label")) == "item", "cluster").otherwise(T.slugify(F.col("label")))
    named = numbered.select(F.concat(F.lit("community:"), slug, F.lit("-"), F.col("rank").cast("string")).alias("id"), "label", "size", "community")
    membership = written(with_sources(g.nodes, edges, found).join(named.select("community", F.col("id").alias("community_id")), "community").select("id", "community_id"), "membership")
    own = membership.join(g.nodes.where("type <> 'source'").select("id"), "id", "left_semi")
    degree = M.degrees(g.nodes, near)
    gods = M.god_nodes(degree).select("id", "degree", "is_god", "sigma")
    other = own.select(F.col("id").alias("neighbor"), F.col("community_id").alias("_c"))
    seen = near.join(other, "neighbor", "left").join(own, "id", "left").groupBy("id").agg(F.count_distinct(F.coalesce("_c", "community_id")).alias("seen"))
    n = F.coalesce("seen", F.lit(0))
    bridge = F.when(F.col("type") == "source", n).otherwise(F.greatest(F.lit(0), n - 1))
    parts = F.concat_ws(
        ", ", F.concat(F.lit("degree "), F.col("degree").cast("string")), F.when(n >= 3, F.concat(F.lit("across "), n.cast("string"), F.lit(" communities"))).when(n == 2, F.lit("bridges 2 communities")),
        F.when(F.col("sigma").isNotNull(), F.concat(F.format_number("sigma", 1), F.lit("σ above mean"))),
    )
    base = g.nodes.select(*[c for c in g.nodes.columns if c not in ("community_id", "degree", "bridge_score", "is_god", "reason")])
    nodes = base.join(membership, "id", "left").join(gods, "id", "left").join(seen, "id", "left").withColumn("bridge_score", bridge).withColumn("reason", F.when(F.col("is_god"), parts)).drop("sigma", "seen")
    hyper = g.hyperedges
    if hyper is not None:
        missing = hyper.select("id", F.explode("node_ids").alias("node_id")).join(g.nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti").select("id").distinct()
        hyper = hyper.join(missing, "id", "left_anti")
    return Graph(nodes, edges, hyper, named, g.pages, g.sources)
