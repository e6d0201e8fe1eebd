"""Trie of conversation prefixes by polynomial rolling fingerprints, verified turn by turn.

Each turn is known by the SHA-256 of its role and text; after that no text is
moved. A scan in numpy over sorted rows numbers the turns of a conversation and
rolls the fingerprints of its prefixes: the sum of the first eight bytes of each
digest times a power of ``BASE``, modulo 2 ** ``bits``. Rows with one depth and
fingerprint are a candidate node. A candidate is verified by its least and
greatest digest of the last turn: if they are equal, every member has the turn of
the representative at this depth, and as fingerprints and last turns are equal,
so are those of the prefixes before it, which are verified in turn. Where digests
differ the fingerprints collided: members are split by digest, and the split is
carried down the conversations it touches (``split``), so nodes are exact
whatever the fingerprint's width.

The smallest member of a node is the smallest member of all its nodes further
down its conversation, so nodes fall into one chain for each conversation that
names any. Subtree sums roll up without a loop over depths: sums along a chain
from its end, plus the whole sum of a chain for every node above its head.

Scans work on ranges of (conversation, order), not on whole conversations: ranges
are scanned apart, then what earlier ranges of the same conversation hold is
added. So one conversation may hold any share of the rows. Groups are aggregated
before they are shuffled; the ids that end at a node are joined to strings within
ranges before one task hashes them in a stream (SHA-256 has no parallel form).

Rebuilding: conversation c takes the first h turns of conversation c - c % 100 and
goes on with its own turns after its first h; h is the crc32 of c's decimal form
modulo 6.

Defined cases: null roles and texts count as empty, a null turn comes first. Rows
of one conversation that share a turn stand in the order of their digests;
repeated rows are turns of their own. Rows without conv_id belong to no
conversation. No rows give no nodes, not even a root. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.llm.common import bounded_broadcast, joined_by, table, written

BASE = 0x9E3779B97F4A7C15
BITS = 64
SPAN, HEADS = 100, 6
IDS = 8_192
BROADCAST_ROWS = 100_000


def _powers(n: int) -> np.ndarray:
    """BASE ** 0 to BASE ** (n - 1), modulo 2 ** 64."""
    made = np.ones(1, np.uint64)
    while len(made) < n:
        step = np.uint64(pow(BASE, len(made), 1 << 64))
        made = np.concatenate([made, made * step])
    return made[:n]


def _power_of(exponents: np.ndarray) -> np.ndarray:
    made, square, rest = np.ones(len(exponents), np.uint64), np.uint64(BASE), exponents.astype(np.uint64)
    while rest.any():
        made = np.where(rest & np.uint64(1), made * square, made)
        square, rest = np.uint64(pow(int(square), 2, 1 << 64)), rest >> np.uint64(1)
    return made


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _within(values: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """Running sums that start anew at each run."""
    total = np.cumsum(values, dtype=values.dtype)
    before = np.where(begin > 0, total[begin - 1], values.dtype.type(0))
    return total - np.repeat(before, np.diff(np.append(begin, n)))


def _scan_range(sums: list[str], digest: bool):
    """Sorted rows of one range: position, fingerprint and running sums within the conversation, as far as this range has it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pos, held, rolled = None, 0, dict.fromkeys(sums, 0), 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = batch.column("conv").to_numpy(zero_copy_only=False)
            begin = _runs(keys)
            goes_on = np.zeros(n, bool)
            if key is not None and keys[0] == key:
                goes_on[: begin[1] if len(begin) > 1 else n] = True
            else:
                pos, held, rolled = 0, dict.fromkeys(sums, 0), 0
            place = _within(np.ones(n, np.int64), begin, n) + np.where(goes_on, pos, 0)
            columns = {"pos": place}
            for name in sums:
                columns[f"{name}_run"] = _within(batch.column(name).to_numpy(zero_copy_only=False), begin, n) + np.where(goes_on, held[name], 0)
            if digest:
                turns = np.frombuffer(b"".join(x[:8] for x in batch.column("digest").to_pylist()), ">u8").astype(np.uint64)
                powers = _powers(int(place.max()) + 1)[place] if place.max() <= 4 * n else _power_of(place)
                columns["rolled"] = (_within(turns * powers, begin, n) + np.where(goes_on, np.uint64(rolled), np.uint64(0))).view(np.int64)
                columns["rolled_up"] = (columns["rolled"].view(np.uint64) - turns * powers).view(np.int64)
            key, pos, held = keys[-1], int(place[-1]), {name: int(columns[f"{name}_run"][-1]) for name in sums}
            rolled = int(columns["rolled"].view(np.uint64)[-1]) if digest else 0
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, columns.values())], [*batch.schema.names, *columns])

    return scan


def _add_before(sums: list[str], digest: bool):
    """Adds what earlier ranges hold of the same conversation."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names if not name.startswith("before_")}
            n_before = batch.column("before_pos").to_numpy(zero_copy_only=False)
            columns["pos"] = pa.array(batch.column("pos").to_numpy(zero_copy_only=False) + n_before)
            for name in sums:
                columns[f"{name}_run"] = pa.array(batch.column(f"{name}_run").to_numpy(zero_copy_only=False) + batch.column(f"before_{name}").to_numpy(zero_copy_only=False))
            if digest:
                before, powers = batch.column("before_rolled").to_numpy(zero_copy_only=False).view(np.uint64), _power_of(n_before)
                for name in ("rolled", "rolled_up"):
                    columns[name] = pa.array((before + batch.column(name).to_numpy(zero_copy_only=False).view(np.uint64) * powers).view(np.int64))
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return add


def _roll_up(sums: list[str], digest: bool):
    """For the pieces of conversations that lie in several ranges, in order: what all earlier ones hold."""

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pos, held, rolled = None, 0, dict.fromkeys(sums, 0), 0
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["conv"] != key:
                    key, pos, held, rolled = row["conv"], 0, dict.fromkeys(sums, 0), 0
                rows.append({"conv": key, "part": row["part"], "before_pos": pos, **{f"before_{s}": held[s] for s in sums}, **({"before_rolled": rolled - (rolled >> 63 << 64)} if digest else {})})
                if digest:
                    rolled = (rolled + row["rolled"] * pow(BASE, pos, 1 << 64)) % (1 << 64)
                pos, held = pos + row["pos"], {s: held[s] + row[f"{s}_run"] for s in sums}
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("conv", pa.int64()), ("part", pa.int32()), ("before_pos", pa.int64()), *[(f"before_{s}", pa.int64()) for s in sums], *([("before_rolled", pa.int64())] if digest else [])]))

    return roll


def scanned(rows: DataFrame, order: list[Column], sums: list[str] = (), digest: bool = False) -> DataFrame:
    """rows with ``pos`` (1 for the first row of its ``conv`` in this order), running sums ``<name>_run`` and, from ``digest``, the fingerprints of the prefix up to the row (``rolled``) and before it (``rolled_up``); written."""
    sums, kinds = list(sums), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    more = ", pos long" + "".join(f", {s}_run long" for s in sums) + (", rolled long, rolled_up long" if digest else "")
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv", *order).sortWithinPartitions("conv", *order)
    local = written(dealt.mapInArrow(_scan_range(sums, digest), kinds + more).withColumn("part", F.spark_partition_id()), "ranges")
    last = F.max(F.struct("pos", *[f"{s}_run" for s in sums], *(["rolled"] if digest else []))).alias("last")
    pieces = local.groupBy("conv", "part").agg(last).select("conv", "part", "last.*")
    # A range shares conversations with another one only at its two ends.
    several = pieces.groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select("conv")
    shared = written(pieces.join(bounded_broadcast(several, BROADCAST_ROWS), "conv"), "pieces")
    if not shared.limit(1).count():
        return local.drop("part")
    befores = "conv long, part int, before_pos long" + "".join(f", before_{s} long" for s in sums) + (", before_rolled long" if digest else "")
    before = shared.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(_roll_up(sums, digest), befores).where("before_pos > 0")
    joined = local.join(bounded_broadcast(written(before, "before"), BROADCAST_ROWS), ["conv", "part"], "left")
    added = ["before_pos", *[f"before_{s}" for s in sums], *(["before_rolled"] if digest else [])]
    joined = joined.select(*[c for c in local.columns if c != "part"], *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in added])
    return written(joined.mapInArrow(_add_before(sums, digest), kinds + more), "scan")


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv, step, digest, length): conversations with the opening of their block's first one; ``step`` orders the turns. Conversations without turns have one row without digest."""
    own = scanned(turns, [F.col("turn").asc_nulls_first(), F.col("digest")])
    convs = own.where("pos = 1").select("conv", (F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS).alias("h"), (F.col("conv") - F.col("conv") % SPAN).alias("block"))
    opening = own.where((F.col("pos") < HEADS) & (F.col("conv") % SPAN == 0)).select(F.col("conv").alias("block"), F.col("pos").alias("step"), "digest", "length")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    first = convs.join(opening, "block").where(F.col("step") <= F.col("h")).select("conv", "step", "digest", "length")
    return convs.select("conv", F.lit(0).cast("long").alias("step"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("length")).unionByName(
        first.unionByName(own.where(F.col("pos") > h).select("conv", F.col("pos").alias("step"), "digest", "length"))
    )


def prefixes(sequences: DataFrame, bits: int = BITS) -> DataFrame:
    """(conv, depth, print, split, up_print, up_split, length): one row for each conversation and prefix, the empty one too; (depth, print, split) names an exact prefix, up_* the one before; written."""
    mask = F.lit((1 << bits) - 1 if bits < 64 else -1).cast("long")
    same = ["depth", "print"]
    rolled = scanned(sequences.where("step > 0"), [F.col("step")], digest=True).select(
        "conv", F.col("pos").alias("depth"), F.col("rolled").bitwiseAND(mask).alias("print"), F.col("rolled_up").bitwiseAND(mask).alias("up_print"), "digest", "length"
    )
    candidates = rolled.groupBy(*same).agg(F.min("digest").alias("low"), F.max("digest").alias("high"))
    collided = written(candidates.where("low <> high").select(*same), "collided")
    if collided.limit(1).count():
        met = rolled.join(bounded_broadcast(collided, BROADCAST_ROWS), same).select(*same, "digest").distinct()
        classes = written(met.withColumn("class", F.dense_rank().over(Window.partitionBy(*same).orderBy("digest"))).where("class > 1"), "classes")
        marks = rolled.join(bounded_broadcast(classes, BROADCAST_ROWS), [*same, "digest"]).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("depth", "class"))).alias("marks"))
        rolled = rolled.join(marks, "conv", "left")
        split = lambda deepest: F.coalesce(F.array_join(F.transform(F.filter("marks", lambda m: m["depth"] <= deepest), lambda m: F.concat(m["depth"], F.lit(":"), m["class"])), ","), F.lit(""))
    else:
        split = lambda deepest: F.lit("")
    below = rolled.select("conv", "depth", "print", split(F.col("depth")).alias("split"), "up_print", split(F.col("depth") - 1).alias("up_split"), "length")
    zero, no = F.lit(0).cast("long"), F.lit(None)
    root = sequences.where("step = 0").select("conv", zero.alias("depth"), zero.alias("print"), F.lit("").alias("split"), no.cast("long").alias("up_print"), no.cast("string").alias("up_split"), zero.alias("length"))
    return written(root.unionByName(below), "prefixes")


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, print, split, conv): stretches of at most IDS ids of a node, joined by commas."""
    name, ids = None, []

    def stretch() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"depth": pa.array([name[0]], pa.int64()), "print": pa.array([name[1]], pa.int64()), "split": [name[2]], "first": pa.array([ids[0]], pa.int64()), "ids": [",".join(map(str, ids))]})

    for batch in batches:
        out = []
        for *node, conv in zip(*(batch.column(c).to_pylist() for c in ("depth", "print", "split", "conv")), strict=True):
            if node != name or len(ids) == IDS:
                if ids:
                    out.append(stretch())
                name, ids = node, []
            ids.append(conv)
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if ids:
        yield stretch()


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted stretches: one SHA-256 for each node, fed stretch by stretch."""
    name, state = None, None
    for batch in batches:
        out = []
        for *node, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "print", "split", "ids")), strict=True):
            if node != name:
                if name:
                    out.append((*name, state.hexdigest()))
                name, state = node, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["depth", "print", "split", "ends_sha256"])
    if name:
        yield pa.RecordBatch.from_arrays([pa.array([name[0]], pa.int64()), pa.array([name[1]], pa.int64()), pa.array([name[2]]), pa.array([state.hexdigest()])], ["depth", "print", "split", "ends_sha256"])


def ends(rows: DataFrame) -> DataFrame:
    """(depth, print, split, ends_sha256): for nodes at which conversations end, the SHA-256 of their ids in ascending order, joined by commas."""
    same = ["depth", "print", "split"]
    last = rows.groupBy("conv").agg(F.max(F.struct(*same)).alias("last")).select("last.*", "conv")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretches = last.repartitionByRange(n, *same, "conv").sortWithinPartitions(*same, "conv").mapInArrow(_joined_ids, "depth long, print long, split string, first long, ids string")
    return stretches.repartition(*same).sortWithinPartitions(*same, "first").mapInArrow(_hashed_ids, "depth long, print long, split string, ends_sha256 string")


def trie(sequences: DataFrame, bits: int = BITS) -> DataFrame:
    """One row for each node of the trie of ``sequences`` (as ``rebuilt`` gives them): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = prefixes(sequences, bits)
    same = ["depth", "print", "split"]
    bare = written(
        rows.groupBy(*same).agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("length").alias("length"), F.min("up_print").alias("up_print"), F.min("up_split").alias("up_split")), "nodes"
    )
    children = bare.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_print").alias("print"), F.col("up_split").alias("split")).agg(F.count("*").alias("n_children"))
    counted = bare.join(children, same, "left").fillna(0, ["n_children"])
    saved, leaf = (F.col("n_convs") - 1) * F.col("length"), (F.col("n_children") == 0).cast("long")
    chains = scanned(counted.withColumn("saved", saved).withColumn("leaf", leaf), [F.col("depth")], sums=["saved", "leaf"])
    totals = written(
        chains.groupBy("conv").agg(F.max(F.struct("depth", "saved_run", "leaf_run")).alias("last"), F.min("depth").alias("head"))
        .select("conv", "head", (F.col("last.depth") + 1).alias("n"), F.col("last.saved_run").alias("saved_all"), F.col("last.leaf_run").alias("leaf_all")), "chains"
    )
    below = joined_by(rows.select("conv", *same), totals, "conv", "n").where("depth < head").groupBy(*same).agg(F.sum("saved_all").alias("saved_below"), F.sum("leaf_all").alias("leaf_below"))
    summed = joined_by(chains, totals, "conv", "n").join(below, same, "left").join(ends(rows), same, "left").select(
        F.col("conv").alias("conv_id"), *same, "up_print", "up_split", "n_convs", "n_children",
        (F.col("leaf_all") - F.col("leaf_run") + F.col("leaf") + F.coalesce("leaf_below", F.lit(0))).alias("n_leaves"),
        (F.col("saved_all") - F.col("saved_run") + F.col("saved") + F.coalesce("saved_below", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    whole = written(summed, "trie")
    parents = whole.where("n_children > 0").select(F.struct(*same).alias("up"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    up = F.struct((F.col("depth") - 1).alias("depth"), F.col("up_print").alias("print"), F.col("up_split").alias("split"))
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    below_root = joined_by(whole.where("depth > 0").withColumn("up", up), parents, "up", "n").select(*result)
    return whole.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*result).unionByName(below_root)


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, turn, digest, length): what the scans need of each turn; the digest covers role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), "turn", F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"), F.char_length(text).cast("long").alias("length"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(written(rebuilt(turns(table(spark, sf_dir, "conversations"))), "sequences"))


_CRC32 = "xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"
ORACLES = {
    "op13_prefix_trie": f"""WITH t AS (SELECT conv_id, coalesce(text, '') AS text, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, digest, length(text) AS len, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS pos FROM t),
c AS (SELECT conv_id, {_CRC32} % {HEADS} AS h FROM (SELECT DISTINCT conv_id FROM t)),
s AS (SELECT c.conv_id, pos, digest, len FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % {SPAN} AND pos <= h UNION ALL SELECT c.conv_id, pos, digest, len FROM c JOIN o ON o.conv_id = c.conv_id AND pos > h),
r AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(digest, '' ORDER BY pos) OVER (PARTITION BY conv_id ORDER BY pos) AS path, len FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
p AS (SELECT conv_id, depth, path, len FROM r UNION ALL SELECT conv_id, 0, '', 0 FROM c),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(len) AS len FROM p GROUP BY path, depth),
k AS (SELECT left(path, length(path) - 64) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (path)),
u AS (SELECT p.path, sum((m.n_convs - 1) * m.len) AS saved, count(*) FILTER (WHERE m.n_children = 0) AS leaves FROM m JOIN p ON p.conv_id = m.conv_id AND p.depth <= m.depth GROUP BY p.path),
e AS (SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, arg_max(path, depth) AS path FROM p GROUP BY conv_id) GROUP BY path)
SELECT m.conv_id, m.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, u.leaves AS n_leaves, u.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM m JOIN u USING (path) LEFT JOIN e USING (path) LEFT JOIN n up ON m.depth > 0 AND up.path = left(m.path, length(m.path) - 64)""",
}
