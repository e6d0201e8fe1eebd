"""A stored full-text index of immutable segments: updates write what changed, searches read what is stored.

Under the index's folder:

* ``segments/<id>/postings``: one row a shard, with its pages (keys, dls, hashes) in
  order of key, so that a page's place is its slot, and its terms in order: how
  many pages each has (sizes), and their slots and frequencies end to end as
  32-bit numbers. A shard has a bounded number of pages, so no row grows with the corpus.
* ``segments/<id>/pages`` (segment, shard, slot, key, dl, hash): the same pages, one row each.
* ``dead/<id>`` (segment, shard, slot): tombstones of pages that changed or went.
* ``manifests/<version>.json``: which segments and tombstones are live (see
  ``versions``): a writer that stops leaves the old state, one whose version
  another writer took fails with ``Conflict`` and changes nothing.

A refresh compares hashes of the pages with the stored ones; only new and changed
pages are split in words, and move once, as texts. ``merge`` rewrites segments that
are small, or hold many dead pages, as one, from their postings, without reading
texts: whole shards come together. Numbers of pages, lengths and frequencies are
sums over live pages, so a search after any updates and merges gives what it gives
over an index made anew.

Searches take sets of questions. Shards and copies of the questions meet in cells,
of which there are a few for each core, however many shards there are: a shard moves
once, as it is stored. A cell passes on the best pages of each question only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from weftgraph.functions import text as T
from weftgraph.operators.versions import Conflict, Versions, files
from weftgraph.session import bounded_broadcast, written

__all__ = ["Conflict", "Manifest", "SegmentIndex"]

# Pages and bytes of text in a shard; shards of a segment at least; questions and their terms in a block; cells for each core.
SHARD, SHARD_BYTES, SHARDS, QUESTIONS, TERMS, CELLS = 4_096, 64_000_000, 16, 32_768, 8_000_000, 4
# Bytes split at a time; questions scored at a time; a term that one in so many pages has is multiplied, others are added up.
BYTES, TOGETHER, DENSE = 4_000_000, 64, 16

_INSIDE = np.zeros(256, bool)
for _low, _high in ("09", "az", "--"):
    _INSIDE[ord(_low) : ord(_high) + 1] = True


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of lower-case texts as ``text.tokens`` finds them, and how many each text has."""
    whole = texts.cast(pa.large_binary())
    ends = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = _INSIDE[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    first = ends[(ends > 0) & (ends < len(data))]
    opens[first], closes[first - 1] = inside[first], inside[first - 1]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    if (dashed := np.flatnonzero(data[begin] == ord("-"))).size:  # a token begins with a letter or digit
        solid = np.append(np.flatnonzero(inside & (data != ord("-"))), len(data))
        begin[dashed] = solid[np.searchsorted(solid, begin[dashed])]
    long_enough = end - begin >= 2
    begin, end = begin[long_enough], end[long_enough]
    edge = np.zeros(len(data) + 1, np.int8)
    edge[begin] += 1
    edge[end] -= 1
    offsets = np.append(0, np.cumsum(end - begin)).astype(np.int32)
    kept = data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    return pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]), np.diff(np.searchsorted(begin, ends))


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of several runs, one after the other."""
    total = np.cumsum(size)
    return np.repeat(begin - (total - size), size) + np.arange(total[-1] if len(total) else 0)


def runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """(begin, end) of each run of equal values."""
    begin = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
    yield from zip(begin.tolist(), np.append(begin[1:], len(values)).tolist(), strict=True)


def _row(number: int, keys: pa.Array, dls: np.ndarray, hashes: pa.Array, terms: pa.Array, term: np.ndarray, slot: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
    """A shard's row of its postings (term as its place in terms, slot, tf) in any order."""
    used, term = np.unique(term, return_inverse=True)
    terms = terms.take(pa.array(used)).cast(pa.binary())
    by_name = pc.sort_indices(terms).to_numpy()
    place = np.empty(len(used), np.int64)
    place[by_name] = np.arange(len(used))
    order = np.argsort(place[term] * max(1, len(keys)) + slot)
    one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
    sizes = pa.array(np.bincount(place[term], minlength=len(used)), pa.int32())
    columns = {
        "shard": pa.array([number], pa.int32()), "keys": one(keys), "dls": one(pa.array(dls, pa.int32())), "hashes": one(hashes), "terms": one(terms.take(pa.array(by_name)).cast(pa.string())), "sizes": one(sizes),
        "slots": pa.array([slot[order].astype("<i4").tobytes()], pa.binary()), "tfs": pa.array([tf[order].astype("<i4").tobytes()], pa.binary()),
    }
    return pa.RecordBatch.from_pydict(columns)


class _Build:
    """The pages of one shard, as they come in order of key."""

    def __init__(self, number: int):
        self.number, self.n, self.known = number, 0, {}
        self.keys, self.hashes, self.dls, self.term, self.slot, self.tf = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def add(self, keys: pa.Array, hashes: pa.Array, texts: pa.Array) -> None:
        self.keys.append(keys)
        self.hashes.append(hashes)
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        for begin, end in runs(size // BYTES):
            words, length = split(texts.slice(begin, end - begin))
            coded, n = words.dictionary_encode(), end - begin
            own = np.fromiter((self.known.setdefault(w, len(self.known)) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
            pair, tf = np.unique(own[coded.indices.to_numpy(zero_copy_only=False)] * n + np.repeat(np.arange(n), length), return_counts=True)
            self.term.append(pair // n)
            self.slot.append(pair % n + self.n)
            self.tf.append(tf)
            self.dls.append(length)
            self.n += n

    def row(self) -> pa.RecordBatch:
        whole = [np.concatenate(x) for x in (self.dls, self.term, self.slot, self.tf)]
        return _row(self.number, pa.concat_arrays(self.keys), whole[0], pa.concat_arrays(self.hashes), pa.array(list(self.known), pa.binary()), *whole[1:])


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, key, hash, low) by shard and key as rows of shards."""
    made = None
    for batch in batches:
        shards = batch.column("shard").to_numpy(zero_copy_only=False)
        for begin, end in runs(shards):
            if made is None or made.number != shards[begin]:
                if made:
                    yield made.row()
                made = _Build(int(shards[begin]))
            made.add(*(batch.column(c).slice(begin, end - begin) for c in ("key", "hash", "low")))
    if made:
        yield made.row()


def _parts(batch: pa.RecordBatch, i: int) -> dict:
    """A shard's row without a copy of what it holds."""
    one = {c: batch.column(c)[i] for c in batch.schema.names}
    gone = one["gone"].values if one["gone"].is_valid else pa.array([], pa.int32())
    return {
        **{c: one[c].values for c in ("keys", "hashes", "terms") if c in one}, **{c: one[c].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dls", "sizes")},
        **{c: np.frombuffer(one[c].as_py(), "<i4").astype(np.int64) for c in ("slots", "tfs")}, "gone": gone.to_numpy(zero_copy_only=False),
    }


def _together(number: int, shards: list[dict]) -> pa.RecordBatch:
    """The live pages of several shards as one."""
    sizes = [len(x["dls"]) for x in shards]
    bases = np.cumsum([0, *sizes])
    alive = np.ones(bases[-1], bool)
    for base, x in zip(bases, shards, strict=False):
        alive[base + x["gone"]] = False
    kept = np.flatnonzero(alive)
    keys = pa.concat_arrays([x["keys"] for x in shards]).take(pa.array(kept))
    by_key = pc.sort_indices(keys).to_numpy()
    slot_of = np.full(bases[-1], -1)
    slot_of[kept[by_key]] = np.arange(len(kept))
    coded = pa.concat_arrays([x["terms"] for x in shards]).dictionary_encode()
    term = np.repeat(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([x["sizes"] for x in shards]))
    slot, tf = slot_of[np.concatenate([base + x["slots"] for base, x in zip(bases, shards, strict=False)])], np.concatenate([x["tfs"] for x in shards])
    here = slot >= 0
    hashes = pa.concat_arrays([x["hashes"] for x in shards]).take(pa.array(kept[by_key]))
    return _row(number, keys.take(pa.array(by_key)), np.concatenate([x["dls"] for x in shards])[kept[by_key]], hashes, coded.dictionary, term[here], slot[here], tf[here])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of shards by their new shard ``to``, as rows of those."""
    held, now = [], None
    for batch in batches:
        for i, to in enumerate(batch.column("to").to_pylist()):
            if held and to != now:
                yield _together(now, held)
                held = []
            now = to
            held.append(_parts(batch, i))
    if held:
        yield _together(now, held)


def _live_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) of each shard: how many live pages have a term."""
    for batch in batches:
        for i in range(batch.num_rows):
            x = _parts(batch, i)
            alive = np.ones(len(x["dls"]), bool)
            alive[x["gone"]] = False
            df = np.bincount(np.repeat(np.arange(len(x["sizes"])), x["sizes"]), alive[x["slots"]], len(x["sizes"])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([x["terms"].filter(pa.array(df > 0)), pa.array(df[df > 0])], ["term", "df"])


class _Cell:
    """A block's questions over the shards of one cell, one after the other."""

    def __init__(self, limit: int, mean: float, k1: float, b: float):
        self.limit, self.mean, self.k1, self.b, self.asks, self.top = limit, mean, k1, b, [], None

    def begin(self) -> None:
        asks = pa.Table.from_batches(self.asks)
        flat = lambda c: asks.column(c).combine_chunks().flatten()
        self.ids, coded = asks.column("query_id").combine_chunks(), flat("terms").dictionary_encode()
        self.ends, self.codes, self.vocabulary = np.cumsum(pc.list_value_length(asks.column("terms").combine_chunks()).to_numpy(zero_copy_only=False)), coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        self.idf = np.zeros(len(self.vocabulary))
        self.idf[self.codes] = flat("idfs").to_numpy(zero_copy_only=False)
        self.top, self.least, self.asks = [[] for _ in range(asks.num_rows)], np.zeros(asks.num_rows), []

    def search(self, x: dict) -> None:
        if self.top is None:
            self.begin()
        n = len(x["dls"])
        code = pc.index_in(x["terms"], value_set=self.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
        alive = np.ones(n, bool)
        alive[x["gone"]] = False
        kept = np.repeat(code >= 0, x["sizes"]) & alive[x["slots"]]
        slots, tfs = x["slots"][kept], x["tfs"][kept]
        sizes = np.bincount(np.repeat(np.arange(len(code)), x["sizes"])[kept], minlength=len(code))[code >= 0]
        code = code[code >= 0]
        weight = self.idf[np.repeat(code, sizes)] * (tfs * (self.k1 + 1) / (tfs + self.k1 * (1 - self.b + self.b * x["dls"][slots] / self.mean)))
        begins, row_of = np.cumsum(sizes) - sizes, np.full(len(self.vocabulary), -1)
        row_of[code] = np.arange(len(code))
        common = np.flatnonzero(sizes * DENSE >= n)
        dense_of = np.full(len(code), -1)
        dense_of[common] = np.arange(len(common))
        dense, at = np.zeros((len(common), n), np.float32), spans(begins[common], sizes[common])
        dense[np.repeat(np.arange(len(common)), sizes[common]), slots[at]] = weight[at]
        # The same by page, terms in order: sums run in one order everywhere, so equal pages have equal scores.
        by_page = np.argsort(slots, kind="stable")
        page_rows, page_weight, page_size = np.repeat(np.arange(len(code)), sizes)[by_page], weight[by_page], np.bincount(slots, minlength=n)
        page_begin = np.cumsum(page_size) - page_size
        has = np.zeros((TOGETHER, len(code)), bool)
        for low in range(0, len(self.ends), TOGETHER):
            high = min(low + TOGETHER, len(self.ends))
            m, first = high - low, self.ends[low - 1] if low else 0
            rows = row_of[self.codes[first : self.ends[high - 1]]]
            of = np.repeat(np.arange(m), np.diff(self.ends[low:high], prepend=first))[rows >= 0]
            rows = rows[rows >= 0]
            column = dense_of[rows]
            asked = np.zeros((m, len(common)), np.float32)
            asked[of[column >= 0], column[column >= 0]] = 1
            thin, thin_of = rows[column < 0], of[column < 0]
            at = spans(begins[thin], sizes[thin])
            total = np.bincount(np.repeat(thin_of * n, sizes[thin]) + slots[at], weight[at], m * n).reshape(m, n) + asked @ dense
            # float32 is off by less than a ten thousandth of a sum.
            least = self.least[low:high].copy()
            if n > self.limit and (fresh := np.flatnonzero(least == 0)).size:
                least[fresh] = np.partition(total[fresh], n - self.limit, axis=1)[:, n - self.limit]
            near = np.flatnonzero(total >= np.maximum(least * (1 - 1e-4) - 1e-8, 1e-300)[:, None])
            if not len(near):
                continue
            which, slot = near // n, near % n
            has[of, rows] = True
            pair, at = np.repeat(np.arange(len(which)), page_size[slot]), spans(page_begin[slot], page_size[slot])
            score = np.bincount(pair, page_weight[at] * has[which[pair], page_rows[at]], len(which))
            has[of, rows] = False
            order = np.lexsort([slot, -np.round(score, 9), which])
            which, slot, score = which[order], slot[order], score[order]
            for begin, end in runs(which):
                end = min(end, begin + self.limit)
                q = low + int(which[begin])
                found = zip((-np.round(score[begin:end], 9)).tolist(), x["keys"].take(pa.array(slot[begin:end])).to_pylist(), score[begin:end].tolist(), strict=True)
                self.top[q] = sorted([*self.top[q], *found])[: self.limit]
                if len(self.top[q]) == self.limit:
                    self.least[q] = -self.top[q][-1][0]

    def found(self, query_kind: pa.DataType, key_kind: pa.DataType) -> pa.RecordBatch:
        top = self.top or []
        place = pa.array(np.repeat(np.arange(len(top)), [len(x) for x in top]).astype(np.int64))
        ids = self.ids.take(place) if top else pa.array([], query_kind)
        return pa.RecordBatch.from_arrays([ids, pa.array([k for x in top for _, k, _ in x], key_kind), pa.array([s for x in top for _, _, s in x], pa.float64())], ["query_id", "key", "score"])


def _scorer(limit: int, mean: float, k1: float, b: float, query_kind: pa.DataType, key_kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows by cell, questions before shards, as the cells' best pages of each question."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, now = None, None
        for batch in batches:
            cells, is_shard = batch.column("cell").to_numpy(zero_copy_only=False), batch.column("is_shard").to_numpy(zero_copy_only=False)
            for begin, end in runs(cells):
                if cell is None or cells[begin] != now:
                    if cell:
                        yield cell.found(query_kind, key_kind)
                    cell, now = _Cell(limit, mean, k1, b), cells[begin]
                shards = begin + int(np.count_nonzero(~is_shard[begin:end]))
                if shards > begin:
                    cell.asks.append(batch.slice(begin, shards - begin).select(["query_id", "terms", "idfs"]))
                for i in range(shards, end):
                    if cell.asks or cell.top:
                        cell.search(_parts(batch, i))
        if cell:
            yield cell.found(query_kind, key_kind)

    return score


SHARD_ROW = "shard int, keys array<{kind}>, dls array<int>, hashes array<string>, terms array<string>, sizes array<int>, slots binary, tfs binary"


@dataclass(frozen=True)
class Manifest:
    version: int = 0
    segments: tuple[str, ...] = ()
    dead: tuple[str, ...] = ()


class SegmentIndex:
    """The index in folder ``root`` of pages (key, body), one row a key (rows without one are left out); ``title``, where named, weighs like the body. A null text counts as empty."""

    def __init__(self, spark: SparkSession, root: str, key: str = "doc_id", body: str = "text", title: str | None = None):
        self.spark, self.root, self.key, self.versions = spark, root.rstrip("/"), key, Versions(spark, root)
        self.whole = F.coalesce(F.col(body), F.lit("")) if title is None else F.concat_ws(" ", title, body)

    # State

    def manifest(self) -> Manifest:
        """The last committed state."""
        version, said = self.versions.last()
        return Manifest(version, tuple(said.get("segments", ())), tuple(said.get("dead", ())))

    def _commit(self, before: Manifest, segments: tuple[str, ...], dead: tuple[str, ...]) -> None:
        self.versions.commit(before.version, {"segments": segments, "dead": dead})

    def _of(self, ids: tuple[str, ...], what: str, schema: str) -> DataFrame:
        if not ids:
            return self.spark.createDataFrame([], "segment string, " + schema)
        paths = [f"{self.root}/segments/{i}/{what}" for i in ids]
        return self.spark.read.schema("segment string, " + schema).parquet(*paths)

    def _key_kind(self, state: Manifest) -> str:
        return self.spark.read.parquet(f"{self.root}/segments/{state.segments[0]}/pages").schema["key"].dataType.simpleString()

    def dead(self, state: Manifest) -> DataFrame:
        """(segment, shard, slot) of tombstones."""
        schema = "segment string, shard int, slot int"
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/dead/{i}" for i in state.dead]) if state.dead else self.spark.createDataFrame([], schema)

    def pages(self, state: Manifest | None = None, kind: str = "bigint") -> DataFrame:
        """(segment, shard, slot, key, dl, hash) of live pages."""
        state = state or self.manifest()
        stored = self._of(state.segments, "pages", f"shard int, slot int, key {self._key_kind(state) if state.segments else kind}, dl int, hash string")
        return stored.join(bounded_broadcast(self.dead(state)), ["segment", "shard", "slot"], "left_anti") if state.dead else stored

    def shards(self, state: Manifest, hidden: DataFrame | None = None) -> DataFrame:
        """The rows of shards as stored, dead slots included, and as ``gone`` which of them are in hidden (segment, shard, slot)."""
        kind = self._key_kind(state)
        stored = self._of(state.segments, "postings", SHARD_ROW.format(kind=kind))
        if hidden is None:
            return stored.withColumn("gone", F.lit(None).cast("array<int>"))
        return stored.join(hidden.groupBy("segment", "shard").agg(F.collect_set("slot").alias("gone")), ["segment", "shard"], "left")

    # Writing

    def _store(self, shards: DataFrame) -> str:
        """A segment of these rows of shards; its pages are read from them."""
        name = uuid.uuid4().hex
        shards.withColumn("segment", F.lit(name)).write.parquet(f"{self.root}/segments/{name}/postings")
        stored = self.spark.read.schema(f"segment string, shard int, {shards.select('keys', 'dls', 'hashes').schema.simpleString()[7:-1].replace(':', ' ')}").parquet(f"{self.root}/segments/{name}/postings")
        each = stored.select("segment", "shard", F.posexplode(F.arrays_zip("keys", "dls", "hashes")).alias("slot", "p"))
        each.select("segment", "shard", "slot", F.col("p.keys").alias("key"), F.col("p.dls").alias("dl"), F.col("p.hashes").alias("hash")).write.parquet(f"{self.root}/segments/{name}/pages")
        return name

    def _write_segment(self, pages: DataFrame, count: int, size: int) -> str:
        """A segment of so many pages (key, whole, hash) of so many bytes. Texts move once; a task splits and counts the words of its shard."""
        shards = max(SHARDS, -(-count // SHARD), -(-size // SHARD_BYTES))
        dealt = pages.select(F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"), "key", "hash", F.lower("whole").alias("low")).repartitionById(shards, F.col("shard"))
        return self._store(dealt.sortWithinPartitions("shard", "key").mapInArrow(_build, SHARD_ROW.format(kind=pages.schema["key"].dataType.simpleString())))

    def _hashed(self, pages: DataFrame) -> DataFrame:
        return pages.where(F.col(self.key).isNotNull()).select(F.col(self.key).alias("key"), self.whole.alias("whole")).withColumn("hash", F.sha2("whole", 256))

    def refresh(self, pages: DataFrame) -> dict[str, int]:
        """Makes the index that of these pages (one row a key); returns how many were added, changed, removed and kept."""
        return self._apply(self.manifest(), self._hashed(pages), whole=True)

    def update(self, changed: DataFrame, removed: DataFrame | None = None) -> dict[str, int]:
        """Puts changed pages (the index's columns) in and takes removed ones (the key) out; other pages stay."""
        state = self.manifest()
        gone = None if removed is None else removed.select(F.col(self.key).alias("key"))
        return self._apply(state, self._hashed(changed), whole=False, gone=gone)

    def _apply(self, state: Manifest, now: DataFrame, whole: bool, gone: DataFrame | None = None) -> dict[str, int]:
        kind = now.schema["key"].dataType.simpleString()
        old = self.pages(state, kind).select("segment", "shard", "slot", F.col("key").alias("old_key"), F.col("hash").alias("old_hash"))
        met = now.select("key", "hash", F.octet_length("whole").alias("size")).join(old, F.col("key") == F.col("old_key"), "full")
        change = F.when(F.col("old_key").isNull(), "added").when(F.col("key").isNull(), "removed" if whole else "kept").when(F.col("hash") == F.col("old_hash"), "kept").otherwise("changed")
        if gone is not None:
            met = met.join(gone.distinct().select(F.col("key").alias("gone_key")), F.col("old_key") == F.col("gone_key"), "left")
            change = F.when(F.col("gone_key").isNotNull() & F.col("key").isNull(), "removed").otherwise(change)
        marked = written(met.withColumn("change", change).select("key", "segment", "shard", "slot", "change", "size"), "changes")
        found = {r["change"]: r for r in marked.groupBy("change").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).collect()}
        counts = {c: found[c]["n"] if c in found else 0 for c in ("added", "changed", "removed", "kept")}
        segments, dead = state.segments, state.dead
        if counts["changed"] + counts["removed"]:
            name = uuid.uuid4().hex
            marked.where("change in ('changed', 'removed')").select("segment", "shard", "slot").write.parquet(f"{self.root}/dead/{name}")
            dead = (*dead, name)
        if counts["added"] + counts["changed"]:
            dirty = marked.where("change in ('added', 'changed')").select("key")
            new = now if whole and not counts["kept"] else now.join(bounded_broadcast(dirty), "key", "left_semi")
            size = sum(found[c]["size"] for c in ("added", "changed") if c in found)
            segments = (*segments, self._write_segment(new, counts["added"] + counts["changed"], size))
        if (segments, dead) != (state.segments, state.dead):
            self._commit(state, segments, dead)
        return counts

    def merge(self, most: int = 8, dead_share: float = 0.3) -> int:
        """Rewrites as one: the smallest segments beyond ``most``, and those of which over ``dead_share`` of the pages are dead. Returns how many it merged."""
        state = self.manifest()
        sizes = self._of(state.segments, "pages", "shard int").groupBy("segment").agg(F.count("*").alias("n"))
        gone = self.dead(state).groupBy("segment").agg(F.count("*").alias("gone"))
        rows = sorted(((r["n"] - (r["gone"] or 0), r["segment"], (r["gone"] or 0) > dead_share * r["n"]) for r in sizes.join(gone, "segment", "left").collect()), key=lambda r: r[:2])  # one row a segment
        beyond = len(rows) - most + 1 if len(rows) > most else 0
        chosen = tuple(s for at, (_, s, full_of_dead) in enumerate(rows) if full_of_dead or at < beyond)
        if not chosen:
            return 0
        part = Manifest(state.version, chosen, state.dead)
        kept = tuple(s for s in state.segments if s not in chosen)
        # Whole shards come together, as many as fit one: one row a shard here.
        to, filled, places = 0, 0, []
        for r in self.pages(part).groupBy("segment", "shard").agg(F.count("*").alias("n")).orderBy("segment", "shard").collect():
            if filled and filled + r["n"] > SHARD:
                to, filled = to + 1, 0
            filled += r["n"]
            places.append((r["segment"], r["shard"], to))
        if places:
            moved = self.shards(part, self.dead(state) if state.dead else None).join(F.broadcast(self.spark.createDataFrame(places, "segment string, shard int, to int")), ["segment", "shard"])
            dealt = moved.drop("shard", "segment").repartitionById(to + 1, F.col("to")).sortWithinPartitions("to")
            kept = (*kept, self._store(dealt.mapInArrow(_gather, SHARD_ROW.format(kind=self._key_kind(state)))))
        still = self.dead(state).where(~F.col("segment").isin(*chosen))
        stone = uuid.uuid4().hex
        still.write.parquet(f"{self.root}/dead/{stone}")
        self._commit(state, kept, (stone,) if still.limit(1).count() else ())
        return len(chosen)

    def vacuum(self) -> int:
        """Deletes folders that the last state does not name; for a time when nobody reads or writes."""
        state, n = self.manifest(), 0
        for what, live in (("segments", state.segments), ("dead", state.dead)):
            store, folder = files(self.spark, f"{self.root}/{what}")
            for entry in store.listStatus(folder) if store.exists(folder) else ():
                if entry.getPath().getName() not in live:
                    store.delete(entry.getPath(), True)
                    n += 1
        return n

    # Reading

    def status(self, pages: DataFrame) -> DataFrame:
        """One row (status, action): ``missing``, ``stale`` or ``current`` against these pages."""
        state = self.manifest()
        if not state.version:
            return self.spark.createDataFrame([("missing", "rebuild")], "status string, action string")
        stored, now = self.pages(state).select("key", "hash"), self._hashed(pages).select("key", "hash")
        differs = now.join(stored, ["key", "hash"], "left_anti").limit(1).unionByName(stored.join(now, ["key", "hash"], "left_anti").limit(1))
        stale = differs.agg((F.count("*") > 0).alias("stale"))
        return stale.select(F.when(F.col("stale"), "stale").otherwise("current").alias("status"), F.when(F.col("stale"), "refresh").otherwise("none").alias("action"))

    def search(self, questions: DataFrame, limit: int = 5, among: DataFrame | None = None, k1: float = 1.2, b: float = 0.75, block: int = QUESTIONS) -> DataFrame:
        """(query_id, rank, key, score): the best live pages for each of questions (query_id, text), by BM25, score before key; ``among`` (the key): only these pages are returned, though all count."""
        state = self.manifest()
        kind = questions.schema["query_id"].dataType.simpleString()
        if not state.segments:
            return self.spark.createDataFrame([], f"query_id {kind}, rank int, `{self.key}` bigint, score double")
        live = self.pages(state)
        corpus = live.agg(F.count("*").alias("n"), F.avg("dl").alias("mean")).first()
        asked = written(questions.select("query_id", F.explode(F.array_distinct(T.tokens(F.coalesce(F.col("text"), F.lit(""))))).alias("term")), "asked")
        if state.dead:
            sizes = self.shards(state, self.dead(state)).drop("keys", "hashes").mapInArrow(_live_sizes, "term string, df long")
        else:
            sizes = self.shards(state).select(F.explode(F.arrays_zip("terms", "sizes")).alias("p")).select(F.col("p.terms").alias("term"), F.col("p.sizes").alias("df"))
        frequency = sizes.join(bounded_broadcast(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        idf = F.log(1 + (F.lit(corpus["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        many = asked.agg(F.count_distinct("query_id").alias("n"), F.count("*").alias("terms")).first()
        blocks = max(1, -(-many["n"] // block), -(-many["terms"] // TERMS))
        hidden = self.dead(state) if state.dead else None
        if among is not None:
            others = live.join(among.select(F.col(self.key).alias("key")), "key", "left_anti").select("segment", "shard", "slot")
            hidden = others if hidden is None else hidden.unionByName(others)
        shards = self.shards(state, hidden)
        cells = max(1, min(shards.select("shard").count(), CELLS * self.spark.sparkContext.defaultParallelism))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        weighed = asked.join(frequency, "term").groupBy("query_id").agg(F.collect_set(F.struct("term", idf.alias("idf"))).alias("x"))
        asks = weighed.select((F.pmod(F.xxhash64("query_id"), F.lit(blocks)) * cells).cast("int").alias("first"), "query_id", F.col("x.term").alias("terms"), F.col("x.idf").alias("idfs"), every(cells).alias("own"))
        own = F.pmod(F.col("shard") + F.pmod(F.crc32("segment"), F.lit(cells)).cast("int"), F.lit(cells))
        placed = shards.drop("hashes").select("*", own.alias("own"), every(blocks).alias("of")).withColumn("cell", (F.col("of") * cells + F.col("own")).cast("int")).drop("segment", "shard", "own", "of")
        rows = asks.withColumn("cell", F.col("first") + F.col("own")).drop("first", "own").withColumn("is_shard", F.lit(False)).unionByName(placed.withColumn("is_shard", F.lit(True)), allowMissingColumns=True)
        kinds = {"query_id": questions.schema["query_id"].dataType, "key": live.schema["key"].dataType}
        dealt = rows.repartitionById(blocks * cells, F.col("cell")).sortWithinPartitions("cell", "is_shard")
        top = dealt.mapInArrow(_scorer(limit, float(corpus["mean"] or 1.0), k1, b, *map(to_arrow_type, kinds.values())), f"query_id {kind}, key {kinds['key'].simpleString()}, score double")
        ranked = top.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "key"))).where(F.col("rank") <= limit)
        return ranked.select("query_id", "rank", F.col("key").alias(self.key), "score")
