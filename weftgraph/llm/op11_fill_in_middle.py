"""Fill-in-middle transformation by a two-pass streaming matcher in constant memory.

A text is a sequence of units, the matches of a pattern from left to right (code
points by default). The first pass runs through a lazy match iterator and only
counts; two ranks among 0 to n are drawn from a hash of the document's id; the
second pass starts a new iterator and advances it to the smaller and then to the
larger rank, whose places cut the text. Beside the text and its output no unit,
offset or list of them is ever held, however long the text is.

Draws: h1 to h4 are the first four groups of eight hex digits of the SHA-256 of
``seed:doc_id``. The prefix has min(h1, h2) units (each modulo n + 1), the middle
goes to the larger rank, the suffix is the rest. h3 decides whether the document
is transformed at all, h4 the order of the pieces: ``psm`` is prefix, suffix,
middle, ``spm`` is suffix, prefix, middle, each piece behind its sentinel.

The transformation needs no shuffle: each text is cut where it is read.

Defined cases: a null text counts as empty. Empty texts and texts that hold a
sentinel stay plain, so that every output can be turned back. A null id is drawn
from the empty string (the hash of ``1:``). Repeated rows give repeated rows.
Other columns are ignored. What stands between units of a pattern that does not
match everything belongs to the piece of the unit before it; what stands before
the first unit, to the first piece that has a unit.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import bounded_batches, table

UNIT = r"(?s:.)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, PLAIN_FROM, SPM_BELOW = 1, 90, 20


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[at : at + 8], 16) for at in (0, 8, 16, 24))


def count_units(pattern: re.Pattern, text: str) -> int:
    """First pass: the matches are counted and forgotten."""
    n = 0
    for _ in pattern.finditer(text):
        n += 1
    return n


def places(pattern: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """Second pass: where the units of rank low and high (low <= high) begin, one lazy iterator advanced to both; the end of the text if there is no such unit."""
    units = pattern.finditer(text)
    at = next(islice(units, low, None), None)
    if at is None:
        return len(text), len(text)
    to = at if high == low else next(islice(units, high - low - 1, None), None)
    return at.start(), to.start() if to else len(text)


def cut(doc_id: int | None, text: str, pattern: re.Pattern, seed: int = SEED) -> tuple[int, str, int, int]:
    """(number of units, form, end of prefix, end of middle); the ends are offsets in the text, 0 if plain."""
    n = count_units(pattern, text)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= PLAIN_FROM:
        return n, "plain", 0, 0
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, "spm" if h4 % 100 < SPM_BELOW else "psm", *(places(pattern, text, low, high) if low else (0, places(pattern, text, high, high)[0] if high else 0))


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = UNIT, seed: int = SEED) -> DataFrame:
    """(key, n_units, form, prefix_chars, middle_chars, output): one row for each row of docs; piece lengths in code points, null if plain."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(unit)
        for batch in batches:
            rows: dict[str, list] = {c: [] for c in ("n_units", "form", "prefix_chars", "middle_chars", "output")}
            for doc_id, value in zip(batch.column("k"), batch.column("text"), strict=True):
                whole = value.as_py() or ""
                n, form, low, high = cut(doc_id.as_py(), whole, pattern, seed)
                pieces = whole[:low], whole[low:high], whole[high:]
                if form == "plain":
                    output = whole
                elif form == "psm":
                    output = f"{PREFIX}{pieces[0]}{SUFFIX}{pieces[2]}{MIDDLE}{pieces[1]}"
                else:
                    output = f"{SUFFIX}{pieces[2]}{PREFIX}{pieces[0]}{MIDDLE}{pieces[1]}"
                for name, x in zip(rows, (n, form, None if form == "plain" else low, None if form == "plain" else high - low, output), strict=True):
                    rows[name].append(x)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(rows["n_units"], pa.int64()), pa.array(rows["form"], pa.string()), pa.array(rows["prefix_chars"], pa.int64()), pa.array(rows["middle_chars"], pa.int64()), pa.array(rows["output"], pa.string())], ["k", *rows])

    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    made = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).mapInArrow(make, f"k {kind}, n_units long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("k", key)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from. Sentinels have no border of their own, so the first of each kind is the one that was put in."""
    first, second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX)), F.lit(MIDDLE)
    step = len(PREFIX)
    turn, middle = F.position(first, output), F.position(second, output)
    head, tail, rest = F.substring(output, F.lit(step + 1), turn - step - 1), F.substring(output, turn + step, middle - turn - step), F.substring(output, middle + step, F.char_length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(head, rest, tail)).otherwise(F.concat(tail, rest, head))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


ORACLES = {
    "op11_fill_in_middle": f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT *, ('0x' || s[1:8])::BIGINT % (n + 1) AS r1, ('0x' || s[9:16])::BIGINT % (n + 1) AS r2, ('0x' || s[17:24])::BIGINT % 100 AS r3, ('0x' || s[25:32])::BIGINT % 100 AS r4 FROM d),
f AS (SELECT *, least(r1, r2) AS a, greatest(r1, r2) AS b, CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR r3 >= {PLAIN_FROM} THEN 'plain' WHEN r4 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS x, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS z FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || x || '{SUFFIX}' || z || '{MIDDLE}' || m ELSE '{SUFFIX}' || z || '{PREFIX}' || x || '{MIDDLE}' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
}
