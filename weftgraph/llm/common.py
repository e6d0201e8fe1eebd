"""Helpers that the operators of this package share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 2_000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only in a single process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="weft-shared-")
    return _OWN[app]


def written(df: DataFrame, label: str, **options: object) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, so lost executors lose none of it. options: those of the writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Fewer rows in an Arrow batch than Spark's 10,000: texts are long, and both sides hold a batch whole. A smaller setting stays."""
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= BATCH_ROWS:
        spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for what runs meanwhile, where a row alone is large."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def crc32_mod(key: Column, mod: int) -> Column:
    """crc32 of the key's decimal text, modulo; a null key counts as 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % F.lit(mod), F.lit(0))


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint where df has at most this many rows, else df as it is for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def joined_by(left: DataFrame, names: DataFrame, key: str, n: str, share: int = 1_000) -> DataFrame:
    """left joined with names, which has one row a key and, as ``n``, how many rows of left that key has; ``n`` is not returned.

    Keys that hold over 1/share of the rows are under ``share`` in number, so they
    are broadcast and their rows stay where they are; only rows of other keys are shuffled.
    """
    total = names.agg(F.coalesce(F.sum(n), F.lit(0)).alias("total")).first()["total"]
    hot = F.broadcast(names.where(F.col(n) * share > total).drop(n))
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(names.where(F.col(n) * share <= total).drop(n), key))


def without(df: DataFrame, names: Iterable[str], keep: Iterable[str] = ()) -> DataFrame:
    """df less the columns whose names, whatever their case, results are about to take; those in ``keep`` stay."""
    taken = {x.lower() for x in names} - {x.lower() for x in keep}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def slot_free(names: Iterable[str], base: str) -> str:
    """A column name that starts as ``base`` and clashes with none of ``names``."""
    taken = {n.lower() for n in names}
    while base.lower() in taken:
        base += "_"
    return base
