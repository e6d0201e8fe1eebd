"""Session helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """Makes checkpoint() usable: the folder named in spark.checkpoint.dir, a temporary one only where none is set (tests)."""
    if not spark.sparkContext.getCheckpointDir():
        if not spark.conf.get("spark.checkpoint.dir", None) and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="weft-checkpoints-"))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or that of the session's checkpoints."""
    return (spark.conf.get("spark.checkpoint.dir", None) or with_checkpoints(spark).sparkContext.getCheckpointDir()).rstrip("/")


def written(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, and lost executors lose none of it."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_broadcast(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """A broadcast hint where df has at most this many rows, else df as it is for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def narrow_side(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """The few distinct keys that a join looks up for many rows: broadcast where they are at most so many, else hashed by partition, so that the many rows are shuffled but not sorted."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("shuffle_hash")


def local_session(cpus: int = 8, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", memory).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
