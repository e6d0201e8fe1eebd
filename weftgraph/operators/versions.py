"""Tables that change as a whole: data files are written aside, one small manifest file makes them the state.

``manifests/<version>.json`` names the folders that are live. A commit writes the
next manifest under a hidden name and renames it to a name that must be free, so
readers see the state before or after it, a writer that stops leaves the old one,
and of two writers of one version the second fails with ``Conflict``. Files go
through Hadoop's file systems: any store that Spark writes will do, as long as it
renames without replacing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has committed this version."""


def files(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsc.hadoopConfiguration()), made


class Versions:
    """The manifests of a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def last(self) -> tuple[int, dict]:
        """(version, what its manifest says); (0, {}) before the first commit."""
        store, folder = files(self.spark, f"{self.root}/manifests")
        if not store.exists(folder):
            return 0, {}
        names = [s.getPath().getName() for s in store.listStatus(folder)]
        last = max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit()), default=0)
        return (last, json.loads(self.spark.read.text(f"{self.root}/manifests/{last:012d}.json", wholetext=True).first()[0])) if last else (0, {})

    def commit(self, before: int, said: dict) -> int:
        """Makes ``said`` the version after ``before``."""
        store, target = files(self.spark, f"{self.root}/manifests/{before + 1:012d}.json")
        _, aside = files(self.spark, f"{self.root}/manifests/.{uuid.uuid4().hex}")
        stream = store.create(aside, True)
        stream.write(bytearray(json.dumps(said).encode()))
        stream.close()
        if store.exists(target) or not store.rename(aside, target):
            store.delete(aside, False)
            raise Conflict(f"version {before + 1} is taken")
        return before + 1


class Tables(Versions):
    """Named tables of one folder that are committed together."""

    def read(self, name: str, schema: str | None = None) -> DataFrame | None:
        """The table as last committed; where there is none, an empty one of this schema, or None."""
        path = self.last()[1].get("tables", {}).get(name)
        if path:
            return self.spark.read.parquet(f"{self.root}/{path}")
        return None if schema is None else self.spark.createDataFrame([], schema)

    def done(self, token: tuple[str, int]) -> bool:
        """Whether this writer has committed this number or a later one."""
        return self.last()[1].get("tokens", {}).get(token[0], -1) >= token[1]

    def commit_tables(self, changed: dict[str, DataFrame], token: tuple[str, int] | None = None) -> bool:
        """Replaces the named tables as one step; other tables stay. A token (writer, rising number) that was committed before changes nothing: False."""
        before, said = self.last()
        if token is not None and said.get("tokens", {}).get(token[0], -1) >= token[1]:
            return False
        paths = {}
        for name, df in changed.items():
            paths[name] = f"data/{name}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{paths[name]}")
        self.commit(before, {"tables": said.get("tables", {}) | paths, "tokens": said.get("tokens", {}) | ({token[0]: token[1]} if token else {})})
        return True

    def upsert(self, name: str, key: str, rows: DataFrame, removed: DataFrame | None = None, token: tuple[str, int] | None = None) -> dict[str, int]:
        """Puts rows (one a key) in the table in place of those with their keys, and takes removed keys out; returns how many were added, changed, removed. Without a difference nothing is committed."""
        old = self.read(name, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema))
        whole = lambda df: F.xxhash64(*[F.col(c) for c in sorted(rows.columns)])  # noqa: E731, ARG005
        met = rows.select(key, whole(rows).alias("_new")).join(old.select(F.col(key).alias("_key"), whole(old).alias("_old")), F.col(key) == F.col("_key"), "full")
        counts = met.agg(F.count_if(F.col("_old").isNull()).alias("added"), F.count_if(F.col("_new") != F.col("_old")).alias("changed")).first()
        gone = 0 if removed is None else old.join(removed.select(key).distinct(), key, "left_semi").join(rows.select(key), key, "left_anti").count()
        if counts["added"] + counts["changed"] + gone or (token and not self.done(token)):
            rest = old.join(rows.select(key), key, "left_anti")
            rest = rest if removed is None else rest.join(removed.select(key), key, "left_anti")
            if not self.commit_tables({name: rest.unionByName(rows.select(*old.columns))}, token):
                return {"added": 0, "changed": 0, "removed": 0}
        return {"added": counts["added"], "changed": counts["changed"], "removed": gone}

    def change(self, name: str, make: Callable[[DataFrame], DataFrame], differs: Callable[[DataFrame, DataFrame], bool] | None = None) -> bool:
        """Commits what ``make`` makes of the table, unless it is the same rows (or ``differs`` says so)."""
        old = self.read(name)
        if old is None:
            return False
        new = make(old).select(*old.columns)
        is_new = differs(old, new) if differs else bool(new.exceptAll(old).limit(1).count() or old.exceptAll(new).limit(1).count())
        return is_new and self.commit_tables({name: new})
