"""Ignore files as a join: their lines become anchored expressions, paths meet them on the folders above.

Rows of rule files are (dir, kind, text), dir relative to the root and '' for it.
Within one file the last matching line wins and ``!`` takes back; what lies under
an ignored folder stays ignored, whatever later lines say. Of several files each
decides for what lies below it, and one that ignores is enough. An include file
lists exceptions from both.

Each folder and file is tested once against the lines of the files above it; a
file is ignored if it or a folder above it is. So work grows with folders and
files, not with their depth times the number of lines.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.versions import files as files_of
from weftgraph.session import bounded_broadcast, written

RULE = "expression string, negated boolean, dir_only boolean"
GIT, CUSTOM, INCLUDE = "gitignore", "ignore", "include"
# The names of rule files.
NAMES = {".gitignore": GIT, ".weftignore": CUSTOM, ".weftinclude": INCLUDE}


def expression(line: str) -> tuple[str, bool, bool] | None:
    """(expression for a whole relative path, negated, for folders only) of one line; None for blank lines and remarks.

    ``*`` and ``?`` stay within a name, ``**`` crosses folders; a slash that is not the last sign ties the pattern to the file's folder.
    """
    line = re.sub(r"(?<!\\) +$", "", line.rstrip("\r\n").replace("\t", " "))
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    if line[:2] in ("\\#", "\\!"):
        line = line[1:]
    dir_only = line.endswith("/")
    line = line.rstrip("/") if dir_only else line
    if not line:
        return None
    tied = "/" in line
    line = line.removeprefix("/")
    out, at = "" if tied else "(?:.*/)?", 0
    while at < len(line):
        rest = line[at:]
        if rest.startswith("**/") and (at == 0 or line[at - 1] == "/"):
            out, at = out + "(?:.*/)?", at + 3
        elif rest == "**" and (at == 0 or line[at - 1] == "/"):
            out, at = out + ".+", at + 2
        elif rest[0] == "*":
            at += len(rest) - len(rest.lstrip("*"))
            out += "[^/]*"
        elif rest[0] == "?":
            out, at = out + "[^/]", at + 1
        elif rest[0] == "[" and (closed := re.match(r"\[([!^]?)(\]?[^\]/]*)\]", rest)):
            inside = re.sub(r"([\\\[\]&^])", r"\\\1", closed[2])
            out, at = out + f"[{'^/' if closed[1] else ''}{inside}]", at + closed.end()
        elif rest[0] == "\\" and len(rest) > 1:
            out, at = out + re.escape(rest[1]), at + 2
        else:
            out, at = out + (re.escape(rest[0]) if rest[0] in r"\.^$+{}()|[]&~#-" else rest[0]), at + 1
    return f"^{out}$", negated, dir_only


def rules(files: DataFrame) -> DataFrame:
    """(dir, kind, at, expression, negated, dir_only) of rule files (dir, kind, text)."""

    @F.pandas_udf(RULE)
    def compiled(lines: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([expression(x) or (None, None, None) for x in lines], columns=["expression", "negated", "dir_only"])

    lines = files.where("text is not null").select("dir", "kind", F.posexplode(F.split("text", "\r?\n")).alias("at", "line"))
    return lines.select("dir", "kind", "at", compiled("line").alias("r")).select("dir", "kind", "at", "r.*").where("expression is not null")


def _above(path: str = "path"):
    """All folders above a path, the root as ''."""
    names = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda n: F.array_join(F.slice(names, 1, n), "/"))


def ignored(paths: DataFrame, files: DataFrame, input_dir: str = "") -> DataFrame:
    """(path, kind): which paths (relative to the root) rule files of which kind match; kind is that of the rule file, ``include`` for exceptions.

    Lines of custom and include files above ``input_dir`` also hold for paths relative to it.
    """
    own = written(rules(files), "rules")
    folders = paths.select(F.explode(_above()).alias("node")).where("node <> ''").distinct().withColumn("is_dir", F.lit(True))
    nodes = folders.unionByName(paths.select(F.col("path").alias("node"), F.lit(False).alias("is_dir")).distinct())
    under = nodes.select("node", "is_dir", F.explode(_above("node")).alias("dir"))
    relative = F.when(F.col("dir") == "", F.col("node")).otherwise(F.substr("node", F.length("dir") + 2))
    seen = under.select("node", "is_dir", "dir", F.lit("anchor").alias("view"), relative.alias("rel"))
    if input_dir:
        inside = F.col("node").startswith(input_dir + "/") & ((F.col("dir") == "") | F.lit(input_dir).startswith(F.concat("dir", F.lit("/"))))
        seen = seen.unionByName(under.where(inside).select("node", "is_dir", "dir", F.lit("input").alias("view"), F.substr("node", F.lit(len(input_dir) + 2)).alias("rel")))
    met = seen.join(bounded_broadcast(own), "dir").where((F.col("view") == "anchor") | (F.col("kind") != GIT)).where(F.col("is_dir") | ~F.col("dir_only")).where(F.expr("rel rlike expression"))
    last = met.groupBy("node", "dir", "kind", "view").agg(F.max_by("negated", "at").alias("negated")).where("not negated").select("node", "kind").distinct()
    hit = bounded_broadcast(written(last, "ignored"))
    every = paths.select("path", F.explode(F.concat(F.filter(_above(), lambda x: x != ""), F.array("path"))).alias("node"))
    return every.join(hit, "node").select("path", "kind").distinct()


def ignore_reasons(paths: DataFrame, files: DataFrame, input_dir: str = "", git: bool = True, custom: bool = True) -> DataFrame:
    """paths with ``ignore_reason``, null for those that stay: rule files themselves (``ignore``, ``include``), then gitignore, then the custom file, both unless an include file names the path."""
    active = files.where(F.col("kind").isin([k for k, on in ((GIT, git), (CUSTOM, custom), (INCLUDE, True)) if on]))
    by = ignored(paths, active, input_dir).groupBy("path").agg(F.collect_set("kind").alias("_kinds"))  # three at most
    name = F.element_at(F.split("path", "/"), -1)
    has = lambda k: F.array_contains("_kinds", k)
    reason = F.when(name.isin([n for n, k in NAMES.items() if k != GIT]), F.when(name == ".weftinclude", INCLUDE).otherwise(CUSTOM)).when(F.col("_kinds").isNull() | has(INCLUDE), F.lit(None)).when(has(GIT), GIT).when(has(CUSTOM), CUSTOM)
    return paths.join(by, "path", "left").withColumn("ignore_reason", reason).drop("_kinds")


def rule_files(spark: SparkSession, root: str, depth: int) -> DataFrame:
    """(dir, kind, text) of the rule files under root, in folders up to this depth.

    Spark's readers pass over names that begin with a dot, so these few files are
    found by their names and read where Spark lists files, on the driver.
    """
    store, base = files_of(spark, root)
    top, jvm, rows = store.makeQualified(base).toString().rstrip("/"), spark._jvm, []
    for d in range(depth + 1):
        pattern = jvm.org.apache.hadoop.fs.Path(f"{top}{'/*' * d}/{{{','.join(NAMES)}}}")
        for status in store.globStatus(pattern) or ():
            path = status.getPath()
            stream = store.open(path)
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            rows.append((path.getParent().toString()[len(top) :].strip("/"), NAMES[path.getName()], text))
    return spark.createDataFrame(rows, "dir string, kind string, text string")
