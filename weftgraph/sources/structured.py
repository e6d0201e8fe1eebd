"""Tables, notebooks, JSON, HTML and code as rows."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"^\s*-?\d+(\.\d+)?([eE][+-]?\d+)?\s*$"


def header_names(rows: DataFrame, key: str = "id", cells: str = "cells") -> DataFrame:
    """(key, names) of tables given as rows (key, at, cells): the first row's cells if they are all set and unique, at least half are no numbers and more rows follow; else column_1, column_2, ..."""
    summary = rows.groupBy(key).agg(F.min_by(cells, "at").alias("first"), F.count("*").alias("n"))
    set_ = F.forall("first", lambda c: F.trim(F.coalesce(c, F.lit(""))) != "")
    unique = F.size(F.array_distinct("first")) == F.size("first")
    words = F.size(F.filter("first", lambda c: ~c.rlike(NUMBER)))
    is_header = set_ & unique & (words >= F.ceil(F.size("first") / 2)) & (F.col("n") > 1)
    return summary.select(key, is_header.alias("has_header"), F.when(is_header, F.col("first")).otherwise(F.transform("first", lambda _, i: F.concat(F.lit("column_"), i + 1))).alias("names"))


def column_hints(df: DataFrame, few: int = 6) -> DataFrame:
    """(column, hint, distinct_values): number if all set values are numbers, category with ``few`` values or less, else text. One pass over df."""
    text = lambda c: F.col(c).cast("string")
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), text(c).alias("v")) for c in df.columns])).alias("x")
    counts = df.select(one).select("x.column", "x.v").where("v is not null").groupBy("column", "v").agg(F.count("*").alias("n"))
    hint = F.when(F.min(F.col("v").rlike(NUMBER)), "number").when(F.count("*") <= few, "category").otherwise("text")
    return counts.groupBy("column").agg(hint.alias("hint"), F.count("*").alias("distinct_values"))


def notebook_cells(notebooks: DataFrame, key: str = "id", text: str = "text", most: int = 1_200) -> DataFrame:
    """(key, at, kind, source, output) of Jupyter notebooks; text outputs, cut."""
    lines = "array<string>"
    shape = f"cells array<struct<cell_type: string, source: {lines}, outputs: array<struct<text: {lines}>>>>"
    cells = notebooks.select(key, F.posexplode(F.from_json(text, shape)["cells"]).alias("at", "c"))
    said = F.array_join(F.flatten(F.transform(F.coalesce("c.outputs", F.array().cast("array<struct<text: array<string>>>")), lambda o: F.coalesce(o["text"], F.array().cast(lines)))), "")
    return cells.select(key, "at", F.col("c.cell_type").alias("kind"), F.array_join("c.source", "").alias("source"), F.substring(said, 1, most).alias("output"))


def _shape(value) -> tuple[str, int, int]:
    if isinstance(value, dict):
        return "object", len(value), 1 + max((_shape(v)[2] for v in value.values()), default=0)
    if isinstance(value, list):
        return "array", len(value), 1 + max((_shape(v)[2] for v in value), default=0)
    return type(value).__name__, 1, 0


def json_shapes(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, kind, size, depth) of JSON texts; kind ``invalid`` for others."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, t in zip(batch["k"], batch["t"], strict=True):
                try:
                    rows.append((k, *_shape(json.loads(t))))
                except (TypeError, ValueError):
                    rows.append((k, "invalid", 0, 0))
            yield pd.DataFrame(rows, columns=["k", "kind", "size", "depth"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(work, f"k {kind}, kind string, size long, depth long").withColumnRenamed("k", key)


class _Markdown(HTMLParser):
    SKIP = {"script", "style", "head", "noscript", "template"}
    BREAKS = {"p", "div", "li", "br", "tr", "article", "section", "ul", "ol", "table", "nav", "footer", "header"}

    def __init__(self) -> None:
        super().__init__()
        self.out: list[str] = []
        self.skip = 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in self.SKIP
        if re.fullmatch("h[1-6]", tag):
            self.out.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in self.BREAKS:
            self.out.append("\n- " if tag == "li" else "\n\n" if tag != "br" else "\n")

    def handle_endtag(self, tag):
        self.skip -= tag in self.SKIP and self.skip > 0
        if re.fullmatch("h[1-6]", tag) or tag in self.BREAKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(re.sub(r"\s+", " ", data))


def html_to_markdown(html: str | None) -> str:
    p = _Markdown()
    p.feed(html or "")
    p.close()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", "".join(p.out))).strip()


def markdown_of_pages(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    @F.pandas_udf("string")
    def convert(c: pd.Series) -> pd.Series:
        return c.map(html_to_markdown)

    return pages.select(key, convert(html).alias("markdown"))


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, href), distinct."""
    return pages.select(key, F.explode(F.regexp_extract_all(html, F.lit(r'<a\s[^>]*?href="([^"]*)"'), F.lit(1))).alias("href")).distinct()


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


SYMBOLS = "array<struct<kind: string, name: string, line: int>>"


def python_symbols(source: str | None) -> list[tuple[str, str, int]]:
    """Imports, functions and classes of Python code; [] if it does not parse."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError):
        return []
    found = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            found += [("import", a.name, node.lineno) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            found.append(("import", "." * node.level + (node.module or ""), node.lineno))
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            found.append(("function", node.name, node.lineno))
        elif isinstance(node, ast.ClassDef):
            found.append(("class", node.name, node.lineno))
    return sorted(found, key=lambda x: (x[2], x[0], x[1]))


def code_symbols(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, kind, name, line) of Python files."""

    @F.pandas_udf(SYMBOLS)
    def read(c: pd.Series) -> pd.Series:
        return c.map(lambda s: [{"kind": k, "name": n, "line": line} for k, n, line in python_symbols(s)])

    return files.select(key, F.explode(read(text)).alias("s")).select(key, "s.kind", "s.name", "s.line")


def sql_lineage(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, relation, object): tables and views that SQL text makes, reads, joins and writes."""
    bare = F.lower(F.regexp_replace(F.regexp_replace(F.col(text), "--[^\n]*", " "), r"(?s)/\*.*?\*/", " "))
    name = r"([a-z_][a-z0-9_.]*)"
    rules = {"defines": rf"\bcreate\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:table|view)\s+(?:if\s+not\s+exists\s+)?{name}", "reads": rf"\bfrom\s+{name}", "joins": rf"\bjoin\s+{name}", "writes": rf"\b(?:insert\s+into|update|delete\s+from|merge\s+into)\s+{name}"}

    def named(relation: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(bare, F.lit(pattern), F.lit(1)), lambda o: F.struct(F.lit(relation).alias("relation"), o.alias("object")))

    found = [named(r, p) for r, p in rules.items()]
    return files.select(key, F.explode(F.concat(*found)).alias("x")).select(key, "x.relation", "x.object").distinct()
