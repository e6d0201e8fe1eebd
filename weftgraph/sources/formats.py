"""Document formats that the standard library can read, each as rows: tables, books, office files, bibliographies, markup, settings."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.sources.structured import html_to_markdown

PREVIEW_ROWS, SHEETS = 20, 10
# Front-matter keys that are content.
CONTENT_KEYS = ("title", "description", "tags", "aliases", "authors", "author", "date", "status", "category")
OFFICE_TEXT = {"docx": r"word/document\.xml", "pptx": r"ppt/slides/slide\d+\.xml", "odt": r"content\.xml", "odp": r"content\.xml"}
PARAGRAPHS = ("p", "h")


def _rows(files: DataFrame, read: Callable, columns: str, key: str, content: str) -> DataFrame:
    """Rows that ``read`` makes of each file's content, with the file's key first and ``problem`` null; a file that it can't read gives one row of nulls that says why."""
    kind = files.schema[key].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = re.findall(r"(\w+) ([\w<>]+)(?:, |$)", columns)
        names, types = ["k", *[n for n, _ in pairs], "problem"], ["", *[t for _, t in pairs], "string"]
        for batch in batches:
            made = []
            for k, c in zip(batch["k"], batch["c"], strict=True):
                try:
                    made += [(k, *row, None) for row in read(c)]
                except (ValueError, KeyError, TypeError, AttributeError, zipfile.BadZipFile, ElementTree.ParseError, csv.Error) as error:
                    made.append((k, *[None] * (len(names) - 2), f"{type(error).__name__}: {error}"[:200]))
            frame = pd.DataFrame(made, columns=names)
            yield frame.astype({n: "Int64" for n, t in zip(names, types, strict=True) if t == "long"})

    return files.select(F.col(key).alias("k"), F.col(content).alias("c")).mapInPandas(work, f"k {kind}, {columns}, problem string").withColumnRenamed("k", key)


def csv_rows(files: DataFrame, key: str = "path", content: str = "text") -> DataFrame:
    """(key, at, cells): the rows of CSV or TSV texts; ``header_names`` tells which have a header, ``column_hints`` what columns hold."""

    def read(text: str) -> Iterator[tuple]:
        delimiter = "\t" if text.split("\n", 1)[0].count("\t") > text.split("\n", 1)[0].count(",") else ","
        return ((at, row) for at, row in enumerate(r for r in csv.reader(io.StringIO(text), delimiter=delimiter) if r))

    return _rows(files, read, "at long, cells array<string>", key, content)


def preview(rows: DataFrame, key: str = "path", most: int = PREVIEW_ROWS) -> DataFrame:
    """(key, n_rows, table): the first rows as a table of Markdown."""
    head = F.transform(F.array_sort(F.collect_list(F.when(F.col("at") < most, F.struct("at", "cells")))), lambda r: F.concat(F.lit("| "), F.array_join(r["cells"], " | "), F.lit(" |")))
    return rows.where("at is not null").groupBy(key).agg(F.count("*").alias("n_rows"), F.array_join(head, "\n").alias("table"))


def _column(reference: str | None, after: int) -> int:
    """The place of a cell by its reference (``C7`` is 2); without one, the place after the last."""
    letters = re.match(r"[A-Z]+", reference or "")
    if not letters:
        return after
    place = 0
    for sign in letters[0]:
        place = place * 26 + ord(sign) - 64
    return place - 1


def sheet_rows(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, sheet, at, cells) of the first ten sheets of xlsx workbooks; cells stand by their references, empty ones between are empty."""

    def read(data: bytes) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(data)) as book:
            there = set(book.namelist())
            words = [_text(x) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in there else []
            sheets = [x for x in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if x.tag.endswith("}sheet")]
            links = {x.get("Id"): x.get("Target", "") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))} if "xl/_rels/workbook.xml.rels" in there else {}
            for number, sheet in enumerate(sheets[:SHEETS], 1):
                target = links.get(next((v for k, v in sheet.items() if k.endswith("}id")), None), f"worksheets/sheet{number}.xml")
                for at, row in enumerate(x for x in ElementTree.fromstring(book.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter() if x.tag.endswith("}row")):
                    cells: list[str] = []
                    for c in row:
                        place = _column(c.get("r"), len(cells))
                        cells += [""] * (place + 1 - len(cells))
                        cells[place] = words[int(_text(c))] if c.get("t") == "s" and _text(c) else _text(c)
                    yield sheet.get("name"), at, cells

    return _rows(files, read, "sheet string, at long, cells array<string>", key, content)


def _text(x: ElementTree.Element) -> str:
    return "".join(x.itertext()).strip()


def office_text(files: DataFrame, kind: str, key: str = "path", content: str = "content") -> DataFrame:
    """(key, at, text): paragraphs of docx, pptx, odt or odp files, in order."""

    def read(data: bytes) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(data)) as book:
            parts = sorted((n for n in book.namelist() if re.fullmatch(OFFICE_TEXT[kind], n)), key=lambda n: [int(d) for d in re.findall(r"\d+", n)])
            said = (_text(x) for part in parts for x in ElementTree.fromstring(book.read(part)).iter() if x.tag.rpartition("}")[2] in PARAGRAPHS)
            yield from ((at, t) for at, t in enumerate(t for t in said if t))

    return _rows(files, read, "at long, text string", key, content)


def book_chapters(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, part_index, title, text): chapters of EPUB books in the order of the spine; navigation and tables of contents are left out."""

    def read(data: bytes) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(data)) as book:
            package = next(x.get("full-path") for x in ElementTree.fromstring(book.read("META-INF/container.xml")).iter() if x.tag.endswith("}rootfile"))
            folder, root = package.rpartition("/")[0], ElementTree.fromstring(book.read(package))
            items = {x.get("id"): x for x in root.iter() if x.tag.endswith("}item")}
            at = 0
            for ref in (x.get("idref") for x in root.iter() if x.tag.endswith("}itemref")):
                item = items.get(ref)
                if item is None or "html" not in (item.get("media-type") or "") or "nav" in (item.get("properties") or "").split():
                    continue
                html = book.read(f"{folder}/{item.get('href')}" if folder else item.get("href")).decode("utf-8", "replace")
                said = re.search(r"(?is)<(?:title|h1)[^>]*>(.*?)</", html)
                title = " ".join(re.sub("<[^>]*>", "", said[1]).split()) if said else item.get("href")
                if title.lower() != "table of contents":
                    at += 1
                    yield at, title, html_to_markdown(html)

    return _rows(files, read, "part_index long, title string, text string", key, content)


def bibliography(files: DataFrame, key: str = "path", content: str = "text") -> DataFrame:
    """(key, at, kind, cite, title, author, year) of BibTeX entries."""

    def read(text: str) -> Iterator[tuple]:
        for at, m in enumerate(re.finditer(r"@(\w+)\s*\{\s*([^,\s]+)\s*,(.*?)\n\}|@(\w+)\s*\{\s*([^,\s]+)\s*,(.*?)\}\s*(?=@|$)", text, re.S)):
            kind, cite, body = (m[1], m[2], m[3]) if m[1] else (m[4], m[5], m[6])
            if kind.lower() not in ("comment", "preamble", "string"):
                fields = {k.lower(): " ".join(re.sub(r"[{}]", "", a or b or c).split()) for k, a, b, c in re.findall(r"(\w+)\s*=\s*(?:\{((?:[^{}]|\{[^{}]*\})*)\}|\"([^\"]*)\"|(\w+))", body)}
                yield at, kind.lower(), cite, fields.get("title"), fields.get("author"), fields.get("year")

    return _rows(files, read, "at long, kind string, cite string, title string, author string, year string", key, content)


def rtf_to_text(text: str) -> str:
    text = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info|\*)(?:[^{}]|\{[^{}]*\})*\}", "", text)
    text = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), text)
    text = re.sub(r"\\u(-?\d+) ?\??", lambda m: chr(int(m[1]) % 65_536), text)
    text = re.sub(r"\\(?:par|line)\b ?", "\n", text)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[{}]", "", re.sub(r"\\[a-zA-Z]+-?\d* ?|\\[^a-zA-Z]", "", text))).strip()


def org_to_markdown(text: str) -> str:
    text = re.sub(r"(?im)^#\+(?!title:)\w+:?.*\n?", "", re.sub(r"(?im)^#\+title:\s*(.*)$", r"# \1", text))
    text = re.sub(r"(?m)^(\*+) (?:TODO |DONE )?", lambda m: "#" * len(m[1]) + " ", text)
    return re.sub(r"\[\[([^\]]*)\]\[([^\]]*)\]\]", r"[\2](\1)", re.sub(r"(?ms)^:[A-Z]+:$.*?^:END:$\n?", "", text)).strip()


def asciidoc_to_markdown(text: str) -> str:
    text = re.sub(r"(?m)^(=+) ", lambda m: "#" * len(m[1]) + " ", re.sub(r"(?m)^(?::[\w-]+:.*|//(?!/).*)\n?", "", text))
    return re.sub(r"(?:link:)?(https?://[^\s\[]+)\[([^\]]*)\]", r"[\2](\1)", re.sub(r"(?m)^(?:-{4,}|\.{4,}|={4,})$\n?", "", text)).strip()


def rst_to_markdown(text: str) -> str:
    """Headings by their adornments, in the order in which these appear."""
    lines, out, levels = text.split("\n"), [], []
    bar = lambda s: bool(re.fullmatch(r"([=\-~^\"'`#*+<>:._])\1{2,}", s.strip()))
    at = 0
    while at < len(lines):
        over = bar(lines[at]) and at + 2 < len(lines) and lines[at + 1].strip() and lines[at + 2].strip() == lines[at].strip()
        if over or at + 1 < len(lines) and lines[at].strip() and not bar(lines[at]) and bar(lines[at + 1]) and len(lines[at + 1].strip()) >= len(lines[at].strip()):
            mark = (over, lines[at + 1 - over].strip()[0])
            if mark not in levels:
                levels.append(mark)
            out.append("#" * min(6, levels.index(mark) + 1) + " " + lines[at + over].strip())
            at += 3 if over else 2
        else:
            out.append(lines[at])
            at += 1
    return "\n".join(out).strip()


MARKUP: dict[str, Callable[[str], str]] = {"rtf": rtf_to_text, "org": org_to_markdown, "adoc": asciidoc_to_markdown, "asciidoc": asciidoc_to_markdown, "rst": rst_to_markdown}


def markup_text(files: DataFrame, key: str = "path", content: str = "text") -> DataFrame:
    """(key, markdown) of rtf, org, AsciiDoc and RST files by their path's ending; others as they are."""

    @F.pandas_udf("string")
    def convert(ending: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([MARKUP.get(e, str.strip)(t) if isinstance(t, str) else None for e, t in zip(ending, c, strict=True)], dtype=object)

    return files.select(key, convert(F.lower(F.regexp_extract(key, r"\.([A-Za-z]+)$", 1)), content).alias("markdown"))


def settings(files: DataFrame, key: str = "path", content: str = "text") -> DataFrame:
    """(key, at, section, name, value) of ini, env and properties texts."""

    def read(text: str) -> Iterator[tuple]:
        section, at = "", 0
        for line in text.split("\n"):
            if m := re.fullmatch(r"\s*\[([^\]]+)\]\s*", line):
                section = m[1].strip()
            elif m := re.fullmatch(r"\s*(?:export\s+)?([^#;!=:\s][^=:]*?)\s*[=:]\s*(.*?)\s*", line):
                yield at, section, m[1], m[2].strip("\"'")
                at += 1

    return _rows(files, read, "at long, section string, name string, value string", key, content)


def front_matter(text: str | None) -> tuple[dict[str, str], str]:
    """Plain ``key: value`` lines between two lines of three hyphens, lists joined by commas; and the body."""
    m = re.match(r"---\r?\n(.*?)\r?\n---\r?\n?(.*)", text or "", re.S)
    if not m:
        return {}, text or ""
    found: dict[str, str] = {}
    last = ""
    for line in m[1].split("\n"):
        if item := re.fullmatch(r"\s+-\s*(.*?)\s*|-\s*(.*?)\s*", line):
            found[last] = ",".join(x for x in (found.get(last), (item[1] or item[2] or "").strip("\"'")) if x)
        elif pair := re.fullmatch(r"([\w-]+):\s*(.*?)\s*", line):
            last = pair[1]
            found[last] = ",".join(x.strip(" \"'") for x in pair[2].strip("[]").split(",")) if pair[2] else ""
    return found, m[2]


def semantic_hash(files: DataFrame, key: str = "path", content: str = "text") -> DataFrame:
    """(key, title, tags, semantic_hash): a hash of the body, white space at line ends apart, and of the front matter that is content."""

    @F.pandas_udf("title string, tags array<string>, hash string")
    def digest(c: pd.Series) -> pd.DataFrame:
        rows = []
        for text in c:
            head, body = front_matter(text)
            kept = {k: head[k] for k in CONTENT_KEYS if k in head}
            normal = "\n".join(line.rstrip() for line in body.replace("\r\n", "\n").split("\n")).strip()
            rows.append((head.get("title"), [t for t in head.get("tags", "").split(",") if t], hashlib.sha256(json.dumps({"body": normal, **kept}, sort_keys=True).encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["title", "tags", "hash"])

    return files.select(key, digest(content).alias("d")).select(key, "d.title", "d.tags", F.col("d.hash").alias("semantic_hash"))


def markdown_rationales(files: DataFrame, key: str = "path", content: str = "text") -> DataFrame:
    """(key, at, kind, text, heading): block quotes and list items that begin with a marker such as NOTE or WHY, under the nearest heading before them. Lines are windowed within their file."""
    from pyspark.sql.window import Window

    from weftgraph.functions import text as T

    lines = files.select(key, F.posexplode(F.split(content, "\n")).alias("at", "line"))
    head = F.regexp_extract("line", r"^#{1,6}\s+(.*?)\s*#*$", 1)
    known = lines.withColumn("heading", F.last(F.nullif(head, F.lit("")), ignorenulls=True).over(Window.partitionBy(key).orderBy("at")))
    quote = F.col("line").rlike(r"^\s*>")
    marked = known.where(F.col("line").rlike(r"^\s*(?:>|[-*+]\s|\d+[.)]\s)")).withColumn("bare", F.trim(F.regexp_replace("line", r"^\s*(?:>\s*)?(?:[-*+]\s+|\d+[.)]\s+)?", ""))).withColumn("quote", quote)
    # Lines of a quote that follow each other are one text, up to a line with a marker of its own.
    by = Window.partitionBy(key).orderBy("at")
    goes_on = F.col("quote") & F.lag("quote").over(by) & (F.lag("at").over(by) == F.col("at") - 1) & T.rationale_marker(F.col("bare")).isNull()
    block = marked.withColumn("block", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(by))
    whole = block.groupBy(key, "block").agg(F.min("at").alias("at"), F.first("heading").alias("heading"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "bare"))), lambda x: x["bare"]), " ").alias("bare"))
    return whole.select(key, "at", F.lower(T.rationale_marker(F.col("bare"))).alias("kind"), T.rationale_text(F.col("bare")).alias("text"), "heading").where("kind is not null and text <> ''")


def chunks(texts: DataFrame, key: str = "doc_id", text: str = "text", target: int = 14_000, most: int = 18_000) -> DataFrame:
    """(key, part_index, part_count, chunk): a text longer than ``most`` is cut between paragraphs into chunks of about ``target`` characters; a longer paragraph is one chunk."""

    def read(whole: str | None) -> Iterator[tuple]:
        whole = whole or ""
        parts, now = [], ""
        for block in re.split(r"\n{2,}", whole) if len(whole) > most else [whole]:
            if now and len(now) + 2 + len(block) > target:
                parts.append(now)
                now = block
            else:
                now = f"{now}\n\n{block}" if now else block
        parts.append(now)
        return ((at, len(parts), p) for at, p in enumerate(parts, 1))

    return _rows(texts, read, "part_index long, part_count long, chunk string", key, text)


def merge_chunk_terms(parts: DataFrame, most: int, key: str = "doc_id", item: str = "name") -> DataFrame:
    """(key, at, item): what the chunks (key, part_index, at, item) found, each once whatever its case, the first ``most`` in order."""
    from pyspark.sql.window import Window

    once = parts.groupBy(key, F.lower(item).alias("_low")).agg(F.min(F.struct("part_index", "at", item)).alias("x"))
    ranked = once.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("x")))
    return ranked.where(F.col("n") <= most).select(key, F.col("n").alias("at"), F.col(f"x.{item}").alias(item))
