"""Directory scans and the classification of what they find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftgraph.functions.text import source_class_of_path
from weftgraph.sources.ignores import ignore_reasons, rule_files

# Extensions by language and by kind.
LANGUAGES = {
    "python": ("py", "pyi"), "javascript": ("js", "mjs", "cjs"), "jsx": ("jsx",), "typescript": ("ts", "mts", "cts"), "tsx": ("tsx",), "go": ("go",), "rust": ("rs",), "java": ("java",), "kotlin": ("kt", "kts"), "scala": ("scala", "sc"),
    "c": ("c", "h"), "cpp": ("cc", "cpp", "cxx", "hh", "hpp"), "csharp": ("cs",), "php": ("php",), "ruby": ("rb",), "swift": ("swift",), "lua": ("lua",), "dart": ("dart",), "elixir": ("ex", "exs"), "haskell": ("hs",), "ocaml": ("ml", "mli"),
    "bash": ("sh", "bash", "zsh"), "powershell": ("ps1", "psm1"), "sql": ("sql",), "html": ("html", "htm"), "css": ("css",), "vue": ("vue",), "svelte": ("svelte",), "zig": ("zig",), "julia": ("jl",), "r": ("r",), "solidity": ("sol",),
}
KINDS = {
    "markdown": ("md", "mdx", "markdown"), "text": ("txt", "log"), "html": ("html", "htm"), "csv": ("csv", "tsv"), "xlsx": ("xlsx", "xlsm"), "pdf": ("pdf",), "docx": ("docx",), "epub": ("epub",), "jupyter": ("ipynb",),
    "data": ("json", "jsonl", "yaml", "yml", "toml", "xml", "ini", "env", "properties"), "bibtex": ("bib",), "rtf": ("rtf",), "org": ("org",), "asciidoc": ("adoc", "asciidoc"), "transcript": ("srt", "vtt"), "email": ("eml", "mbox"),
    "calendar": ("ics",), "image": ("png", "jpg", "jpeg", "gif", "webp", "svg"), "audio": ("mp3", "wav", "m4a", "ogg", "flac"), "video": ("mp4", "mov", "mkv", "webm"),
}
INTERPRETERS = {"python": "python", "node": "javascript", "bash": "bash", "sh": "bash", "ruby": "ruby", "php": "php", "lua": "lua"}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def _by_extension(path: Column, table: dict[str, tuple[str, ...]]) -> Column:
    found = F.lit(None).cast("string")
    for name, own in table.items():
        found = F.when(extension(path).isin(*own), name).otherwise(found)
    return found


def language(path: Column, first_line: Column | None = None) -> Column:
    found = _by_extension(path, LANGUAGES)
    if first_line is not None:
        program = F.regexp_extract(first_line, r"^#!.*?(python|node|bash|ruby|php|lua|sh)[0-9.]*\s*$", 1)
        for name, lang in INTERPRETERS.items():
            found = F.coalesce(found, F.when(program == name, lang))
    return found


def kind(path: Column) -> Column:
    """Code first, then documents by extension, else binary."""
    lang = language(path)
    return F.when(lang.isNotNull() & (lang != "html"), "code").otherwise(F.coalesce(_by_extension(path, KINDS), F.lit("binary")))


def decide(files: DataFrame, include: str | None = None, exclude: str | None = None, classes: tuple[str, ...] = ("first_party",), most: int = 5_000, rule_files: DataFrame | None = None, input_dir: str = "", git: bool = True, custom: bool = True) -> DataFrame:
    """files (path) with kind, language, source_class and the reason why one is skipped (null if it is taken); the first that applies. rule_files (dir, kind, text): ignore and include files, see ``ignores``."""
    ruled = ignore_reasons(files, rule_files, input_dir, git, custom) if rule_files is not None else files.withColumn("ignore_reason", F.lit(None).cast("string"))
    rated = ruled.withColumn("kind", kind(F.col("path"))).withColumn("language", language(F.col("path"))).withColumn("source_class", source_class_of_path(F.col("path")))
    parts = F.split("path", "/")
    reason = F.when(F.arrays_overlap(parts, F.array(F.lit(".git"), F.lit(".venv"))), "ignored")
    if exclude:
        reason = reason.when(F.col("path").rlike(exclude), "excluded")
    reason = reason.when(F.col("ignore_reason").isNotNull(), F.col("ignore_reason"))
    if include:
        reason = reason.when(~F.col("path").rlike(include), "not_included")
    reason = reason.when(F.col("kind") == "binary", "unsupported").when(~F.col("source_class").isin(*classes), "source_class")
    chosen = rated.withColumn("reason", reason).drop("ignore_reason")
    # Places by path are needed only for the files that are taken; the ones within the limit are found with a top-k.
    taken = chosen.where("reason is null").select("path").orderBy("path").limit(most).withColumn("_in", F.lit(True))
    return chosen.join(taken, "path", "left").withColumn("reason", F.when(F.col("reason").isNull() & F.col("_in").isNull(), "max_files").otherwise(F.col("reason"))).drop("_in")


def scan(spark: SparkSession, root: str, **options) -> DataFrame:
    """All files under root with their content, and the decision on each, by its ignore files too. Names that begin with a dot are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).withColumn("path", F.regexp_replace("path", "^[a-z]+:/*" + root.strip("/") + "/", ""))
    deepest = found.agg(F.max(F.size(F.split("path", "/")))).first()[0] or 1
    return found.join(decide(found.select("path"), rule_files=rule_files(spark, root, deepest - 1), **options), "path")


def parts(rows: DataFrame, group: str, order: str) -> DataFrame:
    """rows with part_index (from 1) and part_count in each group."""
    w = Window.partitionBy(group)
    return rows.withColumn("part_index", F.row_number().over(w.orderBy(order))).withColumn("part_count", F.count("*").over(w))


def upsert(old: DataFrame, new: DataFrame, key: str, hash_column: str) -> DataFrame:
    """(key, change): created, updated, unchanged or removed."""
    from weftgraph.operators.graph import changes

    return changes(old, new, key, hash_column)
