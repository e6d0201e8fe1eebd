"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Names, units and numbers are replaced with typed placeholders, so a question and
its re-parameterised copy have one template. Templates are cut into windows of
``K`` words; window hashes of all documents are joined to those of the benchmark
and the words compared. Matches on one diagonal (document place less item place,
neighbouring diagonals merged) are one occurrence of the item. It counts if it
covers ``COVERAGE`` of the item's windows and its slots are consistent: a value
of the item stands for one value of the document, and of names also a value of
the document for one of the item (two amounts may become equal, two people not).
Where enough windows without slots match word by word, slots don't matter.

Placeholders: numbers, also in words; units behind a number in digits; names, that is capitalised words
that begin no sentence (a lower-case letter or , ; : and a blank stand before, and
a lower-case letter behind the first). Two more templates find what this misses:
one takes every capitalised word as a name, so names that begin sentences count;
one has the plain lower-cased words, so copies in other case count. Where several
find an occurrence alike, its word places are those of the first.

The benchmark is joined in blocks of at most ``BLOCK`` windows, each broadcast;
one block is the usual case. Items with fewer than K words are one window as
long as they are.

Defined cases: null or empty items and texts have no windows and match nothing.
Rows that repeat doc_id and text give one result; one doc_id with several texts
gives the best occurrence over them, as do repeated item ids. Null keys are kept.
Columns other than ids and texts are ignored, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K = 5
COVERAGE = 0.8
GAP = 3
BLOCK = 200_000

NUMBER_MARK, NAME_MARK, UNIT_MARK = "", "", ""
# Units, as written behind a number.
UNITS = (
    "mm|cm|km|m|ft|in|mi|miles?|inch|inches|feet|foot|yards?|meters?|metres?|kilometers?|kilometres?|centimeters?|centimetres?|mg|kg|g|lbs?|oz|grams?|kilograms?|pounds?|ounces?|tons?|tonnes?|ml|l|liters?|litres?|gallons?|cups?|"
    "ms|s|sec|seconds?|min|minutes?|h|hrs?|hours?|days?|weeks?|months?|years?|mph|kph|km/h|hz|khz|mhz|ghz|kb|mb|gb|tb|w|kw|kwh|v|volts?|watts?|amps?|degrees?|percent|dollars?|euros?|cents?|usd|eur"
)
# Numbers in words.
NUMBER_WORDS = (
    "zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion|dozen"
)
# Digits, or a number in words by its first letter, behind no letter or digit: most places fail at one look. Groups repeat possessively: else each repeat takes a frame of the stack, which some thousands of parts overflow.
_BY_LETTER = {w[0]: "|".join(x[1:] for x in NUMBER_WORDS.split("|") if x[0] == w[0]) for w in NUMBER_WORDS.split("|")}
_WORDS = "|".join(f"(?<=[{c}{c.upper()}])(?i:{rest})" for c, rest in _BY_LETTER.items())
NUMBER = rf"[0-9{''.join(c + c.upper() for c in _BY_LETTER)}](?<![\p{{L}}\p{{N}}].)(?:(?<=[0-9])[0-9]*(?:[.,:/][0-9]+)*+|(?:{_WORDS})(?![\p{{L}}\p{{N}}]))"
NAME = r"\p{Lu}(?<=[\p{Ll},;:] .)\p{Ll}[\p{L}'-]*(?![\p{L}\p{N}])"
# Any capitalised word, wherever it stands.
CAPITALISED = r"\p{Lu}(?<![\p{L}\p{N}].)\p{Ll}[\p{L}'-]*(?![\p{L}\p{N}])"
UNIT = rf"(?<=[0-9] ?)(?:{UNITS})(?![\p{{L}}\p{{N}}])"
# Names in the templates that texts are compared by: the usual one, all capitalised words, none (plain words; no placeholders at all).
VARIANTS = (NAME, CAPITALISED, None)
SEPARATORS = r"[\x00-/:-`{-\x7f]+"


def template(text: Column, name: str | None = NAME) -> Column:
    """The lower-cased text with placeholders; without a pattern of names there are none."""
    if name is None:
        return F.lower(text)
    named = F.regexp_replace(text, name, f" {NAME_MARK} ")
    measured = F.when(text.rlike("[0-9]"), F.regexp_replace(named, UNIT, f" {UNIT_MARK} ")).otherwise(named)
    return F.lower(F.regexp_replace(measured, NUMBER, f" {NUMBER_MARK} "))


def marks(words: Column) -> Column:
    """How many of the words are placeholders."""
    return F.size(words) - F.size(F.array_remove(F.array_remove(F.array_remove(words, NUMBER_MARK), NAME_MARK), UNIT_MARK))


def template_words(df: DataFrame, name: str | None = NAME) -> DataFrame:
    """df (with text) and its template's words; the split's empty first and last pieces are dropped."""
    first = F.when(F.element_at("_pieces", 1) == "", 1).otherwise(0)
    last = F.when((F.element_at("_pieces", -1) == "") & (F.size("_pieces") > 1), 1).otherwise(0)
    return (
        df.withColumn("_pieces", F.split(template(F.col("text"), name), SEPARATORS))
        .withColumn("_drop", first)
        .withColumn("words", F.slice("_pieces", F.col("_drop") + 1, F.size("_pieces") - F.col("_drop") - last))
        .drop("_pieces", "_drop")
    )


def window_slots(k: int, name: str | None = NAME) -> Column:
    """Values of the placeholders in the window at ``pos``, in order: the text's slots, less those before the window."""
    if name is None:
        return F.array().cast("array<string>")
    slot = rf"({name}|{UNIT}|{NUMBER})"
    before = marks(F.slice("words", 1, F.col("pos")))
    inside = marks(F.slice("words", F.col("pos") + 1, k))
    return F.when(inside > 0, F.slice(F.regexp_extract_all("text", F.lit(slot), F.lit(1)), before + 1, inside)).otherwise(F.array().cast("array<string>"))


def item_windows(benchmark: DataFrame, k: int, name: str | None = NAME) -> DataFrame:
    """(g_hash, g_words, item_id, item_key, at, windows, slots, size): every window of every item; size is k, or fewer words for shorter items."""
    items = template_words(benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")), name).where(F.size("words") > 0)
    sized = items.withColumn("size", F.least(F.lit(k), F.size("words"))).withColumn("windows", F.size("words") - F.col("size") + 1)
    placed = sized.select("*", F.xxhash64("text").alias("item_key"), F.explode(F.sequence(F.lit(0), F.col("windows") - 1)).alias("pos"))
    return placed.select(
        "item_id", "item_key", "windows", "size", F.col("pos").alias("at"), F.slice("words", F.col("pos") + 1, F.col("size")).alias("g_words"), window_slots(k, name).alias("g_slots"),
    ).withColumn("g_hash", F.xxhash64(*[F.get("g_words", F.lit(j)) for j in range(k)]))


def _hits(texts: DataFrame, grams: DataFrame, size: int, variant: int) -> DataFrame:
    """Places of the benchmark's windows. A generated stage keeps all rows that one text gives before it passes them on, so a row that leaves it has no text and no words: all here is compiled into that stage (no lambda functions)."""
    here = F.slice("words", F.col("pos") + 1, size)
    same = (here <= F.col("g_words")) & (here >= F.col("g_words"))  # as equality, the words would be keys of the join, built for every place
    placed = texts.withColumn("text_key", F.xxhash64("text")).select("doc_id", "text_key", "text", "words", F.posexplode_outer("words").alias("pos", "w"))
    return (
        placed.join(F.broadcast(grams), F.xxhash64("w", *[F.get("words", F.col("pos") + j) for j in range(1, size)]) == F.col("g_hash"))
        .where(same)
        .select("doc_id", "text_key", "item_id", "item_key", "windows", "size", "at", "pos", (F.col("pos") - F.col("at")).alias("diag"), "g_slots", window_slots(size, VARIANTS[variant]).alias("slots"), F.lit(variant).alias("variant"))
    )


def contaminations(docs: DataFrame, benchmark: DataFrame, k: int = K, coverage: float = COVERAGE, gap: int = GAP, block: int = BLOCK) -> DataFrame:
    """One row for each document and item that it holds: doc_id, item_id, coverage, consistency, kind (exact, reparameterised or literal), first_word, last_word."""
    parts = []
    for variant, name in enumerate(VARIANTS):
        grams = item_windows(benchmark, k, name).withColumn("block", F.lit(0))
        sizes = {r["size"]: r["n"] for r in grams.groupBy("size").agg(F.count("*").alias("n")).collect()}  # k rows at most
        texts = template_words(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), name)
        for size, n in sorted(sizes.items()) or [(k, 0)]:
            blocks = -(-n // block) or 1
            for b in range(blocks):
                own = grams.where(F.col("size") == size) if blocks == 1 else grams.where((F.col("size") == size) & (F.pmod(F.xxhash64("item_id", "item_key", "at"), F.lit(blocks)) == b))
                parts.append(_hits(texts, own.drop("block"), size, variant))
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    key = ["doc_id", "text_key", "item_id", "item_key", "variant"]
    pairs = F.arrays_zip(F.col("g_slots").alias("own"), F.col("slots").alias("other"))
    votes = hits.repartition("doc_id", "text_key").groupBy(*key, "diag").agg(
        F.first("windows").alias("windows"), F.first("size").alias("size"), F.collect_set("at").alias("found"), F.collect_set(F.when(F.size("g_slots") == 0, F.col("at"))).alias("literal"),
        F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"), F.min("pos").alias("first"), F.max("pos").alias("last"),
    )
    by_diag = Window.partitionBy(*key).orderBy("diag")
    runs = votes.withColumn("_new", F.when(F.col("diag") - F.lag("diag").over(by_diag) <= gap, 0).otherwise(1)).withColumn("run", F.sum("_new").over(by_diag))
    spans = runs.groupBy(*key, "run").agg(
        F.first("windows").alias("windows"), F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("n_found"), F.size(F.array_distinct(F.flatten(F.collect_list("literal")))).alias("n_literal"),
        F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"), F.min("first").alias("first_word"), (F.max("last") + F.first("size") - 1).alias("last_word"),
    )
    own = F.array_distinct(F.transform("pairs", lambda p: p["own"]))
    steady = F.filter(own, lambda v: F.size(F.filter("pairs", lambda p: p["own"] == v)) == 1)
    named = F.filter("pairs", lambda p: p["own"].rlike(r"^\p{Lu}"))
    others = F.array_distinct(F.transform(named, lambda p: p["other"]))
    apart = F.filter(others, lambda v: F.size(F.filter(named, lambda p: p["other"] == v)) == 1)
    judged = spans.select(
        "doc_id", "item_id", "variant", (F.col("n_found") / F.col("windows")).alias("coverage"), (F.col("n_literal") / F.col("windows")).alias("literal"),
        F.when(F.size("pairs") == 0, 1.0).otherwise(F.least(F.size(steady) / F.size(own), F.when(F.size(others) == 0, 1.0).otherwise(F.size(apart) / F.size(others)))).alias("consistency"), F.forall("pairs", lambda p: p["own"].eqNullSafe(p["other"])).alias("equal"), "first_word", "last_word",
    ).where((F.col("coverage") >= coverage) & ((F.col("consistency") >= coverage) | (F.col("literal") >= coverage)))
    kind = F.when(F.col("equal"), "exact").when(F.col("consistency") >= coverage, "reparameterised").otherwise("literal")
    best = judged.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "consistency", kind.alias("kind"), (-F.col("variant")).alias("v"), (-F.col("first_word")).alias("f"), "last_word")).alias("b"))
    return best.select("doc_id", "item_id", "b.coverage", "b.consistency", "b.kind", (-F.col("b.f")).cast("long").alias("first_word"), F.col("b.last_word").cast("long").alias("last_word"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
