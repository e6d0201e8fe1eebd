"""The corpus pipeline: toxicity, language, near-duplicates, benchmark passages, token ids.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read
again as the next one's docs. All stages but the last return the columns of
documents, whatever those are.

Defined cases, for every stage: rows without an id or with a repeated one are
judged one by one (stages number the rows they get, in a written table). A null
text counts as empty. Toxicity keeps empty texts (no evidence); language drops
texts without a letter, so empty ones too; near_duplicates takes all empty texts
for copies of each other, as it does repeated rows, and of documents that tie for
the smallest id keeps the first row; decontamination keeps empty texts; token_ids
gives them no ids. Texts of any length are taken whole. No rows give no rows, and
where nothing is there to learn from, toxicity keeps every row and language none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import op1_decontaminate, op2_toxicity, op3_language_id, op4_byte_bpe, op5_simhash
from weftgraph.llm.common import bounded_broadcast, slot_free, written

MIN_LANGUAGE_SCORE, SURE_LANGUAGE_SCORE, STATED_SHARE = 0.01, 0.5, 0.3
MIN_SIMILARITY = 0.8
BROADCAST_ROWS = 1_000_000


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with numbers of rows, written: every later reader sees the same ones."""
    row = slot_free(docs.columns, "row_number")
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents predicted toxic; learns from the labelled ones among docs, without those that op2 holds out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = ~op2_toxicity.held_out(F.col("doc_id"))
    model = op2_toxicity.learn(docs.where(learn), labels.where(learn))
    judged = op2_toxicity.detect(docs.select(F.struct(*docs.columns).alias("doc"), F.col("text")), model)
    return judged.where(F.col("predicted") == 0).select("doc.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, those that resemble no learned language at all, and those that say they are in one learned language but surely are in another (score of 0.5 or more, and not three tenths of it for the stated one). Texts in several languages stay."""
    model = op3_language_id.learn(docs.where(~op3_language_id.held_out(F.col("doc_id"))))
    judged = op3_language_id.identify(docs.select(F.struct(*docs.columns).alias("doc"), F.col("text"), F.col("lang").alias("said")), model, stated="said")
    wrong = (F.col("score") >= SURE_LANGUAGE_SCORE) & (F.col("stated_score") < STATED_SHARE * F.col("score"))
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE) & ~F.coalesce(wrong, F.lit(False))).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, by fingerprints or by five-word shingles: the one with the smallest doc_id, of equal ones the first row."""
    numbered, row = _numbered(docs)
    keyed = numbered.select(F.struct("doc_id", row).alias("key"), "text")
    groups = op5_simhash.near_duplicates(keyed, key="key", similarity=MIN_SIMILARITY)
    kept = groups.where(F.col("key") == F.col("component_id")).select(F.col(f"key.{row}").alias(row))
    return numbered.join(kept, row, "left_semi").drop(row)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    numbered, row = _numbered(docs)
    found = op1_decontaminate.contaminations(numbered.select(F.col(row).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = written(found.select(F.col("doc_id").alias(row)).distinct(), "contaminated")
    return numbered.join(bounded_broadcast(bad, BROADCAST_ROWS), row, "left_anti").drop(row)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, n_bytes): ids as little-endian unsigned 32-bit integers; n_bytes of the text that they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = op4_byte_bpe.bpe_encode(docs, path, public_tokenizers.PATTERN, decode=True)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.octet_length("bytes").cast("long").alias("n_bytes"))


STAGES = [
    ("toxicity", toxicity),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("token_ids", token_ids),
]

#: Fitted scores, fingerprints and merges are no SQL; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
