"""The corpus pipeline: quality rules, near-duplicates, benchmark passages, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``. Other columns
of docs are left out. Every stage takes an empty table and gives one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lutrin.llm import bpe, decontaminate, pii, quality, simhash
from lutrin.llm.common import bounded, scratch, settle, small
from lutrin.llm.queries import DEMONSTRATION_KEY, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose rules' posterior says that they are good; those that fail the base rules go.

    Null and empty texts have no words and go. Rows are judged each for itself, whatever their other columns (which may be null): repeated
    rows stay or go together, and count as often as they are there when the rules' accuracies are estimated.
    """
    bounded(spark)
    return quality.judge(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the least doc_id, of each group of near copies (word 5-shingles alike at 0.8 or more).

    Rows are told apart by a number of their own: repeated rows are copies, rows of one doc_id only if their texts are alike.
    Rows without a doc_id come last in their group; of equal doc_ids the first row stays. Texts without words, null or empty, are
    alike: one of them stays.
    """
    bounded(spark)
    rows = settle(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")))
    groups = settle(simhash.near_copies(rows, key="row").join(rows.select("row", "doc_id"), "row"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    kept = groups.groupBy("root").agg(F.min_by("row", order).alias("kept"))
    gone = settle(groups.join(kept, "root").where("row <> kept").select("row"))
    return rows.join(small(gone), "row", "left_anti").select(*COLUMNS)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans that benchmark items' windows cover; n_chars is the new length.

    No row goes. Null texts stay null and empty ones empty; a text that nothing is cut from keeps its n_chars, null or not. Repeated rows are cut
    alike. An empty benchmark cuts nothing.
    """
    bounded(spark)
    found = decontaminate.find_spans(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), clean="text")
    length = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumn("n_chars", length).select(*COLUMNS)


def hide_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms for personal data; n_chars is the new length.

    No row goes. Null texts stay null and empty ones empty; a text without personal data keeps its n_chars, null or not. Equal values get equal
    pseudonyms in all rows.
    """
    bounded(spark)
    out = pii.pseudonymise(docs.select(*COLUMNS), DEMONSTRATION_KEY)
    length = F.when(F.size("pii_kinds") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", length).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the token ids of the whole text, their number and hash, and the hash of what they decode to.

    Null and empty texts have no ids. Rows are independent; repeated rows give repeated rows.
    """
    bounded(spark)
    return bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), vocabulary("byte_bpe_50k.json")).drop("text")


STAGES = [("quality", keep_good), ("near_duplicates", drop_near_copies), ("decontamination", cut_benchmark), ("pii", hide_personal), ("bpe", encode)]

#: SQL has neither the model of the first stage nor the tokenizer of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        path = scratch(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
