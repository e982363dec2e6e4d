"""Gazette documents flattened into parent and child chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(chunks: DataFrame) -> DataFrame:
    """(type, chunks): how many parents and children there are."""
    return chunks.groupBy("type").agg(F.count("*").alias("chunks"))


def documents(gazette: DataFrame) -> DataFrame:
    """(source_file, doc_idx, d) of each document; sources without any, or null, have none.

    Outer, as else what the array is made of would be worked out once more, to filter by its size.
    """
    return gazette.select("source_file", F.posexplode_outer("documents").alias("doc_idx", "d")).where("d is not null")


def flatten(gazette: DataFrame) -> DataFrame:
    """One row per document (parent) and per article (child), without a shuffle."""
    docs = documents(gazette)
    title, context, arts = F.coalesce("d.title", F.lit("Sans titre")), F.coalesce("d.context", F.lit("")), F.coalesce("d.articles", F.array().cast("array<string>"))
    parent_id = F.concat("source_file", F.lit("_doc_"), F.col("doc_idx").cast("string"))
    none = F.lit(None).cast("string")
    parent = F.struct(parent_id.alias("chunk_id"), F.concat(F.lit("Titre: "), title, F.lit("\nPréambule: "), context).alias("document"), F.lit("parent").alias("type"), title.alias("title"), context.alias("context"), none.alias("parent_title"), none.alias("parent_id"), none.alias("original_article_text"), F.lit(None).cast("int").alias("art_idx"))
    child = F.transform(arts, lambda x, i: F.struct(F.concat(parent_id, F.lit("_art_"), i.cast("string")).alias("chunk_id"), F.concat(F.lit("Source: "), title, F.lit("\nContenu: "), x).alias("document"), F.lit("child").alias("type"), none.alias("title"), none.alias("context"), title.alias("parent_title"), parent_id.alias("parent_id"), x.alias("original_article_text"), i.alias("art_idx")))
    rows = docs.select("source_file", "doc_idx", F.explode(F.concat(F.array(parent), child)).alias("c"))
    return rows.select("c.chunk_id", "c.document", F.col("source_file").alias("source"), "c.type", "c.title", "c.context", "c.parent_title", "c.parent_id", "c.original_article_text", "doc_idx", "c.art_idx")
