"""Overlapping character windows for a model, and the parse of its tagged answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

#: The windows' size and overlap in characters, and the tags of an answer.
SIZE, OVERLAP = 3500, 200
TAGGED = r"(?s)\[\[START\]\]\s*ID:\s*(.*?)\s*CONTENT:\s*(.*?)\s*\[\[END\]\]"


def char_windows(texts: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(source, start, chunk): windows begin every size - overlap characters while there is text."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")
    n = F.length("text")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))
    return texts.select("source", "text", F.explode(starts).alias("start")).select("source", "start", F.substring("text", F.col("start") + 1, F.lit(size)).alias("chunk"))


def tagged(responses: DataFrame) -> DataFrame:
    """(source, pos, official_id, text, journal_date, type) of (source, response); short ones are dropped."""
    found = F.arrays_zip(F.regexp_extract_all("response", F.lit(TAGGED), F.lit(1)).alias("a"), F.regexp_extract_all("response", F.lit(TAGGED), F.lit(2)).alias("b"))
    each = responses.select("source", F.posexplode(found)).select("source", "pos", strip(F.col("col.a")).alias("official_id"), strip(F.col("col.b")).alias("text"))
    each = each.where((F.length("official_id") > 5) & (F.length("text") > 20))
    return each.withColumn("journal_date", F.lit("Inconnue")).withColumn("type", F.when(F.col("official_id").contains("Décret"), "Decret").otherwise("Arrêté"))


def extract_counts(texts: DataFrame, extracts: DataFrame) -> DataFrame:
    """(source, extracts) of every text, with 0 for those that none was made of."""
    counted = extracts.groupBy("source").agg(F.count("*").alias("extracts"))
    return texts.select("source").join(counted, "source", "left").select("source", F.coalesce("extracts", F.lit(0)).alias("extracts"))


def unprocessed(texts: DataFrame, processed: DataFrame, key: str = "source") -> DataFrame:
    return texts.join(processed.select(key).distinct(), key, "left_anti")
