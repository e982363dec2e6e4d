"""Why a text is found or not: raw search, headers with what stands before them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain, strip
from .segment import A, B, HEADER

#: What cites a text rather than being one, the characters before a header that are looked at, and those of an excerpt.
CITES = ["vu le", "vu l'", "application du"]
BEFORE = 50
EXCERPT = 150
#: A header has eight characters at least ("Arrêté 1"), so BEFORE characters lie within so many pieces that each begin with one.
PIECES = BEFORE // 8 + 1


def raw_search(chunks: DataFrame, needle: str, key: str = "chunk_id", text: str = "document") -> DataFrame:
    """(key, excerpt) of rows whose text contains the needle."""
    return chunks.where(F.col(text).contains(needle)).select(key, F.substring(text, 1, EXCERPT).alias("excerpt"))


def match_count(chunks: DataFrame, needle: str, text: str = "document") -> DataFrame:
    """One row: how many texts contain the needle."""
    return chunks.agg(F.count_if(F.col(text).contains(needle)).alias("matches"))


def headers(texts: DataFrame, target: str = "24-10") -> DataFrame:
    """(source, pos, header, before, is_visa, has_target): each header of the cleaned texts with the 50 characters before it.

    Null and empty texts have none.
    """
    marked = F.regexp_replace(F.translate(plain("text"), A + B, ""), HEADER, f"{A}$0{B}")
    rows = texts.select("source", F.split(marked, A).alias("p"))
    # The end of what stands before each piece: of the pieces just before it, without their sentinels.
    ahead = lambda i: F.translate(F.array_join(F.slice("p", F.greatest(i + 1 - PIECES, F.lit(0)) + 1, F.least(i + 1, F.lit(PIECES))), ""), B, "")
    rest = F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))
    each = F.transform(rest, lambda x, i: F.struct(F.substring_index(x, B, 1).alias("header"), F.right(ahead(i), F.lit(BEFORE)).alias("before")))
    pieces = rows.select("source", F.posexplode(each)).select("source", "pos", "col.header", F.col("col.before").alias("before"))
    before = strip(F.replace(F.lower("before"), F.lit("\n"), F.lit(" ")))
    out = pieces.withColumn("before", before)
    visa = F.col("before").contains(CITES[0]) | F.col("before").contains(CITES[1]) | F.col("before").contains(CITES[2])
    return out.withColumn("is_visa", visa).withColumn("has_target", F.col("header").contains(target))
