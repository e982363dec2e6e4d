"""Page blocks in reading order: bands between separators, the left column before the right."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import remove_arabic, strip, title_key

#: Section titles that are left out, and the share of the page's width from which a block is a separator.
IGNORED = ["decisions et avis", "décisions et avis", "arretes", "arrêtés", "arrêtes", "arretes, decisions et avis", "arrêtés, décisions et avis", "conventions et accords internationaux", "decrets", "décrets", "decisions individuelles", "décisions individuelles", "annonces et communications"]
WIDE = 0.75


def contents_pages(blocks: DataFrame) -> DataFrame:
    """(source, page_no) of pages whose first five raw blocks speak of a table of contents."""
    first = F.row_number().over(Window.partitionBy("source", "page_no").orderBy("block_no"))
    # The word may lie across two blocks, so the first five are joined before it is looked for.
    top = blocks.withColumn("n", first).where("n <= 5").groupBy("source", "page_no").agg(F.array_sort(F.collect_list(F.struct("n", F.coalesce("text", F.lit("")).alias("text")))).alias("b"))
    return top.where(F.lower(F.array_join(F.transform("b", lambda x: x["text"]), " ")).contains("sommaire")).select("source", "page_no")


def reading_order(blocks: DataFrame) -> DataFrame:
    """(source, text) of each source with a page after its cover; pages in order, two newlines after each."""
    kept = blocks.where("page_no > 0").join(contents_pages(blocks), ["source", "page_no"], "left_anti")
    shown = kept.where((F.col("block_type") == 0) & (strip("text") != "")).withColumn("t", strip("text"))
    ignored = title_key("t").isin(IGNORED)
    separator = ignored | (F.col("x1") - F.col("x0") > F.col("page_width") * WIDE)
    shown = shown.withColumn("sep", separator).withColumn("out", F.when(ignored, "").when(separator, F.concat("t", F.lit("\n\n"))).otherwise(F.concat("t", F.lit("\n"))))
    down = Window.partitionBy("source", "page_no").orderBy("y0", "block_no").rowsBetween(Window.unboundedPreceding, 0)
    shown = shown.withColumn("band", F.sum(F.col("sep").cast("int")).over(down)).withColumn("column", F.when(F.col("sep"), -1).when(F.col("x0") < F.col("page_width") / 2, 0).otherwise(1))
    pages = shown.groupBy("source", "page_no").agg(F.array_sort(F.collect_list(F.struct("band", "column", "y0", "block_no", "out"))).alias("b"))
    pages = pages.select("source", "page_no", F.array_join(F.transform("b", lambda x: x["out"]), "").alias("page"))
    pages = kept.select("source", "page_no").distinct().join(pages, ["source", "page_no"], "left")
    whole = pages.select("source", F.struct("page_no", F.concat(remove_arabic(F.coalesce("page", F.lit(""))), F.lit("\n\n")).alias("t")).alias("p"))
    return whole.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["t"]), "").alias("text"))


def join_ocr_pages(pages: DataFrame) -> DataFrame:
    """(source, text) of recognised pages (source, page_no, text): a header, the text and a rule for each page after the cover; a null text is empty."""
    part = F.concat(F.lit("--- Page "), F.col("page_no").cast("string"), F.lit(" ---\n"), F.coalesce("text", F.lit("")), F.lit("\n\n" + "=" * 50 + "\n"))
    each = pages.where("page_no >= 2").select("source", F.struct("page_no", part.alias("t")).alias("p"))
    return each.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["t"]), "\n").alias("text"))
