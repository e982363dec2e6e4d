"""Gazette texts cut into documents, preambles and articles by sentinels that mark pattern matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, collapse, strip

#: The gazette's headings, at the beginning of a line. Texts are given a first line end, so that these begin with one.
TITLE = rf"(?iuUs)\n((?:Décret{SPACE}+(?:présidentiel|exécutif)|Arrêté(?:{SPACE}+interministériel)?|Décision){SPACE}+(?:n[°o\.]?|du).*?\.){SPACE}*[-—–_]{{3,}}"
ARTICLE = rf"(?iuU)\n{SPACE}*Art(?:icle)?\.?{SPACE}*(\d+(?:er)?)\.?{SPACE}*[-—–]+"
FIRST_ARTICLE = rf"(?iuU)\n{SPACE}*Art(?:icle)?\.?{SPACE}*1?(?:er)?\.?{SPACE}*[-—–]+"
ENACTS = rf"(?iuU)\n{SPACE}*(Décrète|Décrètent|Décide|Décident|Arrête|Arrêtent){SPACE}*:{SPACE}*(?:\n|\z)"
NOT_TITLES = ["Article", "Art.", "Chapitre"]
SIGNATURES = ["Fait à Alger", "Fait à ", "Le Premier ministre", "Le Président"]
HEADER = r"(?iuU)(Décret\s+(?:présidentiel|exécutif)|Arrêté|Décision)\s+(?:n[°o\.]?)?\s*(\d+[-‐‑]\d+|\d{1,4}(?!\d))"
A, B = "\x01", "\x02"


def _cut(x: Column, pattern: str, mark: str) -> Column:
    """A text after a line end, cut before (or with another mark, after) each match of a pattern. What stands before the first is the first part."""
    return F.split(F.regexp_replace(F.concat(F.lit("\n"), x), pattern, mark), A)


def _ended(parts: Column) -> Column:
    """array<string>: articles from header to header (after what is before the first); the last ends before the first signature."""
    tidy = lambda x: strip(collapse(x))
    n = F.size(parts)

    def one(x: Column, i: Column) -> Column:
        ends = F.least(*(F.nullif(F.instr(x, m), F.lit(0)) for m in SIGNATURES))
        return tidy(F.when((i == n - 1) & ends.isNotNull(), F.substring(x, F.lit(1), ends - 1)).otherwise(x))

    return F.filter(F.transform(parts, one), lambda x, i: (i > 0) & (x != ""))


def segment(texts: DataFrame) -> DataFrame:
    """(source_file, total_documents, documents) of (source, text); sources without a document have an empty array. Null text is empty.

    What a rejected title began is lost. A preamble goes through the enacting word, else to before the first article, else it is all. Each
    step is one pass over an array that the step before has made, as within a function of an array's elements nothing is shared: time is in
    proportion to the text, however many articles it has.
    """
    marked = _cut(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(A), F.lit("")), F.lit(B), F.lit("")), TITLE, f"{A}$1{B}")
    began = F.filter(marked, lambda x, i: i > 0)
    cut = F.transform(began, lambda x: F.struct(collapse(strip(F.substring_index(x, B, 1))).alias("title"), strip(F.substring_index(x, B, -1)).alias("body")))
    titled = F.filter(cut, lambda x: ~(x["title"].contains(NOT_TITLES[0]) | x["title"].contains(NOT_TITLES[1]) | x["title"].contains(NOT_TITLES[2])))
    parted = F.transform(titled, lambda x: F.struct(x["title"].alias("title"), x["body"].alias("body"), _cut(x["body"], ARTICLE, f"{A}$0").alias("parts"), _cut(x["body"], ENACTS, f"$0{A}").alias("enacted")))

    def document(x: Column) -> Column:
        preamble = F.when(F.size(x["enacted"]) > 1, x["enacted"][0]).otherwise(_cut(x["body"], FIRST_ARTICLE, f"{A}$0")[0])
        return F.struct(x["title"].alias("title"), _ended(x["parts"]).alias("articles"), F.concat(x["title"], F.lit("\n\n"), strip(preamble)).alias("context"))

    made = texts.select(F.col("source").alias("source_file"), F.transform(parted, document).alias("documents"))
    return made.select("source_file", F.size("documents").alias("total_documents"), "documents")
