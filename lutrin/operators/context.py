"""Contexts and prompts as columns. The prompt texts are parameters; the defaults say the task in our own words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Answers where nothing was found, in search and in evaluation.
NOTHING_FOUND = "Désolé, je n'ai trouvé aucun document pertinent dans la base de données."
NOT_IN_CONTEXT = "Les documents fournis ne contiennent pas cette information."
ANSWER = "Réponds à la question en t'appuyant uniquement sur les textes ci-dessous, cite l'article et le décret, et dis « " + NOT_IN_CONTEXT + " » si la réponse n'y est pas.\n\nTEXTES :\n{context}\n\nQUESTION :\n{query}\n\nRÉPONSE :\n"
JUDGE = "Note de 0 à 10 la fidélité de la réponse à la référence et ne donne que la note, sous la forme « SCORE: X ».\n\nQUESTION : {query}\nRÉFÉRENCE : {expected}\nRÉPONSE : {answer}\n"
SEGMENT = "Sépare les textes juridiques et rends chacun ainsi, sans rien changer :\n[[START]]\nID: (titre exact)\nCONTENT: (texte entier)\n[[END]]\n\n{chunk}\n"


def fill(template: str, **values: Column) -> Column:
    """A template with values in the places of their names; null where one of them is null."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), values[name]]
    return F.concat(*parts, F.lit(rest))


def contexts(ranked: DataFrame, chunks: DataFrame, k: int = 3, evaluation: bool = False) -> DataFrame:
    """(query_id, context) of the best k chunks; the text is joined after the ranking. Null texts are empty, and have their place."""
    rows = ranked.where(F.col("rank") <= k).join(chunks, "chunk_id").withColumn("document", F.coalesce("document", F.lit("")))
    n = F.col("rank").cast("string")
    if evaluation:
        item, separator = F.concat(F.lit("--- DOCUMENT "), n, F.lit(" ---\n"), "document"), "\n\n"
    else:
        title = F.coalesce("parent_title", "title", F.lit("Document sans titre"))
        item, separator = F.concat(F.lit("DOCUMENT "), n, F.lit(" (Source: "), title, F.lit(")\nCONTENU: "), "document"), "\n\n---\n\n"
    each = rows.select("query_id", F.struct("rank", item.alias("t")).alias("x"))
    return each.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), separator).alias("context"))


def prompts(queries: DataFrame, found: DataFrame, template: str = ANSWER) -> DataFrame:
    """(query_id, query, prompt) for queries; prompt is null where nothing was found."""
    return queries.join(found, "query_id", "left").select("query_id", "query", fill(template, context=F.col("context"), query=F.col("query")).alias("prompt"))
