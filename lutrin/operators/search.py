"""Questions to answers: embed, retrieve, fuse, read, answer, and the judgement of answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bm25, context, evaluate, fusion, providers, vector

#: The weights of the two systems and how many rows each gives.
WEIGHTS = {"keyword": 0.7, "vector": 0.3}
DEPTH = 10


def retrieve(questions: DataFrame, index: bm25.Index, vectors: DataFrame, k: int = DEPTH, make: Callable[[], providers.Embed] | None = None) -> DataFrame:
    """(query_id, system, rank, chunk_id): both ranked lists of questions(query_id, query[, vector]).

    vectors(chunk_id, embedding). The questions are embedded by ``make``'s model unless they have vectors; one whose vector is null has
    no near chunks, and one without words no keyword hits.
    """
    if "vector" not in questions.columns:
        questions = providers.embed(questions, make or providers.stub_embedder, "query").withColumnRenamed("embedding", "vector")
    near = vector.search(vectors, questions.where("vector is not null").select("query_id", "vector"), k)
    words = bm25.search(index, questions.select("query_id", "query"), k)
    columns = ("query_id", "system", "rank", "chunk_id")
    return near.withColumn("system", F.lit("vector")).select(*columns).unionByName(words.withColumn("system", F.lit("keyword")).select(*columns))


def fused(ranked: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """The ranked lists as one, by the systems' weights."""
    own = ranked.sparkSession.createDataFrame(sorted((weights or WEIGHTS).items()), "system string, weight double")
    return fusion.fuse(ranked, own)


def answers(questions: DataFrame, ranked: DataFrame, chunks: DataFrame, make: Callable[[], providers.Generate] = providers.stub_generator, k: int = 3, template: str = context.ANSWER, evaluation: bool = False) -> DataFrame:
    """(query_id, query, prompt, answer): a model's answer from the best k chunks.

    Where nothing was found there is no prompt, and the answer says so, in search and in evaluation by different sentences; a call
    that fails gives the empty string. evaluation: the context as it is laid out when answers are judged.
    """
    asked = context.prompts(questions, context.contexts(ranked, chunks, k, evaluation), template)
    nothing = context.NOT_IN_CONTEXT if evaluation else context.NOTHING_FOUND
    return asked.withColumn("answer", F.coalesce(providers.generate(F.col("prompt"), make), F.lit(nothing)))


def judged(golden: DataFrame, answered: DataFrame, make: Callable[[], providers.Generate] = providers.stub_generator, template: str = context.JUDGE) -> DataFrame:
    """(query_id, answer, verdict, score) of golden(query_id, query, expected_answer): a judge's score of each answer, 0 without one."""
    rows = golden.join(answered.select("query_id", "answer"), "query_id")
    asked = context.fill(template, query=F.col("query"), expected=F.coalesce("expected_answer", F.lit("")), answer=F.coalesce("answer", F.lit("")))
    rows = rows.select("query_id", "answer", providers.generate(asked, make).alias("verdict"))
    return rows.withColumn("score", evaluate.judge_score("verdict"))
