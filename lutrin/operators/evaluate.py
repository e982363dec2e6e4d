"""Hit rate, reciprocal rank and judge scores over golden sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sizes import small

#: The weightings that are compared (keyword, vector).
WEIGHTINGS = [(1.0, 1.0), (1.0, 0.0), (0.0, 1.0), (0.8, 0.2), (0.6, 0.4), (0.2, 0.8)]


def retrieval(golden: DataFrame, fused: DataFrame, k: int = 3, relevant: Column | None = None, configs: DataFrame | None = None) -> DataFrame:
    """(config_id, hit_rate, mrr) of golden(query_id, expected_doc_id) and fused(config_id, query_id, chunk_id, rank).

    A chunk is relevant if its id contains the expected id. An empty golden set gives null metrics. configs(config_id): the
    configurations, where they are known without looking at the results.
    """
    relevant = relevant if relevant is not None else F.col("chunk_id").contains(F.col("expected_doc_id"))
    top = fused.where(F.col("rank") <= k).join(golden, "query_id").where(relevant).groupBy("config_id", "query_id").agg(F.min("rank").alias("found"))
    each = golden.select("query_id").join(small(configs if configs is not None else fused.select("config_id").distinct())).join(top, ["config_id", "query_id"], "left")
    return each.groupBy("config_id").agg((F.avg(F.when(F.col("found").isNotNull(), 1.0).otherwise(0.0)) * 100).alias("hit_rate"), F.avg(F.coalesce(1 / F.col("found"), F.lit(0.0))).alias("mrr"))


def judge_score(answer: Column | str) -> Column:
    """The first whole number after SCORE:, 0 if there is none or it has no place in a long; not clamped."""
    return F.coalesce(F.regexp_extract(answer, r"(?iu)SCORE:\s*(\d+)", 1).try_cast("long"), F.lit(0).cast("long"))


def band(mean: Column) -> Column:
    return F.when(mean >= 8.5, "excellent").when(mean >= 7.0, "good").otherwise("average")


def judged(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """One row: mean_score and band over all answers."""
    mean = answers.agg(F.avg(judge_score(F.col(answer))).alias("mean_score"))
    return mean.withColumn("band", band(F.col("mean_score")))
