"""Weighted reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .sizes import small

K = 60
#: The order in which systems' lists are read; ties in score keep it.
SYSTEMS = {"vector": 0, "keyword": 1}


def fuse(ranked: DataFrame, weights: DataFrame | None = None, keys: tuple[str, ...] = ("query_id",), k: int = K) -> DataFrame:
    """(*keys, chunk_id, score, rank) of ranked(*keys, system, rank, chunk_id); weights(system, weight[, config_id]).

    A system without a weight counts 1; one of weight 0 still gives candidates. With config_id in weights each
    configuration is fused, from one retrieval.
    """
    rows = ranked
    if weights is not None and "config_id" in weights.columns:
        rows = rows.join(small(weights.select("config_id").distinct()))
        keys = ("config_id", *keys)
    if weights is not None:
        rows = rows.join(small(weights), [x for x in ("config_id", "system") if x in weights.columns], "left")
    else:
        rows = rows.withColumn("weight", F.lit(1.0))
    order = F.coalesce(*(F.when(F.col("system") == s, F.lit(i)) for s, i in SYSTEMS.items()), F.lit(len(SYSTEMS)))
    fused = rows.groupBy(*keys, "chunk_id").agg(F.round(F.sum(F.coalesce("weight", F.lit(1.0)) / (k + F.col("rank"))), 12).alias("score"), F.min(F.struct(order.alias("o"), F.col("rank").alias("r"))).alias("first"))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "first"))
    return fused.withColumn("rank", best).drop("first")
