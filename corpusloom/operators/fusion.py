"""Reciprocal rank fusion, the shortcut for few candidates, and softmax reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config


def rrf(dense: DataFrame, sparse: DataFrame, by: str = "item_id", key: str = "doc_id", k: int = config.RRF_K, top: int = config.RRF_TOP) -> DataFrame:
    """by, key, rrf_score, rank, dense_score: a key's reciprocal ranks are summed, in one list too; ties go to the first seen."""
    seen = dense.select(by, key, "rank", F.col("rank").alias("ord"), F.col("score").alias("d")).unionByName(sparse.select(by, key, "rank", (F.col("rank") + 1_000_000).alias("ord"), F.lit(None).cast("double").alias("d")))
    fused = seen.groupBy(by, key).agg(F.round(F.sum(1.0 / (F.col("rank") + k)), 9).alias("rrf_score"), F.min("ord").alias("ord"), F.coalesce(F.max("d"), F.lit(0.0)).alias("dense_score"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("rrf_score"), "ord"))
    return fused.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).drop("ord")


def shortcut(fused: DataFrame, final_k: int = config.FINAL_K, by: str = "item_id") -> DataFrame:
    """Where no more than ``final_k`` candidates are left: score is the dense score, order stays stable."""
    n = F.count("*").over(Window.partitionBy(by))
    few = fused.withColumn("_n", n).where(F.col("_n") <= final_k)
    order = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("dense_score"), "rank"))
    return few.withColumn("score", F.col("dense_score")).withColumn("rank", order.cast("long")).drop("_n")


def rerank(candidates: DataFrame, logit: Column, top: int = config.FINAL_K, by: str = "item_id", first: str = "rank") -> DataFrame:
    """Softmax of the logits over each question's candidates; ties keep the former order."""
    w = Window.partitionBy(by)
    scored = candidates.withColumn("_l", logit)
    scored = scored.withColumn("_e", F.exp(F.col("_l") - F.max("_l").over(w)))
    scored = scored.withColumn("score", F.round(F.col("_e") / F.sum("_e").over(w), 6))
    order = F.row_number().over(w.orderBy(F.desc("score"), first))
    return scored.withColumn("_r", order.cast("long")).where(F.col("_r") <= top).withColumn("rank", F.col("_r")).drop("_l", "_e", "_r")
