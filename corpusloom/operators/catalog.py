"""Repositories as partitions: list, delete, caps, summaries, the embedding cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config


def list_repos(chunks: DataFrame, by: str = "repo_id") -> DataFrame:
    return chunks.groupBy(by).agg(F.count("*").alias("chunks")).select(by, F.concat(F.lit("repo_"), by).alias("collection"), "chunks")


def without_repo(chunks: DataFrame, repo: str, by: str = "repo_id") -> DataFrame:
    """All other repositories' rows; on a table partitioned by repository no file of theirs is touched."""
    return chunks.where(F.col(by) != repo)


def size_guard(files: DataFrame, size: Column, by: str = "repo_id", limit_mb: int = config.MAX_REPO_MB) -> DataFrame:
    """by, size_mb (rounded up twice, as sizes are reported), admitted."""
    kb = F.floor(F.sum(size) / 1024)
    mb = F.greatest(F.lit(1), F.floor((kb + 1023) / 1024)).cast("long")
    return files.groupBy(by).agg(mb.alias("size_mb")).withColumn("admitted", F.col("size_mb") <= limit_mb)


def total_cap(chunks: DataFrame, cap: int = config.INGEST_MAX_TOTAL_CHUNKS, by: str = "repo_id", path: str = "rel_path", order: str = "chunk_no") -> DataFrame:
    """The first ``cap`` chunks of each repository in the order of their paths; 0 is no cap."""
    if cap <= 0:
        return chunks
    rank = F.row_number().over(Window.partitionBy(by).orderBy(path, order))
    return chunks.withColumn("_r", rank).where(F.col("_r") <= cap).drop("_r")


def cached(chunks: DataFrame, cache: DataFrame, key: str = "content_hash") -> DataFrame:
    """``chunks`` with the cached vector or null."""
    return chunks.join(cache, key, "left")


def missing(chunks: DataFrame, cache: DataFrame, key: str = "content_hash") -> DataFrame:
    """What has to be embedded, once for each hash."""
    return chunks.join(cache, key, "left_anti").dropDuplicates([key])
