"""The Parquet tables, and files, notebooks and questions derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = [".md", ".txt", ".yaml", ".html", ".csv", ".foo"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_files(documents: DataFrame) -> DataFrame:
    """Documents as files of repositories: repo_id (the source), doc_id, rel_path, text, lang."""
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.pmod("doc_id", F.lit(len(EXTENSIONS))) + 1).cast("int"))
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), ext)
    return documents.select(F.col("source").alias("repo_id"), "doc_id", path.alias("rel_path"), "text", "lang")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_files(table(spark, sf_dir, "documents"))


FILES_SQL = (
    "files AS (SELECT source AS repo_id, doc_id, source || '/' || lang || '/doc_' || doc_id || "
    "CASE doc_id % 6 WHEN 0 THEN '.md' WHEN 1 THEN '.txt' WHEN 2 THEN '.yaml' WHEN 3 THEN '.html' WHEN 4 THEN '.csv' ELSE '.foo' END AS rel_path, text, lang FROM documents)"
)


def as_questions(items: DataFrame) -> DataFrame:
    """Items as questions: item_id, question (the first eight words), passage."""
    return items.select("item_id", F.array_join(F.slice(F.split("text", r"\s+"), 1, 8), " ").alias("question"), F.col("text").alias("passage"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_questions(table(spark, sf_dir, "benchmark"))


QUESTIONS_SQL = "questions AS (SELECT item_id, array_to_string(list_slice(regexp_split_to_array(text, '\\s+'), 1, 8), ' ') AS question, text AS passage FROM benchmark)"
