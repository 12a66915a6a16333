"""Retrieval quality over a table of questions: which documents hold the answers, and at what rank the index finds them.

    python -m jobs.evaluate_retrieval DOCUMENTS QUESTIONS OUTPUT --config jobs/evaluate_retrieval.json

DOCUMENTS (doc_id, text, ...) are indexed into OUTPUT/index; the first eight words of every row of QUESTIONS (item_id,
text) are asked, and a document that holds a row's whole text answers it.  OUTPUT also holds

- ``questions``, by outcome: hit@1, hit@5, ... (the smallest k that the first answer lies within), miss (answers, none found) and
  unanswerable (no document holds the text), with the number of answers and the first rank;
- ``summary``, by measure: recall at each k and the mean reciprocal rank of the questions that have an answer, the
  target, and whether it is met.

A run replaces what an earlier one wrote, table by table, so it may be run again at any time with the same result.  Rows
without an id are left out; a null or empty text has no answer.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import evaluate
from corpusloom.operators.index import Bm25Index
from corpusloom.sources.tables import as_questions
from jobs.common import command, log

COLLECTION = "all"


def _replace(rows: DataFrame, path: str, by: str) -> DataFrame:
    # all partitions go: a question may have another outcome than in the run before
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(by).parquet(path)
    return rows.sparkSession.read.parquet(path)


def run(spark: SparkSession, documents: str, questions: str, output: str, ks: list[int] | None = None, recall_target: float = 0.7, mrr_target: float = 0.6) -> DataFrame:
    """Writes the evaluation and returns ``questions`` as it was written."""
    ks, output = sorted(ks or [1, 5, 10]), output.rstrip("/")
    docs = spark.read.parquet(documents).select("doc_id", "text").where("doc_id is not null")
    asked = as_questions(spark.read.parquet(questions)).where("item_id is not null")
    index = Bm25Index(spark, f"{output}/index")
    index.add(docs.withColumn("repo_id", F.lit(COLLECTION)))
    log.info("indexed %s: %s", documents, index.stats().first())
    found = index.top_k(asked, COLLECTION, k=ks[-1])
    answers = evaluate.relevant(index, COLLECTION, docs, asked)
    hits = found.join(answers, ["item_id", "doc_id"]).groupBy("item_id").agg(F.min("rank").alias("first_rank"))
    counts = answers.groupBy("item_id").agg(F.count("*").alias("n_answers"))
    rows = asked.select("item_id").join(counts, "item_id", "left").join(hits, "item_id", "left").withColumn("n_answers", F.coalesce("n_answers", F.lit(0)).cast("long"))
    outcome = F.when(F.col("n_answers") == 0, "unanswerable")
    for k in ks:
        outcome = outcome.when(F.col("first_rank") <= k, f"hit@{k}")
    written = _replace(rows.withColumn("outcome", outcome.otherwise("miss")), f"{output}/questions", "outcome")
    answerable = written.where("n_answers > 0")
    recalls = evaluate.recall(answerable, ks).select(F.concat(F.lit("recall@"), F.col("k").cast("string")).alias("measure"), F.col("recall").alias("value"), F.when(F.col("k") == 5, recall_target).alias("target"))
    summary = recalls.unionByName(evaluate.mrr(answerable).select(F.lit("mrr").alias("measure"), F.col("mrr").alias("value"), F.lit(mrr_target).alias("target")))
    for r in _replace(summary.withColumn("met", F.col("value") >= F.col("target")), f"{output}/summary", "measure").collect():
        log.info("%s: %.3f%s", r.measure, r.value, "" if r.target is None else f", target {r.target:.2f} {'met' if r.met else 'missed'}")
    log.info("read %s and %s, wrote %s/questions (%d rows) and %s/summary", documents, questions, output, written.count(), output)
    return written


if __name__ == "__main__":
    sys.exit(command("evaluate_retrieval", __doc__.split("\n")[0], ["documents", "questions", "output"], run))
