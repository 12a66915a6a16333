"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Defined cases, stage by stage: a null or empty text scores 0, loses no line, is no copy of another and holds no
passage, so it stays to the end, with null ids for a null text; a row with a null id is judged like any other, as the
last of all ids; rows that share an id are judged one by one, and rows alike in id and text are one after the Jaccard
stage, unless they have no word; an empty table gives an empty result; a very long text is worked on whole; further
columns of the input keep their values to the end, those named like a result too, until the last stage puts its own
``n_tokens``, ``ids`` and ``round_trip`` in their place.

Line dedup comes before the Jaccard stage and cuts the lines that near copies share, so few of them are left to link.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, jaccard_join, line_dedup, sentencepiece_codec, toxicity
from corpusloom.llm.blocks import remove_folder, shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from the labels of the stage's own documents, doesn't call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(toxicity.fold() != 0)
    model = toxicity.fit(docs, labels)
    names = docs.columns
    # under other names, so that a column of the input called score or predicted is kept
    rows = docs.select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(names)), "text")
    return toxicity.score(rows, model, keep=rows.columns).where("predicted = 0").select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(names)))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat, or nearly repeat, an earlier one go; so do documents left without a filled line."""
    return line_dedup.dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    return jaccard_join.keep_first(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold the benchmark's passages."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, and whether they decode to the text."""
    new = ["n_tokens", "ids", "round_trip"]
    kept = [c for c in docs.columns if c not in ("text", *new)]
    # under other names, so that no column of the input meets the operator's own
    rows = docs.select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(kept)), "text")
    out = sentencepiece_codec.encode(rows, decoded=True).withColumn("round_trip", F.col("decoded").eqNullSafe(F.col("text")))
    return out.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(kept)), *new)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode),
]

#: The learned score, the graph search and the tokenizer have no SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the session's shared folder, and removed when the next stage is written."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            remove_folder(spark, f"{base}/{k - 1}")
    return docs
