"""The guardrail, chunk formats, the two budget trims and the prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config


def sufficient(chunks: DataFrame, by: str = "item_id", corpus_size: int | None = None) -> DataFrame:
    """by, n, max_score, sufficient."""
    out = chunks.groupBy(by).agg(
        F.count("*").alias("n"), F.max(F.coalesce("score", F.lit(0.0))).alias("max_score"), F.max(F.coalesce("dense_score", F.lit(0.0))).alias("_d"), F.bool_or(F.coalesce(F.col("chunk_type") == "file_manifest", F.lit(False))).alias("_m")
    )
    small = F.lit(corpus_size is not None and corpus_size <= config.SMALL_CORPUS)
    good = small | F.col("_m") | (F.col("max_score") >= config.RERANK_THRESHOLD) | (F.col("_d") >= config.DENSE_THRESHOLD)
    return out.select(by, "n", "max_score", good.alias("sufficient"))


def format_chunk(index: Column, path: Column, start: Column, end: Column, kind: Column, language: Column, text: Column) -> Column:
    """A labelled code block."""
    head = F.concat(F.lit("[Chunk "), index.cast("string"), F.lit("] File: "), F.coalesce(path, F.lit("unknown")), F.lit(" Lines "), F.coalesce(start.cast("string"), F.lit("?")), F.lit("-"), F.coalesce(end.cast("string"), F.lit("?")), F.lit(" ("), F.coalesce(kind, F.lit("snippet")), F.lit(")"))
    return F.concat(head, F.lit("\n```"), F.coalesce(language, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit("\n```"))


def format_structure(text: Column) -> Column:
    """A manifest as a block of a prompt."""
    return F.concat(F.lit("Repository file index:\n"), F.coalesce(text, F.lit("")))


def trim_greedy(chunks: DataFrame, tokens: str, budget: int = config.PROMPT_BUDGET, by: str = "item_id") -> DataFrame:
    """by, rank, new_rank of the chunks that fit in order; one that doesn't is skipped, smaller ones may follow.

    A fold over each question's few candidates, in its own row.
    """
    rows = F.array_sort(F.collect_list(F.struct("rank", F.col(tokens).cast("long").alias("t"))))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<bigint>").alias("kept"))
    step = lambda s, x: F.when(s["total"] + x["t"] <= budget, F.struct((s["total"] + x["t"]).alias("total"), F.array_append(s["kept"], x["rank"]).alias("kept"))).otherwise(s)
    kept = chunks.groupBy(by).agg(F.aggregate(rows, start, step, lambda s: s["kept"]).alias("kept"))
    return kept.select(by, F.posexplode("kept").alias("_p", "rank")).select(by, "rank", (F.col("_p") + 1).cast("long").alias("new_rank"))


def trim_prefix(chunks: DataFrame, tokens: str, budget: int = config.PROMPT_BUDGET, by: str = "item_id") -> DataFrame:
    """The chunks up to the first that doesn't fit, one at least."""
    w = Window.partitionBy(by).orderBy("rank")
    total = F.sum(tokens).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return chunks.withColumn("_t", total).withColumn("_r", F.row_number().over(w)).where((F.col("_t") <= budget) | (F.col("_r") == 1)).drop("_t", "_r")


def prompt(blocks: DataFrame, questions: DataFrame, by: str = "item_id") -> DataFrame:
    """by, prompt: the user message of each question with its blocks in order."""
    joined = blocks.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n\n").alias("blocks"))
    text = F.concat(F.lit("Using the following code context, please answer the question.\n\n"), F.coalesce("blocks", F.lit("")), F.lit("\n\nQuestion: "), "question")
    return questions.join(joined, by, "left").select(by, text.alias("prompt"))


def source_fields(chunks: DataFrame) -> list[Column]:
    """What a client sees of a chunk, with defaults for what is missing."""
    return [F.coalesce("file_path", F.lit("")).alias("file_path"), F.coalesce("start_line", F.lit(0)).cast("long").alias("start_line"), F.coalesce("end_line", F.lit(0)).cast("long").alias("end_line"), F.coalesce("chunk_type", F.lit("snippet")).alias("chunk_type"), F.coalesce("language", F.lit("")).alias("language"), F.coalesce("score", F.lit(0.0)).alias("score")]
