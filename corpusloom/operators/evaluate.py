"""Retrieval and answer quality in batch: first hits, recall, reciprocal rank, keywords, faithfulness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import keyword_rate, tokens
from .index import Bm25Index

#: Candidates that are sent to all tasks, at about 50 bytes each; joined by shuffle beyond.
BROADCAST = 1 << 18


def hit(mode: Column, expected_file: Column, expected_symbol: Column, path: Column, symbol: Column) -> Column:
    """File expectations are parts of the path, symbols are exact; any other mode takes either; an empty one never holds."""
    file = F.coalesce((expected_file != "") & F.contains(path, expected_file), F.lit(False))
    name = F.coalesce((expected_symbol != "") & (symbol == expected_symbol), F.lit(False))
    return F.when(mode == "file", file).when(mode == "symbol", name).otherwise(file | name)


def relevant(index: Bm25Index, collection: str, docs: DataFrame, questions: DataFrame, by: str = "item_id", key: str = "doc_id", text: str = "text", passage: str = "passage") -> DataFrame:
    """``by``, ``key`` of the documents that hold a question's whole passage, letter by letter.

    Candidates are the index's postings of the rarest word from within the passage (its first and last may be parts of
    a document's words); each is read and compared once.  Passages without a word between two others are a stated set
    that is held against all documents.  A null or empty passage has no answer.
    """
    asked = questions.where(F.length(passage) > 0).select(by, F.col(passage).alias("passage"))
    words = F.split("passage", r"\s+")
    inner = tokens(F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), " "))
    asked = asked.withColumn("inner", inner)
    terms = asked.select(by, F.explode(F.array_distinct("inner")).alias("term"))
    weights = index.weights(collection).join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
    # a passage with a word that the index doesn't know is held by none
    rarest = terms.join(weights, "term", "left").groupBy(by).agg(F.min_by("term", F.struct(F.coalesce("df", F.lit(0)), F.col("term"))).alias("term"))
    # the blocks of other terms are left before their postings become rows
    near = index.postings(collection, rarest.select("term").distinct()).join(F.broadcast(rarest), "term").select(by, F.col("key").alias(key))
    near = F.broadcast(near) if near.count() <= BROADCAST else near
    bodies = docs.select(key, F.col(text).alias("body"))
    held = lambda rows: rows.where(F.contains("body", F.col("passage"))).select(by, key)
    long = held(bodies.join(near, key).join(F.broadcast(asked.select(by, "passage")), by))
    short = asked.where(F.size("inner") == 0).select(by, "passage")
    return long.unionByName(held(bodies.join(F.broadcast(short), F.contains("body", F.col("passage"))))) if short.count() else long


def first_hits(results: DataFrame, relevant: DataFrame, by: str = "item_id", key: str = "doc_id") -> DataFrame:
    """by, first_rank of each question that has a relevant document; null without a hit."""
    hits = results.join(relevant, [by, key], "left_semi").groupBy(by).agg(F.min("rank").alias("first_rank"))
    return relevant.select(by).distinct().join(hits, by, "left")


def recall(first: DataFrame, ks: list[int]) -> DataFrame:
    """k, recall: the share of questions with a hit among the first k."""
    rows = first.select(F.explode(F.array(*(F.lit(k).cast("long") for k in ks))).alias("k"), "first_rank")
    return rows.groupBy("k").agg(F.round(F.avg(F.when(F.col("first_rank") <= F.col("k"), 1.0).otherwise(0.0)), 6).alias("recall"))


def mrr(first: DataFrame) -> DataFrame:
    return first.agg(F.round(F.coalesce(F.avg(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))), F.lit(0.0)), 6).alias("mrr"), F.count("*").alias("n"))


def keyword_rates(answers: DataFrame, answer: str, keywords: str, by: str = "item_id") -> DataFrame:
    return answers.select(by, F.round(keyword_rate(F.col(answer), F.col(keywords)), 6).alias("rate"))


def faithfulness(verdicts: DataFrame, verdict: str, by: str) -> DataFrame:
    """by, rate over the judged ones, judged, skipped."""
    v = F.col(verdict).cast("double")
    return verdicts.groupBy(by).agg(F.round(F.avg(v), 6).alias("rate"), F.count(v).alias("judged"), F.count_if(v.isNull()).alias("skipped"))


def judge_prompts(answers: DataFrame, chunks: DataFrame, by: str = "item_id", most: int = 8, chars: int = 400) -> DataFrame:
    """by, prompt: what a judge is shown of each answer - the first chunks, each clipped, and the answer."""
    rows = F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", F.left("text", F.lit(chars)).alias("t")))))
    context = chunks.groupBy(by).agg(F.array_join(F.transform(rows, lambda x: x["t"]), "\n---\n").alias("context"))
    text = F.concat(F.lit("Context:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nAnswer:\n"), "answer", F.lit("\n\nReply faithful or unfaithful."))
    return answers.join(context, by, "left").select(by, text.alias("prompt"))


def verdict(reply: Column) -> Column:
    """True only for exactly the word faithful; null (an answer that could not be judged) stays null."""
    return F.lower(F.trim(reply)) == "faithful"
