"""BM25: postings, lengths and term weights as tables; top-k by joins of question terms and postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.text import tokens


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, term, tf."""
    return docs.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, doc_len; no shuffle."""
    return docs.select(key, F.size(tokens(F.col(text))).cast("long").alias("doc_len"))


def weights(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """term, df, idf: ln(N - df + 0.5) - ln(df + 0.5); negative ones give way to a quarter of the mean."""
    n = docs.agg(F.count("*").alias("n"))
    terms = docs.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    # one row each: the count of documents and the mean weight
    raw = terms.withColumn("raw", F.log(n.scalar() - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = raw.agg((config.BM25_EPSILON * F.avg("raw")).alias("floor"))
    return raw.select("term", "df", F.when(F.col("raw") < 0, floor.scalar()).otherwise(F.col("raw")).alias("idf"))


def top_k(docs: DataFrame, questions: DataFrame, k: int = config.SPARSE_K, key: str = "doc_id", text: str = "text", by: str = "item_id") -> DataFrame:
    """by, key, score, rank of the best documents of each question; scores of 0 or less are cut."""
    asked = questions.select(by, F.explode(tokens(F.col("question"))).alias("term")).groupBy(by, "term").agg(F.count("*").alias("c"))
    # only the questions' terms are posted and weighted
    wanted = asked.select("term").distinct()
    stats = docs.select(F.size(tokens(F.col(text))).alias("l")).agg(F.avg("l").alias("mean"))
    hit = postings(docs, key, text).join(wanted, "term", "left_semi").join(lengths(docs, key, text), key)
    saturation = F.col("tf") + config.BM25_K1 * (1 - config.BM25_B + config.BM25_B * F.col("doc_len") / stats.scalar())
    part = F.col("c") * F.col("idf") * F.col("tf") * (config.BM25_K1 + 1) / saturation
    scored = asked.join(weights(docs, key, text), "term").join(hit, "term").groupBy(by, key).agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)
