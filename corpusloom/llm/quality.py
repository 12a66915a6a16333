"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target to the raw corpus, in built-in functions only.

Words and pairs of neighbouring words fall into hash buckets, one for about ``PER_BUCKET`` n-grams of the corpus and
``BUCKETS`` at least.  Two multinomials over the buckets are counted in one pass, one over the trusted documents and
one over all of them, each smoothed by ``ALPHA`` a bucket.  A document's score is the mean over its n-grams of
log p_target - log p_raw, shrunk to 0 by ``PRIOR`` n-grams so that a short text needs more evidence; it is kept if the
score reaches the threshold.  Every document is counted and judged whole; the only thing sent to all tasks is one
array of a double for each bucket, at most ``FINE`` (8 MB).

The threshold is calibrated on trusted documents that the target has not seen (``held_out``, a fifth by hash of the
id): all but ``SPARE`` of them reach it.

Before the ratio stand two rules: at least ``min_words`` words, and at most half of the words inside 3-word
windows that the text holds twice.

Defined cases: a null text counts as empty, has no words, scores 0 and fails the rules; a very long text is counted
and judged as one row; an empty table gives an empty result; a row with a null id is judged and never trusted; without
a trusted document the target is uniform, without one to calibrate on the threshold is ``THRESHOLD``; repeated rows
are judged row by row; input columns named like a result give way.  Windows are compared by 64-bit hash, a chance of
error of about 1e-11 in a text of 20,000 words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .blocks import checkpointed

#: The least and the largest number of buckets, and how many n-grams of the corpus share one on average.
BUCKETS, FINE = 1 << 14, 1 << 20
PER_BUCKET = 512
ALPHA = 0.5
PRIOR = 50.0
#: For want of trusted documents to calibrate on.
THRESHOLD = -0.06
#: Share of the held-out trusted documents that may fall below the threshold, and the width of the scores' cells.
SPARE, CELL = 0.001, 0.001
#: Ids of trusted documents that may be broadcast (16 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1 << 20
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    """Runs of characters that are not ASCII white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def text_counts(text: str) -> dict[str, Column]:
    """The contract's counts that need no words."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "word_chars": F.length(F.regexp_replace(t, SPACE, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def _places(n: Column, size: int) -> Column:
    """Where each of the windows of ``size`` words begins."""
    return F.when(n >= size, F.sequence(F.lit(0), n - size)).otherwise(F.array().cast("array<int>"))


def repeat_words(words: Column) -> Column:
    """Words under the 3-word windows that the text holds twice or more: in hash order, equal ones stand side by side."""
    windows = F.sort_array(F.transform(_places(F.size(words), 3), lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))))

    def twice(v: Column) -> Column:
        same = lambda w, k: (w["h"] == F.get(v, k + 1)["h"]) | ((k > 0) & (w["h"] == F.get(v, F.greatest(k - 1, F.lit(0)))["h"]))
        return F.sort_array(F.filter(F.transform(v, lambda w, k: F.when(same(w, k), w["i"])), lambda i: i.isNotNull()))

    # positions in order; each window adds the words after the end of the one before
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    return F.aggregate(let(windows, twice), start, lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")), lambda s: s["n"].cast("long"))


def buckets_of(words: Column, buckets: int = BUCKETS) -> Column:
    """Bucket of each word and of each pair of neighbours."""
    ones = F.transform(words, lambda w: _bucket(buckets, w))
    pairs = F.transform(_places(F.size(words), 2), lambda i: _bucket(buckets, F.get(words, i), F.get(words, i + 1)))
    return F.concat(ones, pairs)


def _bucket(buckets: int, *words: Column) -> Column:
    return F.pmod(F.xxhash64(*words), F.lit(buckets)).cast("int")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for a fifth of the ids, by hash."""
    return F.pmod(F.xxhash64(F.col(doc_id).cast("long")), F.lit(5)) == 0


def _ids(trusted: DataFrame, doc_id: str) -> tuple[DataFrame, bool]:
    """Distinct trusted ids, and whether they are few enough to be broadcast."""
    good = trusted.select(F.col(doc_id).alias("_id")).where("_id is not null").distinct()
    few = good.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return (F.broadcast(good) if few else good), few


def _counts(docs: DataFrame, trusted: DataFrame, text: str, doc_id: str) -> DataFrame:
    """b, raw, target: how often each of ``FINE`` buckets occurs in all documents and in the trusted ones."""
    good, few = _ids(trusted, doc_id)
    good = good.withColumn("_good", F.lit(True))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    # ids that are shuffled leave the rows without one where they are
    marked = rows.join(good, "_id", "left") if few else rows.where("_id is not null").join(good, "_id", "left").unionByName(rows.where("_id is null").withColumn("_good", F.lit(None).cast("boolean")))
    words = marked.select("_good", words_of(F.col("_text")).alias("w"))
    # each word with the one behind it; hashing and counting are compiled
    pairs = words.select("_good", F.explode(F.arrays_zip("w", F.slice("w", F.lit(2), F.size("w")).alias("next"))).alias("p")).select("_good", F.col("p.w").alias("w"), F.col("p.next").alias("next"))
    found = pairs.select("_good", F.explode(F.array(_bucket(FINE, F.col("w")), F.when(F.col("next").isNotNull(), _bucket(FINE, F.col("w"), F.col("next"))))).alias("b")).where("b is not null")
    return found.groupBy("b").agg(F.count("*").alias("raw"), F.count("_good").alias("target"))


def n_buckets(grams: int) -> int:
    """The power of two that gives each bucket at most ``PER_BUCKET`` of ``grams``, from ``BUCKETS`` to ``FINE``."""
    return min(FINE, max(BUCKETS, 1 << max(0, -(-grams // PER_BUCKET) - 1).bit_length()))


def weights(docs: DataFrame, trusted: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row, one column ``w``: log p_target - log p_raw of each bucket.

    ``trusted`` has the ids of the trusted documents; it is joined by id before the words are counted.
    """
    fine = checkpointed(_counts(docs, trusted, text, doc_id))
    total = fine.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("raw", "target"))).first()
    n = n_buckets(total.raw)
    # a power of two's buckets are sums over those of a larger one
    counts = fine.groupBy(F.pmod("b", F.lit(n)).alias("b")).agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    every = docs.sparkSession.range(n).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").na.fill(0)
    p = {c: F.log((F.col(c) + ALPHA) / F.lit(total[c] + ALPHA * n)) for c in ("raw", "target")}
    rows = every.select(F.struct("b", (p["target"] - p["raw"]).alias("w")).alias("x")).agg(F.array_sort(F.collect_list("x")).alias("x"))
    return checkpointed(rows.select(F.col("x.w").alias("w")))


def calibrated(docs: DataFrame, model: DataFrame, trusted: DataFrame, text: str = "text", doc_id: str = "doc_id", spare: float = SPARE) -> float:
    """The edge of the cell that all but ``spare`` of the ``trusted`` documents reach; of those that pass the base rules."""
    good, _ = _ids(trusted, doc_id)
    own = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(good, "_id", "left_semi")
    # scores are means of bounded logs, so there are some thousand cells at most; counted without a filter, which would
    # move below the projection and work out every text's counts again
    cells = judge(own, model, "_text", []).groupBy(F.floor(F.col("score") / CELL).alias("c")).agg(F.count_if(~F.col("base_failed")).alias("n"))
    total = cells.withColumns({"below": F.sum("n").over(Window.orderBy("c")), "all": F.sum("n").over(Window.partitionBy())})
    cut = total.where(F.col("below") > spare * F.col("all")).agg(F.min("c")).first()[0]
    return THRESHOLD if cut is None else cut * CELL


def judge(docs: DataFrame, model: DataFrame, text: str = "text", keep: list[str] | None = None, min_words: int = 50, threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns (all by default) with n_words, the base counts, base_failed, score and kept."""
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in new]
    # a higher-order function takes no subquery, so the model is a column first; no exchange follows
    buckets = model.select(F.size("w")).first()[0]
    first = docs.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)), F.col(text).alias("_text")).withColumn("_w", model.scalar())

    def by_words(w: Column) -> Column:
        total = F.aggregate(buckets_of(w, buckets), F.lit(0.0), lambda s, b: s + F.get(F.col("_w"), b))
        return F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("repeats"), total.alias("total"))

    counted = first.select(*(F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)), *(v.alias(k) for k, v in text_counts("_text").items()), let(words_of(F.col("_text")), by_words).alias("_r"))
    counted = counted.withColumns({"n_words": F.col("_r.n"), "n_repeat_words": F.col("_r.repeats"), "score": F.col("_r.total") / (F.greatest(2 * F.col("_r.n") - 1, F.lit(0)) + PRIOR)})
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold)).select(*keep, *new)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    model = weights(docs, trusted.where(~held_out()))
    out = judge(docs, model, keep=["doc_id"], threshold=calibrated(docs, model, trusted.where(held_out())))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("score", 6).alias("score"))
