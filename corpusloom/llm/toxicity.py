"""Toxicity by multiple-instance learning: sentences are judged, documents carry the labels.

A sentence (bytes up to ``.``, ``!``, ``?`` or a line end) scores s = sigmoid(bias + sum of its distinct
features' weights); a document scores 1 - prod(1 - s), the noisy-or of its sentences.  Weights are learned from document
labels alone by gradient descent on the log loss, so the sentences that carry a toxic document's score are
found without sentence labels.

The model is fitted on at most ``sample_docs`` labelled documents, half of each label where there are so many and
those with the smallest hash of their id, and on no more of them than have ``sample_bytes`` of features, half of that
for each label (its first document always); they are weighted back to the labels' shares.  This bounds what the driver
holds; whole texts teach, and every document and every sentence is scored.  Only features of at least
``min_docs`` sampled documents have a weight, ``MAX_WORDS`` of them at most (the most frequent), so the
broadcast model is at most 16 bytes times that.

Defined cases: a null or empty text has no sentence and scores 0; labels that are null, or whose document is
missing, teach nothing; of several labels of one document the largest holds; of several texts with one id the one
whose features hash lowest teaches; all are scored; a row with a null id is scored and teaches nothing; with no labelled document every
score is about 0; every input row gives one row; a column named like a result gives way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import ALNUM, BYTE, U, Block, checkpointed, explode_blocks, lists, map_blocks, prefix_sums, span_hash, starts

MAX_WORDS = 1 << 17
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True


class Sentences(Block):
    """A block's sentences: row and bytes of each, and the features of its words with their sentence.

    A word's features are itself and its first 4, 5 and 6 bytes, so that inflected forms share what they learn.
    """

    def __init__(self, texts: pa.Array):
        super().__init__(texts, lower=True)
        self.words(ALNUM)
        if not len(self.start):
            none = np.zeros(0, np.int64)
            self.sentence, self.hash, self.of, self.begin, self.stop = none, none.astype(U), none, none, none
            return
        stops = np.cumsum(_STOP[self.buf])
        new = np.ones(len(self.start), bool)
        new[1:] = (np.diff(stops[self.start]) > 0) | (np.diff(self.row) > 0)
        number = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        self.of = self.row[head]
        self.begin, self.stop = self.start[head], self.end[np.append(head[1:], len(number)) - 1]
        sums = prefix_sums(BYTE[self.buf])
        found, places = [span_hash(sums, self.start, self.end)], [number]
        for n in (4, 5, 6):
            own = np.flatnonzero(self.end - self.start >= n)
            found.append(span_hash(sums, self.start[own], self.start[own] + n) ^ U(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            places.append(number[own])
        self.hash, self.sentence = np.concatenate(found), np.concatenate(places)


def distinct(sentence: np.ndarray, feature: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each feature (below n) of a sentence once."""
    both = np.unique(sentence * np.int64(max(n, 1)) + feature)
    return both // max(n, 1), both % max(n, 1)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Model:
    """Sorted word hashes with weights, and the bias of every sentence."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.keys, self.weights, self.bias = keys, weights, bias
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(keys >> U(44)).astype(np.int64)] = True

    def sentence_scores(self, s: Sentences) -> np.ndarray:
        if not len(s.of) or not len(self.keys):
            return _sigmoid(np.full(len(s.of), self.bias))
        maybe = np.flatnonzero(self.sieve[(s.hash >> U(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, s.hash[maybe]), len(self.keys) - 1)
        known = self.keys[at] == s.hash[maybe]
        sentence, feature = distinct(s.sentence[maybe[known]], at[known], len(self.keys))
        return _sigmoid(np.bincount(sentence, self.weights[feature], len(s.of)) + self.bias)

    def document_scores(self, s: Sentences, scores: np.ndarray) -> np.ndarray:
        return -np.expm1(np.bincount(s.of, np.log1p(-np.minimum(scores, 1 - 1e-15)), s.rows))


def fit_bags(bags: list[tuple[int, int, np.ndarray, np.ndarray]], share: dict[int, float] | None = None, min_docs: int = 3, steps: int = 300, rate: float = 0.15, lasso: float = 5e-5, ridge: float = 1e-5) -> Model:
    """From (label, number of sentences, sentence and hash of each feature) of each document.

    ``share`` has the number of documents that one of each label stands for.

    Adam on the mean log loss of the noisy-or with a ridge and a lasso on the weights; for a document with
    probability p and label y the loss's slope in the logit of a sentence with score s is s (p - y) / p.
    Features whose weight ends at 0 leave the model.
    """
    if not bags:
        return Model(np.zeros(0, U), np.zeros(0), -20.0)
    y = np.array([b[0] for b in bags], float)
    per = np.array([b[1] for b in bags])
    base = starts(per)
    bag = np.repeat(np.arange(len(bags)), per)
    # features of enough documents first: the rest never reaches the larger arrays
    keys, df = np.unique(np.concatenate([np.unique(b[3]) for b in bags]), return_counts=True)
    good = df >= min_docs
    if good.sum() > MAX_WORDS:
        good &= df >= np.sort(df)[-MAX_WORDS]
    keys, sentences, columns = keys[good], [], []
    if len(keys):
        for b, o in zip(bags, base, strict=False):
            at = np.minimum(np.searchsorted(keys, b[3]), len(keys) - 1)
            known = keys[at] == b[3]
            s_, c_ = distinct(b[2][known] + o, at[known], len(keys))
            sentences.append(s_.astype(np.int32))
            columns.append(c_.astype(np.int32))
    sentence, column = (np.concatenate([*x, np.zeros(0, np.int32)]) for x in (sentences, columns))
    weight = np.array([(share or {}).get(int(x > 0), 1.0) for x in y])
    weight /= weight.sum()
    w, b = np.zeros(len(keys)), -6.0
    m, v = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
    for t in range(1, steps + 1):
        s = _sigmoid(np.bincount(sentence, w[column], len(bag)) + b)
        p = np.clip(-np.expm1(np.bincount(bag, np.log1p(-np.minimum(s, 1 - 1e-12)), len(bags))), 1e-9, 1)
        slope = s * ((p - y) / p * weight)[bag]
        g = np.append(np.bincount(column, slope[sentence], len(keys)) + ridge * w + lasso * np.sign(w), slope.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        w, b = w - step[:-1], b - step[-1]
    alive = np.abs(w) > 0.05
    return Model(keys[alive], w[alive], float(b))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", sample_docs: int = 3000, sample_bytes: int = 96 << 20, **options) -> Model:
    """A model from at most ``sample_docs`` labelled documents (those whose ids hash lowest) with ``sample_bytes`` of features."""
    known = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("y")).where("i is not null and y is not null").groupBy("i").agg(F.max("y").alias("y"))
    total = {r.y: r.n for r in known.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    # half of each label if there are so many; what one lacks the other may have
    some = min(total.get(1, 0), max(sample_docs // 2, sample_docs - total.get(0, 0)))
    half = {1: some, 0: min(total.get(0, 0), sample_docs - some)}
    drawn = [known.where(F.col("y") > 0 if y else F.col("y") <= 0).orderBy(F.xxhash64("i"), "i").limit(n).withColumn("y", F.lit(y)) for y, n in half.items()]
    known = drawn[0].unionByName(drawn[1])
    rows = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(F.broadcast(known), "i")  # sample_docs rows at most
    schema = T.StructType([T.StructField("i", T.StringType()), T.StructField("y", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("sentences", T.BinaryType()), T.StructField("hashes", T.BinaryType())])

    def bags(texts: pa.Array, i: pa.Array, y: pa.Array) -> list[pa.Array]:
        s = Sentences(texts)
        per = np.bincount(s.of, minlength=s.rows)
        base = starts(per)
        # each feature of a sentence once
        order = np.lexsort((s.hash, s.sentence))
        sentence, h = s.sentence[order], s.hash[order]
        new = np.ones(len(h), bool)
        new[1:] = (np.diff(sentence) > 0) | (h[1:] != h[:-1])
        sentence, h = sentence[new], h[new]
        row = s.of[sentence] if len(s.of) else sentence
        cut = starts(np.bincount(row, minlength=s.rows))
        local = (sentence - base[row]).astype(np.int32)
        return [i, y, pa.array(per.astype(np.int32)), *(pa.array([x[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()) for x in (local, h))]

    got = checkpointed(explode_blocks(rows.select(F.col("i").cast("string").alias("i"), "y", "t"), "t", ["i", "y"], schema, bags).withColumn("h", F.xxhash64("hashes", "sentences")))
    # one text of each id, so that these are sample_docs small rows at most
    sizes = got.groupBy("i", "y").agg(F.min(F.struct("h", (F.octet_length("hashes") + F.octet_length("sentences")).alias("size"))).alias("s")).select("i", "y", "s.*")
    chosen, room, used = [], {0: sample_bytes // 2, 1: sample_bytes // 2}, {0: 0, 1: 0}
    for r in sorted(sizes.collect(), key=lambda r: (r.h, r.i)):
        if r.size <= room[r.y] or not used[r.y]:
            room[r.y] -= r.size
            used[r.y] += 1
            chosen.append((r.i, r.h))
    share = {y: total.get(y, 0) / max(n, 1) for y, n in used.items()}
    picked = docs.sparkSession.createDataFrame(chosen, "i string, h long")
    got = got.join(F.broadcast(picked), ["i", "h"]).dropDuplicates(["i", "h"]).collect()
    bags = sorted(((r.y, r.n, np.frombuffer(r.sentences, np.int32), np.frombuffer(r.hashes, U), r.i) for r in got), key=lambda b: (b[4], b[3].tobytes()))
    return fit_bags([b[:4] for b in bags], share, **options)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, sentences: bool = False, threshold: float = 0.5) -> DataFrame:
    """``keep`` columns (all by default) with score, predicted and, if asked for, the offending ``sentences``.

    An offending sentence alone reaches the threshold: (first byte, byte after the last, its score), in the order of the text.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.keys, model.weights, model.bias))
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
    fields = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), *[T.StructField("sentences", span)] * sentences])

    def fn(texts: pa.Array) -> list[pa.Array]:
        s, m = Sentences(texts), Model(*shared.value)
        each = m.sentence_scores(s)
        p = m.document_scores(s, each)
        out = [pa.array(p), pa.array((p >= threshold).astype(np.int32))]
        if sentences:
            bad = np.flatnonzero(each >= threshold)
            base = s.off[s.of[bad]]
            found = pa.StructArray.from_arrays([pa.array(s.begin[bad] - base), pa.array(s.stop[bad] - base), pa.array(each[bad])], ["start", "end", "score"])
            out.append(lists(found, np.bincount(s.of[bad], minlength=s.rows)))
        return out

    return map_blocks(docs, text, list(docs.columns) if keep is None else keep, fields, fn)


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold() != 0)
    out = score(docs, fit(docs, labels), keep=["doc_id"], sentences=True)
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", "predicted", F.size("sentences").alias("n_offending"))
