"""Vectors: validation, normalisation, exact top-k, and a deterministic hashing embedder."""

from __future__ import annotations

import hashlib
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .. import config
from ..functions import text as X

#: Bytes of text whose words are counted at once: at most half a million words or so.
SLICE = 1 << 21
#: Words whose hash is remembered.
MEMO = 1 << 15


def validate(vectors: DataFrame, dim: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    size = F.coalesce(F.size(vector), F.lit(0))
    return vectors.select(key, size.cast("long").alias("dim"), ((size == dim) & (size > 0)).alias("valid"))


def norms(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    return vectors.select(key, F.round(X.norm(F.col(vector)), 6).alias("norm_before"), F.round(X.norm(X.l2_normalize(F.col(vector))), 6).alias("norm_after"))


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices, unit rows) of the vectors that have ``dim`` finite components; a zero vector stays zero."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(size == dim)
    v = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    n = np.sqrt((v * v).sum(1))
    good = np.isfinite(n)
    return at[good], v[good] / np.where(n[good] > 0, n[good], 1)[:, None]


def best_of(scores: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k largest scores, equal ones in the given order."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((order[at], -scores[at]))[:k]]


def places(keys: pa.Array) -> np.ndarray:
    """The rank of each key among the batch's."""
    order = pc.sort_indices(keys).to_numpy()
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out


def in_parts(queries: DataFrame, by: str, vector: str, limit: int) -> list[tuple[list, np.ndarray]]:
    """Queries as (ids, unit rows) in parts of about ``limit`` and of one length each; those without a vector are left out."""
    asked = queries.where(F.col(vector).isNotNull()).select(by, F.col(vector).cast("array<double>").alias("v"))
    parts = max(1, -(-asked.count() // limit))
    out = []
    for p in range(parts):
        rows = asked.where(F.pmod(F.xxhash64(by), F.lit(parts)) == p).toArrow()
        for dim in set(pc.list_value_length(rows["v"]).to_pylist()) - {0, None}:
            at, unit = _matrix(rows["v"].combine_chunks(), dim)
            out.append((rows[by].take(pa.array(at)).to_pylist(), unit))
    return out


def ranked(scored: DataFrame, k: int, key: str, by: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), key))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = config.DENSE_K, key: str = "vec_id", vector: str = "embedding", by: str = "query_id", limit: int = 10_000, positive: bool = False) -> DataFrame:
    """by, key, score, rank: exact cosine of a stated set of queries, sent to all tasks in parts of about ``limit``.

    Each batch of vectors is multiplied with the queries and keeps the best ``k`` of each, so little is shuffled.
    Vectors that are null, of another length than the query or not finite are left out; ``positive`` leaves out scores
    that aren't above 0.
    """
    schema = T.StructType([T.StructField(by, queries.schema[by].dataType), T.StructField(key, vectors.schema[key].dataType), T.StructField("score", T.DoubleType())])
    # nulls are left out in the task: a filter here would be pushed below an embedding and work it out twice
    rows, kind = vectors.select(key, vector), to_arrow_type(schema[by].dataType)

    def part(ids: list, unit: np.ndarray) -> DataFrame:
        shared = vectors.sparkSession.sparkContext.broadcast((ids, unit))

        def run(batches):
            ids, q = shared.value
            for b in batches:
                at, v = _matrix(b.column(1), q.shape[1])
                order, names, found, scores = places(b.column(0).take(pa.array(at))), [], [], []
                for lo in range(0, len(ids), 256):
                    s = np.round(v @ q[lo : lo + 256].T, 6)
                    for i in range(s.shape[1]):
                        own = best_of(s[:, i], order, k)
                        own = own[s[own, i] > 0] if positive else own
                        names += [ids[lo + i]] * len(own)
                        found.append(at[own])
                        scores.append(s[own, i])
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(names, kind), b.column(0).take(pa.array(np.concatenate(found))), pa.array(np.concatenate(scores))], names=schema.names)

        return ranked(rows.mapInArrow(run, schema), k, key, by)

    parts = [part(*p) for p in in_parts(queries, by, vector, limit)]
    return reduce(DataFrame.unionByName, parts) if parts else ranked(rows.limit(0).select(F.lit(None).cast(schema[by].dataType).alias(by), key, F.lit(0.0).alias("score")), k, key, by)


def _unit_counts(buckets: int):
    at_once, at_most = SLICE, MEMO

    class Buckets(dict):
        """The bucket of each word; a frequent one is hashed once or so, and no more than ``at_most`` are held."""

        def __missing__(self, word: str) -> int:
            if len(self) >= at_most:
                self.clear()
            own = self[word] = hashlib.md5(word.encode()).digest()[0] % buckets
            return own

    def counts(words: list[list[str]], bucket) -> np.ndarray:
        size = np.fromiter(map(len, words), np.int64, len(words))
        row, of = np.repeat(np.arange(len(words)), size), np.fromiter(map(bucket, chain.from_iterable(words)), np.int64, int(size.sum()))
        n = np.bincount(row * buckets + of, minlength=len(words) * buckets).reshape(len(words), buckets).astype(np.float64)
        length = np.sqrt((n * n).sum(1))
        return n / np.where(length > 0, length, 1)[:, None]

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(texts: pa.Array) -> pa.Array:
        out, lo, bucket = [], 0, Buckets().__getitem__
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        while lo < len(texts):
            # texts of about ``SLICE`` bytes at once, whatever the batch holds; a longer one by itself
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + at_once, side="right")))
            out.append(counts([(t or "").split() for t in texts.slice(lo, hi - lo).to_pylist()], bucket))
            lo = hi
        n = np.concatenate([np.zeros((0, buckets)), *out])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * buckets), pa.array(n.ravel()))

    return run


def embed(text: Column, buckets: int = 64) -> Column:
    """The stand-in for a model: a text's words counted by two hexadecimal digits of their MD5, as a unit vector; zero without words."""
    return _unit_counts(buckets)(F.lower(text))


def hashed(docs: DataFrame, buckets: int = 64, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, bucket, weight: counts of words by two hex digits of their MD5, scaled to unit length."""
    words = docs.select(key, F.explode(X.tokens(F.col(text))).alias("w"))
    counts = words.groupBy(key, (F.conv(F.left(F.md5("w"), F.lit(2)), 16, 10).cast("long") % buckets).alias("bucket")).agg(F.count("*").alias("n"))
    length = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy(key)))
    return counts.select(key, "bucket", (F.col("n") / length).alias("weight"))
