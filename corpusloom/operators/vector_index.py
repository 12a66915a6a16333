"""Stored vectors in inverted lists: coarse centroids, residual codes to search by, the vectors themselves to score by.

A vector lies in the list of its nearest centroid, as its difference from it in one byte a component.  A question is held
against the codes of the lists nearest to it - other lists' files aren't opened, and of those that are only the codes
are read - and the best by their codes are scored exactly on their vectors.  Centroids are trained on at most ``sample``
vectors, taken by hash; every vector is indexed.  ``exact=True`` reads all lists and scores all vectors.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .. import config
from . import vectors as V

#: Candidates that are sent to all tasks for scoring, at about 50 bytes each; joined by shuffle beyond.
BROADCAST = 1 << 18
#: Queries whose scores against a batch are held at once.
QUERIES = 256


def trained(x: np.ndarray, lists: int, rounds: int) -> np.ndarray:
    """Unit centroids of unit vectors by k-means on the sphere; a list that loses all its vectors keeps its centroid."""
    c = x[:: max(1, len(x) // lists)][:lists].copy()
    for _ in range(rounds):
        of = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        n = np.sqrt((sums * sums).sum(1))
        c[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return c


def calibrated(x: np.ndarray, c: np.ndarray, k: int, target: float, queries: int = 128) -> int:
    """The smallest number of lists that hold ``target`` of the ``k`` nearest of a sample's vectors, for some of them.

    A sample's neighbours lie further apart than all vectors' do, so it asks for too many rather than too few.
    """
    at = np.arange(0, len(x), max(1, len(x) // queries))[:queries]
    of = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
    place = np.argsort(np.argsort(-(x[at] @ c.T), axis=1, kind="stable"), axis=1)
    s = x[at] @ x.T
    s[np.arange(len(at)), at] = np.inf  # itself, which comes first and isn't counted
    near = np.argsort(-s, axis=1)[:, 1 : k + 1]
    if not near.size:
        return len(c)
    needed = np.take_along_axis(place, of[near], axis=1)
    share = np.cumsum(np.bincount(needed.ravel(), minlength=len(c))) / needed.size
    return int(np.searchsorted(share, target) + 1)


class VectorIndex:
    """The index below ``root``: tables ``centroids`` and ``vectors``, the latter partitioned by list."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def build(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", lists: int | None = None, sample: int = 65_536, rounds: int = 8, k: int = config.DENSE_K, target: float = 0.95) -> None:
        """Trains and writes the index in place of what was there; ``lists`` is the square root of the number of vectors if not given, 4,096 at most.

        The number of lists that a search opens is calibrated on the sample, so that they hold ``target`` of the ``k``
        nearest: few where vectors lie in groups, most where they lie like noise.
        Vectors that are null, not finite or of another length than most of the sample are left out; a table without
        any other is an error.
        """
        rows = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0))
        taken = rows.select(F.col(vector).cast("array<double>").alias("v"), F.xxhash64(key).alias("h")).orderBy("h").limit(sample).toArrow()["v"].combine_chunks()
        sizes = np.bincount(taken.value_lengths().to_numpy(zero_copy_only=False)) if len(taken) else np.zeros(1)
        x = V._matrix(taken, int(sizes.argmax()))[1] if len(taken) else np.zeros((0, 1))
        if not len(x):
            raise ValueError("there is no vector to index")
        lists = lists or int(min(4096, max(1, round(rows.count() ** 0.5))))
        c = trained(x, min(lists, len(x)), rounds)
        probes = min(len(c), calibrated(x, c, k, target))
        self.spark.createDataFrame([(i, v, probes) for i, v in enumerate(c.tolist())], "list int, centroid array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/centroids")
        self._write(rows, key, vector, c, "overwrite")

    def add(self, vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> None:
        """Adds vectors to the lists that are there; a key that is there already is then held twice."""
        self._write(vectors.where(F.col(vector).isNotNull()), key, vector, self.centroids(), "append")

    def centroids(self) -> np.ndarray:
        return np.array([r.centroid for r in self.spark.read.parquet(f"{self.root}/centroids").orderBy("list").collect()])

    def probes(self) -> int:
        return self.spark.read.parquet(f"{self.root}/centroids").first().probes

    def _write(self, rows: DataFrame, key: str, vector: str, c: np.ndarray, mode: str) -> None:
        schema = T.StructType([
            T.StructField("key", rows.schema[key].dataType), T.StructField("code", T.BinaryType()), T.StructField("scale", T.DoubleType()), T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("list", T.IntegerType())
        ])
        shared = self.spark.sparkContext.broadcast(c)

        def run(batches):
            c = shared.value
            for b in batches:
                at, v = V._matrix(b.column(1), c.shape[1])
                if not len(at):
                    continue
                of = (v @ c.T).argmax(1)
                rest = v - c[of]
                scale = np.abs(rest).max(1) / 127
                code = np.round(rest / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
                held = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([x.tobytes() for x in code], pa.binary()), pa.array(scale), held, pa.array(of, pa.int32())], names=schema.names)

        # a list's rows come together; lists that are much larger than others are split
        out = rows.select(key, vector).mapInArrow(run, schema).hint("rebalance", "list")
        out.write.mode(mode).option("partitionOverwriteMode", "static").partitionBy("list").parquet(f"{self.root}/vectors")

    def top_k(self, queries: DataFrame, k: int = config.DENSE_K, probes: int | None = None, refine: int = 4, exact: bool = False, key: str = "vec_id", vector: str = "embedding", by: str = "query_id", limit: int = 10_000) -> DataFrame:
        """``by``, ``key``, score, rank of the best vectors for a stated set of queries, in parts of about ``limit``.

        ``probes`` lists, the calibrated number if not given, are searched for each query, and ``refine`` times ``k`` candidates are scored exactly.
        """
        stored = self.spark.read.parquet(f"{self.root}/vectors")
        if exact:
            asked = queries.select(F.col(by), F.col(vector).alias("vector"))
            return V.top_k(stored, asked, k, "key", "vector", by, limit).withColumnRenamed("key", key)
        c, probes = self.centroids(), probes or self.probes()
        parts = [self._search(stored, ids, unit, c, k, probes, refine, by, queries.schema[by].dataType) for ids, unit in V.in_parts(queries, by, vector, limit) if unit.shape[1] == c.shape[1]]
        if not parts:
            return stored.limit(0).select(F.lit(None).cast(queries.schema[by].dataType).alias(by), F.col("key").alias(key), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank"))
        return reduce(DataFrame.unionByName, parts).withColumnRenamed("key", key)

    def _search(self, stored: DataFrame, ids: list, unit: np.ndarray, c: np.ndarray, k: int, probes: int, refine: int, by: str, kind: T.DataType) -> DataFrame:
        near = np.argsort(-(unit @ c.T), axis=1, kind="stable")[:, :probes]
        asked: dict[int, np.ndarray] = {j: np.flatnonzero((near == j).any(1)) for j in np.unique(near).tolist()}
        shared = self.spark.sparkContext.broadcast((asked, unit, c))
        schema = T.StructType([T.StructField("_q", T.IntegerType()), stored.schema["key"], T.StructField("list", T.IntegerType()), T.StructField("score", T.DoubleType())])
        kept_type = to_arrow_type(stored.schema["key"].dataType)
        keep = k * refine

        def by_code(batches):
            """The best of each query among all that a task reads: few enough to be ranked over all tasks."""
            asked, q, c = shared.value
            pool, lists = pa.nulls(0, kept_type), np.zeros(0, np.int32)
            held = [(np.zeros(0), np.zeros(0, np.int64))] * len(q)  # scores and places in the pool, a query each
            for b in batches:
                if not b.num_rows:
                    continue
                own = b.column("list").to_numpy()
                code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.int8).reshape(b.num_rows, -1)
                v = c[own] + code * b.column("scale").to_numpy()[:, None]
                keys, before = pa.concat_arrays([pool, b.column("key")]), len(pool)
                order = V.places(keys)
                for lo in range(0, len(q), QUERIES):
                    s = np.full((min(QUERIES, len(q) - lo), len(v)), -np.inf)
                    for j in np.unique(own).tolist():
                        rows = asked[j][(asked[j] >= lo) & (asked[j] < lo + QUERIES)]
                        at = np.flatnonzero(own == j)
                        s[np.ix_(rows - lo, at)] = q[rows] @ v[at].T
                    for i, row in enumerate(s, lo):
                        scores, place = held[i]
                        # equal scores go on, as their keys decide
                        more = np.flatnonzero(row >= scores.min() if len(scores) == keep else row > -np.inf)
                        if len(more):
                            scores, place = np.append(scores, row[more]), np.append(place, more + before)
                            best = V.best_of(scores, order[place], keep)
                            held[i] = scores[best], place[best]
                used = np.unique(np.concatenate([p for _, p in held]))
                pool, lists = keys.take(pa.array(used)), np.append(lists, own)[used]
                held = [(s, np.searchsorted(used, p)) for s, p in held]
            for lo in range(0, len(q), QUERIES):
                some = held[lo : lo + QUERIES]
                place = np.concatenate([p for _, p in some])
                of = np.repeat(np.arange(lo, lo + len(some)), [len(p) for _, p in some])
                yield pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), pool.take(pa.array(place)), pa.array(lists[place], pa.int32()), pa.array(np.concatenate([s for s, _ in some]))], names=schema.names)

        codes = stored.where(F.col("list").isin(list(asked))).select("key", "list", "code", "scale")
        cand = V.ranked(codes.mapInArrow(by_code, schema), keep, "key", "_q").select("_q", "key", "list").distinct()
        cand = F.broadcast(cand) if len(ids) * k * refine <= BROADCAST else cand
        pairs = stored.where(F.col("list").isin(list(asked))).select("key", "list", "vector").join(cand, ["list", "key"]).select("_q", "key", "vector")
        scored = T.StructType([T.StructField(by, kind), stored.schema["key"], T.StructField("score", T.DoubleType())])
        named, arrow = self.spark.sparkContext.broadcast(ids), to_arrow_type(kind)

        def exactly(batches):
            q = shared.value[1]
            for b in batches:
                if b.num_rows:
                    of = b.column("_q").to_numpy()
                    v = b.column("vector").flatten().to_numpy().reshape(b.num_rows, -1)
                    yield pa.RecordBatch.from_arrays([pa.array([named.value[i] for i in of.tolist()], arrow), b.column("key"), pa.array(np.round((v * q[of]).sum(1), 6))], names=scored.names)

        return V.ranked(pairs.mapInArrow(exactly, scored), k, "key", by)


def recall(found: DataFrame, exact: DataFrame, key: str = "vec_id", by: str = "query_id") -> DataFrame:
    """n, recall: the share of the exact results that were found; a result as good as the last exact one counts as it."""
    least = exact.groupBy(by).agg(F.min("score").alias("least"), F.count("*").alias("n"))
    good = found.join(least, by).where(F.col("score") >= F.col("least")).groupBy(by).agg(F.count("*").alias("got"))
    share = F.least(F.coalesce("got", F.lit(0)) / F.col("n"), F.lit(1.0))
    return least.join(good, by, "left").agg(F.count("*").alias("n"), F.avg(share).alias("recall"))
