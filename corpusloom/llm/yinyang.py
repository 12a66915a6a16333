"""Centroid clustering by Yinyang k-means over whole-number vectors, with exact distances.

Centroids are put into groups once.  Every vector keeps an upper bound of the distance to its own centroid and one
lower bound a group for all other centroids; after each round both move by how far centroids moved.  A vector whose
bounds say that no centroid can have come nearer is left alone (global filter); else only groups, and in them only
centroids, whose bound allows it are measured (group filter, exact scan).  Bounds are kept a little loose, so that
rounding never hides a nearer centroid or a tie; what is measured is exact.

A round is one pass over the vectors, in parallel and without a shuffle: centroids go to all tasks (``k`` times ``dim``
numbers, both parameters), each round's state is a Parquet table in the session's shared folder, which replaces the
round before it, and new centroids come from the sums of the vectors that moved, added up task by task.

Defined cases: a vector that is null, has another number of components than ``dim``, or has a null or non-finite one is
left out.  Components are held to +-2^27, so that no distance leaves a long; an inertia beyond a long is the largest
long.  With fewer than ``k`` vectors there are as many centroids as vectors.  Rows that share an id are separate
vectors; ids that tie for a seed are ordered by their components.  A vector with a null id is clustered as any other
and is a seed only after all with an id.  An empty table gives no rows.  Other columns, whatever their names, are not
read; the results have fixed names.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import reach, remove_folder, shared_folder

LIMIT = 1 << 27
#: Rows are worked on in blocks of about this many numbers.
BLOCK = 1 << 21
_LOOSE = 1e-12


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows of x by rows of c) of whole numbers held in int64."""
    if not len(x) or not len(c):
        return np.zeros((len(x), len(c)), np.int64)
    most = int(max(np.abs(x).max(), np.abs(c).max()))
    if 4 * x.shape[1] * most * most < 1 << 53:  # floats hold every sum exactly
        f, g = x.astype(np.float64), c.astype(np.float64)
        return ((f * f).sum(1)[:, None] - 2 * (f @ g.T) + (g * g).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)


def _own(x: np.ndarray, c: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row to its own centroid."""
    d = x - c[a]
    return (d * d).sum(1)


def grouped(c: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each centroid, by a few k-means rounds over the centroids from the first ones on."""
    means = c[:groups].astype(np.float64)
    of = np.zeros(len(c), np.int64)
    for _ in range(rounds):
        of = ((c[:, None, :] - means[None]) ** 2).sum(2).argmin(1)
        for g in range(len(means)):
            if (of == g).any():
                means[g] = c[of == g].mean(0)
    return of


def first_assignment(x: np.ndarray, c: np.ndarray, of: np.ndarray, groups: int) -> tuple[np.ndarray, ...]:
    """(cluster, upper bound, lower bounds, distances measured) by measuring all centroids."""
    d = squared(x, c)
    a = d.argmin(1)
    low = np.sqrt(d.astype(np.float64))
    upper = low[np.arange(len(x)), a]
    low[np.arange(len(x)), a] = np.inf
    lower = np.stack([low[:, of == g].min(1, initial=np.inf) for g in range(groups)], axis=1)
    return a, upper * (1 + _LOOSE), lower * (1 - _LOOSE), np.full(len(x), len(c))


def reassignment(x: np.ndarray, c: np.ndarray, of: np.ndarray, moved: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same from the state of the round before; ``moved`` is how far each centroid went since."""
    groups = lower.shape[1]
    far = np.array([moved[of == g].max(initial=0.0) for g in range(groups)])
    before, a = lower, a.copy()
    upper, lower = (upper + moved[a]) * (1 + _LOOSE), (lower - far) * (1 - _LOOSE) - _LOOSE
    scans = np.zeros(len(x), np.int64)
    open_ = np.flatnonzero(lower.min(1) <= upper)
    best = _own(x[open_], c, a[open_])
    scans[open_] += 1
    upper[open_] = np.sqrt(best.astype(np.float64)) * (1 + _LOOSE)
    still = lower[open_].min(1) <= upper[open_]
    open_, best = open_[still], best[still]
    old, own = a[open_].copy(), np.sqrt(best.astype(np.float64))
    win, seen = old.copy(), []
    for g in range(groups):
        members = np.flatnonzero(of == g)
        near = np.flatnonzero(lower[open_, g] <= upper[open_])
        rows = open_[near]
        bound = np.empty((len(rows), len(members)))
        for m, j in enumerate(members):
            bound[:, m] = (before[rows, g] - moved[j]) * (1 - _LOOSE) - _LOOSE
            mine = old[near] == j
            bound[mine, m] = own[near[mine]]
            todo = np.flatnonzero(~mine & (bound[:, m] <= upper[rows]))
            d = squared(x[rows[todo]], c[j : j + 1])[:, 0]
            scans[rows[todo]] += 1
            bound[todo, m] = np.sqrt(d.astype(np.float64))
            at = near[todo]
            better = (d < best[at]) | ((d == best[at]) & (j < win[at]))
            best[at[better]], win[at[better]] = d[better], j
            upper[rows[todo[better]]] = np.sqrt(d[better].astype(np.float64)) * (1 + _LOOSE)
        seen.append((near, members, bound))
    # the winner leaves its group's bound, the centroid that lost joins that of its own
    a[open_] = win
    for g, (near, members, bound) in enumerate(seen):
        bound[members[None, :] == win[near][:, None]] = np.inf
        lower[open_[near], g] = bound.min(1, initial=np.inf) * (1 - _LOOSE)
    lost = np.flatnonzero(win != old)
    lower[open_[lost], of[old[lost]]] = np.minimum(lower[open_[lost], of[old[lost]]], own[lost] * (1 - _LOOSE))
    return a, upper, lower, scans


def _matrix(column: pa.Array, kind) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


def _rows(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel(), kind))


def prepared(vectors: DataFrame, key: str, vector: str, dim: int, scale: float) -> DataFrame:
    """``key`` and x, the whole-number components of each vector that counts."""
    v = F.col(vector)
    good = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(v.isNotNull() & good).select(F.col(key).alias("key"), v.cast("array<double>").alias("x"))
    schema = T.StructType([rows.schema["key"], T.StructField("x", T.ArrayType(T.IntegerType()))])

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = np.clip(np.floor(_matrix(b.column("x"), np.float64) * scale), -LIMIT, LIMIT).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("key"), _rows(x, pa.int32())], names=schema.names)

    return rows.mapInArrow(run, schema)


def _pass(state: DataFrame, c: np.ndarray, of: np.ndarray, groups: int, moved: np.ndarray | None) -> DataFrame:
    """key, x, before, cluster, upper, lower, scans."""
    double, whole = T.DoubleType(), T.IntegerType()
    schema = T.StructType([state.schema["key"], state.schema["x"], T.StructField("before", whole), T.StructField("cluster", whole), T.StructField("upper", double), T.StructField("lower", T.ArrayType(double)), T.StructField("scans", whole)])
    shared = state.sparkSession.sparkContext.broadcast((c, of, moved))
    step = max(1, BLOCK // max(c.shape[1], len(c)))

    def run(batches):
        c, of, moved = shared.value
        for whole_batch in batches:
            for lo in range(0, whole_batch.num_rows, step):
                b = whole_batch.slice(lo, step)
                x = _matrix(b.column("x"), np.int64)
                if moved is None:
                    before = np.full(len(x), -1)
                    a, upper, lower, scans = first_assignment(x, c, of, groups)
                else:
                    before = b.column("cluster").to_numpy().astype(np.int64)
                    a, upper, lower, scans = reassignment(x, c, of, moved, before, b.column("upper").to_numpy(), _matrix(b.column("lower"), np.float64))
                yield pa.RecordBatch.from_arrays(
                    [b.column("key"), b.column("x"), pa.array(before, pa.int32()), pa.array(a, pa.int32()), pa.array(upper), _rows(lower, pa.float64()), pa.array(scans, pa.int32())], names=schema.names
                )

    cols = ["key", "x"] if moved is None else ["key", "x", "cluster", "upper", "lower"]
    return state.select(*cols).mapInArrow(run, schema)


_SUMS = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("s", T.ArrayType(T.LongType()))])


def _changes(state: DataFrame, dim: int) -> list[tuple[int, int, int, int]]:
    """(cluster, component, sum, count) of what joined less what left each cluster: ``k`` times ``dim`` rows at most."""

    def run(batches):
        sums: dict[int, list] = {}
        for b in batches:
            x = _matrix(b.column("x"), np.int64)
            for name, sign in (("cluster", 1), ("before", -1)):
                own = b.column(name).to_numpy()
                for j in np.unique(own[own >= 0]).tolist():
                    hit = own == j
                    s = sums.setdefault(j, [0, np.zeros(dim, np.int64)])
                    s[0] += sign * int(hit.sum())
                    s[1] += sign * x[hit].sum(0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s[0] for s in sums.values()], pa.int64()), _rows(np.stack([s[1] for s in sums.values()]), pa.int64())], names=_SUMS.names)

    parts = state.where("before <> cluster").select("x", "before", "cluster").mapInArrow(run, _SUMS)
    total = parts.select("cluster", "n", F.posexplode("s").alias("i", "v")).groupBy("cluster", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    return [tuple(r) for r in total.collect()]


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dim: int = 64, k: int = 16, rounds: int = 3, groups: int | None = None, scale: float = 64, seed: str = "1:") -> tuple[DataFrame, np.ndarray]:
    """(``key``, cluster, distance, scans of every vector that counts; the final centroids).

    Centroids start as the ``k`` vectors whose ids, led by ``seed``, have the smallest SHA-256; every round assigns each
    vector to its nearest centroid (smaller number on ties) and replaces each centroid that has vectors by the floor of
    their mean; then vectors are assigned once more.  ``scans`` counts the distances that the last round measured.
    ``groups`` is a quarter of ``k`` if not given.
    """
    spark = vectors.sparkSession
    reach(spark)
    base = f"{shared_folder(spark)}/yinyang-{uuid.uuid4().hex}"
    prepared(vectors, key, vector, dim, scale).write.parquet(f"{base}/x")
    state = spark.read.parquet(f"{base}/x")
    name = F.sha2(F.concat(F.lit(seed), F.col("key").cast("string")), 256)
    seeds = state.select("x", name.alias("h")).orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()
    c = np.array([r.x for r in seeds], np.int64).reshape(-1, dim)
    if not len(c):
        return state.select(F.col("key").alias(key), F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).alias("scans")), c
    groups = min(len(c), groups or max(1, k // 4))
    of, moved, kept = grouped(c, groups), None, f"{base}/x"
    sums, counts = [[0] * dim for _ in c], [0] * len(c)
    for r in range(rounds):
        _pass(state, c, of, groups, moved).write.parquet(f"{base}/{r}")
        state = spark.read.parquet(f"{base}/{r}")
        remove_folder(spark, kept)
        kept = f"{base}/{r}"
        for j, i, v, n in _changes(state, dim):
            sums[j][i] += v
            if i == 0:
                counts[j] += n
        new = np.array([[s // n for s in own] if n else old.tolist() for own, n, old in zip(sums, counts, c, strict=True)], np.int64)
        moved = np.sqrt(_own(new, c, np.arange(len(c))).astype(np.float64)) * (1 + _LOOSE)
        c = new
    last = _pass(state, c, of, groups, moved)
    final = c

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, step):
                p = b.slice(lo, step)
                d = _own(_matrix(p.column("x"), np.int64), final, p.column("cluster").to_numpy().astype(np.int64))
                yield pa.RecordBatch.from_arrays([p.column("key"), p.column("cluster"), pa.array(d), p.column("scans")], names=schema.names)

    step = max(1, BLOCK // dim)
    schema = T.StructType([T.StructField(key, state.schema["key"].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType()), T.StructField("scans", T.IntegerType())])
    last.select("key", "x", "cluster", "scans").mapInArrow(run, schema).write.parquet(f"{base}/out")
    remove_folder(spark, kept)
    return spark.read.parquet(f"{base}/out"), c


def with_inertia(assigned: DataFrame, c: np.ndarray) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia and centroid_sha256: one row a cluster, sent to all tasks."""
    spark = assigned.sparkSession
    most = (1 << 63) - 1
    own = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    total = min(sum(own.values()), most)
    rows = [(j, min(own.get(j, 0), most), total, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for j, x in enumerate(c.tolist())]
    info = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(info), "cluster")


def op11_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    assigned, c = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return with_inertia(assigned, c).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
