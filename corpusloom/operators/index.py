"""The stored BM25 index: postings in blocks, document frequencies and statistics, one partition a collection.

Building tokenises every document once and shuffles lists of postings, many terms to a row, by buckets of terms; a
bucket's task sorts them into blocks of at most ``BLOCK`` documents, each with its largest count and shortest length.
Lists that are long within a piece of the documents are dealt over all buckets, so no task ever holds all postings of a
frequent term.  Files are sorted by term, so a reader skips the pages that a question's terms don't lie in.

Asking reads no document: the blocks of the questions' terms, once for all questions, are dealt by document; each
share of the documents adds up its own scores and gives on the best ``k`` of each question.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import config
from ..functions.text import tokens
from ..sources.storage import drop_folder
from . import vectors as V

BLOCK = 512
#: Documents, and about as many words, that are counted together; more of them make longer lists of postings.
PIECE, WORDS = 4096, 1 << 18
#: Bytes of text that share a bucket of terms; buckets at least and at most.
BUCKET, LEAST, MOST = 1 << 22, 16, 1 << 14
#: A question's terms that are sent to all tasks, at about 100 bytes each; more of them are asked in parts.
BROADCAST = 1 << 18
#: Postings of the questions' terms that are added up together.
SHARE = 1 << 19

_TYPES = {"stats": "n_docs long, mean_len double, floor double, n_terms long, repo_id string", "terms": "term string, df long, repo_id string"}


def _posting() -> Column:
    """A block's postings: lists of numbers side by side are a third of the size of a list of structs."""
    return F.arrays_zip(F.col("keys").alias("key"), F.col("tfs").alias("tf"), F.col("lens").alias("len"))


def _impact(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (config.BM25_K1 + 1) / (tf + config.BM25_K1 * (1 - config.BM25_B + config.BM25_B * length / mean))


def _packed(own: DataFrame, buckets: int, most: int) -> DataFrame:
    """Of each piece of the documents (repo_id, key, text in lower case): one row a bucket of terms, with their lists of postings side by side.

    Documents' words are counted where they are read.  ``terms`` are joined by blanks, which no term holds, and ``sizes``
    has the length of each one's list.  A term lies in the bucket of its CRC-32; lists of ``most`` postings or more are
    dealt over all buckets, piece by piece.  A piece is up to ``PIECE`` documents of about ``WORDS`` words; a longer
    document is a piece of its own.
    """
    whole, key = T.ArrayType(T.IntegerType()), own.schema["key"].dataType
    schema = T.StructType([
        T.StructField("repo_id", T.StringType()), T.StructField("bucket", T.IntegerType()), T.StructField("terms", T.StringType()), T.StructField("sizes", whole),
        T.StructField("keys", T.ArrayType(key)), T.StructField("tfs", whole), T.StructField("lens", whole),
    ])
    fields, at_most, at_once = to_arrow_schema(schema), PIECE, WORDS

    def piece(repos: pa.Array, keys: pa.Array, words: list[list[str]]) -> pa.RecordBatch:
        repos = repos.dictionary_encode()
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat = pa.array(chain.from_iterable(words), pa.string()).dictionary_encode()
        v, of = max(1, len(flat.dictionary)), repos.indices.to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(size)), size)
        pairs, tf = np.unique((of[row] * v + flat.indices.to_numpy().astype(np.int64)) * len(size) + row, return_counts=True)
        group, row = pairs // len(size), pairs % len(size)
        head = np.flatnonzero(np.diff(group, prepend=-1))
        n = np.diff(np.append(head, len(group)))
        names = flat.dictionary.to_pylist()
        mark = int.from_bytes(hashlib.md5(str(keys[0].as_py()).encode()).digest()[:4], "big")
        home = np.fromiter((crc32(w.encode()) for w in names), np.int64, len(names))[group[head] % v]
        bucket = (home + np.where(n >= most, mark, 0)) % buckets
        # lists by collection and bucket, and their postings in the same order
        order = np.lexsort((bucket, group[head] // v))
        n, bucket, repo, term = n[order], bucket[order], (group[head] // v)[order], (group[head] % v)[order].tolist()
        place = _spread(head[order], n)
        cut = np.flatnonzero(np.diff(repo * buckets + bucket, prepend=-1))
        ends = np.append(cut, len(n))
        upto = np.append(0, np.cumsum(n))[ends].astype(np.int32)
        row = row[place]
        columns = [
            repos.dictionary.take(pa.array(repo[cut])), pa.array(bucket[cut]), pa.array([" ".join([names[i] for i in term[lo:hi]]) for lo, hi in zip(ends, ends[1:])], pa.string()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(n.astype(np.int32))),
            *(pa.ListArray.from_arrays(pa.array(upto), x) for x in (keys.take(pa.array(row)), pa.array(tf[place].astype(np.int32)), pa.array(size[row].astype(np.int32)))),
        ]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    def run(batches):
        for b in batches:
            repos, keys, texts = (b.column(c) for c in ("repo_id", "key", "text"))
            words, held, lo = [], 0, 0
            for hi in range(b.num_rows):
                own = (texts[hi].as_py() or "").split()
                if words and (held + len(own) > at_once or len(words) == at_most):
                    yield piece(repos.slice(lo, hi - lo), keys.slice(lo, hi - lo), words)
                    words, held, lo = [], 0, hi
                words.append(own)
                held += len(own)
            if words:
                yield piece(repos.slice(lo), keys.slice(lo), words)

    return own.mapInArrow(run, schema)


def _hashed(keys: pa.Array) -> np.ndarray:
    """A number of 31 bits for each key."""
    if pa.types.is_integer(keys.type):
        return (keys.to_numpy().astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
    keys = keys.dictionary_encode()
    return np.fromiter((crc32(str(x).encode()) >> 1 for x in keys.dictionary.to_pylist()), np.int64, len(keys.dictionary))[keys.indices.to_numpy()]


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places ``start[i]``, ``start[i]`` + 1, ... ``n[i]`` of them for each i, one after the other."""
    return np.repeat(start - np.append(0, np.cumsum(n)[:-1])[: len(n)], n) + np.arange(n.sum())


def _merged(packed: DataFrame, block: int, buckets: int) -> DataFrame:
    """The blocks of each bucket's terms, in the order of the terms; a term's postings with the largest impact come first, so its blocks differ in what they can score."""
    whole = T.ArrayType(T.IntegerType())
    schema = T.StructType([
        T.StructField("repo_id", T.StringType()), T.StructField("term", T.StringType()), T.StructField("block_no", T.LongType()), T.StructField("keys", packed.schema["keys"].dataType), T.StructField("tfs", whole), T.StructField("lens", whole),
        *(T.StructField(c, T.LongType()) for c in ("max_tf", "min_len", "n", "words")),
    ])
    fields = to_arrow_schema(schema)

    def run(group, table):
        repo, bucket = (x.as_py() for x in group)
        flat = lambda c: table[c].combine_chunks().flatten()
        names = pa.array(chain.from_iterable(t.split(" ") for t in table["terms"].to_pylist()), pa.string()).dictionary_encode()
        n = flat("sizes").to_numpy().astype(np.int64)
        tf, size = flat("tfs").to_numpy(), flat("lens").to_numpy()
        order = pc.sort_indices(names.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        term = np.repeat(rank[names.indices.to_numpy()], n)
        # by any mean length: the order of a term's postings is free
        place = np.lexsort((-tf / (tf + config.BM25_K1 * (1 - config.BM25_B + config.BM25_B * size / size.mean())), term))
        term, tf, size = term[place], tf[place], size[place]
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        nth = np.arange(len(term)) - np.repeat(starts, np.diff(np.append(starts, len(term))))
        head = np.flatnonzero(nth % block == 0)
        ends = pa.array(np.append(head, len(term)).astype(np.int32))
        columns = [
            pa.array([repo] * len(head), pa.string()), names.dictionary.take(pa.array(order[term[head]])), pa.array(bucket + buckets * (nth[head] // block)),
            *(pa.ListArray.from_arrays(ends, x) for x in (flat("keys").take(pa.array(place)), pa.array(tf), pa.array(size))),
            pa.array(np.maximum.reduceat(tf, head)), pa.array(np.minimum.reduceat(size, head)), pa.array(np.diff(np.append(head, len(term)))), pa.array(np.add.reduceat(tf.astype(np.int64), head)),
        ]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    return packed.groupBy("repo_id", "bucket").applyInArrow(run, schema)


class Bm25Index:
    """The index below ``root``: tables ``postings``, ``terms`` and ``stats``, each partitioned by repo_id."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self, name: str) -> DataFrame:
        read = self.spark.read
        return (read.schema(_TYPES[name]) if name in _TYPES else read).parquet(f"{self.root}/{name}").withColumn("repo_id", F.col("repo_id").cast("string"))

    def _put(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("repo_id").parquet(f"{self.root}/{name}")

    def add(self, docs: DataFrame, key: str = "doc_id", text: str = "text", repo: str = "repo_id", block: int = BLOCK) -> None:
        """Indexes ``docs``, whole collections each, in place of what their collections had; other collections stay.

        A null text has no terms and counts as a document; a document without a key or a collection is left out.  The
        statistics, which make a collection visible, are written last.
        """
        build, staged = uuid.uuid4().hex, f"{self.root}/staging-{uuid.uuid4().hex}"
        rows = docs.where(F.col(key).isNotNull() & F.col(repo).isNotNull()).select(F.col(repo).cast("string").alias("repo_id"), F.col(key).alias("key"), F.col(text).alias("text"))
        own = rows.withColumn("text", F.lower("text"))
        # a collection's documents; the bytes of their texts tell into how many buckets the terms go
        sizes = rows.groupBy("repo_id").agg(F.count("*").alias("n_docs"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("bytes"))
        sizes.write.parquet(f"{staged}/sizes")
        sizes = self.spark.read.schema(sizes.schema).parquet(f"{staged}/sizes")
        size = sizes.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
        buckets = min(MOST, max(LEAST, 1 << (size // BUCKET).bit_length()))
        blocks = _merged(_packed(own, buckets, max(1, block // 2)), block, buckets)
        self._put(blocks.withColumn("build", F.lit(build)).sortWithinPartitions("repo_id", "term", "block_no"), "postings")
        # a collection that has lost all its words keeps its old blocks, which no question sees
        posted = self.spark.read.schema("term string, n long, words long, build string, repo_id string").parquet(f"{self.root}/postings").where(F.col("build") == build)
        # dealt by ranges, so that grouping needs no other shuffle and files are sorted by term
        terms = posted.select("repo_id", "term", "n").repartitionByRange("repo_id", "term").groupBy("repo_id", "term").agg(F.sum("n").alias("df"))
        self._put(terms.sortWithinPartitions("repo_id", "term"), "terms")
        sizes = sizes.join(posted.groupBy("repo_id").agg(F.sum("words").alias("words")), "repo_id", "left").select("repo_id", "n_docs", F.coalesce("words", F.lit(0)).alias("words"))
        raw = F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        floors = self._table("terms").join(F.broadcast(sizes.where("words > 0").select("repo_id", "n_docs")), "repo_id").groupBy("repo_id").agg((config.BM25_EPSILON * F.avg(raw)).alias("floor"), F.count("*").alias("n_terms"))
        self._put(sizes.join(floors, "repo_id", "left").select("repo_id", "n_docs", (F.col("words") / F.col("n_docs")).alias("mean_len"), "floor", F.coalesce("n_terms", F.lit(0)).cast("long").alias("n_terms")).coalesce(1), "stats")
        drop_folder(self.spark, staged)

    def drop(self, repo: str) -> None:
        """Takes a collection out: the statistics first, so that no question sees a half of it."""
        for name in ("stats", "terms", "postings"):
            drop_folder(self.spark, f"{self.root}/{name}/repo_id={repo}")

    def stats(self) -> DataFrame:
        return self._table("stats")

    def postings(self, repo: str, terms: DataFrame | None = None) -> DataFrame:
        """term, key, tf, len of a collection, of all terms or of a stated set of them (``term``); none of one that isn't there."""
        if not self.stats().where((F.col("repo_id") == repo) & (F.col("n_terms") > 0)).count():
            return self.spark.createDataFrame([], "term string, key string, tf long, len long")
        rows = self._table("postings").where(F.col("repo_id") == repo)
        rows = rows if terms is None else rows.join(F.broadcast(terms), "term", "left_semi")
        return rows.select("term", F.explode(_posting()).alias("d")).select("term", "d.key", F.col("d.tf").cast("long").alias("tf"), F.col("d.len").cast("long").alias("len"))

    def weights(self, repo: str) -> DataFrame:
        """term, df, idf; negative weights give way to a quarter of the mean."""
        s = self.stats().where(F.col("repo_id") == repo)
        raw = F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        return self._table("terms").where(F.col("repo_id") == repo).join(F.broadcast(s.select("repo_id", "n_docs", "floor")), "repo_id").select("term", "df", F.when(raw < 0, F.col("floor")).otherwise(raw).alias("idf"))

    def top_k(self, questions: DataFrame, repo: str, k: int = config.SPARSE_K, by: str = "item_id", key: str = "doc_id", question: str = "question", skip: bool = True) -> DataFrame:
        """``by``, ``key``, score, rank of the best documents of each question; scores of 0 or less are cut.

        ``questions`` are a stated set, whose terms go to all tasks in parts of about ``BROADCAST``.  Without ``skip``
        every posting is a row that is joined and grouped; the results are the same.
        """
        s = self.stats().where(F.col("repo_id") == repo).first()
        asked = questions.select(by, F.explode(tokens(F.col(question))).alias("term")).groupBy(by, "term").agg(F.count("*").alias("c"))
        size = asked.count()
        if s is None or not s.n_terms or not size:
            none = questions.select(by).limit(0)
            kind = self._key_type() if s is not None and s.n_terms else "string"
            return none.select(by, F.lit(None).cast(kind).alias(key), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("rank"))
        parts = -(-size // BROADCAST)
        ask = self._dealt if skip else self._plain
        # a question's terms stay together
        answers = [ask(asked if parts == 1 else asked.where(F.pmod(F.xxhash64(by), F.lit(parts)) == p), repo, s, k, by) for p in range(parts)]
        return reduce(DataFrame.unionByName, answers).withColumnRenamed("key", key)

    def _key_type(self):
        return self._table("postings").schema["keys"].dataType.elementType

    def _weighted(self, asked: DataFrame, repo: str, by: str) -> DataFrame:
        """by, term, w: the count in the question times the weight, of terms that the collection has."""
        words = [r.term for r in asked.select("term").distinct().limit(11).collect()]
        terms = self.weights(repo)
        terms = terms.where(F.col("term").isin(words)) if len(words) <= 10 else terms
        return asked.join(terms, "term").select(by, "term", (F.col("c") * F.col("idf")).alias("w"), "df")

    def _blocks(self, weighted: DataFrame, repo: str) -> DataFrame:
        """The blocks of the questions' terms, with the question and the weight; few terms are pushed to the files."""
        words = [r.term for r in weighted.select("term").distinct().limit(11).collect()]
        rows = self._table("postings").where(F.col("repo_id") == repo)
        rows = rows.where(F.col("term").isin(words)) if len(words) <= 10 else rows
        return rows.join(F.broadcast(weighted.drop("df")), "term")

    def _scored(self, blocks: DataFrame, s, by: str) -> DataFrame:
        rows = blocks.select(by, "w", F.explode(_posting()).alias("d"))
        return rows.select(by, F.col("d.key").alias("key"), (F.col("w") * _impact(F.col("d.tf"), F.col("d.len"), F.lit(s.mean_len))).alias("part"))

    def _best(self, parts: DataFrame, k: int, by: str) -> DataFrame:
        scored = parts.groupBy(by, "key").agg(F.round(F.sum("part"), 6).alias("score")).where("score > 0")
        rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "key"))
        return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)

    def _plain(self, asked: DataFrame, repo: str, s, k: int, by: str) -> DataFrame:
        return self._best(self._scored(self._blocks(self._weighted(asked, repo, by), repo), s, by), k, by)

    def _dealt(self, asked: DataFrame, repo: str, s, k: int, by: str) -> DataFrame:
        weighted = self._weighted(asked, repo, by).toArrow()
        of, terms = (weighted[c].combine_chunks().dictionary_encode() for c in (by, "term"))
        # each question's terms, by number, and their weights
        at, tid, w = of.indices.to_numpy(), terms.indices.to_numpy(), weighted["w"].to_numpy()
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(len(of.dictionary) + 1))
        shared = self.spark.sparkContext.broadcast((of.dictionary, [(tid[order[lo:hi]], w[order[lo:hi]]) for lo, hi in zip(ends, ends[1:])]))
        df = np.zeros(len(terms.dictionary), np.int64)
        df[tid] = weighted["df"].to_numpy()
        parts = int(min(1 << 14, 1 + df.sum() // SHARE))
        names = terms.dictionary.to_pylist()
        rows = self._table("postings").where(F.col("repo_id") == repo)
        rows = rows.where(F.col("term").isin(names)) if len(names) <= 10 else rows
        numbers = self.spark.createDataFrame(list(enumerate(names)), "tid int, term string")
        blocks = rows.join(F.broadcast(numbers), "term").select("tid", "keys", "tfs", "lens")
        key, whole = self._key_type(), T.ArrayType(T.IntegerType())
        dealt = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("tids", whole), T.StructField("keys", T.ArrayType(key)), T.StructField("tfs", whole), T.StructField("lens", whole)])
        scored = T.StructType([asked.schema[by], T.StructField("key", key), T.StructField("score", T.DoubleType())])
        dealt_fields, scored_fields, mean = to_arrow_schema(dealt), to_arrow_schema(scored), s.mean_len

        def deal(batches):
            """Each batch's postings by the hash of the document, with the number of the term."""
            for whole_batch in batches:
                for lo in range(0, whole_batch.num_rows, 1024):
                    b = whole_batch.slice(lo, 1024)
                    tids = np.repeat(b.column("tid").to_numpy(), b.column("tfs").value_lengths().to_numpy())
                    keys, tfs, lens = (b.column(c).flatten() for c in ("keys", "tfs", "lens"))
                    to = _hashed(keys) % parts
                    order = np.argsort(to, kind="stable")
                    cut = np.flatnonzero(np.diff(to[order], prepend=-1))
                    ends, place = pa.array(np.append(cut, len(order)).astype(np.int32)), pa.array(order)
                    lists = [pa.ListArray.from_arrays(ends, x.take(place)) for x in (pa.array(tids), keys, tfs, lens)]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([pa.array(to[order][cut]), *lists], dealt_fields, strict=True)], schema=dealt_fields)

        def best(table):
            ids, questions = shared.value
            tids, keys, tf, size = (table[c].combine_chunks().flatten() for c in ("tids", "keys", "tfs", "lens"))
            keys = keys.dictionary_encode()
            tids, tf, names = tids.to_numpy(), tf.to_numpy(), keys.dictionary
            order = np.argsort(tids, kind="stable")
            ends = np.searchsorted(tids[order], np.arange(tids.max() + 2))
            doc = keys.indices.to_numpy()[order]
            impact = (tf * (config.BM25_K1 + 1) / (tf + config.BM25_K1 * (1 - config.BM25_B + config.BM25_B * size.to_numpy() / mean)))[order]
            place, found, scores = V.places(names), [], []
            for terms, weights in questions:
                own = [(slice(ends[j], ends[j + 1]), w) for j, w in zip(terms.tolist(), weights.tolist()) if j + 1 < len(ends)]
                if not own:
                    found.append(np.zeros(0, np.int64))
                    continue
                score = np.bincount(np.concatenate([doc[x] for x, _ in own]), np.concatenate([w * impact[x] for x, w in own]), len(names))
                score = np.floor(score * 1e6 + 0.5) / 1e6
                some = np.flatnonzero(score > 0)
                some = some[V.best_of(score[some], place[some], k)]
                found.append(some)
                scores.append(score[some])
            asked_at = np.repeat(np.arange(len(questions)), list(map(len, found)))
            columns = [ids.take(pa.array(asked_at)), names.take(pa.array(np.concatenate(found).astype(np.int64))), pa.array(np.concatenate([*scores, np.zeros(0)]))]
            return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, scored_fields, strict=True)], schema=scored_fields)

        return V.ranked(blocks.mapInArrow(deal, dealt).groupBy("part").applyInArrow(best, scored), k, "key", by)
